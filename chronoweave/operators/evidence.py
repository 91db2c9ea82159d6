"""Observations, audits of annotations, and the catalogue of units they speak of."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textops import content_hash, tokens

FINDINGS = "array<struct<kind:string,field:string,claim:string,evidence_ids:array<string>,reason:string>>"
#: Fixed kinds of findings.
KINDS = ("omission", "contradiction", "unsupported_claim")


def _labels(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), t) for c, t in pairs]))


def _blank(x: Column) -> Column:
    return F.coalesce(F.trim(x), F.lit("")) == ""


def observation_errors(facts: Column, uncertainties: Column) -> Column:
    """Faults of an observation: both lists have to be there, hold only texts, and facts have to be some."""
    return _labels(
        (facts.isNull() | uncertainties.isNull(), "observation must contain visible_facts and uncertainties"),
        (F.exists(facts, _blank), "visible_facts must be nonempty strings"), (F.exists(uncertainties, _blank), "uncertainties must be nonempty strings"),
        (F.size(facts) == 0, "visible_facts must not be empty"),
    )


def audit_errors(reviewed: Column, evidence: Column, findings: Column, fields: Column) -> Column:
    """Faults of an audit: every evidence id reviewed exactly once; findings of a known kind, on a field of the
    annotation, with claim and reason, that cite known ids, each once."""
    once = F.array_sort(reviewed) == F.array_sort(evidence)
    refs = lambda f: f["evidence_ids"]
    known = lambda f: (F.size(refs(f)) > 0) & (F.size(F.array_distinct(refs(f))) == F.size(refs(f))) & (F.size(F.array_except(refs(f), evidence)) == 0)
    listed = _labels(
        (F.exists(findings, lambda f: ~F.coalesce(f["kind"].isin(*KINDS), F.lit(False))), "unknown finding kind"),
        (F.exists(findings, lambda f: ~F.coalesce(F.array_contains(fields, f["field"]), F.lit(False))), "unknown annotation field"),
        (F.exists(findings, lambda f: _blank(f["claim"])), "finding claim must be a nonempty string"),
        (F.exists(findings, lambda f: _blank(f["reason"])), "finding reason must be a nonempty string"),
        (F.exists(findings, lambda f: ~F.coalesce(known(f), F.lit(False))), "finding must cite known unique evidence IDs"),
    )
    first = F.when(~F.coalesce(once, F.lit(False)), F.array(F.lit("audit must review every evidence ID exactly once"))).when(findings.isNull(), F.array(F.lit("findings must be an array")))
    return F.coalesce(first, listed)


def audit_status(stored_inputs: Column, inputs: Column, errors: Column, findings: Column) -> Column:
    """unchecked for evidence of other inputs or a faulty audit; else whether something was found."""
    fresh = F.coalesce(stored_inputs == inputs, F.lit(False)) & (F.coalesce(F.size(errors), F.lit(1)) == 0) & findings.isNotNull()
    return F.when(~fresh, "unchecked").when(F.size(findings) > 0, "needs_review").otherwise("no_issue_detected")


def identity(*parts: Column) -> Column:
    """What an audit was made from, as one hash."""
    return content_hash(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def units(shots: DataFrame, windows: DataFrame) -> DataFrame:
    """Whole takes and windows as one table; what one side lacks is null."""
    return shots.unionByName(windows, allowMissingColumns=True)


def orphan_windows(shots: DataFrame, windows: DataFrame) -> DataFrame:
    """Windows whose parent is not there."""
    return windows.join(shots.select(F.col("shot_id").alias("parent_shot_id")), "parent_shot_id", "left_anti")


def catalogue(units_: DataFrame, annotations: DataFrame, never: Sequence[str] = ()) -> DataFrame:
    """Annotated units that can serve as cover: annotated without error and with a subject, not a take whose windows
    stand for it, not from a source of prefix `never`."""
    parents = units_.where("parent_shot_id is not null").select(F.col("parent_shot_id").alias("shot_id")).distinct()
    good = annotations.where(F.col("error").isNull() & (F.coalesce("subject", F.lit("")) != "")).drop("error")
    out = units_.join(parents, "shot_id", "left_anti").join(good, "shot_id")
    for prefix in never:
        out = out.where(~F.col("source_id").startswith(prefix))
    return out


def shot_motion(pairs: DataFrame, keys: Sequence[str], magnitude: str, whole: str, least: float = 1e-3) -> DataFrame:
    """Mean and largest motion of a shot's frame pairs, and the mean part of it that the whole picture makes, over
    pairs that move at all; 0 where none does."""
    share = F.when(F.col(magnitude) > least, F.col(whole) / F.col(magnitude))
    return pairs.groupBy(*keys).agg(
        F.avg(magnitude).alias("energy"), F.max(magnitude).alias("peak"), F.coalesce(F.avg(share), F.lit(0.0)).alias("camera_ratio"), F.count("*").alias("pairs")
    )


def neighbour_words(picks: DataFrame, keys: Sequence[str], order: Sequence[str], text: str, n: int = 6) -> DataFrame:
    """The last n tokens of the text before each pick and the first n of the one after."""
    w = Window.partitionBy(*keys).orderBy(*order)
    t = tokens(F.coalesce(text, F.lit("")))
    said = picks.withColumn("_t", t)
    none = F.array().cast("array<string>")
    before, after = (F.coalesce(f("_t").over(w), none) for f in (F.lag, F.lead))
    ends = said.withColumns({"_p": before, "_n": after})
    last = F.slice("_p", F.greatest(F.lit(1), F.size("_p") - n + 1), F.lit(n))
    return ends.select(*picks.columns, last.alias("before_words"), F.slice("_n", 1, n).alias("after_words"))


def best_sessions(clips: DataFrame, sessions: DataFrame, scores: DataFrame, deal: int = 32) -> DataFrame:
    """For each clip and side the session of the largest r, among those of the clip's day, or all where it has none.

    clips: clip, day. sessions: session, side, day. scores: clip, session, r, lag, margin, as correlation made them.
    There are few sessions and many scores, so the scores of a session are dealt to `deal` parts, each with a copy of its
    row. Scores are then shuffled and sorted once, by clip; what meets the clips, and is sorted again, is the best session
    of each day and side. The best of the clip's day and the best of all stay side by side until it is known which counts.
    """
    parts = sessions.select("session", "side", F.col("day").alias("_day"), F.explode(F.sequence(F.lit(0), F.lit(deal - 1))).alias("_part"))
    dealt = scores.withColumn("_part", F.pmod(F.hash("clip"), F.lit(deal))).join(parts, ["session", "_part"])
    own, order = F.struct("session", "r", "lag", "margin"), F.struct("r", "session")
    daily = dealt.repartition("clip").groupBy("clip", "side", "_day").agg(F.max_by(own, order).alias("b"))
    rows = daily.join(clips, "clip").withColumn("_same", F.col("day").eqNullSafe(F.col("_day")))
    order = F.struct("b.r", "b.session")
    best = rows.groupBy("clip", "side").agg(F.max_by("b", F.when(F.col("_same"), order)).alias("_own"), F.max_by("b", order).alias("_all"), F.bool_or("_same").alias("_same"))
    held = best.withColumn("_has", F.bool_or("_same").over(Window.partitionBy("clip"))).where(F.col("_same") | ~F.col("_has"))
    return held.select("clip", "side", F.when(F.col("_same"), F.col("_own")).otherwise(F.col("_all")).alias("b")).select("clip", "side", "b.*")


def stretch_picks(stretches: DataFrame, picks: DataFrame) -> DataFrame:
    """Scorecard stretches with their pick: by its key, or for cards without keys by shared time (0.2 s or more)."""
    keyed = stretches.where("pick is not null")
    p = picks.select(F.col("pick").alias("_pick"), F.col("beat").alias("_beat"), F.col("t0").alias("_t0"), F.col("t1").alias("_t1"))
    over = (F.col("beat") == F.col("_beat")) & (F.least("t1", "_t1") - F.greatest("t0", "_t0") > 0.2)
    by_time = stretches.where("pick is null").join(p, over)
    return keyed.unionByName(by_time.withColumn("pick", F.col("_pick")).select(*stretches.columns))


def words_kept(words: DataFrame, picks: DataFrame, keys: Sequence[str], slack: float = 0.05, middle: bool = False, width: float = 60.0, inside: str | None = None) -> DataFrame:
    """Words of each pick: those inside it, give or take `slack`; with `middle`, those whose middle is (ends included).

    width: of the time buckets, about a pick's length. inside: a column that says whether all of the word is inside.
    """
    w = words.select(*keys, "w", F.col("s").alias("_s"), F.col("e").alias("_e"))
    within = (F.col("_s") >= F.col("in_s") - slack) & (F.col("_e") <= F.col("out_s") + slack)
    centre = ((F.col("_s") + F.col("_e")) / 2).between(F.col("in_s") - slack, F.col("out_s") + slack)
    from .intervals import overlap_join

    # a microsecond more on both sides: words without length meet, also where seconds count from 1970
    wide = picks.withColumns({"_a": F.col("in_s") - slack - 1e-6, "_b": F.col("out_s") + slack + 1e-6})
    met = overlap_join(wide, w.withColumn("_stop", F.greatest("_e", F.col("_s") + 1e-6)), keys, ("_a", "_b"), ("_s", "_stop"), width)
    said = met.where(centre if middle else within)
    return said.select(*picks.columns, "w", F.col("_s").alias("s"), F.col("_e").alias("e"), *([within.alias(inside)] if inside else []))
