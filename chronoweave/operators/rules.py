"""Dated decisions checked against a cut and against what was read back.

Rules of one kind are one join; findings of all kinds are one table: rule, status (honoured, broken, not_testable),
evidence. A rule that nothing can be said about is not_testable, never honoured.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textops import base_clip, whole_word

EDGE = 0.1
#: Pieces of evidence that a finding shows.
SHOWN = 5


def picks_in_scope(rules: DataFrame, picks: DataFrame, beats: DataFrame) -> DataFrame:
    """(rule, pick, ...) of the spoken picks a rule protects: by clip and text, or by its beats' titles and notes; all
    picks of these or the last of each.

    rules: id, kind, scope_clip, scope_text, scope_title, scope_notes, scope_last. picks: pick, beat, clip, text, t0, t1.
    """
    contains = lambda column, part: part.isNull() | F.lower(F.coalesce(column, F.lit(""))).contains(F.lower(part))
    r = rules.select(F.col("id").alias("rule"), *[f"scope_{c}" for c in ("clip", "text", "title", "notes", "last")])
    by_clip = r.where("scope_clip is not null").join(picks, base_clip(F.col("clip")) == F.col("scope_clip")).where(contains(F.col("text"), F.col("scope_text")))
    scoped = r.where("scope_clip is null").join(beats.select("beat", "title", "notes"), contains(F.col("title"), F.col("scope_title")) & contains(F.col("notes"), F.col("scope_notes")))
    by_beat = scoped.join(picks, "beat")
    last = F.row_number().over(Window.partitionBy("rule", "beat").orderBy(F.desc("t0"), F.desc("pick")))
    by_beat = by_beat.withColumn("_r", last).where(~F.coalesce("scope_last", F.lit(False)) | (F.col("_r") == 1))
    return by_clip.select("rule", *picks.columns).unionByName(by_beat.select("rule", *picks.columns))


def rows_over(scoped: DataFrame, rows: DataFrame) -> DataFrame:
    """Picture rows that overlap a pick of their beat by more than a tenth of a second at both edges."""
    r = rows.select(F.col("beat").alias("_beat"), F.col("clip").alias("row_clip"), "type", "dest_in_s", "dest_out_s")
    over = (F.col("beat") == F.col("_beat")) & (F.col("dest_out_s") > F.col("t0") + EDGE) & (F.col("dest_in_s") < F.col("t1") - EDGE)
    return scoped.join(r, over)


def _finding(df: DataFrame, status: Column, evidence: Column) -> DataFrame:
    return df.select("rule", status.alias("status"), evidence.alias("evidence"))


def _verdict(rules: DataFrame, broken: DataFrame, untested: DataFrame | None = None) -> DataFrame:
    """One finding for each rule: broken with its first evidence in order, not_testable, or honoured.

    Evidence is made distinct and cut to SHOWN by rank, within tasks first, before it is gathered.
    """
    place = F.row_number().over(Window.partitionBy("rule").orderBy("evidence"))
    first = broken.select("rule", "evidence").distinct().withColumn("_r", place).where(F.col("_r") <= SHOWN)
    b = first.groupBy("rule").agg(F.array_join(F.array_sort(F.collect_list("evidence")), "; ").alias("_e"))
    out = rules.select(F.col("id").alias("rule")).join(b, "rule", "left")
    if untested is not None:
        out = out.join(untested.select("rule").distinct().withColumn("_u", F.lit(True)), "rule", "left")
    else:
        out = out.withColumn("_u", F.lit(False))
    status = F.when(F.col("_e").isNotNull(), "broken").when(F.coalesce("_u", F.lit(False)), "not_testable").otherwise("honoured")
    return _finding(out, status, F.coalesce("_e", F.lit("")))


def check_cut(rules: DataFrame, picks: DataFrame, beats: DataFrame, rows: DataFrame, heard: DataFrame | None = None) -> DataFrame:
    """Findings of the active rules on a cut. picks have t0 and t1; rows dest_in_s and dest_out_s (null: not placed).

    heard: text of the render's transcript, one row; without it words are judged by the cut's own text.
    rules carry, by kind: terms, clips, clip, span_in, span_out, needs (a term that cover has to name), prefix.
    """
    active = rules.where("why is null") if "why" in rules.columns else rules
    of = lambda *kinds: active.where(F.col("kind").isin(*kinds))
    spoken = heard.select(F.lower("text").alias("said")) if heard is not None else picks.select(F.lower("text").alias("said"))
    found = []

    words = of("words_forbidden").select(F.col("id").alias("rule"), F.explode("terms").alias("term"))
    hits = words.join(spoken, whole_word(F.col("said"), F.col("term"))).select("rule", F.col("term").alias("evidence"))
    found.append(_verdict(of("words_forbidden"), hits))

    history = of("words_allowed_history").select(F.col("id").alias("rule"), F.explode("terms").alias("term"))
    seen = history.join(spoken, F.expr("rlike(said, concat('\\\\b', term, '\\\\b'))")).groupBy("rule").agg(F.count("*").alias("n"))
    found.append(_finding(of("words_allowed_history").select(F.col("id").alias("rule")).join(seen, "rule", "left"), F.lit("honoured"), F.format_string("%d uses", F.coalesce("n", F.lit(0)))))

    spans = of("clip_span_excluded").select(F.col("id").alias("rule"), F.col("clip").alias("_clip"), "span_in", "span_out")
    used = picks.select("clip", "in_s", "out_s").unionByName(rows.where("clip is not null").select("clip", "in_s", "out_s"))
    over = (base_clip(F.col("clip")) == F.col("_clip")) & (F.col("out_s") > F.col("span_in") + EDGE) & (F.col("in_s") < F.col("span_out") - EDGE)
    found.append(_verdict(of("clip_span_excluded"), spans.join(used, over).select("rule", F.format_string("%s %.1f-%.1f", "clip", "in_s", "out_s").alias("evidence"))))

    all_used = used.select(base_clip(F.col("clip")).alias("c")).distinct()
    named = lambda kind: of(kind).select(F.col("id").alias("rule"), F.explode("clips").alias("c"))
    found.append(_verdict(of("must_be_present"), named("must_be_present").join(all_used, "c", "left_anti").select("rule", F.col("c").alias("evidence"))))
    found.append(_verdict(of("clips_excluded"), named("clips_excluded").join(all_used, "c", "left_semi").select("rule", F.col("c").alias("evidence"))))

    covers = ("no_cover", "no_cover_pick", "cover_only_named_detail", "cover_required", "placeholder_required")
    scoped = picks_in_scope(of(*covers), picks, beats)
    unplaced = rows.groupBy("beat").agg(F.bool_or(F.col("dest_in_s").isNotNull()).alias("_placed")).where(~F.col("_placed"))
    untested = scoped.join(unplaced, "beat", "left_semi").select("rule")
    picture = rows_over(scoped, rows.where("dest_in_s is not null"))
    cover = picture.where("type <> 'bare'")
    show = F.concat_ws(" ", "pick", "row_clip")
    for kind in ("no_cover", "no_cover_pick"):
        found.append(_verdict(of(kind), cover.select("rule", show.alias("evidence")), untested))
    detail = cover.join(of("cover_only_named_detail").select(F.col("id").alias("rule"), "clips", "prefix"), "rule")
    foreign = F.coalesce(F.col("row_clip").startswith(F.col("prefix")), F.lit(False)) | ((F.size("clips") > 0) & ~F.array_contains("clips", base_clip(F.col("row_clip"))))
    found.append(_verdict(of("cover_only_named_detail"), detail.where(foreign).select("rule", show.alias("evidence")), untested))
    keys = ["rule", "pick"]
    bare = scoped.join(of("cover_required").select(F.col("id").alias("rule")), "rule", "left_semi").join(cover.select(*keys).distinct(), keys, "left_anti")
    found.append(_verdict(of("cover_required"), bare.select("rule", F.col("pick").alias("evidence")), untested))
    held = picture.where("type = 'placeholder'").select(*keys).distinct()
    without = scoped.join(of("placeholder_required").select(F.col("id").alias("rule")), "rule", "left_semi").join(held, keys, "left_anti")
    found.append(_verdict(of("placeholder_required"), without.select("rule", F.col("pick").alias("evidence")), untested))

    for kind, status in (("open", "open"), ("note", "noted"), ("talking_cover_exempt", "noted"), ("delivery_loudness", "not_testable")):
        found.append(_finding(of(kind).select(F.col("id").alias("rule"), F.coalesce("decision", F.lit("")).alias("_d")), F.lit(status), F.col("_d")))
    return reduce(DataFrame.unionByName, found)


def check_readback(rules: DataFrame, items: DataFrame, protected: DataFrame, frames: int = 2, own: int = 3) -> DataFrame:
    """Findings on what a timeline holds: excluded clips in it, required ones missing, cover over protected picks.

    items: type, track, clip, rec, dur. protected: rule, pick, clip, rec, dur. A pick's own picture, within `own` frames
    of its place, is not cover; an overlap of up to `frames` frames is none.
    """
    active = rules.where("why is null") if "why" in rules.columns else rules
    of = lambda kind: active.where(F.col("kind") == kind)
    there = items.select(base_clip(F.col("clip")).alias("c")).distinct()
    named = lambda kind: of(kind).select(F.col("id").alias("rule"), F.explode("clips").alias("c"))
    excluded = _verdict(of("clips_excluded"), named("clips_excluded").join(there, "c", "left_semi").select("rule", F.col("c").alias("evidence")))
    missing = _verdict(of("must_be_present"), named("must_be_present").join(there, "c", "left_anti").select("rule", F.col("c").alias("evidence")))
    v = items.where("type = 'video'").select(F.col("clip").alias("_clip"), F.col("rec").alias("_rec"), F.col("dur").alias("_dur"))
    over = (F.col("_rec") + F.col("_dur") > F.col("rec") + frames) & (F.col("_rec") < F.col("rec") + F.col("dur") - frames)
    mine = (base_clip(F.col("_clip")) == base_clip(F.col("clip"))) & (F.abs(F.col("_rec") - F.col("rec")) <= own)
    cover = protected.join(v, over & ~mine).select("rule", F.concat_ws(" ", "pick", "_clip").alias("evidence"))
    kept = _verdict(active.where(F.col("kind").isin("no_cover", "no_cover_pick")), cover)
    return excluded.unionByName(missing).unionByName(kept)


def summary(findings: DataFrame) -> DataFrame:
    """Findings by status."""
    return findings.groupBy("status").agg(F.count("*").alias("n")).orderBy("status")


def brief(rules: DataFrame) -> DataFrame:
    """Lines of the current brief: active decisions in order, then what no longer applies and why."""
    text = F.when(F.col("why").isNull(), F.format_string("- [%s] %s (decided %s)", "id", "decision", F.coalesce("decided", F.lit("?")))).otherwise(F.format_string("- [%s] %s (%s)", "id", "decision", "why"))
    return rules.select(F.col("why").isNotNull().cast("int").alias("part"), "ord", text.alias("line")).orderBy("part", "ord")


def exempt_clips(rules: DataFrame) -> DataFrame:
    """Clips that active decisions allow as cover although they talk."""
    return rules.where("why is null and kind = 'talking_cover_exempt'").select(F.explode("clips").alias("clip")).distinct()
