"""Algebra of half-open intervals [t0, t1): joins, unions, differences, splits, clamping and layout.

Every function names its key and bound columns. Rows with a null bound, or with t1 <= t0, hold no time and are
left out unless a function says otherwise. Sequences are ordered by columns that the caller names, in full.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bucket(bound: Column, width) -> Column:
    return F.floor(bound / F.lit(width))


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    a: tuple[str, str],
    b: tuple[str, str],
    width,
    how: str = "inner",
) -> DataFrame:
    """Pairs of rows of equal keys whose intervals a (of left) and b (of right) share time.

    Both sides are dealt to buckets of `width` and joined on keys and bucket, so that a long series of one key is
    spread over many tasks; a pair is made only in the first bucket that both touch. Choose a width of about the
    longer side's usual interval. how="left" also keeps left rows that meet nothing. Column names beside the keys
    must differ. Spark's estimate of a side doesn't know of its buckets, so neither is broadcast.
    """
    a0, a1, b0, b1 = (F.col(c) for c in (*a, *b))
    last = lambda stop, start: F.greatest(F.ceil(stop / F.lit(width)) - 1, _bucket(start, width))
    spread = left.where(a1 > a0).withColumn("_bucket", F.explode(F.sequence(_bucket(a0, width), last(a1, a0))))
    other = right.where(b1 > b0).withColumn("_bucket", F.explode(F.sequence(_bucket(b0, width), last(b1, b0))))
    met = (
        spread.hint("merge").join(other, [*keys, "_bucket"])
        .where((b1 > a0) & (b0 < a1))
        .where(F.col("_bucket") == F.greatest(_bucket(a0, width), _bucket(b0, width)))
        .drop("_bucket")
    )
    if how != "left":
        return met
    seen = met.select(*[F.col(c).alias(f"_{c}") for c in left.columns]).distinct()
    alone = left.join(seen, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in left.columns], "left_anti")
    return met.unionByName(alone, allowMissingColumns=True)


def contains_join(points: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, bounds: tuple[str, str], width) -> DataFrame:
    """Points of equal keys inside [t0, t1) of spans."""
    t0, t1 = F.col(bounds[0]), F.col(bounds[1])
    dealt = points.withColumn("_bucket", _bucket(F.col(at), width))
    spread = spans.where(t1 > t0).withColumn(
        "_bucket", F.explode(F.sequence(_bucket(t0, width), F.greatest(F.ceil(t1 / F.lit(width)) - 1, _bucket(t0, width))))
    )
    return dealt.join(spread, [*keys, "_bucket"]).where((F.col(at) >= t0) & (F.col(at) < t1)).drop("_bucket")


def split(left: DataFrame, right: DataFrame, keys: Sequence[str], a: tuple[str, str], b: tuple[str, str], width, least=0) -> DataFrame:
    """Common parts of overlapping rows as (t0, t1) beside both sides' columns, those longer than `least`.

    `into` is how far into the left interval the part begins: what a source's in-point has to be moved by.
    """
    met = overlap_join(left, right, keys, a, b, width)
    cut = met.withColumn("t0", F.greatest(a[0], b[0])).withColumn("t1", F.least(a[1], b[1]))
    return cut.withColumn("into", F.col("t0") - F.col(a[0])).where(F.col("t1") - F.col("t0") > least)


def union(df: DataFrame, keys: Sequence[str], t0: str = "t0", t1: str = "t1", touch=0, width=None) -> DataFrame:
    """Maximal intervals covered by each key's rows; gaps of at most `touch` are closed.

    width: intervals are first merged within buckets of so much time, which spreads a long key over tasks and
    leaves few rows to the second pass.
    """
    spans = df.where(F.col(t1) > F.col(t0)).select(*keys, F.col(t0).alias("t0"), F.col(t1).alias("t1"))
    if width is not None:
        spans = _merge(spans.withColumn("_bucket", _bucket(F.col("t0"), width)), [*keys, "_bucket"], touch).drop("_bucket")
    return _merge(spans, keys, touch)


def _merge(spans: DataFrame, keys: Sequence[str], touch) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("t0", "t1")
    reach = F.max("t1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(reach.isNull() | (F.col("t0") > reach + F.lit(touch)), 1).otherwise(0)
    island = F.sum("_begins").over(w.rowsBetween(Window.unboundedPreceding, 0))
    numbered = spans.withColumn("_begins", begins).withColumn("_island", island)
    return numbered.groupBy(*keys, "_island").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1")).drop("_island")


def minus(keep: DataFrame, cut: DataFrame, keys: Sequence[str], t0: str = "t0", t1: str = "t1", touch=0, width=None) -> DataFrame:
    """What is covered by keep and not by cut, as maximal intervals, for each key.

    A sweep over the bounds of both: running sums say how many of each are open. width: as for `union`.
    """
    def edges(df: DataFrame, kept: int) -> DataFrame:
        merged = union(df, keys, t0, t1, touch, width)
        up = merged.select(*keys, F.col("t0").alias("at"), F.lit(kept).alias("_k"), F.lit(1 - kept).alias("_c"))
        return up.unionAll(merged.select(*keys, F.col("t1").alias("at"), F.lit(-kept).alias("_k"), F.lit(kept - 1).alias("_c")))

    points = edges(keep, 1).unionAll(edges(cut, 0)).groupBy(*keys, "at").agg(F.sum("_k").alias("_k"), F.sum("_c").alias("_c"))
    w = Window.partitionBy(*keys).orderBy("at")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    swept = points.select(*keys, F.col("at").alias("t0"), F.lead("at").over(w).alias("t1"), F.sum("_k").over(run).alias("_k"), F.sum("_c").over(run).alias("_c"))
    return _merge(swept.where("_k > 0 and _c = 0 and t1 > t0").select(*keys, "t0", "t1"), keys, 0)


def intersect(left: DataFrame, right: DataFrame, keys: Sequence[str], width, t0: str = "t0", t1: str = "t1", least=0) -> DataFrame:
    """Parts of at least `least` that rows of both sides share."""
    a = left.select(*keys, F.col(t0).alias("a0"), F.col(t1).alias("a1"))
    b = right.select(*keys, F.col(t0).alias("b0"), F.col(t1).alias("b1"))
    met = overlap_join(a, b, keys, ("a0", "a1"), ("b0", "b1"), width)
    parts = met.select(*keys, F.greatest("a0", "b0").alias("t0"), F.least("a1", "b1").alias("t1"))
    return parts.where(F.col("t1") - F.col("t0") >= least)


def stable_runs(windows: DataFrame, keys: Sequence[str], level: str, limit, least, t0: str = "t0", t1: str = "t1", touch=0, width=None) -> DataFrame:
    """Runs of at least `least` under windows of a level up to the limit and under none above it.

    Windows without a level are neither. The caller measures a run again as a whole where that matters.
    """
    calm = windows.where(F.col(level) <= limit)
    return minus(calm, windows.where(F.col(level) > limit), keys, t0, t1, touch, width).where(F.col("t1") - F.col("t0") >= least)


def prefix_layout(df: DataFrame, group: Sequence[str], order: Sequence[str], duration: str, gap: str | None = None) -> DataFrame:
    """Rows laid end to end in their order within a group: t0 and t1; `gap` is time after a row."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    length = F.col(duration) + (F.coalesce(F.col(gap), F.lit(0)) if gap else F.lit(0))
    after = F.sum(length).over(w)
    return df.withColumn("t0", after - length).withColumn("t1", F.col("t0") + F.col(duration))


def pick_spans(picks: DataFrame, beats: DataFrame, cut: Sequence[str], tier: int, gaps_of_empty: bool = False) -> DataFrame:
    """t0 and t1 of every pick of at most that tier, beat after beat, with each beat's gap behind it.

    picks: cut, beat, j, duration_s, tier (null is 1). beats: cut, beat, gap_after_s. The gap of a beat without such
    a pick is left out, unless gaps_of_empty. Sums of gaps are made for each beat before they are spread.
    """
    chosen = picks.where(F.coalesce("tier", F.lit(1)) <= tier)
    spoken = chosen.groupBy(*cut, "beat").agg(F.sum("duration_s").alias("_spoken"))
    each = beats.join(spoken, [*cut, "beat"], "left")
    length = F.coalesce("_spoken", F.lit(0.0)) + F.when(F.lit(gaps_of_empty) | F.col("_spoken").isNotNull(), F.coalesce("gap_after_s", F.lit(0.0))).otherwise(0.0)
    w = Window.partitionBy(*cut).orderBy("beat").rowsBetween(Window.unboundedPreceding, 0)
    starts = each.select(*cut, "beat", (F.sum(length).over(w) - length).alias("_start"))
    inside = Window.partitionBy(*cut, "beat").orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    laid = chosen.join(starts, [*cut, "beat"])
    t0 = F.col("_start") + F.sum("duration_s").over(inside) - F.col("duration_s")
    return laid.withColumn("t0", t0).withColumn("t1", F.col("t0") + F.col("duration_s")).drop("_start")


def words_under(spans: DataFrame, words: DataFrame, keys: Sequence[str], span_id: Sequence[str], width, text: str = "w", order: Sequence[str] = ("s",)) -> DataFrame:
    """`words`, joined by spaces in order, that strictly overlap each span; spans: t0, t1; words: s, e.

    Spans without a word get an empty string.
    """
    met = overlap_join(spans, words, keys, ("t0", "t1"), ("s", "e"), width)
    said = met.groupBy(*span_id).agg(F.array_sort(F.collect_list(F.struct(*order, text))).alias("_w"))
    joined = said.select(*span_id, F.array_join(F.transform("_w", lambda x: x[text]), " ").alias("words"))
    return spans.join(joined, list(span_id), "left").withColumn("words", F.coalesce("words", F.lit("")))


def heard_in(spans: DataFrame, words: DataFrame, keys: Sequence[str], span_id: Sequence[str], width, most: int = 40) -> DataFrame:
    """Seconds of words inside each span (clipped to it), the first `most` words, and whether more were said."""
    met = overlap_join(spans, words, keys, ("t0", "t1"), ("s", "e"), width)
    said = met.groupBy(*span_id).agg(
        F.sum(F.least("e", "t1") - F.greatest("s", "t0")).alias("heard_s"),
        F.array_sort(F.collect_list(F.struct("s", "w"))).alias("_w"),
    )
    text = F.array_join(F.transform(F.slice("_w", 1, most), lambda x: x["w"]), " ")
    return said.select(*span_id, "heard_s", text.alias("text"), (F.size("_w") > most).alias("truncated"))


def spoken_seconds(spans: DataFrame, words: DataFrame, keys: Sequence[str], span_id: Sequence[str], width) -> DataFrame:
    """Seconds of speech under each span: 0 where its source was transcribed and is silent, null where it was not."""
    heard = heard_in(spans, words, keys, span_id, width).select(*span_id, "heard_s")
    known = words.select(*keys).distinct().withColumn("_known", F.lit(True))
    out = spans.join(heard, list(span_id), "left").join(known, list(keys), "left")
    return out.withColumn("spoken_s", F.when(F.col("_known"), F.coalesce("heard_s", F.lit(0.0)))).drop("heard_s", "_known")


def word_bounds(words: DataFrame, keys: Sequence[str], word: str = "w", s: str = "s", e: str = "e") -> DataFrame:
    """Of each group the first word and its start, the last word and its end, and how many there are."""
    return words.groupBy(*keys).agg(
        F.min_by(word, F.struct(s, e, word)).alias("first_word"), F.min(s).alias("first_s"),
        F.max_by(word, F.struct(e, s, word)).alias("last_word"), F.max(e).alias("last_e"), F.count("*").alias("words"),
    )


def clamp_to_runs(start: Column, stop: Column, runs: Column, least: Column) -> Column:
    """Where [start, stop) may stand: in the first run that holds it whole, else in the largest common part with a
    run if that is at least `least`, else null. runs: array of structs (t0, t1), in order; null means anywhere."""
    whole = F.get(F.filter(runs, lambda r: (r["t0"] <= start) & (r["t1"] >= stop)), F.lit(0))
    rooms = F.transform(
        runs,
        lambda r, i: F.struct(
            (F.least(r["t1"], stop) - F.greatest(r["t0"], start)).alias("room"), (-i).alias("first"),
            F.greatest(r["t0"], start).alias("t0"), F.least(r["t1"], stop).alias("t1"),
        ),
    )
    best = F.array_max(rooms)
    most = F.when(best["room"] >= least, F.struct(best["t0"].alias("t0"), best["t1"].alias("t1")))
    span = F.struct(start.alias("t0"), stop.alias("t1"))
    return F.when(runs.isNull() | whole.isNotNull(), span).otherwise(most)


def as_of(points: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, t0: str = "t0", width=None) -> DataFrame:
    """Each point with the columns of the last span of its keys that begins at or before it.

    One pass: both sides are put in one order, and the last span seen is carried on. Points before all spans get
    the first one, as lookups past the last one get the last. width: rows are ordered within buckets of so much time,
    and only each bucket's last span is carried from bucket to bucket, which spreads a long key over tasks.
    """
    extra = [c for c in spans.columns if c not in keys]
    own = [c for c in points.columns if c not in keys]
    a = points.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.struct(*own).alias("_p"), F.lit(None).cast(spans.select(F.struct(*extra)).schema[0].dataType).alias("_s"))
    b = spans.select(*keys, F.col(t0).alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast(points.select(F.struct(*own)).schema[0].dataType).alias("_p"), F.struct(*extra).alias("_s"))
    both, by = a.unionByName(b), list(keys)
    if width is not None:
        both, by = both.withColumn("_bucket", _bucket(F.col("_at"), width)), [*keys, "_bucket"]
    seen = F.last("_s", ignorenulls=True).over(Window.partitionBy(*by).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0))
    if width is None:
        following = Window.partitionBy(*by).orderBy("_at", "_kind").rowsBetween(0, Window.unboundedFollowing)
        found = both.withColumn("_found", F.coalesce(seen, F.first("_s", ignorenulls=True).over(following))).where("_kind = 1")
        return found.select(*keys, "_p.*", *[F.col("_found")[c].alias(c) for c in extra])
    # one row a bucket: its last span, and of all the buckets before it
    tails = both.groupBy(*by).agg(F.max_by(F.when(F.col("_kind") == 0, F.col("_s")), F.when(F.col("_kind") == 0, F.col("_at"))).alias("_tail"))
    order = Window.partitionBy(*keys).orderBy("_bucket")
    before = F.last("_tail", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_before")
    first = spans.groupBy(*keys).agg(F.min_by(F.struct(*extra), t0).alias("_first"))
    inside = both.withColumn("_seen", seen).where("_kind = 1")
    found = inside.join(tails.select(*by, before), by).join(first, list(keys), "left")
    use = F.coalesce("_seen", "_before", "_first")
    return found.withColumn("_found", use).select(*keys, "_p.*", *[F.col("_found")[c].alias(c) for c in extra])


def nearest(points: DataFrame, candidates: DataFrame, keys: Sequence[str], at: str, place: str) -> DataFrame:
    """Each point with the candidate nearest to it, the earlier one on a tie, found by two as-of looks."""
    own = [c for c in points.columns if c not in keys]
    marks = candidates.select(*keys, F.col(place).alias("_at"))
    both = points.select(*keys, F.col(at).alias("_at"), F.struct(*own).alias("_p")).unionByName(
        marks.select(*keys, "_at", F.lit(None).cast(points.select(F.struct(*own)).schema[0].dataType).alias("_p"))
    )
    mark = F.when(F.col("_p").isNull(), F.col("_at"))
    back = F.last(mark, ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_at").rangeBetween(Window.unboundedPreceding, 0))
    on = F.first(mark, ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_at").rangeBetween(0, Window.unboundedFollowing))
    seen = both.withColumn("_back", back).withColumn("_on", on).where(F.col("_p").isNotNull())
    before, after = F.col("_at") - F.col("_back"), F.col("_on") - F.col("_at")
    pick = F.when(F.col("_on").isNull() | (before <= after), F.col("_back")).otherwise(F.col("_on"))
    return seen.select(*keys, "_p.*", pick.alias("nearest"))
