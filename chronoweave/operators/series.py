"""Operators on dense time series: one row for each sample, keyed by source, ordered by time or index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.session import cut_lineage

UP_TO = (Window.unboundedPreceding, 0)


def _ordered(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def cumulative(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Running sums of the columns, as <column>_path."""
    w = _ordered(keys, order).rowsBetween(*UP_TO)
    return df.select("*", *[F.sum(c).over(w).alias(f"{c}_path") for c in columns])


def centred_mean(df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, half: int) -> DataFrame:
    """`smooth`, the mean of the 2 * half + 1 samples around each one, with odd reflection at both ends.

    A sample that is k places beyond an end counts as twice the end's value less the sample k places inside. These
    samples are added as rows of their own, so the mean is one window over one order. Series of at most `half`
    samples have too little to reflect and get their plain mean.
    """
    w, whole = _ordered(keys, order), Window.partitionBy(*keys)
    wide = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = df.select(
        "*", (F.row_number().over(w) - 1).alias("_i"), (F.count(F.lit(1)).over(whole) - 1).alias("_last"),
        F.first(column).over(wide).alias("_head"), F.last(column).over(wide).alias("_tail"), F.avg(column).over(whole).alias("_mean"),
    )
    i, last, x = F.col("_i"), F.col("_last"), F.col(column)
    place = lambda at, value: F.struct(at.cast("long").alias("at"), value.alias("x"))
    copies = F.array_compact(
        F.array(
            place(i, x),
            F.when((i >= 1) & (i <= half), place(-i, 2 * F.col("_head") - x)),
            F.when((i < last) & (i >= last - half), place(2 * last - i, 2 * F.col("_tail") - x)),
        )
    )
    each = placed.withColumn("_c", F.explode(copies))
    mean = F.avg("_c.x").over(Window.partitionBy(*keys).orderBy("_c.at").rowsBetween(-half, half))
    smooth = F.when(last < half, F.col("_mean")).otherwise(F.col("_smooth"))
    return each.withColumn("_smooth", mean).where(F.col("_c.at") == i).select(*df.columns, smooth.alias("smooth"))


def sliding_profile(df: DataFrame, keys: Sequence[str], at: str, value: str, size: int, step: int, least: int) -> DataFrame:
    """Windows [a, a + size) every `step` from each key's first sample, as long as they end by its last one.

    t0, t1, n, rms and mean of those that hold `least` samples. at: whole numbers. A sample is sent to each of the
    size / step windows that can hold it, and windows are summed before they are shuffled.
    """
    ends = df.groupBy(*keys).agg(F.min(at).alias("_first"), F.max(at).alias("_last"))
    k = F.sequence(
        F.greatest(F.lit(0), F.floor((F.col(at) - F.col("_first") - size) / step) + 1), F.floor((F.col(at) - F.col("_first")) / step)
    )
    each = df.join(ends, list(keys)).withColumn("_k", F.explode(k))
    t0 = F.col("_first") + F.col("_k") * step
    windows = each.groupBy(*keys, "_first", "_last", "_k").agg(
        F.count(value).alias("n"), F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"), F.avg(value).alias("mean")
    )
    whole = windows.where((t0 + size <= F.col("_last")) & (F.col("n") >= least))
    return whole.select(*keys, t0.alias("t0"), (t0 + size).alias("t1"), "n", "rms", "mean")


def dip(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """How far each sample lies under the lesser of the maxima on its two sides, as a part of the series' maximum."""
    w = _ordered(keys, order)
    left = F.max(value).over(w.rowsBetween(*UP_TO))
    right = F.max(value).over(w.rowsBetween(0, Window.unboundedFollowing))
    top = F.max(value).over(Window.partitionBy(*keys))
    return df.withColumn("dip", F.when(top > 0, (F.least(left, right) - F.col(value)) / top).otherwise(0.0))


def pauses(df: DataFrame, keys: Sequence[str], t0: str, t1: str, least) -> DataFrame:
    """Gaps of at least `least` between an interval and the farthest end before it: gap and its middle, `at`."""
    w = _ordered(keys, [t0, t1])
    reach = F.max(t1).over(w.rowsBetween(Window.unboundedPreceding, -1))
    seen = df.withColumn("reach", reach).withColumn("gap", F.col(t0) - F.col("reach"))
    return seen.where(F.col("gap") >= least).withColumn("at", (F.col(t0) + F.col("reach")) / 2)


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], begins: Column) -> DataFrame:
    """`island`, counted from 1: a row with `begins` opens a new one, as does a key's first row."""
    w = _ordered(keys, order)
    first = F.row_number().over(w) == 1
    marked = df.withColumn("_begins", F.when(first | F.coalesce(begins, F.lit(False)), 1).otherwise(0))
    return marked.withColumn("island", F.sum("_begins").over(w.rowsBetween(*UP_TO))).drop("_begins")


def gap_islands(df: DataFrame, keys: Sequence[str], t0: str, t1: str, least, closes: str | None = None) -> DataFrame:
    """Islands that a gap of `least` to the row before divides, or a row before that `closes` one."""
    w = _ordered(keys, [t0, t1])
    begins = F.col(t0) - F.lag(t1).over(w) >= least
    if closes:
        begins = begins | F.coalesce(F.lag(closes).over(w), F.lit(False))
    marked = df.withColumn("_new", begins)
    return islands(marked, keys, [t0, t1], F.col("_new")).drop("_new")


def merge_short(df: DataFrame, keys: Sequence[str], t0: str, t1: str, least) -> DataFrame:
    """Spans shorter than `least` go to the span before them; a key's first ones begin its first span."""
    joined = islands(df, keys, [t0, t1], F.col(t1) - F.col(t0) >= least)
    return joined.groupBy(*keys, "island").agg(F.min(t0).alias("t0"), F.max(t1).alias("t1"), F.count("*").alias("n"))


def percentiles(df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """keys and percentiles with linear interpolation, by name; null for a group without values. No group is held as a whole."""
    at = lambda p: (F.col("_n") - 1) * F.lit(p)
    places = {f"_{k}{end}": f(at(p)).cast("long") for k, p in shares.items() for end, f in (("0", F.floor), ("1", F.ceil))}
    out = values_at(df, keys, value, places | {"_n": None})
    part = lambda k: at(shares[k]) - F.floor(at(shares[k]))
    return out.select(*keys, *[(F.col(f"_{k}0") * (1 - part(k)) + F.col(f"_{k}1") * part(k)).alias(k) for k in shares])


def levels(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """floor (tenth percentile) and speech (ninetieth), and the mean power's root."""
    power = df.groupBy(*keys).agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"))
    return match(power, percentiles(df, keys, value, {"floor": 0.10, "speech": 0.90}), keys, "left").select(*keys, "floor", "speech", "rms")


def upper_median(value: str) -> Column:
    """The element n div 2 of the sorted values, counted from 0: the larger middle one of an even number. For groups
    that fit an array; `upper_medians` takes any."""
    ranked = F.sort_array(F.collect_list(value))
    return F.get(ranked, F.floor(F.size(ranked) / 2).cast("int"))


def upper_medians(df: DataFrame, keys: Sequence[str], value: str, out: str = "median", buckets: int = 64) -> DataFrame:
    """keys and the upper median of each group, null where it has no value. No group is held as a whole."""
    return values_at(df, keys, value, {out: F.floor(F.col("_n") / 2).cast("long")}, buckets)


def values_at(df: DataFrame, keys: Sequence[str], value: str, places: dict[str, Column], buckets: int = 64) -> DataFrame:
    """keys and the values at places of each group's sorted values, counted from 0; null where there is none. A place
    is a column made from `_n`, the number of the group's values; the place None is that number itself.

    Equal values are counted. A value's bucket is its sign and the whole part of `buckets` times its logarithm, which
    ascends with it; running counts of a group's buckets tell which one holds a place, and only the values of such
    buckets are put in order. Both uses of the counted values read one shuffle.
    """
    x = F.col("_x").cast("double")
    sign = F.when(F.isnan(x), 2).when(x > 0, 1).when(x < 0, -1).when(x == 0, 0)
    size = F.floor(F.log(F.when(F.isnan(x) | (x == 0), 1.0).otherwise(F.abs(x))) * buckets)
    each = df.groupBy(*keys, F.col(value).alias("_x")).agg(F.count("*").alias("_c")).withColumns({"_sign": sign, "_size": F.when(sign == -1, -size).otherwise(size)})
    sums = each.groupBy(*keys, "_sign", "_size").agg(F.sum("_c").alias("_here"))
    known = F.when(F.col("_sign").isNotNull(), F.col("_here")).otherwise(0)
    order = Window.partitionBy(*keys).orderBy(F.asc_nulls_first("_sign"), "_size")
    sums = sums.withColumns({"_n": F.sum(known).over(Window.partitionBy(*keys)), "_before": F.sum(known).over(order.rowsBetween(*UP_TO)) - known})
    asked = F.array(*[F.struct(F.lit(name).alias("name"), place.cast("long").alias("at")) for name, place in places.items() if place is not None])
    held = F.filter(asked, lambda w: (w["at"] >= F.col("_before")) & (w["at"] < F.col("_before") + F.col("_here")))
    hit = sums.where("_sign is not null").select(*keys, "_sign", "_size", "_before", held.alias("_asked")).where(F.size("_asked") > 0)
    inside = match(each, hit, [*keys, "_sign", "_size"])
    inside = inside.withColumn("_up", F.col("_before") + F.sum("_c").over(_ordered([*keys, "_sign", "_size"], ["_x"]).rowsBetween(*UP_TO)))
    here = lambda name: F.exists("_asked", lambda w: (w["name"] == name) & (w["at"] < F.col("_up")) & (w["at"] >= F.col("_up") - F.col("_c")))
    wide = inside.groupBy(*keys).agg(*[F.max(F.when(here(name), F.col("_x"))).alias(name) for name in places if places[name] is not None])
    counted = [F.max("_n").alias(name) for name in places if places[name] is None]
    groups = sums.groupBy(*keys).agg(*counted) if counted else sums.select(*keys).distinct()
    return match(groups, wide, keys, "left")


def match(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Columns of a and the others of b, joined where all keys agree; null agrees with null."""
    right = b.select(*[F.col(c).alias(f"_right_{c}" if c in keys else c) for c in b.columns])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    return a.join(right, same, how).drop(*[f"_right_{k}" for k in keys])


def median_of_enough(value: str, least: int) -> Column:
    """Median of values that are numbers, or null where fewer than `least` are."""
    number = F.nullif(F.col(value), F.lit(float("nan")))
    return F.when(F.count(number) >= least, F.percentile(number, F.lit(0.5)))


def edge_room(frames: DataFrame, marks: DataFrame, keys: Sequence[str], index: str, loud: Column, first: str, last: str, cap: int) -> DataFrame:
    """Quiet frames in front of `first` and behind `last` of each mark, up to `cap` and to the series' ends.

    One ordered pass carries the last loud frame onwards and the next one back.
    """
    w = _ordered(keys, [index])
    back = F.max(F.when(loud, F.col(index))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    on = F.min(F.when(loud, F.col(index))).over(w.rowsBetween(1, Window.unboundedFollowing))
    low, high = (f(index).over(Window.partitionBy(*keys)) for f in (F.min, F.max))
    room = frames.select(
        *keys, F.col(index).alias("_i"),
        F.least(F.lit(cap), F.col(index) - F.coalesce(back, low - 1) - 1).alias("_before"),
        F.least(F.lit(cap), F.coalesce(on, high + 1) - F.col(index) - 1).alias("_after"),
    )
    a = room.select(*keys, F.col("_i").alias(first), F.col("_before").alias("room_before"))
    b = room.select(*keys, F.col("_i").alias(last), F.col("_after").alias("room_after"))
    return marks.join(a, [*keys, first], "left").join(b, [*keys, last], "left")


def shake_stats(path: DataFrame, keys: Sequence[str], at: str, dx: str, dy: str, inliers: str, rate: float = 12, width: float = 480, least: int = 12, pairs: int = 12) -> DataFrame:
    """Shake and pan of each source in percent of the picture's width, or `unchecked` with fewer pairs.

    Pairs with too few inliers count as no motion. Shake is the root mean square of the distance between the
    summed path and its one-second mean; pan is the mean step of the reliable pairs, a second.
    """
    good = F.col(inliers) >= least
    steps = path.select(
        *keys, at, inliers, *[F.when(good, F.col(c)).otherwise(0.0).alias(n) for c, n in ((dx, "_dx"), (dy, "_dy"))],
        *[F.when(good, F.col(c)).alias(n) for c, n in ((dx, "_gx"), (dy, "_gy"))],
    )
    walked = cumulative(steps, keys, [at], ["_dx", "_dy"])
    half = int(rate) // 2
    smooth = centred_mean(walked, keys, [at], "_dx_path", half).withColumnRenamed("smooth", "_sx")
    smooth = centred_mean(smooth, keys, [at], "_dy_path", half).withColumnRenamed("smooth", "_sy")
    square = F.pow(F.col("_dx_path") - F.col("_sx"), 2) + F.pow(F.col("_dy_path") - F.col("_sy"), 2)
    stats = smooth.groupBy(*keys).agg(
        F.count("*").alias("pairs"),
        (F.sqrt(F.avg(square)) / width * 100).alias("shake"),
        (F.hypot(F.avg("_gx"), F.avg("_gy")) * rate / width * 100).alias("pan"),
        F.avg(F.when(F.col(inliers) < least, 1.0).otherwise(0.0)).alias("unreliable"),
        F.percentile(inliers, F.lit(0.5)).alias("median_inliers"),
    )
    enough = F.col("pairs") >= pairs
    return stats.select(
        *keys, "pairs", F.when(enough, "ok").otherwise("unchecked").alias("status"),
        *[F.when(enough, F.col(c)).alias(c) for c in ("shake", "pan", "unreliable", "median_inliers")],
    )


def steady_runs(path: DataFrame, runs: DataFrame, keys: Sequence[str], at: str, dx: str, dy: str, inliers: str, limit: float = 2.0) -> DataFrame:
    """Runs (t0, t1) that hold when they are measured again as a whole: their own pairs' shake is known and not over
    the limit. A run joined from steady windows can be worse than each of them."""
    from .intervals import contains_join

    own = contains_join(path, runs.select(*keys, "t0", "t1"), keys, at, ("t0", "t1"), 60.0)
    again = shake_stats(own, [*keys, "t0", "t1"], at, dx, dy, inliers)
    return again.where((F.col("status") == "ok") & (F.col("shake") <= limit)).select(*keys, "t0", "t1", "shake")


def usable_runs(shake: Column, limit: float, runs: Column, length: Column, least: float) -> Column:
    """Null where the whole source is steady enough, else its steady runs; an empty list means not usable."""
    return F.when((shake <= limit) | (length < least), F.lit(None)).otherwise(
        F.coalesce(runs, F.expr("cast(array() as array<struct<t0:double,t1:double>>)"))
    )


def clean_reasons(direction: Column, dip_: Column, shake: Column, unreliable: Column, seconds: Column) -> Column:
    """Why a move isn't clean; none for a clean one. Unmeasured values are reasons, never passes."""
    limits = [
        (direction >= 0.90, "direction"), (dip_ <= 0.25, "dip"), (shake <= 2.0, "shake"), (unreliable <= 0.2, "unreliable"),
    ]
    found = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(why)) for ok, why in limits]
    found.append(F.when(~F.coalesce(seconds >= 3.0, F.lit(False)), F.format_string("%.1f s long", seconds)))
    return F.array_compact(F.array(*found))


def clean_except_length(reasons: Column) -> Column:
    return F.forall(reasons, lambda r: r.endswith(" s long"))


def correlate(df: DataFrame, keys: Sequence[str], left: str, right: str, lags: Sequence[int]) -> DataFrame:
    """r of two arrays at each lag, over their common part: left shifted by `lag` against right.

    A product for each place and lag is summed within tasks, so a long array costs rows but no memory. r is null where
    a side does not vary.
    """
    lag = F.explode(F.array(*[F.lit(k) for k in lags])).alias("lag")
    shifted = df.select(*keys, left, right, lag).select(
        *keys, "lag",
        F.slice(left, 1 + F.greatest(F.lit(0), F.col("lag")), F.size(left)).alias("_a"),
        F.slice(right, 1 + F.greatest(F.lit(0), -F.col("lag")), F.size(right)).alias("_b"),
    )
    n = F.least(F.size("_a"), F.size("_b"))
    pairs = shifted.select(*keys, "lag", F.explode(F.arrays_zip(F.slice("_a", F.lit(1), n).alias("a"), F.slice("_b", F.lit(1), n).alias("b"))).alias("p"))
    return pairs.groupBy(*keys, "lag").agg(F.corr("p.a", "p.b").alias("r"))


def best_match(scores: DataFrame, clip: Sequence[str], r: str, lag: str, guard: int) -> DataFrame:
    """The lag of the largest r of each clip, and how far it leads any lag outside [peak - guard, peak + guard)."""
    peak = scores.groupBy(*clip).agg(F.max_by(F.struct(r, lag), F.struct(F.col(r), -F.col(lag))).alias("_p"))
    both = scores.join(peak, list(clip))
    away = (F.col(lag) < F.col("_p")[lag] - guard) | (F.col(lag) >= F.col("_p")[lag] + guard)
    return both.groupBy(*clip).agg(
        F.first(F.col("_p")[r]).alias("r"), F.first(F.col("_p")[lag]).alias("lag"),
        (F.first(F.col("_p")[r]) - F.max(F.when(away, F.col(r)))).alias("margin"),
    )
