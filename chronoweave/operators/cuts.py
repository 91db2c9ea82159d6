"""Cuts and lay plans: where to cut, what picture goes under which words, and in which frames.

Folds whose next step hangs on the last one are walked in order, inside an expression.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cut_points(start: Column, stop: Column, pauses: Column, target: float = 45.0, longest: float = 90.0, shortest: float = 12.0) -> Column:
    """Inner cut points of a long take: even parts, each moved to the nearest pause within half a target that leaves
    at least `shortest` and at most `longest` since the cut before; else the even place. pauses: sorted times."""
    span = stop - start
    n = F.least(F.ceil(span / target), F.greatest(F.lit(1), F.floor(span / shortest))).cast("int")

    def step(cuts: Column, k: Column) -> Column:
        ideal, before = start + span * k / n, F.coalesce(F.try_element_at(cuts, F.lit(-1)), start)
        fits = F.filter(pauses, lambda p: (F.abs(p - ideal) <= target / 2) & (p - before >= shortest) & (p - before <= longest) & (stop - p >= shortest))
        near = F.array_min(F.transform(fits, lambda p: F.struct(F.abs(p - ideal).alias("d"), p.alias("p"))))["p"]
        return F.concat(cuts, F.array(F.coalesce(near, ideal)))

    none = F.array().cast("array<double>")
    return F.when(n > 1, F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), none, step)).otherwise(none)


def windows(takes: DataFrame, keys: Sequence[str], start: str, stop: str, pauses: str, least: float = 60.0) -> DataFrame:
    """Windows of takes of at least `least` seconds: w (from 1), t0, t1 and how each edge was found."""
    points = cut_points(F.col(start), F.col(stop), F.col(pauses))
    long = takes.where(F.col(stop) - F.col(start) >= least).withColumn("_cuts", points)
    bounds = F.concat(F.array(F.col(start)), F.col("_cuts"), F.array(F.col(stop)))
    method = lambda x: F.when(x == F.col(start), "source_start").when(x == F.col(stop), "source_end").when(F.array_contains(pauses, x), "speech_pause").otherwise("even_split")
    parts = F.transform(
        F.sequence(F.lit(0), F.size("_cuts")),
        lambda i: F.struct((i + 1).alias("w"), F.get("_b", i).alias("t0"), F.get("_b", i + 1).alias("t1"), method(F.get("_b", i)).alias("start_method"), method(F.get("_b", i + 1)).alias("end_method")),
    )
    return long.withColumn("_b", bounds).select(*keys, F.explode(parts).alias("x")).select(*keys, "x.*")


def legacy_layout(rows: DataFrame, beats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Picture rows without places, laid one after the other in a beat of `room` seconds: a bare row takes what is
    left, a clip is skipped where less than a second is, and more than a quarter second at the end becomes bare."""
    listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", "type", "clip", "duration_s"))).alias("_rows"))
    state = F.expr("named_struct('out', cast(array() as array<struct<k:int,type:string,clip:string,t0:double,t1:double>>), 'at', 0.0D)")

    def lay(s: Column, r: Column) -> Column:
        room = F.col("room") - s["at"]
        take = F.least(r["duration_s"], room)
        skip = (take <= 0) | ((r["type"] != "bare") & (room < 1.0))
        row = F.struct(r["k"].cast("int").alias("k"), r["type"].alias("type"), r["clip"].alias("clip"), s["at"].alias("t0"), (s["at"] + take).alias("t1"))
        return F.when(skip, s).otherwise(F.struct(F.concat(s["out"], F.array(row)).alias("out"), (s["at"] + take).alias("at")))

    laid = beats.select(*keys, "room").join(listed, list(keys), "left").withColumn("_s", F.aggregate(F.coalesce("_rows", F.expr("cast(array() as array<struct<k:int,type:string,clip:string,duration_s:double>>)")), state, lay))
    tail = F.struct(F.lit(None).cast("int").alias("k"), F.lit("bare").alias("type"), F.lit(None).cast("string").alias("clip"), F.col("_s.at").alias("t0"), F.col("room").alias("t1"))
    all_ = F.when(F.col("room") - F.col("_s.at") > 0.25, F.concat("_s.out", F.array(tail))).otherwise(F.col("_s.out"))
    return laid.select(*keys, F.explode(all_).alias("x")).select(*keys, "x.*")


def stretches(picks: DataFrame, rows: DataFrame, cut: Sequence[str], least: float = 0.04) -> DataFrame:
    """Placed picture rows cut where spoken picks begin and end; slivers of at most `least` seconds go."""
    from .intervals import split

    p = picks.select(*cut, "beat", "pick", F.col("clip").alias("pick_clip"), F.col("t0").alias("p0"), F.col("t1").alias("p1"))
    out = split(rows, p, [*cut, "beat"], ("dest_in_s", "dest_out_s"), ("p0", "p1"), 120.0, least)
    return out.withColumns({"src_in": F.col("in_s") + F.col("into"), "dur": F.col("t1") - F.col("t0")})


def word_room(picks: DataFrame, words: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Seconds free of words before and after each pick in its source: to the last word that ends by in + 0.02, and
    to the first that starts from out - 0.02, less 0.05, never under 0; `in_s` and 3 seconds where there is none.

    Both are looked up in one ordered pass over words and picks. Limits count in microseconds: a word that ends right on
    one is met, also where seconds count from 1970.
    """
    p = picks.select(*keys, "pick", "in_s", "out_s")
    ends = words.select(*keys, F.round("e", 6).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast("string").alias("pick"))
    asks = p.select(*keys, F.round(F.col("in_s") + 0.02, 6).alias("_at"), F.lit(1).alias("_side"), F.col("pick").cast("string").alias("pick"))
    w = Window.partitionBy(*keys).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    before = ends.unionByName(asks).withColumn("_last", F.max(F.when(F.col("_side") == 0, F.col("_at"))).over(w)).where("_side = 1").select(*keys, "pick", "_last")
    starts = words.select(*keys, F.round("s", 6).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast("string").alias("pick"))
    asks = p.select(*keys, F.round(F.col("out_s") - 0.02, 6).alias("_at"), F.lit(0).alias("_side"), F.col("pick").cast("string").alias("pick"))
    w = Window.partitionBy(*keys).orderBy("_at", "_side").rowsBetween(0, Window.unboundedFollowing)
    after = starts.unionByName(asks).withColumn("_next", F.min(F.when(F.col("_side") == 1, F.col("_at"))).over(w)).where("_side = 0").select(*keys, "pick", "_next")
    out = picks.join(before, [*keys, "pick"], "left").join(after, [*keys, "pick"], "left")
    head = F.when(F.col("_last").isNull(), F.col("in_s")).otherwise(F.col("in_s") - F.col("_last") - 0.05)
    tail = F.when(F.col("_next").isNull(), F.lit(3.0)).otherwise(F.col("_next") - F.col("out_s") - 0.05)
    return out.withColumns({"max_head_s": F.greatest(F.lit(0.0), head), "max_tail_s": F.greatest(F.lit(0.0), tail)}).drop("_last", "_next")


def alternate_tracks(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows on tracks 1 and 2 in turn."""
    i = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return rows.withColumn("track", 1 + i % 2)


def selects_timeline(rows: DataFrame, keys: Sequence[str], order: Sequence[str], gap: int = 24) -> DataFrame:
    """Selects laid one after the other with a gap: `rec` in frames."""
    from .intervals import prefix_layout

    return prefix_layout(rows.withColumn("_gap", F.lit(gap)), keys, order, "dur", "_gap").withColumnRenamed("t0", "rec").drop("t1", "_gap")


def item_span(rec: Column, dur: Column, src_in: Column, fps: Column, rate: int = 24) -> Column:
    """Seconds of its source that a timeline item shows; its in-point counts the source's own frames."""
    start = src_in / fps
    return F.struct(start.alias("t0"), (start + dur / F.lit(rate)).alias("t1"))


def trim_for(items: DataFrame, trims: DataFrame) -> DataFrame:
    """Each item with the first listed grade trim of its clip; one that names a span has to meet the item's."""
    t = trims.select(F.col("clip").alias("_clip"), F.col("ord").alias("_ord"), "grade", F.col("t0").alias("_t0"), F.col("t1").alias("_t1"))
    meets = F.col("_t0").isNull() | ((F.col("_t1") > F.col("src_t0")) & (F.col("_t0") < F.col("src_t1")))
    met = items.join(t, (F.col("clip") == F.col("_clip")) & meets).groupBy("item").agg(F.min_by("grade", "_ord").alias("grade"))
    return items.join(met, "item", "left")


def species_claims(picks: DataFrame, rows: DataFrame, species: DataFrame, cut: Sequence[str]) -> DataFrame:
    """Picks that name a species beside the picture over them, or beside their own where none is."""
    from .intervals import overlap_join
    from .textops import word_starts

    named = picks.join(species, word_starts(F.col("text"), F.col("species")))
    v = rows.where("type <> 'bare'").select(*cut, F.col("clip").alias("cover"), F.col("dest_in_s").alias("d0"), F.col("dest_out_s").alias("d1"))
    covered = overlap_join(named, v, cut, ("t0", "t1"), ("d0", "d1"), 120.0).select(*cut, "pick", "species", "cover")
    own = named.join(covered.select(*cut, "pick", "species").distinct(), [*cut, "pick", "species"], "left_anti")
    return covered.unionByName(own.select(*cut, "pick", "species", F.col("clip").alias("cover")))
