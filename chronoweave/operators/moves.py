"""Camera moves: where a source's velocity starts, stops or turns, over sources of any length.

A cut depends on the mean of the segment that is open, so a source is a chain of decisions. But after a cut nothing
before it counts any more. So chunks of time are scanned at once, each from its own beginning as if nothing came
before and some way into the next chunk; from the first cut that two neighbouring scans share they agree for ever.
Where they share none, the earlier one is scanned again twice as far.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.session import cut_lineage


class MoveRules:
    """Fixed limits of move segmentation, in samples and percent of the picture a second."""

    hover, turn_deg, hold, deep, margin = 0.5, 35.0, 6, 0.25, 12


def split_moves(v: np.ndarray, rules=MoveRules) -> list[int]:
    """Where segments begin: a start or stop held for `hold` samples, or a turn away from the segment's mean.

    The mean is a running sum from the last cut, so what follows a cut is the same wherever the scan began.
    """
    n, hold = len(v), rules.hold
    moving = np.hypot(v[:, 0], v[:, 1]) >= rules.hover
    held = np.append(0, np.cumsum(moving))
    limit, on = np.cos(np.radians(rules.turn_deg)), moving.tolist()
    cuts, i, count, sx, sy = [0], 1, 0, 0.0, 0.0
    seen = 0
    while i + hold <= n:
        while seen < i:  # the open segment up to here
            if on[seen]:
                count, sx, sy = count + 1, sx + float(v[seen, 0]), sy + float(v[seen, 1])
            seen += 1
        state, ahead = 2 * count >= i - cuts[-1], int(held[i + hold] - held[i])
        cut = ahead == 0 if state else ahead == hold
        if state and count and ahead == hold:
            mean = np.array([sx / count, sy / count])
            part = v[i : i + hold]
            cut = bool((part @ mean < limit * np.maximum(np.hypot(part[:, 0], part[:, 1]) * np.hypot(*mean), 1e-12)).all())
        if cut:
            cuts.append(i)
            seen, count, sx, sy = i, 0, 0.0, 0.0
            i += hold
        i += 1
    return cuts


def split_dips(speed: np.ndarray, rules=MoveRules) -> list[int]:
    """Inner bounds of a moving stretch: the deepest dip in its middle, again and again while one is deep enough."""
    todo, cuts = [(0, len(speed))], []
    while todo:
        a, b = todo.pop()
        s = speed[a:b]
        if len(s) < 2 * rules.margin + 1 or s.max() <= 0:
            continue
        envelope = np.minimum(np.maximum.accumulate(s), np.maximum.accumulate(s[::-1])[::-1])
        depth = ((envelope - s) / s.max())[rules.margin : len(s) - rules.margin]
        k = int(depth.argmax())
        if depth[k] > rules.deep:
            cut = a + rules.margin + k
            cuts.append(cut)
            todo += [(a, cut), (cut, b)]
    return sorted(cuts)


def _scanned(samples: DataFrame, wanted: DataFrame, width: float, beyond: float) -> DataFrame:
    """key, chunk and cuts (times; the first is where the scan began) of the wanted chunks, each read `beyond` its end."""
    chunks = F.sequence(F.floor((F.col("at") - beyond) / width), F.floor(F.col("at") / width))
    dealt = samples.withColumn("chunk", F.explode(chunks)).where(F.col("at") < (F.col("chunk") + 1) * width + beyond)
    dealt = dealt.join(wanted, ["key", "chunk"])
    schema = T.StructType([samples.schema["key"], T.StructField("chunk", T.LongType()), T.StructField("cuts", T.ArrayType(T.DoubleType()))])

    def walk(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        v = np.column_stack([table["vx"].to_numpy(), table["vy"].to_numpy()])
        at = table["at"].to_numpy()
        return pa.table({"key": table["key"][:1], "chunk": table["chunk"][:1], "cuts": pa.array([at[split_moves(v)].tolist()], pa.list_(pa.float64()))})

    return dealt.groupBy("key", "chunk").applyInArrow(walk, schema)


def move_cuts(samples: DataFrame, width: float, beyond: float) -> DataFrame:
    """key and t0 of every segment. samples: key, at (distinct within a key), vx, vy."""
    chunks = samples.select("key", F.floor(F.col("at") / width).alias("chunk")).distinct()
    ends = samples.groupBy("key").agg(F.max("at").alias("end"))
    order = Window.partitionBy("key").orderBy("chunk")
    known, wanted = None, cut_lineage(chunks)
    while True:
        found = _scanned(samples, wanted, width, beyond).withColumn("to", (F.col("chunk") + 1) * width + beyond)
        known = cut_lineage(found if known is None else known.join(wanted, ["key", "chunk"], "left_anti").select(*found.columns).union(found))
        after = F.lead("cuts").over(order)
        shared = F.array_min(F.array_intersect("cuts", F.slice(after, 2, F.greatest(F.lit(1), F.size(after)))))
        met = known.withColumn("shared", shared).join(ends, "key")
        wanted = cut_lineage(met.where(F.col("shared").isNull() & (F.col("to") <= F.col("end"))).select("key", "chunk"))
        if wanted.isEmpty():
            break
        beyond *= 2
    never = F.lit(float("inf"))
    first = F.row_number().over(order) == 1
    begins = met.withColumn("own", F.when(first, F.lit(float("-inf"))).otherwise(F.coalesce(F.lag("shared").over(order), never)))
    # a scan counts from where it met the one before, and never before that one counted itself
    begins = begins.withColumn("from", F.max("own").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    begins = begins.withColumn("until", F.coalesce(F.lead("from").over(order), never))
    true = F.filter("cuts", lambda c: (c >= F.col("from")) & (c < F.col("until")))
    return begins.select("key", F.explode(true).alias("t0"))


def move_segments(path: DataFrame, key: str, at: str, vx: str, vy: str, width: float = 600.0, beyond: float = 60.0) -> DataFrame:
    """Segments of each source's velocity: moving or not, direction (mean cosine to the mean, by speed) and dip.

    width: seconds of a chunk; times within a source are distinct. Nulls count as no motion. A task holds a chunk, then
    a segment; a source without samples has no segment.
    """
    filled = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(n) for c, n in ((vx, "vx"), (vy, "vy"))]
    samples = cut_lineage(path.where(F.col(at).isNotNull()).select(F.col(key).alias("key"), F.col(at).cast("double").alias("at"), *filled))
    cuts = move_cuts(samples, width, beyond)
    last = Window.partitionBy("key").orderBy("t0")
    spans = cuts.withColumn("until", F.lead("t0").over(last)).join(samples.groupBy("key").agg(F.max("at").alias("end")), "key")
    spans = spans.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("t0") / width), F.floor(F.coalesce("until", "end") / width))))
    inside = (F.col("at") >= F.col("t0")) & (F.col("until").isNull() | (F.col("at") < F.col("until")))
    owned = samples.withColumn("chunk", F.floor(F.col("at") / width)).join(spans, ["key", "chunk"]).where(inside).select("key", "t0", "at", "vx", "vy")
    doubles = [T.StructField(c, T.DoubleType()) for c in ("direction", "dip", "mean_vx", "mean_vy")]
    schema = T.StructType([samples.schema["key"], T.StructField("t0", T.DoubleType()), T.StructField("t1", T.DoubleType()), T.StructField("moving", T.BooleanType()), *doubles])

    def measure(table: pa.Table) -> pa.Table:
        table, rows = table.sort_by("at"), []
        v, t = np.column_stack([table["vx"].to_numpy(), table["vy"].to_numpy()]), table["at"].to_numpy()
        speed = np.hypot(v[:, 0], v[:, 1])
        moving = bool((speed >= MoveRules.hover).mean() >= 0.5)
        bounds = [0, *(split_dips(speed) if moving else []), len(v)]
        for p, q in zip(bounds, bounds[1:], strict=False):
            s, part = speed[p:q], v[p:q]
            mean = part.mean(axis=0)
            cosine = (part @ mean) / np.maximum(s * np.hypot(*mean), 1e-12)
            envelope = np.minimum(np.maximum.accumulate(s), np.maximum.accumulate(s[::-1])[::-1])
            going = moving and s.max() > 0
            dip = float(((envelope - s) / s.max()).max()) if going else 0.0
            rows.append((t[p], t[q - 1], moving, float((s @ cosine) / s.sum()) if going else 1.0, dip, float(mean[0]), float(mean[1])))
        from pyspark.sql.pandas.types import to_arrow_schema

        types = to_arrow_schema(schema)
        made = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(types)[1:], strict=True)]
        return pa.table([table["key"].take(pa.array([0] * len(rows))), *made], names=types.names)

    found = owned.groupBy("key", "t0").applyInArrow(measure, schema)
    number = (F.row_number().over(last) - 1).cast("int").alias("segment")
    return found.select(F.col("key").alias(key), number, "t0", "t1", "moving", "direction", "dip", "mean_vx", "mean_vy")
