"""What was planned against what was read back."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def match_nearest(plan: DataFrame, found: DataFrame, keys: Sequence[str], place: str, tolerance, order: Sequence[str], plan_id: str = "plan_id", found_id: str = "found_id", first: bool = False) -> DataFrame:
    """(plan_id, found_id) pairs of equal keys within the tolerance, each row used once.

    Plan rows choose in order, the nearest free one (first=True: the first listed). Rows that cannot reach each other
    do not compete: a key's rows are cut into chains wherever two neighbours lie farther apart than the tolerance,
    and each chain is walked by itself.
    """
    a = plan.select(*keys, F.col(place).alias("_at"), F.col(plan_id).cast("string").alias("_id"), F.struct(*order).alias("_order"), F.lit(0).alias("_side"))
    b = found.select(*keys, F.col(place).alias("_at"), F.col(found_id).cast("string").alias("_id"), F.lit(None).cast(a.schema["_order"].dataType).alias("_order"), F.lit(1).alias("_side"))
    from .series import islands

    w = Window.partitionBy(*keys).orderBy("_at", "_side", "_id")
    both = a.unionByName(b)
    chains = islands(both.withColumn("_gap", F.col("_at") - F.lag("_at").over(w)), keys, ["_at", "_side", "_id"], F.col("_gap") > tolerance)
    schema = T.StructType([*[plan.schema[k] for k in keys], T.StructField(plan_id, T.StringType()), T.StructField(found_id, T.StringType())])

    def pair(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        wanted = sorted((r for r in rows if r["_side"] == 0), key=lambda r: tuple(r["_order"].values()))
        free = [(r["_at"], r["_id"]) for r in sorted((r for r in rows if r["_side"] == 1), key=lambda r: (r["_at"], r["_id"]))]
        out = []
        for r in wanted:
            near = [(0 if first else abs(at - r["_at"]), i) for i, (at, _) in enumerate(free) if abs(at - r["_at"]) <= tolerance]
            if near:
                _, i = min(near)
                out.append([*[r[k] for k in keys], r["_id"], free.pop(i)[1]])
        from pyspark.sql.pandas.types import to_arrow_schema

        types = to_arrow_schema(schema)
        columns = list(zip(*out, strict=True)) if out else [[] for _ in types]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, types, strict=True)], names=types.names)

    chain = Window.partitionBy(*keys, "island")
    sized = chains.drop("_gap").withColumns({"_n": F.count(F.lit(1)).over(chain), "_found": F.sum("_side").over(chain)})
    # two rows that only have each other are a pair; only chains with a choice go to Python
    two = sized.where("_n = 2 and _found = 1").groupBy(*keys, "island").agg(
        F.min(F.when(F.col("_side") == 0, F.col("_id"))).alias(plan_id), F.min(F.when(F.col("_side") == 1, F.col("_id"))).alias(found_id)
    )
    many = sized.where("_n > 2 and _found > 0 and _found < _n").drop("_n", "_found").groupBy(*keys, "island").applyInArrow(pair, schema)
    return two.drop("island").unionByName(many)


def differences(pairs: DataFrame, fields: Sequence[tuple[str, Column, Column, float]]) -> DataFrame:
    """pairs with `diffs`: name, planned and found value of each field that differs by more than its tolerance.
    A value missing on one side differs."""
    def one(name: str, want: Column, have: Column, tolerance: float) -> Column:
        differ = F.when(want.isNull() & have.isNull(), False).otherwise(F.coalesce(F.abs(want.cast("double") - have.cast("double")) > tolerance, F.lit(True)))
        return F.when(differ, F.concat(F.lit(f"{name} "), F.coalesce(want.cast("string"), F.lit("none")), F.lit(" / "), F.coalesce(have.cast("string"), F.lit("none"))))

    return pairs.withColumn("diffs", F.array_compact(F.array(*[one(*f) for f in fields])))


def conform(plan: DataFrame, found: DataFrame, keys: Sequence[str], place: str, tolerance, order: Sequence[str], fields: Sequence[tuple[str, float]]) -> DataFrame:
    """Each planned row as ok, mismatch (with diffs) or missing, and each item that nothing asked for as unexpected.

    plan: plan_id, keys, place, fields. found: found_id, the same.
    """
    pairs = match_nearest(plan, found, keys, place, tolerance, order).select(F.col("plan_id").alias("_p"), F.col("found_id").alias("_f"))
    p = plan.select(F.col("plan_id").cast("string").alias("_p"), *[F.col(c).alias(f"want_{c}") for c, _ in fields])
    f = found.select(F.col("found_id").cast("string").alias("_f"), *[F.col(c).alias(f"have_{c}") for c, _ in fields])
    met = differences(pairs.join(p, "_p").join(f, "_f"), [(c, F.col(f"want_{c}"), F.col(f"have_{c}"), t) for c, t in fields])
    ok = F.when(F.size("diffs") == 0, "ok").otherwise("mismatch")
    none = F.array().cast("array<string>")
    return (
        met.select(F.col("_p").alias("plan_id"), F.col("_f").alias("found_id"), ok.alias("status"), F.col("diffs"))
        .unionByName(p.join(pairs, "_p", "left_anti").select(F.col("_p").alias("plan_id"), F.lit(None).cast("string").alias("found_id"), F.lit("missing").alias("status"), none.alias("diffs")))
        .unionByName(f.join(pairs, "_f", "left_anti").select(F.lit(None).cast("string").alias("plan_id"), F.col("_f").alias("found_id"), F.lit("unexpected").alias("status"), none.alias("diffs")))
    )


def placement_faults(rows: DataFrame, picks: DataFrame, cut: Sequence[str], tolerance: float = 0.05) -> DataFrame:
    """(cut, beat, fault) of picture rows that leave a gap or overlap, do not last as long as they say, or do not
    end where the beat's picks end. rows: beat, k, dest_in_s, dest_out_s, duration_s; picks: beat, duration_s."""
    keys = [*cut, "beat"]
    w = Window.partitionBy(*keys).orderBy("k")
    seen = rows.withColumn("_before", F.coalesce(F.lag("dest_out_s").over(w), F.lit(0.0)))
    faults = F.array_compact(
        F.array(
            F.when(F.abs(F.col("dest_in_s") - F.col("_before")) > tolerance, F.format_string("row %d does not follow", "k")),
            F.when(F.abs(F.col("dest_out_s") - F.col("dest_in_s") - F.col("duration_s")) > tolerance, F.format_string("row %d is not as long as it says", "k")),
        )
    )
    each = seen.select(*keys, F.explode(faults).alias("fault"))
    ends = rows.groupBy(*keys).agg(F.max("dest_out_s").alias("_end")).join(picks.groupBy(*keys).agg(F.sum("duration_s").alias("_spoken")), keys, "full")
    late = ends.where(F.abs(F.coalesce("_end", F.lit(0.0)) - F.coalesce("_spoken", F.lit(0.0))) > tolerance).select(*keys, F.lit("does not end with its picks").alias("fault"))
    return each.unionByName(late)


def missing_references(df: DataFrame, column: str, known: DataFrame, reference: str) -> DataFrame:
    """Values of a column that the other table does not have, with how many rows hold them. Null refers to nothing."""
    lost = df.where(F.col(column).isNotNull()).join(known.select(F.col(reference).alias(column)).distinct(), column, "left_anti")
    return lost.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("rows"))


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def unknown_values(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    odd = ~F.coalesce(F.col(column).isin(*allowed), F.lit(False))
    return df.where(odd).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("rows"))


def update_keyed(df: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df with the non-null values of an update of the same keys; other rows and columns stay."""
    fields = [c for c in updates.columns if c not in keys]
    new = updates.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in fields])
    joined = df.join(new, list(keys), "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c) for c in df.columns])


def append_new(df: DataFrame, more: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df and those rows of more whose keys it doesn't have."""
    return df.unionByName(more.join(df.select(*keys).distinct(), list(keys), "left_anti"))


def keep_longest(df: DataFrame, keys: Sequence[str], text: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row for each key: the longest text, the first in order of equals."""
    size = F.length(F.coalesce(text, F.lit("")))
    place = F.struct((-size).alias("size"), *order)
    return df.groupBy(*keys).agg(F.min_by(F.struct(*columns), place).alias("_b")).select(*keys, "_b.*")
