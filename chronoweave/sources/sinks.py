"""Sinks: tables that refuse to be overwritten, manifests beside them, keyed files, ordered text."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed columns of a list of selects, in order.
SELECTS = ("id", "kind", "rank", "source", "in_s", "out_s", "part", "parts", "text")


def write(df: DataFrame, path: str, overwrite: bool = False, format: str = "parquet", **options) -> None:
    """df as a table; an existing one is an error unless asked for. Spark's commit shows it whole or not at all."""
    df.write.mode("overwrite" if overwrite else "errorifexists").format(format).options(**options).save(path)


def fingerprint(df: DataFrame) -> str:
    """A hash of a table's rows that does not depend on their order; repeats count."""
    row = F.xxhash64(*df.columns)
    n, total, mixed = df.agg(F.count("*"), F.sum(row.cast("decimal(38,0)")), F.bit_xor(F.xxhash64(row))).first()
    return f"{n}:{total or 0}:{mixed or 0}"


def manifest(spark: SparkSession, inputs: dict[str, DataFrame], tool: str, counts: dict[str, int]) -> DataFrame:
    """One row: hashes of the inputs, the tool's version and what was checked."""
    text = json.dumps({"inputs": {k: fingerprint(v) for k, v in sorted(inputs.items())}, "tool": tool, "counts": counts}, sort_keys=True)
    return spark.createDataFrame([(text,)], "manifest string")


def write_with_manifest(df: DataFrame, path: str, inputs: dict[str, DataFrame], tool: str, overwrite: bool = False) -> None:
    write(df, path, overwrite)
    write(manifest(df.sparkSession, inputs, tool, {"rows": df.sparkSession.read.parquet(path).count()}), f"{path}.manifest", overwrite, "json")


def unchanged(spark: SparkSession, path: str, inputs: dict[str, DataFrame], tool: str) -> bool:
    """Whether a table was made by this tool from these inputs, so that it need not be made again."""
    try:
        beside = spark.read.json(f"{path}.manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False  # there is none
    old = json.loads(beside.first()["manifest"])
    return old["tool"] == tool and old["inputs"] == {k: fingerprint(v) for k, v in sorted(inputs.items())}


def write_selects(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Selects as CSV with fixed columns in order of kind and rank."""
    rows = df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in SELECTS])
    write(rows.orderBy("kind", "rank", "part"), path, overwrite, "csv", header=True)


def write_lines(df: DataFrame, path: str, order: Sequence[str], line: str = "line", overwrite: bool = False) -> None:
    """Lines of a report in order."""
    write(df.orderBy(*order).select(F.col(line).cast("string").alias("value")), path, overwrite, "text")


def write_keyed(df: DataFrame, path: str, key: str) -> None:
    """Rows under one folder for each key; keys that are written again are replaced, the others stay."""
    df.write.mode("overwrite").partitionBy(key).option("partitionOverwriteMode", "dynamic").parquet(path)


def append_new(spark: SparkSession, path: str, more: DataFrame, keys: Sequence[str]) -> int:
    """Append rows of new keys, read the table again, and return how many there are; none of the old may be gone."""
    from chronoweave.operators.reconcile import append_new as joined

    old = spark.read.parquet(path)
    before = old.count()
    fresh = joined(old.limit(0), more.join(old.select(*keys).distinct(), list(keys), "left_anti"), keys)
    fresh.write.mode("append").parquet(path)
    after = spark.read.parquet(path).count()
    if after < before:
        raise RuntimeError(f"{path}: {before} rows before, {after} after")
    return after
