"""Event-time windows that read the same in batch and in Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read(spark: SparkSession, folder: str, schema: str = SCHEMA, pattern: str | None = None, files_per_batch: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(folder)


def marked(df: DataFrame, at: str, late: str | None) -> DataFrame:
    """df with a watermark, for which wall-clock times are taken in the session's zone; as it is without `late`."""
    if not late:
        return df
    timed = df.withColumn(at, F.col(at).cast("timestamp")) if dict(df.dtypes)[at] == "timestamp_ntz" else df
    return timed.withWatermark(at, late)


def tumbling(df: DataFrame, at: str, size: str, late: str | None = None, keys: Sequence[str] = ("event_type",), slide: str | None = None) -> DataFrame:
    """Counts and sums of `value` in windows of a size (every `slide`); `late` is how late a row may come."""
    rows = marked(df, at, late)
    window = F.window(at, size, slide) if slide else F.window(at, size)
    out = rows.groupBy(*keys, window.alias("_w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(*keys, F.col("_w.start").alias("t0"), F.col("_w.end").alias("t1"), "n", "total")


def sessions(df: DataFrame, at: str, gap: str, late: str | None = None, keys: Sequence[str] = ("user_id",)) -> DataFrame:
    """Runs of events with less than `gap` between neighbours; a session ends a gap after its last event."""
    rows = marked(df, at, late)
    out = rows.groupBy(*keys, F.session_window(at, gap).alias("_w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(*keys, F.col("_w.start").alias("t0"), F.col("_w.end").alias("t1"), "n", "total")


def first_seen(df: DataFrame, at: str, keys: Sequence[str], late: str) -> DataFrame:
    """One row for each key within the watermark: work that was done is not done again."""
    return marked(df, at, late).dropDuplicatesWithinWatermark(list(keys))


STATE = T.StructType([T.StructField("n", T.LongType()), T.StructField("total", T.DoubleType())])


def running_totals(df: DataFrame, key: str, value: str) -> DataFrame:
    """Totals so far of every key that a batch touches, kept in state."""
    kind = df.schema[key].dataType
    out = T.StructType([T.StructField(key, kind), *STATE.fields])

    def add(who, batches, state):
        import pandas as pd

        n, total = state.get if state.exists else (0, 0.0)
        for rows in batches:
            n, total = n + len(rows), total + float(rows[value].sum())
        state.update((n, total))
        yield pd.DataFrame({key: [who[0]], "n": [n], "total": [total]})

    return df.groupBy(key).applyInPandasWithState(add, out, STATE, "update", "NoTimeout")


#: Parts of a keyed table, by the hash of its keys.
PARTS = 64


def upsert(stream: DataFrame, folder: str, checkpoint: str, keys: Sequence[str], merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None, parts: int = PARTS):
    """Write a stream as a keyed table: each batch replaces the rows of its keys. `latest` reads it.

    The table is cut into parts by the hash of the keys, and a batch writes only the parts that it touches, under its own
    number; then an index of the parts' newest numbers is written under that number too. What a batch reads are the parts
    that the index before it names, so one that runs twice leaves one result, and one that cannot read them fails. A
    folder that another checkpoint has written is refused. Parts and indexes that neither the last index nor the one
    before it names are removed.
    """
    join = merge or (lambda old, new: old.join(new.select(*keys), list(keys), "left_anti").unionByName(new))

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if not number and (others := [n for n in _numbers(spark, f"{folder}/index") if n or _owner(spark, folder, n) != checkpoint]):
            raise ValueError(f"{folder} holds batches {sorted(others)} of another checkpoint")
        part = F.expr(f"cast(pmod(xxhash64({', '.join(f'`{k}`' for k in keys)}), {parts}) as int)")
        batch = batch.persist()
        touched = {r[0] for r in batch.select(part).distinct().collect()}  # `parts` at most
        before = _index(spark, folder, number - 1) if number else {}
        old = _read_parts(spark, folder, {p: before[p] for p in touched & before.keys()}, batch)
        join(old, batch).withColumn("_part", part).write.mode("overwrite").partitionBy("_part").parquet(f"{folder}/parts/{number}")
        # a part whose rows are all gone has no folder
        now = before | dict.fromkeys(touched, number)
        rows = [(p, n, checkpoint) for p, n in now.items()]
        spark.createDataFrame(rows, "part int, number long, checkpoint string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/index/{number}")
        batch.unpersist()
        named = set(now.items()) | set(before.items())
        for n in _numbers(spark, f"{folder}/parts"):
            for p in _numbers(spark, f"{folder}/parts/{n}", "_part="):
                if n < number and (p, n) not in named:
                    _remove(spark, f"{folder}/parts/{n}/_part={p}")
        for n in _numbers(spark, f"{folder}/index"):
            if n < number - 1:
                _remove(spark, f"{folder}/index/{n}")

    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)


def _filesystem(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _numbers(spark: SparkSession, folder: str, prefix: str = "") -> list[int]:
    """Numbers of the folders below a folder, none where there is no such folder."""
    system, at = _filesystem(spark, folder)
    names = [s.getPath().getName() for s in system.listStatus(at)] if system.exists(at) else []
    return [int(n.removeprefix(prefix)) for n in names if n.startswith(prefix) and n.removeprefix(prefix).isdigit()]


def _owner(spark: SparkSession, folder: str, number: int) -> str | None:
    row = spark.read.schema("checkpoint string").parquet(f"{folder}/index/{number}").first()
    return row and row["checkpoint"]


def _remove(spark: SparkSession, path: str) -> None:
    system, at = _filesystem(spark, path)
    system.delete(at, True)


def _index(spark: SparkSession, folder: str, number: int) -> dict[int, int]:
    return {r["part"]: r["number"] for r in spark.read.parquet(f"{folder}/index/{number}").collect()}


def _read_parts(spark: SparkSession, folder: str, numbers: dict[int, int], like: DataFrame) -> DataFrame:
    """The rows of these parts, each as its batch left it."""
    out, schema = like.limit(0), T.StructType([*like.schema.fields, T.StructField("_part", T.IntegerType())])
    for number in sorted(set(numbers.values())):
        wanted = [p for p, n in numbers.items() if n == number]
        rows = spark.read.schema(schema).parquet(f"{folder}/parts/{number}").where(F.col("_part").isin(wanted))
        out = out.unionByName(rows.drop("_part"))
    return out


def latest(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    """The keyed table that upsert wrote into a folder, with the columns of like."""
    number = F.regexp_extract(F.input_file_name(), r"/index/(\d+)/", 1).cast("long")
    newest = spark.read.option("recursiveFileLookup", True).parquet(f"{folder}/index").select(number.alias("n")).agg(F.max("n")).first()[0]
    return _read_parts(spark, folder, _index(spark, folder, newest), like)


def keep_late(stream: DataFrame, at: str, late: str, folder: str, checkpoint: str):
    """Write a stream's rows below folder/rows and those that come too late below folder/late, by batch.

    A row is too late if its time lies more than `late` (an interval) before the latest time of the batches before; a
    watermark would drop it in silence. Rows without a time are not late.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        seen = spark.read.parquet(f"{folder}/seen/{number - 1}").first()[0] if number else None
        over = F.coalesce(F.col(at) < F.lit(seen) - F.expr(f"interval {late}"), F.lit(False)) if seen is not None else F.lit(False)
        batch = batch.persist()
        batch.where(over).write.mode("overwrite").parquet(f"{folder}/late/{number}")
        batch.where(~over).write.mode("overwrite").parquet(f"{folder}/rows/{number}")
        batch.agg(F.max(at).alias("seen")).select(F.greatest("seen", F.lit(seen).cast(batch.schema[at].dataType)).alias("seen")).write.mode("overwrite").parquet(f"{folder}/seen/{number}")
        batch.unpersist()

    return stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)
