"""Sinks that commit: a table to which two writers cannot both add a key, and reports that appear whole or not at all.

Tasks write files of their own into a folder of the run, below the sink's; nobody sees them until the commit names them,
and an abort takes the folder away, with what killed tasks left and from under those that still run. The sink's folder has
to be one that all executors and the driver share, with atomic links and renames.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator, Sequence
from contextlib import suppress
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Someone else committed since the table was read."""


@dataclass
class Wrote(WriterCommitMessage):
    partition: int
    files: list[str]


class _Staged(DataSourceArrowWriter):
    """What both sinks share: a folder for each run, made by the driver, and in it one staged file a task."""

    def __init__(self, options: dict):
        self.folder, self.options, self.run = options["path"].removeprefix("file://"), options, uuid.uuid4().hex
        self.staged = f"{self.folder}/data/{self.run}"
        os.makedirs(self.staged)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        raise NotImplementedError

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Remove all that the run wrote, reported or not. Under its new name no task finds the folder to add to it."""
        with suppress(FileNotFoundError):  # it was removed before
            os.rename(self.staged, f"{self.staged}.gone")
        shutil.rmtree(f"{self.staged}.gone", ignore_errors=True)


class _AppendWriter(_Staged):
    def write(self, batches: Iterator[pa.RecordBatch]) -> Wrote:
        from pyspark import TaskContext

        name, out = f"{uuid.uuid4().hex}.parquet", None
        try:
            for batch in batches:
                out = out or pq.ParquetWriter(f"{self.staged}/{name}", batch.schema)
                out.write_batch(batch)
        except BaseException:
            if out:
                out.close()
                with suppress(FileNotFoundError):
                    os.unlink(f"{self.staged}/{name}")
            raise
        if out:
            out.close()
        return Wrote(TaskContext.get().partitionId(), [f"{self.run}/{name}"] if out else [])

    def commit(self, messages: list[Wrote]) -> None:
        """Claim the version behind the one that was read. A link to a name that exists fails, so one writer gets it."""
        version, files = int(self.options["version"]) + 1, [f for m in messages for f in m.files]
        for name in os.listdir(self.staged):  # attempts that were killed and made again
            if f"{self.run}/{name}" not in files:
                with suppress(FileNotFoundError):
                    os.unlink(f"{self.staged}/{name}")
        entry = f"{self.folder}/data/{uuid.uuid4().hex}.entry"
        with open(entry, "w") as file:
            json.dump(files, file)
        try:
            os.link(entry, f"{self.folder}/{version:08d}.json")
        except FileExistsError:
            self.abort(messages)
            raise Conflict(f"version {version} was taken by another writer") from None
        finally:
            os.unlink(entry)
        if not files:
            with suppress(OSError):
                os.rmdir(self.staged)


class KeyedAppend(DataSource):
    @classmethod
    def name(cls) -> str:
        return "keyed_append"

    def writer(self, schema: StructType, overwrite: bool) -> _AppendWriter:
        return _AppendWriter(self.options)


def _versions(folder: str) -> list[str]:
    folder = folder.removeprefix("file://")
    return sorted(f for f in os.listdir(folder) if f.endswith(".json")) if os.path.isdir(folder) else []


def read_appended(spark: SparkSession, folder: str, like: DataFrame, versions: Sequence[str] | None = None) -> DataFrame:
    """The rows of all committed versions, with the columns of like."""
    local, files = folder.removeprefix("file://"), []
    for v in _versions(folder) if versions is None else versions:
        with open(f"{local}/{v}") as file:
            files += [f"file://{os.path.abspath(local)}/data/{name}" for name in json.load(file)]
    return spark.read.schema(like.schema).parquet(*files) if files else like.limit(0)


def append_keyed(more: DataFrame, folder: str, keys: Sequence[str], attempts: int = 5) -> int:
    """Append rows of keys that the table does not hold, one row a key (the least of all its columns); the table's version.

    Rows are held against the version that was read, by an anti-join; if another writer commits first, they are held
    against its version and written again. A row without a key is never held twice either.
    """
    spark = more.sparkSession
    spark.dataSource.register(KeyedAppend)
    for _ in range(attempts):
        seen = _versions(folder)
        old = read_appended(spark, folder, more, seen).select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        one = more.groupBy(*keys).agg(F.min(F.struct(*[c for c in more.columns if c not in keys])).alias("_r")) if set(more.columns) - set(keys) else more.distinct()
        fresh = one.join(old, same, "left_anti")
        fresh = fresh.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in more.columns])
        try:
            fresh.write.format("keyed_append").mode("append").option("path", folder).option("version", len(seen)).save()
            return len(seen) + 1
        except Exception as e:
            if "was taken by another writer" not in str(e):
                raise
    raise Conflict(f"{attempts} other writers came first")


class _ReportWriter(_Staged):
    def write(self, batches: Iterator[pa.RecordBatch]) -> Wrote:
        from pyspark import TaskContext

        name = f"{self.run}/{uuid.uuid4().hex}.part"
        path = f"{self.folder}/data/{name}"
        try:
            with open(path, "w", encoding="utf-8") as out:
                for batch in batches:
                    out.writelines(line + "\n" for line in batch.column(0).to_pylist())
        except BaseException:
            with suppress(FileNotFoundError):
                os.unlink(path)
            raise
        return Wrote(TaskContext.get().partitionId(), [name])

    def commit(self, messages: list[Wrote]) -> None:
        """All parts in order into one file beside the report, which then takes its name."""
        target, made = f"{self.folder}/{self.options['report']}", f"{self.staged}/{uuid.uuid4().hex}.whole"
        with open(made, "wb") as out:
            for m in sorted(messages, key=lambda m: m.partition):
                with open(f"{self.folder}/data/{m.files[0]}", "rb") as part:
                    while block := part.read(1 << 20):
                        out.write(block)
        os.replace(made, target)
        self.abort(messages)


class Report(DataSource):
    @classmethod
    def name(cls) -> str:
        return "report"

    def writer(self, schema: StructType, overwrite: bool) -> _ReportWriter:
        return _ReportWriter(self.options)


def table_lines(df: DataFrame, columns: Sequence[str], order: Sequence[str], section: int) -> DataFrame:
    """section, ord and line of a table: a head, a rule and a row of cells for each row, in order. Nulls are a dash."""
    cell = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("-")), r"[|\n]", " ")
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |"))
    head = df.sparkSession.createDataFrame([(0, "| " + " | ".join(columns) + " |"), (1, "|" + "---|" * len(columns))], "n int, line string")
    # a report's table is a page; its rows are numbered in one pass
    body = df.select((F.row_number().over(Window.orderBy(*order)) + 1).alias("n"), line.alias("line"))
    return head.union(body).select(F.lit(section).alias("section"), F.col("n").alias("ord"), "line")


def text_lines(spark: SparkSession, lines: Sequence[str], section: int) -> DataFrame:
    return spark.createDataFrame([(section, i, t) for i, t in enumerate(lines)], "section int, ord int, line string")


def write_report(lines: DataFrame, folder: str, report: str) -> None:
    """Lines (section, ord, line) in order as one file below folder. A failing task leaves the old report as it was."""
    lines.sparkSession.dataSource.register(Report)
    rows = lines.repartitionByRange("section", "ord").sortWithinPartitions("section", "ord").select("line")
    rows.write.format("report").mode("append").option("path", folder).option("report", report).save()
