"""Scans: files, keyed JSON, configuration, documents and recorder names, with explicit schemas."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.functions.schemas import record

#: Fixed extensions of video files.
VIDEO = ("mp4", "mov", "mxf", "mts", "m4v", "avi", "mkv")

CLIPS = "id string, path string, role string, duration_s double, fps double, width int, height int, codec string, start_timecode string, creation_time string, has_audio boolean"
WORD = "w string, s double, e double, p double"
TRANSCRIPT = f"struct<language:string,segments:array<struct<start:double,end:double,text:string,no_speech:double,compression:double,words:array<struct<w:string,s:double,e:double,p:double>>>>>"


def list_videos(spark: SparkSession, folder: str, extensions: Sequence[str] = VIDEO) -> DataFrame:
    """path, bytes and modified of video files under a folder, names that begin with a dot left out. Only listings
    are read, never contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    name = F.element_at(F.split("path", "/"), -1)
    known = F.lower(F.element_at(F.split(name, r"\."), -1)).isin(*extensions)
    return files.where(known & ~name.startswith(".")).orderBy("path")


def keyed_json(spark: SparkSession, path: str, value: str) -> DataFrame:
    """A JSON object of objects as rows (key, value): value is the schema of each member. Members that don't fit are
    null, and so visible."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,{value}>"))).toDF("key", "value")


def words(spark: SparkSession, path: str) -> DataFrame:
    """Timed words (source, segment, w, s, e, p) of a transcript file, with the segment's confidence measures."""
    t = keyed_json(spark, path, TRANSCRIPT).select(F.col("key").alias("source"), F.posexplode("value.segments").alias("segment", "x"))
    return t.select("source", "segment", "x.no_speech", "x.compression", F.explode("x.words").alias("y")).select("source", "segment", "no_speech", "compression", "y.*")


def split_confident(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments that are kept, and those dropped for their confidence: both are tables, nothing is lost."""
    from chronoweave.operators.verdicts import confident

    kept = confident(F.col("no_speech"), F.col("compression"))
    return segments.where(kept), segments.where(~kept)


def keyed_list(spark: SparkSession, rows: Sequence[dict], schema: str) -> DataFrame:
    """Records of a configuration as a table; a single value where a list is due becomes a list of one."""
    types = T.StructType.fromDDL(schema)
    out = []
    for i, r in enumerate(rows):
        unknown = set(r) - set(types.names)
        if unknown:
            raise ValueError(f"record {i}: unknown keys {', '.join(sorted(unknown))}")
        out.append(tuple([r[f.name]] if isinstance(f.dataType, T.ArrayType) and f.name in r and not isinstance(r[f.name], list) else r.get(f.name) for f in types))
    return spark.createDataFrame(out, types)


def load_config(text: str, defaults: dict, required: Sequence[str] = ()) -> dict:
    """A JSON configuration over its defaults: unknown and missing keys are errors."""
    given = json.loads(text) if text.strip() else {}
    if not isinstance(given, dict):
        raise ValueError("the configuration is no mapping")
    unknown, missing = set(given) - set(defaults) - set(required), [k for k in required if k not in given]
    if unknown or missing:
        raise ValueError(f"unknown: {sorted(unknown)}; missing: {missing}")
    return defaults | given


def first_profile(*profiles: dict | None) -> dict:
    """The first profile that is given: a film's own, its project's, the defaults."""
    return next((p for p in profiles if p), {})


def camera_tags(tags: Column, path: Column) -> Column:
    """(make, model) by key preference, keys in any case; a comment of the form `make model`; the encoder last."""
    low = F.transform_keys(tags, lambda k, _: F.lower(k))
    get = lambda *keys: F.coalesce(*[F.try_element_at(low, F.lit(k)) for k in keys])
    comment = F.coalesce(get("comment"), F.lit(""))
    said = lambda g: F.nullif(F.regexp_extract(comment, r"(?i)camera[:=]\s*(\S+)\s+(\S+)", g), F.lit(""))
    make = F.coalesce(get("make", "com.apple.quicktime.make", "manufacturer"), said(1))
    model = F.coalesce(get("model", "com.apple.quicktime.model", "com.android.model"), said(2), get("encoder"))
    return F.struct(make.alias("make"), model.alias("model"))


def first_tag(container: Column, streams: Column, key: str) -> Column:
    """A tag of the container, else of the first stream that has it."""
    of = lambda tags: F.try_element_at(F.transform_keys(tags, lambda k, _: F.lower(k)), F.lit(key))
    found = F.filter(F.transform(streams, lambda s: of(s["tags"])), lambda x: x.isNotNull())
    return F.coalesce(of(container), F.get(found, F.lit(0)))


def recorder_sessions(files: DataFrame, pattern: str = r"(\d{8})[_-](\d{6})[_-]?(?:tx|mic)?(\d*)") -> DataFrame:
    """Recorder chunks by name: session (date and time), part and start; names of another shape have null."""
    name = F.element_at(F.split("path", "/"), -1)
    part = lambda g: F.nullif(F.regexp_extract(name, pattern, g), F.lit(""))
    stamp = F.concat(part(1), part(2))
    return files.withColumns({"session": stamp, "part": part(3).try_cast("int"), "start": F.try_to_timestamp(stamp, F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")})


def contiguous(chunks: DataFrame, keys: Sequence[str], most: float = 2.0) -> DataFrame:
    """Gaps of more than `most` seconds between a chunk's end and the next one's start: none means one recording."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("start")
    end = F.timestamp_add("MICROSECOND", F.round(F.col("duration_s") * 1_000_000).cast("long"), F.col("start"))
    gap = F.timestamp_diff("MICROSECOND", F.lag("_end").over(w), F.col("start")) / 1_000_000
    return chunks.withColumn("_end", end).withColumn("gap_s", gap).where(F.abs("gap_s") > most).drop("_end")


def envelope(samples: DataFrame, keys: Sequence[str], index: str, value: str, hop: int) -> DataFrame:
    """Root mean square of every `hop` samples, its log1p, and dB of full scale (null for silence)."""
    frame = F.floor(F.col(index) / hop).cast("long")
    rms = F.sqrt(F.avg(F.col(value) * F.col(value)))
    return samples.groupBy(*keys, frame.alias("i")).agg(rms.alias("rms"), F.log1p(rms).alias("level"), F.when(rms > 0, 20 * F.log10(rms)).alias("db"))


WORDS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
RUNS = record("path string, paragraph int, run int, marker string, text string")
COMMENTS = record("path string, author string, comment string, anchor string")


def _paragraph_runs(data: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    for p, paragraph in enumerate(root.iter(f"{WORDS}p")):
        for r, run in enumerate(paragraph.iter(f"{WORDS}r")):
            mark = run.find(f"{WORDS}rPr/{WORDS}highlight")
            yield p, r, None if mark is None else mark.get(f"{WORDS}val"), "".join(t.text or "" for t in run.iter(f"{WORDS}t"))


def _comments(data: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if "word/comments.xml" not in z.namelist():
            return
        root, notes = (ElementTree.fromstring(z.read(f"word/{n}.xml")) for n in ("document", "comments"))
    text: dict[str, list[str]] = {}
    still: set[str] = set()
    for e in root.iter():
        if e.tag == f"{WORDS}commentRangeStart":
            still.add(e.get(f"{WORDS}id"))
        elif e.tag == f"{WORDS}commentRangeEnd":
            still.discard(e.get(f"{WORDS}id"))
        elif e.tag == f"{WORDS}t":
            for i in still:
                text.setdefault(i, []).append(e.text or "")
    for c in notes.iter(f"{WORDS}comment"):
        yield c.get(f"{WORDS}author"), "".join(t.text or "" for t in c.iter(f"{WORDS}t")), "".join(text.get(c.get(f"{WORDS}id"), []))


def _documents(spark: SparkSession, folder: str, parse, schema: T.StructType) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", True).load(folder).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        types = to_arrow_schema(schema)
        for batch in batches:
            rows = [(p, *x) for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for x in parse(c)]
            columns = zip(*rows, strict=True) if rows else [[] for _ in types]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, types, strict=True)], schema=types)

    return files.mapInArrow(run, schema)


def marked_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbouring runs of one marker of every document, joined."""
    from chronoweave.operators.talk import marked_runs as merge

    runs = _documents(spark, folder, lambda c: list(_paragraph_runs(c)), RUNS)
    return merge(runs, ["path", "paragraph"], "run", "marker", "text")


def comments(spark: SparkSession, folder: str) -> DataFrame:
    """Comments of every document; of repeats by one author, the one with the longest anchor."""
    from chronoweave.operators.reconcile import keep_longest

    found = _documents(spark, folder, lambda c: list(_comments(c)), COMMENTS)
    return keep_longest(found, ["path", "author", "comment"], "anchor", ["anchor"], ["anchor"])


def measured(text: Column, label: str) -> Column:
    """The last number that follows a label in a tool's report."""
    found = F.regexp_extract_all(text, F.lit(rf"{re.escape(label)}:?\s*(-?[0-9]+(?:\.[0-9]+)?)"), F.lit(1))
    return F.try_element_at(found, F.lit(-1)).try_cast("double")


def catalogue_conflicts(clips: DataFrame) -> DataFrame:
    """Paths that are listed under more than one role."""
    return clips.groupBy("path").agg(F.array_sort(F.collect_set("role")).alias("roles")).where(F.size("roles") > 1)
