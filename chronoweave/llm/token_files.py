"""Token ids of a corpus in binary files, coded by a static range asymmetric numeral system.

1. Documents are dealt by ranges of their key and sorted, so that row numbers ascend with the key over all partitions;
   then their ids are found and written to a table in the shared folder.
2. Ids are counted over all of that table; the counts make one table of shares for all files. It grows with the
   vocabulary, not with the corpus, and is what every task gets.
3. Each task codes the runs of consecutive rows that it reads into files. A file holds blocks of whole lanes; each
   block is coded by itself, and every checkpoint of a block begins a part with a checksum of its own.
4. Files are read back part by part. A task begins at any checkpoint, takes the documents that begin in its part, and
   goes on into the next parts until the last of these documents has ended.

A file: MAGIC; all parts of all blocks; a footer (zlib-compressed: keys, null marks and id counts of its documents,
ids, lanes, first byte and checksum of each block's parts, checksum of the shares); the footer's length and checksum.
Files get a new name in every attempt of a task, and only those that the manifest lists belong to the corpus, so tasks
that run twice do no harm. They are written and read through pyarrow's file systems, which know file, hdfs, s3 and gs.

Defined cases: null and empty texts have the end id only; null keys come first; rows of one key are ordered by the
hash of their text, then by the text, so repeated rows are kept side by side and each gets its own start; an empty
table makes no file and no row; columns beside key and text are not looked at.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.session import shared_folder

from . import rans
from .library_tokens import encoder
from .rows import name

MAGIC = b"TOKENS1\n"
#: Ids of a block and of a file, at most (a longer document takes as many blocks as it needs).
BLOCK = 1 << 20
FILE = 1 << 24
#: Ids that one task reads, about, and tasks that read, at most.
READ, TASKS = 1 << 22, 1 << 15

TOKENS = T.StructType([T.StructField("key", T.LongType()), T.StructField("ids", T.BinaryType())])
MANIFEST = "path string, first_seq long, n_docs long, n_ids long, n_bytes long"
PARTS = "path string, base long, keys array<long>, nulls array<boolean>, lengths array<long>, skip long, parts array<struct<at:long,bytes:long,n:long,lanes:int,crc:long>>, shares long"


def _files(uri: str):
    """(file system, path) of a folder or file."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else os.path.abspath(uri.removeprefix("file:")))


def _under(uri: str) -> str:
    """A Hadoop path such as file:/a as one with two slashes."""
    return uri if "://" in uri else uri.replace("file:/", "file:///", 1)


_last: dict[bytes, rans.Table] = {}


def _unpacked(packed: bytes) -> rans.Table:
    """The shares that this process used last are kept."""
    if packed not in _last:
        _last.clear()
        _last[packed] = rans.Table.unpack(packed)
    return _last[packed]


# ids


def tokenise(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, end: int = 0) -> DataFrame:
    """seq (ascending with the key), key and ids (packed) of every row, written to the shared folder."""
    spark = docs.sparkSession
    rows = docs.select(F.col(name(key)).cast("long").alias("key"), F.coalesce(F.col(name(text)).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("mix", F.xxhash64("text"))
    rows = rows.repartitionByRange("key", "mix").sortWithinPartitions("key", "mix", "text").drop("mix")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(vocabulary, end)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), made.encode(batch.column(1))], names=["key", "ids"])

    path = f"{shared_folder(spark)}/ids"
    rows.mapInArrow(run, TOKENS).withColumn("seq", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def width(vocabulary: str | None, end: int) -> str:
    """Type of the packed ids."""
    return np.dtype(encoder(vocabulary, end).kind).newbyteorder("<").str


def shares(tokens: DataFrame, kind: str = "<u2") -> rans.Table:
    """One table of shares by the counts of all ids. Counts are summed by task before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for ids in _packed(batch.column(0), kind):
                found = np.bincount(ids)
                if len(found) > len(total):
                    total = np.pad(total, (0, len(found) - len(total)))
                total[: len(found)] += found
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    counts = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return rans.Table.of({r["id"]: r["n"] for r in counts.toLocalIterator()})


def _packed(column: pa.Array, kind: str) -> Iterator[np.ndarray]:
    """All ids of an Arrow column of packed ids, as few arrays as it has buffers."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    if offsets[-1] > offsets[0]:
        yield np.frombuffer(column.buffers()[2], kind, (offsets[-1] - offsets[0]) // np.dtype(kind).itemsize, offsets[0])


# files


class _Writer:
    """One file, block by block."""

    def __init__(self, folder: str, table: rans.Table, crc: int, first_seq: int):
        self.path = f"{folder}/{first_seq:020d}-{uuid.uuid4().hex}.ans"
        system, path = _files(self.path)
        self.out, self.table, self.crc, self.first_seq = system.open_output_stream(path), table, crc, first_seq
        self.out.write(MAGIC)
        self.at, self.parts = len(MAGIC), []
        self.waiting, self.held, self.n = [], 0, 0
        self.keys, self.nulls, self.lengths = [], [], []

    def add(self, keys: np.ndarray, nulls: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        self.keys.append(keys), self.nulls.append(nulls), self.lengths.append(lengths)
        self.n += len(ids)
        for a in range(0, len(ids), BLOCK):
            self.waiting.append(ids[a : a + BLOCK])
            self.held += len(self.waiting[-1])
            while self.held >= BLOCK:
                held = np.concatenate(self.waiting)
                self.block(held[:BLOCK])
                self.waiting, self.held = [held[BLOCK:]], len(held) - BLOCK

    def block(self, ids: np.ndarray) -> None:
        lanes = rans.lanes_for(len(ids))
        for k, part in enumerate(rans.encode(ids, self.table)):
            n = min(lanes * rans.EVERY, len(ids) - k * lanes * rans.EVERY)
            self.out.write(part)
            self.parts.append((self.at, len(part), n, lanes, zlib.crc32(part)))
            self.at += len(part)

    def close(self) -> tuple:
        if self.held:
            self.block(np.concatenate(self.waiting))
        lengths = np.concatenate(self.lengths)
        docs = [np.concatenate(self.keys).astype("<i8"), np.concatenate(self.nulls).astype("u1"), lengths.astype("<i8")]
        parts = np.array(self.parts, "<i8").reshape(-1, 5)
        head = struct.pack("<qqI", len(lengths), len(parts), self.crc)
        footer = zlib.compress(head + b"".join(x.tobytes() for x in [*docs, parts]), 1)
        self.out.write(footer + struct.pack("<qI", len(footer), zlib.crc32(footer)))
        self.out.close()
        return self.path, self.first_seq, len(lengths), self.n, self.at + len(footer) + 12


def write(tokens: DataFrame, table: rans.Table, folder: str, kind: str = "<u2") -> DataFrame:
    """Files below folder, a shared one, and their manifest: path, first_seq, n_docs, n_ids, n_bytes."""
    spark = tokens.sparkSession
    system, path = _files(folder)
    system.create_dir(path, recursive=True)
    packed = table.pack()
    crc = zlib.crc32(packed)
    with system.open_output_stream(f"{path}/shares") as out:
        out.write(packed)
    sent = spark.sparkContext.broadcast(packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, now, due, done = _unpacked(sent.value), None, None, []
        for batch in batches:
            seq, key = batch.column(0).to_numpy(), batch.column(1)
            nulls = key.is_null().to_numpy(zero_copy_only=False)
            keys = key.fill_null(0).to_numpy()
            offsets = np.frombuffer(batch.column(2).buffers()[1], np.int32, len(seq) + 1, batch.column(2).offset * 4)
            lengths = np.diff(offsets).astype(np.int64) // np.dtype(kind).itemsize
            ids = next(_packed(batch.column(2), kind), np.empty(0, kind))
            # a new file where rows are not consecutive or the file is full
            stops = np.cumsum(lengths)
            a = 0
            while a < len(seq):
                if now is None or seq[a] != due or now.n >= FILE:
                    if now is not None:
                        done.append(now.close())
                    now = _Writer(folder, own, crc, int(seq[a]))
                gaps = np.flatnonzero(np.diff(seq[a:]) != 1)
                b = a + int(gaps[0]) + 1 if len(gaps) else len(seq)
                before = int(stops[a - 1]) if a else 0
                b = min(b, max(a + 1, int(np.searchsorted(stops, before + FILE - now.n, side="right"))))
                now.add(keys[a:b], nulls[a:b], lengths[a:b], ids[before : int(stops[b - 1])])
                due, a = int(seq[b - 1]) + 1, b
        if now is not None:
            done.append(now.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=["path", "first_seq", "n_docs", "n_ids", "n_bytes"])

    manifest = f"{folder}/manifest"
    tokens.select("seq", "key", "ids").mapInArrow(run, MANIFEST).write.parquet(manifest)
    return spark.read.schema(MANIFEST).parquet(manifest)


# reading


def _footer(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    system, at = _files(path)
    with system.open_input_file(at) as file:
        end = file.size()
        if file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{path} is no token file")
        n, crc = struct.unpack("<qI", file.read_at(12, end - 12))
        packed = file.read_at(n, end - 12 - n)
    if zlib.crc32(packed) != crc:
        raise ValueError(f"the footer of {path} is damaged")
    data = zlib.decompress(packed)
    docs, parts, shares_crc = struct.unpack_from("<qqI", data)
    keys = np.frombuffer(data, "<i8", docs, 20)
    nulls = np.frombuffer(data, "u1", docs, 20 + 8 * docs)
    lengths = np.frombuffer(data, "<i8", docs, 20 + 9 * docs)
    return keys, nulls, lengths, np.frombuffer(data, "<i8", parts * 5, 20 + 17 * docs).reshape(-1, 5), shares_crc


def parts_of(manifest: DataFrame) -> DataFrame:
    """One row for each part in which a document begins: its documents and what to read for them.

    The list of files (not of documents) passes through the driver, which adds up their ids.
    """
    spark = manifest.sparkSession
    base, files = 0, []
    for r in sorted(manifest.select("path", "first_seq", "n_ids").toLocalIterator(), key=lambda r: r["first_seq"]):
        files.append((r["path"], base))
        base += r["n_ids"]
    listed = spark.createDataFrame(files, "path string, base long").repartition(max(1, min(len(files), TASKS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys, nulls, lengths, parts, crc = _footer(path)
                begins, ends = np.cumsum(lengths) - lengths, np.cumsum(parts[:, 2])
                lows = ends - parts[:, 2]
                first = np.searchsorted(begins, lows)
                last = np.append(first[1:], len(begins))
                made = []
                for k in np.flatnonzero(last > first).tolist():
                    a, b = int(first[k]), int(last[k])
                    stop = int(np.searchsorted(ends, begins[b - 1] + lengths[b - 1])) + 1
                    wanted = [dict(zip(("at", "bytes", "n", "lanes", "crc"), p, strict=True)) for p in parts[k:stop].tolist()]
                    made.append((path, start + int(begins[a]), keys[a:b].tolist(), nulls[a:b].astype(bool).tolist(), lengths[a:b].tolist(), int(begins[a] - lows[k]), wanted, crc))
                if made:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, m, strict=True)) for m in made], schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(spark.createDataFrame([], PARTS).schema)
    # a part's row is small and its work is not, so the number of tasks follows the ids
    return listed.mapInArrow(run, PARTS).repartition(max(1, min(base // READ, TASKS)))


def read(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """key, start (ids of all documents before), n_tokens and ids_crc32 (of ids as 32-bit integers) of every document.

    with_ids: also its ids, packed as little-endian 32-bit integers.
    """
    parts = parts_of(spark.read.schema(MANIFEST).parquet(f"{folder}/manifest"))
    fields = "key long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _files(f"{folder}/shares")
        with system.open_input_file(path) as file:
            packed = file.read()
        table, crc = _unpacked(packed), zlib.crc32(packed)
        for batch in batches:
            for row in batch.to_pylist():
                if row["shares"] != crc:
                    raise ValueError(f"{row['path']} was written with other shares")
                yield _documents(row, table, with_ids)

    return parts.mapInArrow(run, fields)


def _documents(row: dict, table: rans.Table, with_ids: bool) -> pa.RecordBatch:
    system, path = _files(row["path"])
    waiting, sums, kept = list(row["parts"]), [], []
    with system.open_input_file(path) as file:
        now = np.empty(0, np.uint32)

        def more() -> np.ndarray:
            p = waiting.pop(0)
            data = file.read_at(p["bytes"], p["at"])
            if zlib.crc32(data) != p["crc"]:
                raise ValueError(f"a part of {row['path']} is damaged")
            return rans.decode(data, p["n"], p["lanes"], table)

        skip = row["skip"]
        for n in row["lengths"]:
            while skip > len(now) or (not len(now) and n):
                skip -= len(now)
                now = more()
            now, skip = now[skip:], 0
            total, own = 0, []
            while n:
                if not len(now):
                    now = more()
                data = now[:n].astype("<u4").tobytes()
                total = zlib.crc32(data, total)
                if with_ids:
                    own.append(data)
                n, now = n - min(n, len(now)), now[n:]
            sums.append(total)
            kept.append(b"".join(own))
    lengths = np.array(row["lengths"], np.int64)
    columns = {
        "key": pa.array(row["keys"], pa.int64(), mask=np.array(row["nulls"], bool)),
        "start": pa.array(row["base"] + np.cumsum(lengths) - lengths),
        "n_tokens": pa.array(lengths),
        "ids_crc32": pa.array(sums, pa.int64()),
    }
    if with_ids:
        columns["ids"] = pa.array(kept, pa.binary())
    return pa.RecordBatch.from_pydict(columns)


def store(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, end: int = 0, folder: str | None = None) -> str:
    """Write the ids of all documents, in ascending order of the key, to files below a new shared folder; its path."""
    folder = _under(folder or f"{shared_folder(docs.sparkSession)}/tokens")
    tokens = tokenise(docs, key, text, vocabulary, end)
    kind = width(vocabulary, end)
    write(tokens, shares(tokens, kind), folder, kind)
    return folder
