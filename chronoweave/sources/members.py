"""JSON objects of any size, read by their members in many tasks.

Where a member begins cannot be seen from the middle of a file: a brace may stand inside a string. So each chunk is
first looked at twice at once, as if it began outside and inside a string, and only tells how the depth and the quotes
change. What holds at the beginning of each chunk follows from adding these up; then every chunk cuts out the members
that begin in it, reading on where the last one ends in a later chunk.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a chunk.
CHUNK = 8 << 20


def _open(uri: str):
    from pyarrow import fs

    if "://" not in uri:
        uri = os.path.abspath(uri.removeprefix("file:"))
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def _slashes_before(file, at: int) -> int:
    """How many backslashes stand right before a place."""
    n, step = 0, 64
    while at > n:
        data = file.read_at(min(step, at - n), max(0, at - n - step))
        kept = len(data.rstrip(b"\\"))
        n += len(data) - kept
        if kept:
            break
        step *= 2
    return n


def _marks(data: np.ndarray, slashes: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of quotes up to and with each byte, change of depth at each byte as if no string were open)."""
    n = len(data)
    place = np.arange(n)
    plain = np.maximum.accumulate(np.where(data != 92, place, -1))
    before = np.empty(n, np.int64)  # backslashes right before each byte
    if n:
        before[0] = slashes
        before[1:] = place[:-1] - plain[:-1]
        before[1:][plain[:-1] < 0] += slashes
    quotes = np.cumsum((data == 34) & (before % 2 == 0))
    depth = np.isin(data, [123, 91]).astype(np.int8) - np.isin(data, [125, 93]).astype(np.int8)
    return quotes, depth


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            with _open(r["path"]) as file:
                quotes, depth = _marks(np.frombuffer(file.read_at(r["size"], r["at"]), np.uint8), _slashes_before(file, r["at"]))
            odd = quotes % 2 == 1
            rows.append({**r, "quotes": int(quotes[-1] % 2), "outside": int(depth[~odd].sum()), "inside": int(depth[odd].sum())})
        yield pa.RecordBatch.from_pylist(rows)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            with _open(r["path"]) as file:
                total, at, size, open_, depth = file.size(), r["at"], r["size"], r["string"], r["depth"]
                members, begun, own = [], None, True
                while at < total and (own or begun is not None):
                    data = file.read_at(size, at)
                    b = np.frombuffer(data, np.uint8)
                    quotes, change = _marks(b, _slashes_before(file, at))
                    outside = (quotes + open_) % 2 == 0
                    after = depth + np.cumsum(np.where(outside, change, 0))
                    first = outside & (b == 123) & (after == 1)
                    comma = outside & (b == 44) & (after == 1)
                    last = outside & (b == 125) & (after == 0)
                    held = 0  # where the open member goes on in this chunk
                    for i in np.flatnonzero(first | comma | last).tolist():
                        if begun is not None:
                            members.append(b"".join([*begun, data[held:i]]))
                            begun = None
                            if not own:
                                break
                        if own and not last[i]:
                            begun, held = [], i + 1
                    if begun is not None:
                        begun.append(data[held:])
                    open_, depth, at, own = int(quotes[-1] + open_) % 2, int(after[-1]), at + len(data), False
            found = [b"{" + m + b"}" for m in members if m.strip()]
            yield pa.RecordBatch.from_arrays([pa.array([r["path"]] * len(found), pa.string()), pa.array([m.decode() for m in found], pa.string())], names=["path", "member"])


def keyed_members(spark: SparkSession, path: str, value: str, chunk: int = CHUNK) -> DataFrame:
    """The members (key, value) of JSON objects as `tables.keyed_json` gives them, each file read in as many tasks as it has chunks.

    value: the schema of each member; one that does not fit is null. An empty object has no members; members of one
    key stay apart. What passes through the driver is one row for each chunk.
    """
    listed = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("total")).where("total > 0")
    starts = listed.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1, F.lit(chunk).cast("long"))).alias("at"), "total")
    chunks = starts.select("path", "at", F.least(F.lit(chunk).cast("long"), F.col("total") - F.col("at")).alias("size"))
    n = max(1, chunks.count())
    schema = "path string, at long, size long, quotes long, outside long, inside long"
    seen = chunks.repartition(min(n, 10_000)).mapInArrow(_summaries, schema).collect()
    states, now = [], (None, 0, 0)
    for r in sorted(seen, key=lambda r: (r["path"], r["at"])):
        _, string, depth = now if now[0] == r["path"] else (r["path"], 0, 0)
        states.append((r["path"], r["at"], r["size"], string, depth))
        now = (r["path"], (string + r["quotes"]) % 2, depth + (r["inside"] if string else r["outside"]))
    told = spark.createDataFrame(states, "path string, at long, size long, string int, depth int")
    members = told.repartition(min(n, 10_000)).mapInArrow(_cut, "path string, member string")
    return members.select(F.explode(F.from_json("member", f"map<string,{value}>"))).toDF("key", "value")
