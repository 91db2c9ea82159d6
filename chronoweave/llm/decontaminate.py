"""Benchmark decontamination by Wu-Manber search over word codes.

Every window of `width` consecutive words of a benchmark item is a pattern; an item of fewer words, but not
none, is one pattern. Patterns of one length form a group. A group has a shift table, indexed by the hash of a
block of two words: how far the search may move when it sees that block at the end of its window. Blocks that
no pattern holds allow the longest move, so most positions are never looked at. Where the shift is 0, the hash
of the block selects the bucket of patterns that end so, and word codes are compared directly.

Defined cases: null and empty texts have no words and are clean; repeated rows each get their own result; an
item with a null id or no words matches nothing; items that share an id count once; an empty benchmark leaves
every document clean. Columns beside id and text are neither read nor able to clash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.session import cut_lineage

from .rows import annotate, long, name, plain_words, structs

BLOCK = 2
LANE = 256
#: A block of the query set holds so many distinct windows at most; it is what one broadcast carries.
BLOCK_WINDOWS = 200_000

FOUND = (
    long("n_words"),
    structs("hits", long("start"), long("end")),
    T.StructField("items", T.ArrayType(T.StringType())),
)


class Group:
    """Patterns of one length."""

    def __init__(self, patterns: np.ndarray, ids: np.ndarray):
        self.length = m = patterns.shape[1]
        self.block = b = min(BLOCK, m)
        self.mask = (1 << max(10, int(np.ceil(np.log2(8 * patterns.size + 1))))) - 1
        # a shift is at most a window's length, so one byte holds it: 16 MB for 200,000 windows of 10 words
        kind = np.int8 if m < 128 else np.int32
        self.shift = np.full(self.mask + 1, m - b + 1, kind)
        for end in range(b - 1, m):
            np.minimum.at(self.shift, self._block(patterns, end), kind(m - 1 - end))
        keys = self._keys(patterns)
        order = np.argsort(keys, kind="stable")
        self.keys, self.patterns, self.ids = keys[order], patterns[order], ids[order]
        runs = np.unique(self.keys, return_counts=True)[1]
        self.longest = int(runs.max()) if len(runs) else 0

    def _block(self, codes: np.ndarray, end) -> np.ndarray:
        """Hash of the block that ends in column `end` of rows of codes."""
        last = codes[..., end].astype(np.int64)
        if self.block == 1:
            return (last * 0x9E3779B1) & self.mask
        return (codes[..., end - 1].astype(np.int64) * 0x85EBCA77 + last * 0x9E3779B1) & self.mask

    def _keys(self, rows: np.ndarray) -> np.ndarray:
        """The suffix block's hash above a hash of the whole window: a bucket, and the order in it."""
        whole = np.zeros(len(rows), np.uint64)
        for j in range(self.length):
            whole = whole * np.uint64(0x9E3779B97F4A7C15) + rows[:, j].astype(np.uint64)
        return (self._block(rows, self.length - 1).astype(np.uint64) << np.uint64(34)) | (whole >> np.uint64(30))

    def search(self, codes: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start positions in codes and pattern ids of all occurrences within documents that start at `first`."""
        m, none = self.length, np.zeros(0, np.int64)
        lanes = np.where(size >= m, -(-(size - m + 1) // LANE), 0)
        if not lanes.sum():
            return none, none
        nth = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = np.repeat(first, lanes) + nth * LANE + m - 1
        stop = np.minimum(at + LANE, np.repeat(first + size, lanes))
        found = []
        while at.size:
            last = codes[at].astype(np.int64)
            h = last * 0x9E3779B1 if self.block == 1 else codes[at - 1].astype(np.int64) * 0x85EBCA77 + last * 0x9E3779B1
            step = self.shift[h & self.mask]
            found.append(at[step == 0])
            at = at + np.maximum(step, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        start = np.concatenate(found) - m + 1
        rows = codes[start[:, None] + np.arange(m)]
        keys = self._keys(rows)
        place = np.searchsorted(self.keys, keys)
        starts, ids = [none], [none]
        for _ in range(self.longest):
            near = np.minimum(place, len(self.keys) - 1)
            on = (place < len(self.keys)) & (self.keys[near] == keys)
            if not on.any():
                break
            same = on.copy()
            same[on] = (self.patterns[near[on]] == rows[on]).all(axis=1)
            starts.append(start[same])
            ids.append(self.ids[near[same]])
            place = place + 1
        return np.concatenate(starts), np.concatenate(ids)


class Searcher:
    """A block of windows, compiled. windows: (words joined by spaces, ids of its items)."""

    def __init__(self, windows: list[tuple[bytes, list[str]]]):
        self.code: dict[bytes, int] = {}
        self.items = [items for _, items in windows]
        by_length: dict[int, list[tuple[list[int], int]]] = {}
        for i, (window, _) in enumerate(windows):
            codes = [self.code.setdefault(w, len(self.code) + 1) for w in window.split()]
            by_length.setdefault(len(codes), []).append((codes, i))
        self.groups = [
            Group(np.array([c for c, _ in found], np.int32), np.array([i for _, i in found], np.int64))
            for found in by_length.values()
        ]

    def __call__(self, texts: list[bytes | None]) -> tuple[list, list, list]:
        parts, get = [], self.code.get
        for text in texts:
            words = plain_words(text)
            parts.append(np.fromiter((get(w, 0) for w in words), np.int32, len(words)))
        size = np.array([len(p) for p in parts], np.int64)
        codes = np.concatenate([*parts, np.zeros(1, np.int32)])
        first = np.cumsum(size) - size
        edge = np.zeros(len(codes) + 1, np.int64)
        items: list[set[str]] = [set() for _ in texts]
        for group in self.groups:
            starts, ids = group.search(codes, first, size)
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + group.length, -1)
            docs = np.searchsorted(first, starts, "right") - 1
            for doc, i in set(zip(docs.tolist(), ids.tolist(), strict=True)):
                items[doc].update(self.items[i])
        hit = np.cumsum(edge[: len(codes)]) > 0
        spans = []
        for f, n in zip(first.tolist(), size.tolist(), strict=True):
            inside = hit[f : f + n]
            if not inside.any():
                spans.append([])
                continue
            turns = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
            spans.append([{"start": a, "end": b} for a, b in turns.reshape(-1, 2).tolist()])
        return size.tolist(), spans, [sorted(x) for x in items]


def windows_of(benchmark: DataFrame, item_id: str, text: str, width: int) -> DataFrame:
    """Distinct windows with the ids of the items that hold them."""

    def make():
        def cut(texts):
            out = []
            for t in texts:
                w = plain_words(t)
                out.append(list({b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))}) if w else [])
            return (out,)

        return cut

    cut = annotate(
        benchmark.where(F.col(name(item_id)).isNotNull()), text, make,
        [T.StructField("windows", T.ArrayType(T.BinaryType()))], keep=[item_id],
    )
    each = cut.select(F.col("row")[item_id].cast("string").alias("item"), F.explode("windows").alias("window"))
    return each.groupBy("window").agg(F.collect_set("item").alias("items"))


def merge_spans(spans: list[dict]) -> list[dict]:
    """Union of half-open spans that may touch or overlap."""
    out: list[dict] = []
    for x in sorted(spans, key=lambda s: s["start"]):
        if out and x["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], x["end"])
        else:
            out.append({"start": x["start"], "end": x["end"]})
    return out


def find_benchmark(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = 10,
    keep: list[str] | None = None,
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """row, n_words, hits (runs of hit words, half open) and items (sorted as strings) for each row of docs.

    The benchmark is the query set: its windows are counted, and a set beyond `block_windows` is searched for in
    blocks, each of which reads all documents and is written before the next, so that a task holds one block.
    Documents are not shuffled.
    """
    spark = docs.sparkSession
    windows = cut_lineage(windows_of(benchmark, item_id, item_text, width))
    blocks = max(1, -(-windows.count() // block_windows))
    block_of = F.pmod(F.xxhash64("window"), F.lit(blocks))
    found = None
    for k in range(blocks):
        rows = [(bytes(r[0]), list(r[1])) for r in windows.where(block_of == k).collect()]
        shared = spark.sparkContext.broadcast(rows)

        def make(shared=shared):
            return Searcher(shared.value)

        if found is None:
            found = annotate(docs, text, make, FOUND, keep=None if blocks == 1 else docs.columns)
            if blocks == 1 and keep is not None:
                found = annotate(docs, text, make, FOUND, keep=keep)
            continue
        before = cut_lineage(found).select(
            F.struct("row", "hits", "items").alias("kept"), F.col("row")[text].alias("text")
        )
        again = annotate(before, "text", make, FOUND, keep=["kept"])
        old = F.col("row.kept")
        both = F.array_sort(F.concat(old["hits"], "hits"))
        merged = F.aggregate(
            both,
            F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"),
            lambda out, x: F.when(
                (F.size(out) > 0) & (F.try_element_at(out, F.lit(-1))["end"] >= x["start"]),
                F.concat(
                    F.slice(out, F.lit(1), F.size(out) - 1),
                    F.array(F.struct(
                        F.try_element_at(out, F.lit(-1))["start"].alias("start"),
                        F.greatest(F.try_element_at(out, F.lit(-1))["end"], x["end"]).alias("end"),
                    )),
                ),
            ).otherwise(F.concat(out, F.array(x))),
        )
        found = again.select(
            old["row"].alias("row"), "n_words", merged.alias("hits"),
            F.array_sort(F.array_union(old["items"], "items")).alias("items"),
        )
    if blocks > 1 and keep is not None:
        found = found.withColumn("row", F.struct(*[F.col("row")[c].alias(c) for c in keep]))
    return found


def n_hit() -> F.Column:
    """Words inside hits."""
    return F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, that hold no window of the benchmark."""
    found = find_benchmark(docs, benchmark, **options).where(F.size("hits") == 0)
    return found.select("row.*")
