"""SimHash near-duplicates by tiled exact comparison.

A fingerprint has 64 bits. Distinct fingerprints are laid out in cells by the population counts of their four
16-bit quarters, and a cell is cut into tiles of bounded size. Two fingerprints that differ in at most `radius`
bits have population counts that differ by at most `radius` in sum over the quarters, so pairs of tiles whose
counts lie farther apart are never made; all others are compared in full by numpy exclusive-or and bit counts.
From each pair of tiles a spanning forest of its links is kept rather than all links; components of all forests
together are the components of all links, whatever the number of copies.

Defined cases: null, empty and blank texts have fingerprint 0, which is linked like any other; texts of fewer
words than a shingle are one shingle; equal texts, repeated rows included, share a fingerprint and so a
component. A null id never represents a component unless it has no other id; component_id is then null.
"""

from __future__ import annotations

from functools import partial
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.session import cut_lineage

from .graph import components
from .rows import annotate, long, name, spaced_words

SEED = 42
#: Fingerprints in a tile, about.
TILE = 2048
#: Shingle hashes whose bits are counted at a time.
CHUNK = 1 << 17


def shingle_hashes(text: bytes | None, width: int) -> np.ndarray:
    words = spaced_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([h(joined, SEED)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    stop = np.cumsum(size + 1) - 1
    starts, stops = (stop - size)[: len(words) - width + 1].tolist(), stop[width - 1 :].tolist()
    return np.array([h(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes set each bit, the highest first."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(hashes[i : i + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return counts


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """Bits set in over half of the shingles' hashes; 0 without words."""
    hashes = shingle_hashes(text, width)
    bits = bit_counts(hashes) * 2 > len(hashes)
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def _fingerprints(width: int):
    def signed(texts):
        return (pa.array(np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64)),)

    return signed


def fingerprints(docs: DataFrame, text: str = "text", width: int = 3, keep=None) -> DataFrame:
    """row and fingerprint (as a signed long) for each row of docs. No shuffle."""
    return annotate(docs, text, partial(_fingerprints, width), [long("fingerprint")], keep)


def _near(radius: int):
    """Cells within reach of another, as differences of the counts of the four quarters."""
    return [d for d in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, d)) <= radius]


def _forest(a: np.ndarray, b: np.ndarray, same: bool, radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links between a and b: each linked value to the least in its part."""
    left, right = [], []
    step = max(1, (1 << 20) // max(1, len(b)))
    for i in range(0, len(a), step):
        near = np.bitwise_count(a[i : i + step, None] ^ b[None, :]) <= radius
        x, y = np.nonzero(near)
        x += i
        if same:
            x, y = x[x < y], y[x < y]
        left.append(x)
        right.append(y)
    x, y = np.concatenate(left), np.concatenate(right)
    if not len(x):
        return []
    nodes = a if same else np.concatenate([a, b])
    y = y if same else y + len(a)
    label = np.arange(len(nodes))
    while True:  # the smaller label wins along every link; then labels of labels
        before = label.copy()
        least = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], least)
        np.minimum.at(label, label[y], least)
        np.minimum.at(label, x, least)
        np.minimum.at(label, y, least)
        label = label[label]
        if (before == label).all():
            break
    tied = np.flatnonzero(label != np.arange(len(nodes)))
    return list(zip(nodes[tied].tolist(), nodes[label[tied]].tolist(), strict=True))


def links(distinct: DataFrame, column: str, radius: int = 3, tile: int = TILE) -> DataFrame:
    """Edges (u, v) that connect exactly those distinct fingerprints that links of at most `radius` bits connect."""
    quarter = [f"bit_count(shiftrightunsigned(fp, {s}) & 65535)" for s in (48, 32, 16, 0)]
    cell = " + ".join(f"{17 ** (3 - i)} * {q}" for i, q in enumerate(quarter))
    placed = distinct.select(F.col(column).alias("fp")).withColumn("cell", F.expr(f"cast({cell} as int)"))
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n"))
    # 17 ** 4 cells at most, whatever the input: a few hundred kilobytes
    parts = cut_lineage(sizes.select("cell", F.ceil(F.col("n") / tile).cast("int").alias("parts")))
    tiles = cut_lineage(
        placed.join(F.broadcast(parts), "cell")
        .groupBy("cell", F.expr("cast(pmod(xxhash64(fp), parts) as int)").alias("part"))
        .agg(F.collect_list("fp").alias("fps"))
    )
    steps = F.array(*[F.struct(*[F.lit(x).alias(f"d{i}") for i, x in enumerate(d)]) for d in _near(radius)])
    own = [F.expr(f"cast(cell / {17 ** (3 - i)} as int) % 17") for i in range(4)]
    moved = [own[i] + F.col("d")[f"d{i}"] for i in range(4)]
    inside = F.lit(True)
    for m in moved:
        inside = inside & m.between(0, 16)
    to = sum((m * 17 ** (3 - i) for i, m in enumerate(moved)), F.lit(0))
    wanted = (
        tiles.select("cell", "part", F.explode(steps).alias("d"))
        .where(inside)
        .select("cell", "part", to.cast("int").alias("to"))
        .where(F.col("to") >= F.col("cell"))
        .join(F.broadcast(parts.select(F.col("cell").alias("to"), "parts")), "to")
        .select("cell", "part", "to", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("to_part"))
        .where((F.col("to") > F.col("cell")) | (F.col("to_part") >= F.col("part")))
    )
    pairs = (
        wanted.join(tiles.withColumnRenamed("fps", "a"), ["cell", "part"])
        .join(tiles.select(F.col("cell").alias("to"), F.col("part").alias("to_part"), F.col("fps").alias("b")), ["to", "to_part"])
        .select("a", "b", ((F.col("cell") == F.col("to")) & (F.col("part") == F.col("to_part"))).alias("same"))
    )
    schema = T.StructType([long("u"), long("v")])

    def compare(batches):
        for batch in batches:
            a, b, same = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            edges = []
            for i in range(batch.num_rows):
                x, y = (np.asarray(c[i].values.to_numpy()).view(np.uint64) for c in (a, b))
                edges += _forest(x, y, same[i], radius)
            found = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["u", "v"])

    return pairs.mapInArrow(compare, schema)


def near_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, radius: int = 3, tile: int = TILE) -> DataFrame:
    """doc_id, fingerprint (signed long) and component_id, the smallest id reachable, for each row of docs."""
    prints = cut_lineage(
        fingerprints(docs, text, width, keep=[doc_id]).select(F.col("row")[doc_id].alias("doc_id"), "fingerprint")
    )
    return prints.join(_roots(prints, radius, tile), "fingerprint").select("doc_id", "fingerprint", "component_id")


def _roots(prints: DataFrame, radius: int, tile: int) -> DataFrame:
    """component_id for each distinct fingerprint."""
    distinct = cut_lineage(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct, "fingerprint", radius, tile))
    linked = cut_lineage(roots.join(distinct, roots["node"] == distinct["fingerprint"]).select("node", "root", "least"))
    first = linked.groupBy("root").agg(F.min("least").alias("first"))
    known = linked.join(first, "root").select(F.col("node").alias("fingerprint"), "first")
    # written, so that the join with all documents is between two plain shuffles, whose hot parts Spark can split
    return cut_lineage(
        distinct.join(known, "fingerprint", "left").select(
            "fingerprint", F.coalesce("first", "least").alias("component_id")
        )
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, radius: int = 3, tile: int = TILE) -> DataFrame:
    """The rows of docs, all columns, with one document of each component: the one of the smallest id.

    Rows that repeat both id and fingerprint of the one that stays are the same document; one of them stays.
    Rows are told apart by two 64-bit hashes of id and text, so fingerprints are made once.
    """
    key = [F.xxhash64(F.col(name(doc_id)), F.col(name(text))).alias("key1"), F.xxhash64(F.lit(1), F.col(name(text)), F.col(name(doc_id))).alias("key2")]
    keyed = docs.select(F.struct(*[F.col(name(c)) for c in docs.columns]).alias("row"), *key)
    plain = docs.select(F.col(name(doc_id)).alias("doc_id"), F.col(name(text)).alias("text"), *key)
    made = fingerprints(plain, "text", width, keep=["doc_id", "key1", "key2"])
    prints = cut_lineage(made.select("row.doc_id", "fingerprint", "row.key1", "row.key2"))
    # among rows of the smallest id with differing texts, the smallest key stays; one row of a key
    chosen = (
        prints.join(_roots(prints, radius, tile), "fingerprint")
        .withColumn("place", F.struct("component_id", F.when(F.col("component_id").isNull(), F.col("fingerprint")).alias("fingerprint")))
        .where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy("place")
        .agg(F.min(F.struct("key1", "key2")).alias("k"))
        .select("k.key1", "k.key2")
    )
    kept = keyed.join(chosen, ["key1", "key2"], "left_semi")
    first = F.first(F.col("row")).alias("row")
    return kept.groupBy("key1", "key2").agg(first).select("row.*")
