"""Exact substring dedup by hashing lines.

A unit is a line (or whatever `separator`, a fixed string, separates: two line breaks for paragraphs). It is
normalised (ASCII lower case, white space runs to one space, ends trimmed) and hashed; digests of all documents are grouped, the occurrence of the lowest rank (id,
then offset) stays, and every other occurrence is removed from its text. Every unit that is not blank counts;
`least_words` can leave shorter ones alone. What is removed is reported with its code point offsets in the text as it was, separator
included, so that the original can be cut again.

Digests are 128 bits. Occurrences are counted before they are shuffled, only digests that occur again are joined
back, and that join has one row for each digest on its right, written before, so Spark can split a hot one. Each row of the
input is told from its repeats by the hash of its id and text: rows that repeat both are one document, kept once
whole under the same rules (their units count once), so repeats of a row get equal results.

Defined cases: null and empty texts have no units; a null id ranks after all others; very long texts have many
units and nothing else; extra columns are untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.session import cut_lineage

from .rows import annotate, long, name, string, structs

LEAST_WORDS = 1


def _unit_maker(least_words: int, separator: str):
    import xxhash

    from .rows import LOWER

    def make():
        def units(texts):
            out = []
            for text in texts:
                found, at = [], 0
                for line in text.split(separator) if text else []:
                    words = line.encode("utf-8", "replace").translate(LOWER).split()
                    if len(words) >= max(1, least_words):
                        digest = xxhash.xxh3_128_intdigest(b" ".join(words))
                        found.append({"high": (digest >> 64) - (1 << 63), "low": (digest & ((1 << 64) - 1)) - (1 << 63), "start": at, "end": at + len(line)})
                    at += len(line) + len(separator)
                out.append(found)
            return (out,)

        return units

    return make


def units(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS, separator: str = "\n") -> DataFrame:
    """doc_id, key1, key2 (of id and text), high, low (the digest), start and end of every unit."""
    keyed = docs.select(F.col(name(doc_id)).alias("doc_id"), F.col(name(text)).cast("string").alias("text")).select("doc_id", "text", *_keys("doc_id", "text"))
    fields = [structs("units", long("high"), long("low"), long("start"), long("end"))]
    made = annotate(keyed, "text", _unit_maker(least_words, separator), fields, keep=["doc_id", "key1", "key2"], binary=False)
    return made.select("row.*", F.explode("units").alias("u")).select("doc_id", "key1", "key2", "u.*")


def _keys(doc_id: str, text: str) -> list[F.Column]:
    return [F.xxhash64(doc_id, text).alias("key1"), F.xxhash64(F.lit(1), text, doc_id).alias("key2")]


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS, separator: str = "\n") -> DataFrame:
    """doc_id, key1, key2, spans (start, end) of the units to remove from each document that has any."""
    each = cut_lineage(units(docs, doc_id, text, least_words, separator))
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "key1", "key2", "start")
    # written, so that the join is between two plain shuffles, whose hot parts Spark can split
    first = cut_lineage(each.groupBy("high", "low").agg(F.min(rank).alias("first"), F.max(rank).alias("last")).where("first != last").drop("last"))
    later = each.join(first, ["high", "low"]).where(rank != F.col("first"))
    return later.groupBy("doc_id", "key1", "key2").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))


def _cutter(width: int):
    def cut(texts):
        out, kept = [], []
        for packed in texts:
            spans, _, text = packed.partition("\0")
            spans = [tuple(map(int, s.split(":"))) for s in spans.split(",") if s]
            parts, at, full = [], 0, []
            for a, b in spans:
                parts.append(text[at:a])
                at = min(len(text), b + width)
                full.append({"start": a, "end": at})
            kept.append("".join([*parts, text[at:]]))
            out.append(full)
        return out, kept

    return cut


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS, separator: str = "\n") -> DataFrame:
    """row, removed (start, end of each removed unit with its separator) and kept (what is left of the text)."""
    spans = repeats(docs, doc_id, text, least_words, separator).drop("doc_id")
    keyed = docs.select(F.struct(*[F.col(name(c)) for c in docs.columns]).alias("doc"), F.xxhash64(F.col(name(doc_id)), F.col(name(text)).cast("string")).alias("key1"), F.xxhash64(F.lit(1), F.col(name(text)).cast("string"), F.col(name(doc_id))).alias("key2"))
    joined = keyed.join(spans, ["key1", "key2"], "left")
    places = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    packed = joined.select("doc", F.concat(F.coalesce(places, F.lit("")), F.lit("\0"), F.coalesce(F.col("doc")[text].cast("string"), F.lit(""))).alias("packed"))
    made = annotate(packed, "packed", lambda: _cutter(len(separator)), [structs("removed", long("start"), long("end")), string("kept")], keep=["doc"], binary=False)
    return made.select(F.col("row.doc").alias("row"), "removed", F.when(F.col("row.doc")[text].isNotNull(), F.col("kept")).alias("kept"))
