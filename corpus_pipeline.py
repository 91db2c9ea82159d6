"""A pipeline over documents: each stage is written as Parquet and read again as the next one's documents.

Defined cases: null and empty texts are documents like others (they have no words, windows, secrets or tokens; of
several, whose fingerprints are all zero, the near-duplicate stage keeps one); rows of one id and text are one
document; ties between copies go to the smallest id; null ids rank behind all others and are never dropped for having
none; an empty table runs through to an empty result; further columns are carried along, whatever their names, up to
the last stage, which returns columns of its own. What a run wrote to the shared folder can be deleted once its result
has been written.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm import bpe, decontaminate, secret, simhash, toxicity
from chronoweave.session import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity scorer rejects go; it learns from all of `documents` that are labelled."""
    index = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, index).where(F.col("score") < 0.5).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one of the smallest id."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return secret.redact(docs, length="n_chars")


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, the number of them, and whether they decode to the text."""
    both = bpe.round_trip(docs)
    text = F.encode(F.coalesce(F.col("row.text"), F.lit("")), "utf-8")
    return both.select(
        "row.doc_id", "row.lang", "row.source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids",
        (F.col("decoded") == text).alias("round_trip"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scans", redact_secrets),
    ("byte_level_bpe", encode_tokens),
]

#: SQL cannot express the trained stages; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each made is written to the shared folder before the next reads it."""
    from chronoweave.session import shared_folder

    folder, docs = shared_folder(spark), table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return made
        path = os.path.join(folder, f"{i}_{name}")
        made.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return docs
