"""Vector expressions and exact search of a stated query set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector has no length."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def top_cosines(queries: DataFrame, rows: DataFrame, query: tuple[str, str], row: tuple[str, str], k: int, digits: int = 9, block: int = 1_000) -> DataFrame:
    """The k rows of the largest cosine for each query, itself left out; ties (after rounding) by id; and `rank`.

    query and row name the id (a long) and the vector. Queries are searched in blocks: about `block` of them are sent
    to the tasks at a time, by hash, and each task keeps the k best of its rows for each query of the block, so what is
    sent or gathered does not grow with the data. Rows of null vectors or of no length are nobody's neighbours.
    """
    (query_id, query_vector), (row_id, row_vector) = query, row
    ready = queries.select(F.col(query_id).cast("long").alias("q"), F.col(query_vector).cast("array<double>").alias("v")).where("v is not null and q is not null")
    blocks, found = max(1, -(-ready.count() // block)), None
    for i in range(blocks):
        part = ready.where(F.expr(f"pmod(xxhash64(q), {blocks})") == i).toArrow()
        shared = rows.sparkSession.sparkContext.broadcast((part["q"].to_numpy(), _matrix(part["v"].combine_chunks())))
        scored = rows.select(F.col(row_id).cast("long"), F.col(row_vector).cast("array<double>")).mapInArrow(_best(shared, k, digits), "q long, id long, score double")
        found = scored if found is None else found.unionAll(scored)
    w = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select(F.col("q").alias(query_id), F.col("id").alias(row_id), "score", "rank")


#: Rows that are scored against a block of queries at a time.
TILE = 512


def _matrix(vectors):
    """An Arrow array of lists of one length as numbers, a row each; no value becomes a Python object."""
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1) if len(vectors) else vectors.flatten().to_numpy(zero_copy_only=False).reshape(0, 1)


def _best(shared, k: int, digits: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        names, q = shared.value
        size = np.linalg.norm(q, axis=1)
        best_score, best_id = np.full((len(names), k), -np.inf), np.full((len(names), k), np.iinfo(np.int64).max)
        for batch in batches:
            known = pc.and_(pc.is_valid(batch.column(0)), pc.equal(pc.fill_null(pc.list_value_length(batch.column(1)), -1), q.shape[1]))
            for at in range(0, batch.num_rows, TILE):
                part = batch.slice(at, TILE).filter(known.slice(at, TILE))
                if not part.num_rows:
                    continue
                ids, v = part.column(0).to_numpy(), _matrix(part.column(1))
                with np.errstate(divide="ignore", invalid="ignore"):
                    score = np.round((q @ v.T) / (size[:, None] * np.linalg.norm(v, axis=1)[None, :]), digits)
                score[~np.isfinite(score) | (names[:, None] == ids[None, :])] = -np.inf
                if score.shape[1] > k:  # candidates: all that reach the k-th best
                    keep = score >= np.partition(score, -k, axis=1)[:, -k][:, None]
                    score = np.where(keep, score, -np.inf)
                score = np.concatenate([best_score, score], axis=1)
                each = np.concatenate([best_id, np.broadcast_to(ids, (len(names), len(ids)))], axis=1)
                order = np.lexsort((each, -score), axis=1)[:, :k]
                best_score, best_id = np.take_along_axis(score, order, 1), np.take_along_axis(each, order, 1)
        some = np.isfinite(best_score)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, some.sum(axis=1))), pa.array(best_id[some]), pa.array(best_score[some])], names=["q", "id", "score"])

    return run
