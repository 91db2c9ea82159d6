"""Ranking and choice: first matches, top rows, greedy suppression, candidates with reuse, resolved decisions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def top(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key; Spark ranks within tasks before rows are shuffled."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def best(df: DataFrame, keys: Sequence[str], order: Column, columns: Sequence[str]) -> DataFrame:
    """One row for each key: the columns of the row of the largest order."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("_b")).select(*keys, "_b.*")


def suppress_overlaps(df: DataFrame, keys: Sequence[str], order: Sequence[str], t0: str = "t0", t1: str = "t1", reach=None) -> DataFrame:
    """Rows in their order within each key, keeping one if it shares no time with any kept before it.

    Only kept rows suppress, so the answer hangs on the whole order. Rows that cannot meet through any chain of
    overlaps are apart: each key's time is first cut where nothing overlaps, and a cut piece, not a key, is a group.
    """
    from .series import islands

    w = Window.partitionBy(*keys).orderBy(t0, t1)
    far = F.max(t1).over(w.rowsBetween(Window.unboundedPreceding, -1))
    pieces = islands(df.withColumn("_far", far), keys, [t0, t1], F.col(t0) >= F.col("_far")).drop("_far")
    schema, columns = df.schema, df.columns

    def keep(table: pa.Table) -> pa.Table:
        import bisect

        rows = table.select(columns)
        sort = rows.sort_by([(c.lstrip("-"), "descending" if c.startswith("-") else "ascending") for c in order])
        a, b, kept, starts, ends = sort[t0].to_pylist(), sort[t1].to_pylist(), [], [], []
        for i, (x, y) in enumerate(zip(a, b, strict=True)):
            at = bisect.bisect_right(starts, x)
            if (at == 0 or ends[at - 1] <= x) and (at == len(starts) or starts[at] >= y):
                kept.append(i)
                starts.insert(at, x)
                ends.insert(at, y)
        return sort.take(pa.array(kept, pa.int64()))

    # a piece of one row is kept as it is; only rows that meet others go to Python
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys, "island"))
    sized = pieces.withColumn("_size", size)
    met = sized.where("_size > 1").drop("_size").groupBy(*keys, "island").applyInArrow(keep, schema)
    return sized.where("_size = 1").select(*columns).unionByName(met)


def rank_candidates(df: DataFrame, keys: Sequence[str], t0: str = "t0", t1: str = "t1") -> DataFrame:
    """Candidates with an ok verdict by score (standalone and strength), tighter room, start and id, with those
    left out that overlap a better one of their kind; `rank` counts from 1. A room that isn't known counts as 0."""
    scored = df.where("verdict_status = 'ok'").withColumns(
        {"score": F.col("standalone") + F.col("strength"), "room": F.least(F.coalesce("head_room", F.lit(0.0)), F.coalesce("tail_room", F.lit(0.0)))}
    )
    kept = suppress_overlaps(scored, keys, ["-score", "-room", t0, "id"], t0, t1)
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("room"), t0, "id")))


PLACEHOLDER_SCORE = 2.5


def choose(picks: DataFrame, candidates: DataFrame, film: Sequence[str]) -> DataFrame:
    """A shot for each pick: `shot`, `status` (ok or unchecked), `note`.

    picks: film, ord, pick, bare (needs none). candidates: film, pick, i, shot, score (null: not judged), accepted,
    barred, placeholder. A shot's score is lessened by 0.75 for each use beyond the first by picks before it, so a
    film's picks are walked in order; they stream through a task, sorted, and only the uses of one film are held.
    """
    if not film:
        raise ValueError("picks of a film are walked in order: name the columns of the film")
    # what hangs on no other pick is settled in the plan: scores, and why a pick has nothing to choose from
    score = F.when(F.col("placeholder"), F.lit(PLACEHOLDER_SCORE)).when(F.col("accepted"), F.col("score").cast("double"))
    free = candidates.where(~F.coalesce("barred", F.lit(False))).select(*film, "pick", F.struct("i", "shot", score.alias("score")).alias("_o"))
    per = free.groupBy(*film, "pick").agg(F.array_sort(F.collect_list(F.when(F.col("_o.score").isNotNull(), F.col("_o")))).alias("_options"))
    note = F.when(F.col("bare"), "bare by choice").when(F.col("_options").isNull(), "no candidate").when(F.size("_options") == 0, "no verdict accepted")
    ready = picks.join(per, [*film, "pick"], "left").select(*film, "ord", "pick", note.alias("note"), F.transform("_options", lambda o: o["shot"]).alias("shots"), F.transform("_options", lambda o: o["score"]).alias("scores"))
    schema = T.StructType([*[picks.schema[c] for c in film], picks.schema["pick"]] + [T.StructField(c, T.StringType()) for c in ("shot", "status", "note")])
    n = len(film)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        types = to_arrow_schema(schema)
        uses: dict[str, int] = {}
        now = None
        for batch in batches:
            keys, shots, notes = [batch.column(i).to_pylist() for i in range(n)], [], []
            for key, why, names, scores in zip(zip(*keys, strict=True), *[batch.column(i).to_pylist() for i in range(n + 2, n + 5)], strict=True):
                if key != now:
                    uses, now = {}, key
                shot = None
                if why is None:
                    best = None
                    for name, given in zip(names, scores, strict=True):  # the first of equals
                        left = given - 0.75 * max(0, uses.get(name, 0) - 1)
                        if best is None or left > best:
                            best, shot = left, name
                    why = ""
                    if best < 1:
                        shot, why = None, "best is under 1"
                    else:
                        uses[shot] = uses.get(shot, 0) + 1
                shots.append(shot)
                notes.append(why)
            status = ["unchecked" if x == "no verdict accepted" else "ok" for x in notes]
            made = [pa.array(c, types.field(x).type) for x, c in (("shot", shots), ("status", status), ("note", notes))]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(n)], batch.column(n + 1), *made], names=types.names)

    return ready.repartition(*film).sortWithinPartitions(*film, "ord").mapInArrow(walk, schema)


TECHNICAL = ["motion blur", "shaky", "soft focus", "dead frame"]


def feedback(stretches: DataFrame) -> DataFrame:
    """What a scorecard says of each pick and clip: keep, bad, barred for the whole film (any pick).

    stretches: pick, clip, kind, score, technical. A clip is kept for a pick if its only stretch is a video scored
    3; bad where one scored 1 or less; barred where one scored 0 for a technical fault.
    """
    per = stretches.groupBy("pick", "clip").agg(
        F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high"), F.bool_and(F.col("kind") == "video").alias("video")
    )
    barred = stretches.where((F.col("score") == 0) & F.col("technical").isin(*TECHNICAL)).select("clip").distinct().withColumn("barred", F.lit(True))
    out = per.join(barred, "clip", "left")
    return out.select("pick", "clip", ((F.col("n") == 1) & (F.col("high") == 3) & F.col("video")).alias("keep"), (F.col("low") <= 1).alias("bad"), F.coalesce("barred", F.lit(False)).alias("barred"))


def resolve_rules(rules: DataFrame) -> DataFrame:
    """rules (id, ord, topic, decided, status, supersedes) with `why` they are retired; null for the active ones.

    Rules marked superseded, and those named by any rule, are out, whoever names them; of the rest, the latest
    decision on a topic stays (the later listed of equals). A rule without a topic is its own.
    """
    named = rules.select(F.col("id").alias("_by"), "decided", F.explode("supersedes").alias("_old"))
    by = named.groupBy("_old").agg(F.max_by(F.concat(F.lit("superseded by "), "_by"), F.struct("decided", "_by")).alias("_super"))
    marked = rules.join(by, rules["id"] == by["_old"], "left").drop("_old")
    out = F.coalesce("_super", F.when(F.col("status") == "superseded", "marked superseded"))
    live = marked.withColumn("_out", out).withColumn("_topic", F.coalesce("topic", "id"))
    last = live.where("_out is null").groupBy("_topic").agg(F.max_by("id", F.struct(F.coalesce("decided", F.lit("")), "ord")).alias("_winner"))
    done = live.join(last, "_topic", "left")
    lost = F.when(F.col("_winner") != F.col("id"), F.concat(F.lit("later decision "), F.col("_winner")))
    return done.select(*rules.columns, F.coalesce("_out", lost).alias("why"))


def attach_by_vocabulary(items: DataFrame, picks: DataFrame, keys: Sequence[str], item_id: str, item_words: str, pick_words: str, order: str) -> DataFrame:
    """Each item with the pick of its keys that shares most words of more than three letters; the first of equals."""
    long = lambda c: F.filter(F.array_distinct(F.col(c)), lambda w: F.length(w) > 3)
    met = items.select(*keys, item_id, long(item_words).alias("_a")).join(picks.select(*keys, "pick", order, long(pick_words).alias("_b")), list(keys))
    shared = met.withColumn("shared", F.size(F.array_intersect("_a", "_b")))
    return shared.groupBy(*keys, item_id).agg(F.max_by(F.struct("pick", "shared"), F.struct("shared", -F.col(order))).alias("_p")).select(*keys, item_id, "_p.*")
