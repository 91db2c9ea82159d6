"""Repair of the turn order of conversations at the least cost.

A repaired conversation is an optional system message and then pairs of user and assistant, or nothing. Messages are
kept (free), given the other role, deleted, or inserted; blank and repeated ones have to go. What the messages so far
left open is one of four states, so a block of messages is a 4 x 4 matrix of least costs.

1. All messages are sorted by conversation and turn over ranges, so a large conversation lies in many tasks. Blocks of
   at most BLOCK consecutive messages are solved alone.
2. Costs: a conversation of several blocks multiplies their matrices (least sums), backwards, so that every block
   knows what each of its end states costs from there on. Then each block finds the cost of every node (message,
   state) and the optimal arcs.
3. Ranks: nodes are ranked by the first letter of their audit, then of the first two, four, eight letters and so on: a
   node's rank for twice the length is the rank of the pair of its own rank and that of the node its pointer leads to,
   and pointers are doubled. Among optimal arcs the least letter wins, then the rank of the node behind. (From one
   node, a letter leads to one node.) The path from the first node is read off the doubled pointers.
4. The states in which blocks begin are passed on from block to block, and the audits of blocks are joined.

Defined cases: a null role or text is one space, a null turn comes before all others, null conversation ids are one
conversation; messages of one turn are ordered by role and text; messages that are equal in role and text repeat each
other wherever they stand; an empty table has no conversations; further columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.session import cut_lineage

from .rows import name

#: Messages of a block, at most (a power of two), and blocks of a group of blocks.
BLOCK_BITS, FAN = 12, 4096
#: Costs.
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
#: States: nothing yet, after a system message, after a user's, after an assistant's.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a user's or an assistant's message that was given that role or inserted.
GIVEN = np.array([USER, USER, ASSISTANT, USER])
#: State after keeping a message of class s, u, a or other; -1: not allowed.
KEPT = np.array([[SYSTEM, USER, -1, -1], [-1, USER, -1, -1], [-1, -1, ASSISTANT, -1], [-1, USER, -1, -1]])
LETTERS, FAR = "DIKR", 1 << 60
#: What an end of all messages costs in each state.
FINAL = np.array([0, 2 * INSERT, INSERT, 0], np.int64)
WHITE = " \t\n\x0b\x0c\r"


def messages_of(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """talk (the conversation's id as text, never null), turn, role, text and seq (ascending with talk and turn)."""
    rows = df.select(
        F.coalesce(F.concat(F.lit("="), F.col(name(conv)).cast("string")), F.lit("")).alias("talk"),
        F.col(name(turn)).cast("long").alias("turn"),
        F.coalesce(F.col(name(role)).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(name(text)).cast("string"), F.lit(" ")).alias("text"),
    )
    # a text's beginning is ordered as the text is, and samples of it stay small
    dealt = rows.repartitionByRange("talk", "turn", "role", F.substring("text", 1, 32))
    return cut_lineage(dealt.sortWithinPartitions("talk", "turn", "role", "text").withColumn("seq", F.monotonically_increasing_id()))


def with_faults(messages: DataFrame) -> DataFrame:
    """fault of each message: blank, duplicate, truncated (the first that holds) or null."""
    keyed = messages.withColumn("digest", F.sha2("text", 256))
    first = keyed.groupBy("talk", "role", "digest").agg(F.min("seq").alias("first"), F.count("*").alias("k")).where("k > 1").drop("k")
    said = F.rtrim(F.col("text"), F.lit(WHITE))
    fault = (
        F.when(F.length(said) == 0, "blank")
        .when(F.col("seq") > F.col("first"), "duplicate")
        .when(~F.right(said, F.lit(1)).isin(".", "!", "?"), "truncated")
    )
    return keyed.join(first, ["talk", "role", "digest"], "left").withColumn("fault", fault).drop("digest", "first")


def blocks_of(flagged: DataFrame) -> DataFrame:
    """talk, block, seq (of its first message) and codes: class of the role (s, u, a, other), and 4 for truncated, 8 for what has to go."""
    initial = F.left("role", F.lit(1))
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    fault = F.when(F.col("fault") == "truncated", 4).when(F.col("fault").isNotNull(), 8).otherwise(0)
    coded = flagged.select("talk", F.shiftrightunsigned("seq", BLOCK_BITS).alias("block"), F.struct("seq", (kind + fault).cast("int").alias("code")).alias("m"))
    made = coded.groupBy("talk", "block").agg(F.sort_array(F.collect_list("m")).alias("m"))
    return made.select("talk", "block", F.col("m")[0]["seq"].alias("seq"), F.col("m.code").alias("codes"))


# costs


def _insertions() -> np.ndarray:
    """Least cost from state to state by insertions."""
    cost = np.full((4, 4), FAR, np.int64)
    for s in range(4):
        cost[s, s], cost[s, GIVEN[s]] = 0, INSERT
    for s in range(4):
        t = GIVEN[s]
        cost[s, GIVEN[t]] = min(cost[s, GIVEN[t]], 2 * INSERT)
    return cost


def _message(code: int) -> np.ndarray:
    """Least cost from state to state by one message."""
    cost = np.full((4, 4), FAR, np.int64)
    for s in range(4):
        cost[s, s] = DELETE
        if code < 8:
            more = TRUNCATED if code >= 4 else 0
            cost[s, GIVEN[s]] = min(cost[s, GIVEN[s]], REROLE + more)
            if KEPT[s, code & 3] >= 0:
                cost[s, KEPT[s, code & 3]] = min(cost[s, KEPT[s, code & 3]], more)
    return cost


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of matrices, or of matrices and vectors, by least sums."""
    if b.ndim == a.ndim:
        return np.minimum((a[..., :, :, None] + b[..., None, :, :]).min(-2), FAR)
    return np.minimum((a + b[..., None, :]).min(-1), FAR)


STEPS = np.stack([_times(_insertions(), _message(code)) for code in range(12)])


def _matrices(codes: list[np.ndarray]) -> np.ndarray:
    """Each block's matrix."""
    length = np.array([len(c) for c in codes])
    order = np.argsort(-length, kind="stable")
    made = np.broadcast_to(_times(np.where(np.eye(4, dtype=bool), 0, FAR), np.where(np.eye(4, dtype=bool), 0, FAR)), (len(codes), 4, 4)).copy()
    for i in range(int(length.max(initial=0))):
        live = order[: int((length > i).sum())]
        made[live] = _times(made[live], STEPS[[codes[b][i] for b in live]])
    return made


def scan(values: DataFrame, back: bool, together: Callable, through: Callable, first: list[int]) -> DataFrame:
    """talk, block and what each block gets from those after it (back) or before it, as an array.

    values: talk, block, value (an array). together(a, b) is what a, met before b, and b do in one; through(a, x) is
    what leaves a when x comes in. Groups of FAN blocks are first taken as one block each where a talk has more.
    """
    from pyspark.sql import Window

    order = F.col("block").desc() if back else F.col("block")
    ranked = values.withColumn("group", F.floor((F.row_number().over(Window.partitionBy("talk").orderBy(order)) - 1) / FAN).cast("long"))
    ranked = cut_lineage(ranked)
    single = not ranked.where(F.col("group") > 0).take(1)

    def fold(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("block", ascending=not back)
        total = None
        for v in own["value"]:
            total = np.asarray(v) if total is None else together(total, np.asarray(v))
        return pd.DataFrame({"talk": own["talk"].iloc[:1], "block": own["group"].iloc[:1], "value": [np.asarray(total).ravel().tolist()]})

    def spread(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("block", ascending=not back)
        now, got = np.asarray(own["came"].iloc[0]), []
        for v in own["value"]:
            got.append(now.tolist())
            now = through(np.asarray(v), now)
        return pd.DataFrame({"talk": own["talk"], "block": own["block"], "came": got})

    if single:
        ranked = ranked.withColumn("came", F.array(*[F.lit(x).cast("long") for x in first]))
    else:
        # groups are numbered in the order in which they are met
        folded = ranked.groupBy("talk", "group").applyInPandas(fold, "talk string, block long, value array<long>")
        came = scan(folded, False, together, through, first)
        ranked = ranked.join(came.withColumnRenamed("block", "group"), ["talk", "group"])
    return ranked.groupBy("talk", "group").applyInPandas(spread, "talk string, block long, came array<long>")


def _costs_behind(several: DataFrame) -> DataFrame:
    """What the end states of each block cost from there on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = _matrices([np.array(c) for c in batch.column(2).to_pylist()])
            value = pa.array([m.ravel().tolist() for m in made], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), value], names=["talk", "block", "value"])

    values = several.select("talk", "block", "codes").mapInArrow(run, "talk string, block long, value array<long>")

    def together(later: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        return _times(earlier.reshape(4, 4), later.reshape(4, 4)).ravel()

    return scan(values, True, together, lambda m, behind: _times(m.reshape(4, 4), behind), FINAL.tolist())


# nodes, ranks and paths


class Nodes:
    """All nodes of some blocks: number base[b] + 4 * i + s for state s before message i of block b; the last four are its ends."""

    def __init__(self, codes: list[np.ndarray], behind: np.ndarray, last: np.ndarray):
        self.length = np.array([len(c) for c in codes], np.int64)
        self.base = 4 * (np.cumsum(self.length + 1) - self.length - 1)
        n = int(4 * (self.length + 1).sum())
        state = np.arange(n) % 4
        # code of the message behind each node; 12 at an end
        code = np.full(n // 4, 12, np.int64)
        inner = np.ones(n // 4, bool)
        inner[(self.base // 4) + self.length] = False
        code[inner] = np.concatenate(codes) if codes else []
        code = np.repeat(code, 4)
        ends = (self.base + 4 * self.length)[:, None] + np.arange(4)
        cost = np.full(n, FAR, np.int64)
        cost[ends] = behind
        more = np.where((code & 4) > 0, TRUNCATED, 0)
        free = code < 8
        kept = np.where(free, KEPT[state, code & 3], -1)
        ahead = np.arange(n) - state + 4
        # by letter: allowed, price, target
        can_insert = code < 12
        can_insert[ends[last]] = np.array([False, True, True, False])
        self.arcs = [
            (code < 12, np.full(n, DELETE), ahead + state),
            (can_insert, np.full(n, INSERT), ahead - 4 + GIVEN[state]),
            (kept >= 0, more, ahead + np.maximum(kept, 0)),
            (free, REROLE + more, ahead + GIVEN[state]),
        ]
        order = np.argsort(-self.length, kind="stable")
        for i in range(int(self.length.max(initial=0)) - 1, -1, -1):
            live = order[: int((self.length > i).sum())]
            at = (self.base[live] + 4 * i)[:, None] + np.arange(4)
            now = np.full(at.shape, FAR, np.int64)
            for k in (0, 2, 3):
                can, price, to = self.arcs[k]
                now = np.minimum(now, np.where(can[at], price[at] + cost[np.minimum(to[at], n - 1)], FAR))
            user, assistant = now[:, USER].copy(), now[:, ASSISTANT].copy()
            now[:, USER] = np.minimum(user, INSERT + assistant)
            now[:, ASSISTANT] = np.minimum(assistant, INSERT + user)
            now[:, :2] = np.minimum(now[:, :2], INSERT + now[:, USER, None])
            cost[at] = now
        self.cost, self.n, self.ends = cost, n, ends
        self.rank()

    def rank(self) -> None:
        """Letter and target of every node's chosen arc, and pointers of 1, 2, 4 ... letters; a path stays at its end."""
        n, here = self.n, np.arange(self.n)
        best = []
        for can, price, to in self.arcs:
            to = np.minimum(to, n - 1)
            best.append((can & (self.cost < FAR) & (price + self.cost[to] == self.cost), to))
        letter, to = np.zeros(n, np.int64), here
        for k in range(3, -1, -1):
            letter, to = np.where(best[k][0], k + 1, letter), np.where(best[k][0], best[k][1], to)
        rank, jump = letter, to
        while True:  # ranks by twice as many letters
            rank = np.unique(rank * (rank.max(initial=0) + 1) + rank[jump], return_inverse=True)[1]
            if (jump[jump] == jump).all():
                break
            jump = jump[jump]
        # the least letter, then the least rank behind
        least = np.full(n, FAR, np.int64)
        for k, (can, target) in enumerate(best):
            key = (k + 1) * n + rank[target]
            better = can & (key < least)
            least, letter, to = np.where(better, key, least), np.where(better, k + 1, letter), np.where(better, target, to)
        self.letter, self.to, self.jumps = letter, to, [to]
        steps = (letter > 0).astype(np.int64)
        while not (self.jumps[-1][self.jumps[-1]] == self.jumps[-1]).all():
            steps = steps + steps[self.jumps[-1]]
            self.jumps.append(self.jumps[-1][self.jumps[-1]])
        self.steps = steps

    def exits(self) -> np.ndarray:
        """The end state for each of a block's first states."""
        at = self.base[:, None] + np.arange(4)
        for _ in range(2):
            at = self.jumps[-1][at]
        return at % 4

    def paths(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(block, letter, node) along the path of every block from its first state, block after block."""
        start = self.base + entry
        length = self.steps[start]
        block = np.repeat(np.arange(len(start)), length)
        step = np.arange(len(block)) - np.repeat(np.cumsum(length) - length, length)
        node = start[block]
        for k, jump in enumerate(self.jumps):
            node = np.where((step >> k) & 1 == 1, jump[node], node)
        return block, self.letter[node], node


def _nodes(batch: pa.RecordBatch) -> Nodes:
    codes = [np.array(c, np.int64) for c in batch.column("codes").to_pylist()]
    behind = np.array([FINAL if v is None else v for v in batch.column("behind").to_pylist()], np.int64).reshape(-1, 4)
    return Nodes(codes, behind, np.array(batch.column("last").to_pylist(), bool))


def _solve(blocks: DataFrame) -> DataFrame:
    """audit, cost and the repaired messages of each block: seq (null for an inserted one) and role (null for its own)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 512):
                yield some(batch.slice(a, 512))

    def some(batch: pa.RecordBatch) -> pa.RecordBatch:
        nodes = _nodes(batch)
        entry = np.array(batch.column("entry").to_pylist(), np.int64)
        block, letter, node = nodes.paths(entry)
        written = np.frombuffer(LETTERS.encode(), np.uint8)[letter - 1].tobytes().decode()
        ends = np.cumsum(np.bincount(block, minlength=len(batch)))
        audit = [written[a:b] for a, b in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True)]
        stays = letter > 1
        seq = np.array(batch.column("seq").to_pylist(), np.int64)[block] + (node - nodes.base[block]) // 4
        given = np.where(GIVEN[node % 4] == USER, "user", "assistant")
        counts = np.bincount(block[stays], minlength=len(batch))
        messages = pa.ListArray.from_arrays(
            pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)),
            pa.StructArray.from_arrays(
                [pa.array(seq[stays], mask=letter[stays] == 2), pa.array(given[stays], pa.string(), mask=letter[stays] == 3)], names=["seq", "role"]
            ),
        )
        cost = pa.array(nodes.cost[nodes.base + entry])
        return pa.RecordBatch.from_arrays([batch.column("talk"), batch.column("block"), pa.array(audit, pa.string()), cost, messages], names=["talk", "block", "audit", "cost", "messages"])

    return blocks.mapInArrow(run, "talk string, block long, audit string, cost long, messages array<struct<seq:long,role:string>>")


def _exits(blocks: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 512):
                part = batch.slice(a, 512)
                value = pa.array(_nodes(part).exits().tolist(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("talk"), part.column("block"), value], names=["talk", "block", "value"])

    return blocks.mapInArrow(run, "talk string, block long, value array<long>")


def solve(blocks: DataFrame) -> DataFrame:
    """Each block's part of its conversation's repair, see _solve. blocks: as blocks_of makes them."""
    from pyspark.sql import Window

    size = blocks.groupBy("talk").agg(F.count("*").alias("size"), F.max("block").alias("end"))
    sized = cut_lineage(blocks.join(size, "talk").withColumn("last", F.col("block") == F.col("end")).drop("end"))
    alone = sized.where("size = 1").select("talk", "block", "seq", "codes", F.lit(None).cast("array<long>").alias("behind"), "last", F.lit(EMPTY).cast("long").alias("entry"))
    several = sized.where("size > 1")
    if several.isEmpty():
        return _solve(alone)
    known = cut_lineage(several.join(_costs_behind(several).withColumnRenamed("came", "behind"), ["talk", "block"]).select("talk", "block", "seq", "codes", "behind", "last"))
    entered = scan(_exits(known), False, lambda a, b: b[a], lambda m, x: m[x], [EMPTY])
    entered = entered.select("talk", "block", F.col("came")[0].alias("entry"))
    return _solve(alone.union(known.join(entered, ["talk", "block"]).select(*alone.columns)))


# results


def _illegal(blocks: DataFrame) -> DataFrame:
    """Pairs of neighbours whose roles are not system and user, user and assistant, or assistant and user."""
    from pyspark.sql import Window

    def bad(a: Column, b: Column) -> Column:
        return (~((a * 4 + b).isin(1, 6, 9))).cast("long")

    kinds = F.transform("codes", lambda c: c % 4)
    pairs = F.when(F.size("k") > 1, F.aggregate(F.sequence(F.lit(1), F.size("k") - 1), F.lit(0).cast("long"), lambda n, i: n + bad(F.get("k", i - 1), F.get("k", i)))).otherwise(0)
    before = F.lag(F.element_at("k", -1)).over(Window.partitionBy("talk").orderBy("block"))
    per = blocks.select("talk", "block", kinds.alias("k")).withColumn("inside", pairs).select("talk", "inside", F.col("k")[0].alias("first"), before.alias("before"))
    seam = F.when(F.col("before").isNotNull(), bad(F.col("before"), F.col("first"))).otherwise(0)
    return per.groupBy("talk").agg(F.sum(F.col("inside") + seam).alias("illegal"))


def repair(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(summary, messages).

    summary, one row a conversation: talk, gaps, blank, duplicate, truncated, illegal, cost, audit. messages, the
    repaired conversations: talk, block and place (in this order), role, text, and seq (null for inserted messages).
    """
    flagged = cut_lineage(with_faults(messages_of(df, conv, turn, role, text)))
    blocks = cut_lineage(blocks_of(flagged))
    solved = cut_lineage(solve(blocks))
    of = [F.sum((F.col("fault") == f).cast("long")).alias(f) for f in ("blank", "duplicate", "truncated")]
    turns = flagged.groupBy("talk", "turn").agg(*of)
    counts = turns.groupBy("talk").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"),
        *[F.coalesce(F.sum(f), F.lit(0)).alias(f) for f in ("blank", "duplicate", "truncated")],
    )
    pieces = F.sort_array(F.collect_list(F.struct("block", "audit")))
    audits = solved.groupBy("talk").agg(F.min_by("cost", "block").alias("cost"), F.array_join(F.transform(pieces, lambda p: p["audit"]), "").alias("audit"))
    summary = counts.join(_illegal(blocks), "talk").join(audits, "talk")
    placed = solved.select("talk", "block", F.posexplode("messages").alias("place", "m")).select("talk", "block", "place", "m.seq", F.col("m.role").alias("given"))
    texts = flagged.select("seq", F.col("role").alias("own"), "text")
    kept = placed.where(F.col("seq").isNotNull()).join(texts, "seq").select("talk", "block", "place", F.coalesce("given", "own").alias("role"), "text", "seq")
    added = placed.where(F.col("seq").isNull()).select("talk", "block", "place", F.col("given").alias("role"), F.lit("").alias("text"), "seq")
    return summary, kept.union(added)


def digest(messages: DataFrame) -> DataFrame:
    """talk and repaired_sha256: of all `role:text`, joined by newlines.

    Messages are streamed in order through one running hash; such a hash knows no other way, but nothing is held.
    """
    rows = messages.select("talk", "block", "place", F.concat("role", F.lit(":"), "text").alias("line"))
    rows = rows.repartition("talk").sortWithinPartitions("talk", "block", "place").select("talk", "line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, running = None, None
        for batch in batches:
            done = []
            for talk, line in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if talk == now:
                    running.update(b"\n")
                else:
                    if running:
                        done.append((now, running.hexdigest()))
                    now, running = talk, hashlib.sha256()
                running.update(line)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=["talk", "repaired_sha256"])
        if running:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([running.hexdigest()])], names=["talk", "repaired_sha256"])

    return rows.mapInArrow(run, "talk string, repaired_sha256 string")
