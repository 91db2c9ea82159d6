"""Words that differ by one letter, found by walking a trie as joins.

The trie is an edge table (node, label, child): a node is the hash of a prefix that branches or at which a word ends,
so chains without a branch are one edge with a longer label. States (word, position, node, edits) meet the edges of
their node, round after round; a state without an edit goes on along the same letters or spends its edit inside the
label, a state with one edit only goes on along the same letters. A state that has used one edit and all letters at a
node where a word ends has found a neighbour.

A word of n letters begins at its prefix of n // 2 letters at most, in a trie of words and in one of reversed words:
of two neighbours, one edit leaves the first or the second half of a word as it was. So the upper, crowded levels are
never walked, and both tries are walked in the same rounds. There are as many rounds as branching nodes on a path.

Nodes of equal hashes would only add edges, and every found pair is compared again, so no neighbour is lost or invented.

Defined cases: null and empty texts hold no words; repeated rows count as often as they stand; words of any length are
taken, and work grows with their length; an empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.session import cut_lineage

from .rows import name

#: Letters of the words that are looked at, at least: half of them are where the walk begins.
LEAST = 6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[a-zÀ-ÿ]+"


def runs(text: str) -> Column:
    """Maximal runs of letters up to U+00FF of a text in lower case (A-Z only)."""
    return F.regexp_extract_all(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), F.lit(RUN), 0)


def count_words(docs: DataFrame, text: str = "text", edit=None, least: int = 5) -> DataFrame:
    """word and n of all words of at least LEAST letters and `least` occurrences.

    edit: from the columns of docs and a column of runs to the words that are counted instead.
    """
    rows = docs.select("*", F.explode(F.filter(runs(name(text)), lambda w: F.length(w) >= LEAST)).alias("a run of letters"))
    words = rows.select((edit or (lambda w: w))(F.col("a run of letters")).alias("word")).where(F.length("word") >= LEAST)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


# the trie

START = LEAST // 2


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _prefixes(words: DataFrame) -> DataFrame:
    """spelt (the word or its reverse), depth, node and next (code point; -1 at the end) of all prefixes from START on."""
    both = words.select(F.explode(F.array(F.struct(F.lit(0).alias("back"), F.col("word").alias("spelt")), F.struct(F.lit(1).alias("back"), F.reverse("word").alias("spelt")))).alias("x"), "n").select("x.*", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 2000):
                yield some(batch.slice(a, 2000))

    def some(batch: pa.RecordBatch) -> pa.RecordBatch:
        spelt = batch.column(1).to_pylist()
        length = np.array([len(w) for w in spelt], np.int64)
        codes = np.frombuffer("".join(spelt).encode("utf-32-le"), np.uint32).astype(np.uint64)
        begin = np.cumsum(length) - length
        owner = np.repeat(np.arange(len(spelt)), length)
        depth = np.arange(len(codes)) - begin[owner]
        with np.errstate(over="ignore"):
            power = np.cumprod(np.append(np.uint64(1), np.full(int(length.max(initial=0)), 0x9E3779B97F4A7C15, np.uint64)))
            total = np.cumsum(codes * power[depth])
            total = total - np.append(np.uint64(0), total)[begin[owner]]
            depth += 1
            back = batch.column(0).to_numpy().astype(np.uint64)[owner]
            node = _mix(_mix(total) + depth.astype(np.uint64) * np.uint64(2) + back)
        after = np.append(codes[1:], 0).astype(np.int64)
        after[begin + length - 1] = -1
        keep = depth >= START
        columns = [batch.column(1).take(pa.array(owner[keep])), pa.array(back[keep].astype(np.int8)), batch.column(2).take(pa.array(owner[keep]))]
        columns += [pa.array(depth[keep].astype(np.int32)), pa.array(node[keep].view(np.int64)), pa.array(after[keep].astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, names=["spelt", "back", "n", "depth", "node", "next"])

    return both.mapInArrow(run, "spelt string, back byte, n long, depth int, node long, next int")


def paths(words: DataFrame) -> DataFrame:
    """spelt, back, n and path (depth and node of every node of the trie on the way, from START on) of all words."""
    prefixes = _prefixes(words)
    branch = (F.min("next") != F.max("next")) | (F.min("next") == -1) | (F.min("depth") == START)
    nodes = prefixes.groupBy("node").agg(branch.alias("is")).where("is").select("node")
    on = prefixes.join(nodes, "node")
    return on.groupBy("spelt", "back", "n").agg(F.sort_array(F.collect_list(F.struct("depth", "node"))).alias("path"))


def edges(paths: DataFrame) -> DataFrame:
    """node, label, child, and the word that ends at the child with its n (null where none does)."""
    step = F.transform(
        F.sequence(F.lit(1), F.size("path") - 1),
        lambda i: F.struct(
            F.col("path")[i - 1]["node"].alias("node"),
            F.substring(F.col("spelt"), F.col("path")[i - 1]["depth"] + 1, F.col("path")[i]["depth"] - F.col("path")[i - 1]["depth"]).alias("label"),
            F.col("path")[i]["node"].alias("child"),
            F.when(F.col("path")[i]["depth"] == F.length("spelt"), F.struct(F.col("spelt").alias("word"), "n")).alias("ends"),
        ),
    )
    found = paths.where(F.size("path") > 1).select(F.explode(step).alias("e")).select("e.*")
    # a word's own row has its end; the rows of longer words through the same edge have not
    return found.groupBy("node", "label", "child").agg(F.first("ends", ignorenulls=True).alias("ends"))


def _begin(paths: DataFrame) -> DataFrame:
    """The first state of every word: at its last node within the first half."""
    at = F.element_at(F.filter("path", lambda p: p["depth"] <= F.floor(F.length("spelt") / 2)), -1)
    return paths.select("spelt", "back", at["depth"].alias("position"), at["node"].alias("node"), F.lit(0).alias("edits"))


def _step(states: DataFrame, edges: DataFrame) -> DataFrame:
    k, rest = F.length("label"), F.col("rest")

    def state(taken: Column, edits: int) -> Column:
        return F.struct((F.col("position") + taken).cast("int").alias("position"), F.lit(edits).alias("edits"))

    def one_edit(taken: Column) -> Column:
        return (F.col("edits") == 0) & (F.length(rest) >= taken) & (F.levenshtein(F.substring(rest, F.lit(1), taken), F.col("label"), 1) == 1)

    same = F.startswith(rest, F.col("label"))
    ways = F.array(
        F.when(same, F.struct((F.col("position") + k).cast("int").alias("position"), F.col("edits").alias("edits"))),
        F.when(one_edit(k), state(k, 1)),
        F.when(one_edit(k - 1), state(k - 1, 1)),
        F.when(one_edit(k + 1), state(k + 1, 1)),
    )
    ahead = states.withColumn("rest", F.substring(F.col("spelt"), F.col("position") + 1, F.length("spelt")))
    met = ahead.join(edges, "node").where((F.col("edits") == 0) | same)
    return met.select("spelt", "back", F.explode(F.array_compact(ways)).alias("way"), "child", "ends").select(
        "spelt", "back", "way.position", F.col("child").alias("node"), "way.edits", "ends"
    )


def neighbours(words: DataFrame) -> DataFrame:
    """word, near and n of near for all pairs of words that differ by exactly one letter, both ways. words: word, n."""
    known = cut_lineage(paths(words))
    trie = cut_lineage(edges(known))
    states, found = cut_lineage(_begin(known)), None
    while True:
        met = cut_lineage(_step(states, trie))
        over = (F.col("edits") == 1) & (F.col("position") == F.length("spelt"))
        ended = met.where(over & F.col("ends").isNotNull()).select("spelt", "back", F.col("ends.word").alias("near"), "ends.n")
        found = ended if found is None else found.union(ended)
        states = met.where(~over).drop("ends")
        if states.isEmpty():
            break
    turned = [F.when(F.col("back") == 1, F.reverse(c)).otherwise(F.col(c)).alias(a) for c, a in (("spelt", "word"), ("near", "near"))]
    pairs = found.where(F.levenshtein("spelt", "near", 1) == 1).select(*turned, "n").distinct()
    return pairs


def group(words: DataFrame, times: int = 5) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word. words: word, n (each word once).

    form: the neighbour of largest n (ties: the first in code-point order) if it occurs `times` as often; root: where
    forms lead in the end. A form's n grows by `times` at each step, so a few doublings of the pointers reach the root.
    """
    near = neighbours(words)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("n"), "near")).alias("best"))
    is_form = -F.col("best.n") >= times * F.col("n")
    rows = words.join(best, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best.near")).alias("form"),
        F.when(is_form, -F.col("best.n")).alias("form_n"),
    )
    rows = cut_lineage(rows)
    now = rows.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        met = cut_lineage(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = met.select("word", "root")
        if met.where("moved").isEmpty():
            break
    return rows.join(now, "word", "left").withColumn("root", F.coalesce("root", "word"))
