"""Toxicity by distance-weighted votes of the nearest labelled examples.

Examples are a bounded sample of the labelled training rows: `examples` of each class, those whose ids have the
smallest hashes. Class rates come from all training rows and weigh the votes, so the sample's balance does not
show in the scores. Terms are whole words and word beginnings of 4 and 6 bytes; the vocabulary is the terms
that tell the classes apart (log-likelihood ratio above `least`), the strongest of those that point to toxic examples
and as many of those that point to others, and the COVER strongest terms of every example that has none of them, so
that no example with words is left out. The ratios come from all training rows and the inverse document frequencies from
all documents; only the examples are a sample. Within it, cosines of TF-IDF vectors are exact: the inverted index holds the
examples in blocks, of every term the blocks that hold it, and the largest weight in each; the blocks of the highest bounds are scored
first, then those whose bounds reach the similarity of the k-th best example; the others are skipped. Scores are calibrated by a logistic curve fitted to the examples' own
scores with each example left out.

Training rows are those whose crc32 of the id, as text, is not 0 modulo `folds`; the others are held out. Labels,
ids and other columns are never inputs of a score.

Defined cases: null, empty and blank texts, and texts without a vocabulary term, get the calibrated rate of the
examples without any; labels that are null are skipped, and a document with several has the largest; without
labels every score is 0; repeated rows get equal scores.
"""

from __future__ import annotations

from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.session import cut_lineage

from .rows import annotate, double, long, name, plain_words, string, structs

EXAMPLES = 1500
VOCABULARY = 1024
NEIGHBOURS = 15
FOLDS = 5
LEAST = 25.0
#: Terms that an example without any other term of the vocabulary adds to it.
COVER = 8
PREFIXES = (4, 6)
BLOCK = 16
#: Blocks that are scored before bounds are compared.
FIRST = 8
#: Cosines nearer to each other than this may be equal after rounding.
MARGIN = 2e-6
#: Vectors whose vote a task remembers, and words whose terms it does.
MEMO, WORDS = 4000, 100_000
#: Rows whose terms are packed and counted together.
ROWS = 500
#: Weight of the prior in a vote, and the power of the cosine that weighs a neighbour's: of 1 and 2, that of the lower log
#: loss over the examples with each left out.
PRIOR, CLOSENESS = 0.2, 2


def terms(text: bytes | None) -> Counter:
    """Counts of words and of the beginnings of longer words (kept apart by a mark)."""
    words = Counter(plain_words(text))
    out = Counter(words)
    for w, n in words.items():
        for p in PREFIXES:
            if len(w) > p:
                out[w[:p] + b"*"] += n
    return out


class TermNumbers(dict):
    """Of each word the numbers of its terms in `place`; what was asked for is remembered."""

    def __init__(self, place: dict[bytes, int]):
        super().__init__()
        self.place = place

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= WORDS:
            self.clear()
        each = [word, *[word[:p] + b"*" for p in PREFIXES if len(word) > p]]
        self[word] = found = tuple(i for t in each if (i := self.place.get(t)) is not None)
        return found

    def counts(self, text: bytes | None) -> dict[int, int]:
        out: dict[int, int] = {}
        for word, n in Counter(plain_words(text)).items():
            for i in self[word]:
                out[i] = out.get(i, 0) + n
        return out


def bucket(doc_id: F.Column, folds: int) -> F.Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


class Index:
    """Block-max inverted index over TF-IDF vectors of labelled examples, and the calibrated vote."""

    def __init__(self, rows: list[tuple[str, int, Counter]], totals: dict[int, int], vocabulary: list[tuple[bytes, int]], documents: int, k: int = NEIGHBOURS):
        """rows: id, label and term counts of each example; totals: training rows of each label; vocabulary: terms
        and the numbers of documents that hold them, of `documents` in all."""
        rows = sorted(rows, key=lambda r: r[0])
        self.k, self.ids = k, np.array([r[0] for r in rows], object)
        self.labels = np.array([r[1] for r in rows], np.float64)
        have = np.array([max(1, (self.labels == c).sum()) for c in (0, 1)])
        total = np.array([totals.get(0, 0), totals.get(1, 0)], np.float64)
        self.rate = float(total[1] / total.sum()) if total.sum() else 0.0
        self.weights = (total / have)[self.labels.astype(int)] if len(rows) else np.zeros(0)
        self.weights = self.weights / max(1e-12, self.weights.mean()) if len(rows) else self.weights
        self.vocabulary = {t: i for i, (t, _) in enumerate(vocabulary)}
        frequency = np.array([n for _, n in vocabulary], np.float64)
        self.idf = np.log((1 + documents) / (1 + frequency)) + 1
        self.numbers = TermNumbers(self.vocabulary)
        vectors = [self.vector({self.vocabulary[t]: n for t, n in found.items()}) for _, _, found in rows]
        some = np.array([j for j, (ids, _) in enumerate(vectors) if len(ids)], np.int64)
        # examples that share their heaviest term stand together, so that bounds are tight
        heaviest = np.array([vectors[j][0][vectors[j][1].argmax()] for j in some], np.int64)
        self.order = some[np.lexsort((self.ids[some], heaviest))]
        self.blocks = -(-len(self.order) // BLOCK)
        self._lay_postings(vectors)
        self.curve = (0.0, 1.0)
        empty = np.setdiff1d(np.arange(len(rows)), some)
        w = self.weights
        self.blank = (w[empty] @ self.labels[empty] + PRIOR * self.rate) / (w[empty].sum() + PRIOR) if len(rows) else 0.0
        raw = np.full(len(rows), self.blank)
        for place, j in enumerate(self.order):
            raw[j] = self._vote(*vectors[j], but=place)[0]
        if len(rows):
            self.curve = _logistic(_logit(raw), self.labels, w)
        self.memo: dict = {}

    def _lay_postings(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """The inverted lists: of each term the blocks that hold it, each with its largest weight (`bounds`) and the
        row of a strip with the weights of the block's examples; row 0 is of blocks that don't."""
        found: dict[tuple[int, int], np.ndarray] = {}
        for place, j in enumerate(self.order):
            for i, value in zip(*(x.tolist() for x in vectors[j]), strict=True):
                found.setdefault((i, place // BLOCK), np.zeros(BLOCK, np.float32))[place % BLOCK] = value
        self.rows = np.zeros((len(self.vocabulary), self.blocks), np.int32)
        self.strips = np.stack([np.zeros(BLOCK, np.float32), *found.values()])
        for row, key in enumerate(found, 1):
            self.rows[key] = row
        self.bounds = self.strips.max(axis=1)[self.rows]

    def vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the terms and their weights, from the counts of terms of the vocabulary."""
        if not counts:
            return np.zeros(0, np.int64), np.zeros(0, np.float32)
        pairs = np.array(sorted(counts.items()), np.int64)
        values = (1 + np.log(pairs[:, 1])) * self.idf[pairs[:, 0]]
        return pairs[:, 0], (values / np.sqrt((values**2).sum())).astype(np.float32)

    def vector_of(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        return self.vector(self.numbers.counts(text))

    def nearest(self, ids: np.ndarray, values: np.ndarray, but: int = -1) -> list[tuple[float, int]]:
        """The k examples of the largest cosines above 0: (cosine, example), ties by id. but: a place to leave out."""
        bound = values @ self.bounds[ids]
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        places, scores = self._scores(order[:FIRST], ids, values, but)
        rest = order[FIRST:]
        if len(scores) >= self.k:
            rest = rest[bound[rest] >= np.partition(scores, -self.k)[-self.k] - MARGIN]
        if len(rest):
            more = self._scores(rest, ids, values, but)
            places, scores = np.concatenate([places, more[0]]), np.concatenate([scores, more[1]])
        if len(scores) > self.k:
            near = scores >= np.partition(scores, -self.k)[-self.k] - MARGIN
            places, scores = places[near], scores[near]
        best = zip(scores.tolist(), self.order[places].tolist(), strict=True)
        return sorted(best, key=lambda x: (-round(x[0], 6), self.ids[x[1]]))[: self.k]

    def _scores(self, blocks: np.ndarray, ids: np.ndarray, values: np.ndarray, but: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the blocks' examples and their cosines, where above 0, from the strips of the terms."""
        strips = self.strips.take(self.rows[ids][:, blocks].ravel(), axis=0)
        sums = values @ strips.reshape(len(ids), len(blocks) * BLOCK)
        places = (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
        some = (sums > 0) & (places != but)
        return places[some], sums[some]

    def _vote(self, ids: np.ndarray, values: np.ndarray, but: int = -1) -> tuple[float, list]:
        near = self.nearest(ids, values, but)
        if not near:
            return self.blank, near
        i = np.array([j for _, j in near])
        w = self.weights[i] * np.array([s for s, _ in near]) ** CLOSENESS
        return float((w @ self.labels[i] + PRIOR * self.rate) / (w.sum() + PRIOR)), near

    def score(self, text: bytes | None) -> tuple[float, list[dict]]:
        """Calibrated score and the neighbours that voted."""
        if not len(self.ids):
            return 0.0, []
        ids, values = self.vector_of(text)
        key = (ids.tobytes(), values.tobytes())
        if key not in self.memo:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            raw, near = self._vote(ids, values) if len(ids) else (self.blank, [])
            a, b = self.curve
            evidence = [{"doc_id": self.ids[j], "similarity": round(s, 6), "toxic": int(self.labels[j])} for s, j in near]
            self.memo[key] = (float(1 / (1 + np.exp(-(a + b * _logit(raw))))), evidence)
        return self.memo[key]


def _likelihood_ratio(a: int, n1: int, b: int, n0: int) -> float:
    """G-squared of a term in a of n1 and b of n0 documents."""
    n, g = n1 + n0, 0.0
    for seen, rows, column in ((a, n1, a + b), (b, n0, a + b), (n1 - a, n1, n - a - b), (n0 - b, n0, n - a - b)):
        if seen > 0:
            g += seen * np.log(seen * n / (rows * column))
    return 2 * g


def _logit(p):
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Weighted logistic curve a + b x with a small ridge; b is positive."""
    beta, design = np.array([0.0, 1.0]), np.stack([np.ones_like(x), x], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ beta))
        gradient = design.T @ (w * (p - y)) + 1e-2 * (beta - [0, 1])
        hessian = (design * (w * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta = beta - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(max(beta[1], 1e-3))


def _count_terms():
    def count(texts):
        return ([[{"term": t, "n": n} for t, n in terms(x).items()] for x in texts],)

    return count


def choose_vocabulary(seen: dict[bytes, tuple[int, int]], n1: int, n0: int, size: int = VOCABULARY, least: float = LEAST) -> list[bytes]:
    """Of terms and the numbers of toxic and other training rows that hold them, the `size` that point to toxic ones
    most and the `size` that point to others most."""
    sides: tuple[list, list] = ([], [])
    for t, (a, b) in seen.items():
        if (g := _likelihood_ratio(a, n1, b, n0)) >= least:
            sides[a * n0 > b * n1].append((-g, t))
    return [t for side in sides for _, t in sorted(side)[:size]]


def cover(bare: list[list[bytes]], seen: dict[bytes, tuple[int, int]], n1: int, n0: int) -> list[bytes]:
    """The COVER terms of each of the bare examples that tell the classes apart most."""
    strength = {t: _likelihood_ratio(seen[t][0], n1, seen[t][1], n0) for found in bare for t in found}
    return sorted({t for found in bare for t in sorted(found, key=lambda t: (-strength[t], t))[:COVER]})


def pack(lists: list[np.ndarray]) -> pa.Array:
    """Ascending numbers below 2 ** 28 as differences of 7 bits a byte, one binary value for each list."""
    sizes = np.array([len(x) for x in lists], np.int64)
    flat = np.concatenate([np.zeros(0, np.int64), *lists])
    gaps = np.diff(flat, prepend=0)
    first = (np.cumsum(sizes) - sizes)[sizes > 0]
    gaps[first] = flat[first]
    wide = np.stack([(gaps >> s) & 127 for s in (0, 7, 14, 21)], axis=1)
    used = np.stack([np.ones(len(gaps), bool), gaps >= 1 << 7, gaps >= 1 << 14, gaps >= 1 << 21], axis=1)
    wide[:, :3] |= used[:, 1:] * 128
    ends = np.concatenate([[0], np.cumsum(used.sum(axis=1))])[np.concatenate([[0], np.cumsum(sizes)])]
    return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(wide[used].astype(np.uint8).tobytes())])


def unpack(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of all lists, and how many each list holds."""
    data = np.frombuffer(b"".join(packed), np.uint8).astype(np.int64)
    last = np.flatnonzero(data < 128)
    if not len(last):
        return np.zeros(0, np.int64), np.zeros(len(packed), np.int64)
    start = np.concatenate([[0], last[:-1] + 1])
    gaps = np.add.reduceat((data & 127) << 7 * (np.arange(len(data)) - np.repeat(start, last - start + 1)), start)
    ends = np.searchsorted(last, np.cumsum([len(x) for x in packed]))
    sizes = np.diff(ends, prepend=0)
    sums = np.concatenate([[0], np.cumsum(gaps)])
    return sums[1:] - np.repeat(sums[ends - sizes], sizes), sizes


def parts_of(batches):
    """Arrow batches in parts of ROWS rows, so that what is made of a part stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _packer(shared):
    numbers = TermNumbers({t: i for i, t in enumerate(shared.value.split(b" "))} if shared.value else {})

    def run(batches):
        for part in parts_of(batches):
            texts = part.column(1).cast(pa.binary()).to_pylist()
            lists = [np.array(sorted({i for w in set(plain_words(t)) for i in numbers[w]}), np.int64) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pack(lists)], names=["doc_id", "held"])

    return run


def _counter(size: int):
    """Documents, toxic and other training rows that hold each of the terms; a task's rows are summed here."""

    def count(batches):
        sums = np.zeros((3, size + 1), np.int64)
        for part in parts_of(batches):
            numbers, sizes = unpack(part.column(0).to_pylist())
            labels = part.column(1).to_numpy()
            of = np.repeat(labels, sizes)
            for label in range(3):
                sums[label, :size] += np.bincount(numbers[of == label], minlength=size)
                sums[label, size] += (labels == label).sum()  # the documents themselves
        some = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (some, *sums[:, some])], names=["place", "other", "toxic", "docs"])

    return count


def frequencies(docs: DataFrame, known: DataFrame, words: list[bytes], folds: int = FOLDS) -> tuple[dict[bytes, tuple[int, int]], dict[bytes, int], int, int, int]:
    """Of each word the toxic and other rows of docs that hold it, by their label in known (doc_id, label), and all
    rows that do; then the numbers of toxic, other and all rows. Texts are read once and not shuffled: each becomes the
    packed numbers of the words it holds, and these meet the labels. Each task sends one row for each word at most."""
    # words hold no spaces
    shared = docs.sparkSession.sparkContext.broadcast(b" ".join(words))

    def run(batches):
        return _packer(shared)(batches)

    held = cut_lineage(docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string")).mapInArrow(run, "doc_id string, held binary"))
    # labels grow with the documents: both sides are dealt by id at every size
    trained = held.where(bucket(F.col("doc_id"), folds) != 0).join(known.hint("merge"), "doc_id").select("held", "label")
    each = held.select("held", F.lit(2).alias("label")).unionAll(trained)
    size = len(words)
    counted = each.mapInArrow(lambda batches: _counter(size)(batches), "place long, other long, toxic long, docs long").groupBy("place").agg(*[F.sum(c).alias(c) for c in ("other", "toxic", "docs")])
    found = counted.toArrow().to_pydict()
    seen, all_rows, n = {}, {}, (0, 0, 0)
    for i, b, a, d in zip(found["place"], found["other"], found["toxic"], found["docs"], strict=True):
        if i == size:
            n = (a, b, d)
        else:
            seen[words[i]], all_rows[words[i]] = (a, b), d
    return seen, all_rows, *n


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = FOLDS, examples: int = EXAMPLES, vocabulary: int = VOCABULARY, k: int = NEIGHBOURS) -> Index:
    """The index of a bounded sample of training rows: of 2 * examples documents at most, the terms of the vocabulary
    reach the driver. Terms are counted on the executors, over all documents and all training rows."""
    known = (
        labels.where(F.col(name(label)).isin(0, 1) & (bucket(F.col(name(doc_id)), folds) != 0))
        .groupBy(F.col(name(doc_id)).cast("string").alias("doc_id"))
        .agg(F.max(F.col(name(label)).cast("int")).alias("label"))
    )
    totals = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    chosen = None
    for c in (0, 1):
        part = known.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples)
        chosen = part if chosen is None else chosen.union(part)
    plain = docs.select(F.col(name(doc_id)).cast("string").alias("doc_id"), F.col(name(text)).cast("string").alias("text"))
    # the sample is bounded by its parameter, so it can be broadcast
    sample = plain.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    counted = cut_lineage(annotate(sample, "text", _count_terms, [structs("terms", T.StructField("term", T.BinaryType()), long("n"))], keep=["doc_id", "label"]))
    # no other term can be part of a cosine with an example
    held = counted.select(F.explode("terms.term").alias("term")).distinct().toArrow().column(0).to_pylist()
    seen, everywhere, n1, n0, n = frequencies(plain, known, sorted(held), folds) if held else ({}, {}, 0, 0, 0)
    n1, n0 = max(1, n1), max(1, n0)
    words = choose_vocabulary(seen, n1, n0, vocabulary)
    made: dict[str, tuple[str, int, Counter]] = {
        r["doc_id"]: (r["doc_id"], r["label"], Counter()) for r in counted.select("row.doc_id", "row.label").collect()
    }
    _hold(counted, words, made)
    # the examples that hold none of these terms; few, as the terms point both ways
    bare = [i for i, (_, _, held) in made.items() if not held]
    if bare:
        those = docs.sparkSession.createDataFrame([(i,) for i in bare], "doc_id string")
        found = counted.select("row.doc_id", F.col("terms.term").alias("found")).join(F.broadcast(those), "doc_id")
        more = cover([[bytes(t) for t in r["found"]] for r in found.collect()], seen, n1, n0)
        _hold(counted, more, made)
        words += more
    return Index(list(made.values()), totals, [(t, everywhere[t]) for t in words], n, k)


def _hold(counted: DataFrame, words: list[bytes], made: dict[str, tuple[str, int, Counter]]) -> None:
    """Add the counts of these words to the examples that hold them."""
    if not words:
        return
    wanted = counted.sparkSession.createDataFrame([(bytearray(w),) for w in words], "term binary")
    held = counted.select("row.doc_id", F.explode("terms").alias("t")).select("doc_id", "t.*").join(F.broadcast(wanted), "term")
    for i, t, n in zip(*held.select("doc_id", "term", "n").toArrow().to_pydict().values(), strict=True):
        made[i][2][t] = n


def _scorer(shared):
    index = shared.value

    def score(texts):
        made = [index.score(t) for t in texts]
        return [s for s, _ in made], [e for _, e in made]

    return score


def score(docs: DataFrame, index: Index, text: str = "text", keep=None) -> DataFrame:
    """row, score (0 to 1) and evidence (the examples that voted) for each row of docs. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    fields = [double("score"), structs("evidence", string("doc_id"), double("similarity"), long("toxic"))]
    return annotate(docs, text, partial(_scorer, shared), fields, keep)


def reject_toxic(docs: DataFrame, labels: DataFrame, text: str = "text", threshold: float = 0.5, **options) -> DataFrame:
    """The rows of docs, all columns, whose score is below the threshold."""
    return score(docs, fit(docs, labels, text=text, **options), text).where(F.col("score") < threshold).select("row.*")
