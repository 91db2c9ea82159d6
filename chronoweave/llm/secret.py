"""Secret scans: base formats by regular expression, others by inferred probabilistic automata.

Values that the base formats find are labelled credentials. A bounded sample of them (`examples` of each kind,
those of the smallest hashes) builds a frequency prefix tree for each kind; states whose outgoing and ending
frequencies are compatible by Hoeffding's bound, down all their common paths, are merged (red and blue states).
The result is a deterministic probabilistic automaton. Candidates are all runs of the characters that a labelled value
may hold, of its least length; words are candidates as well. Every candidate of every text is scored: by the
log-likelihood of its format against pairs of neighbouring symbols of all candidates that no base format found, which are
counted over all texts. A candidate becomes a span of kind `format` where two things hold for a kind: its ratio for each
symbol is no lower than 95 % of values of its length would have it, by the mean and the deviation of the labelled values
kept out of the automaton; and its whole ratio outweighs the odds of all candidates to labelled values. Neither hangs on
how long labelled values are. Base spans always stay, and carry their value's score too.

A chunk of texts is one array: runs are found and scored column by column for all of them at once.

Defined cases: null and empty texts have no spans; without labelled values nothing is added; repeated rows get
equal results; offsets are code points, end exclusive; a kind without labelled values has no automaton, and one of a
single value is tested by that value.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.session import cut_lineage

from .rows import annotate, double, long, name, string, structs

KINDS = ("assign", "access", "hex")
EXAMPLES = 400
ALPHA = 0.05
#: Bytes of texts that are looked at together, and the longest candidate that is scored column by column.
CHUNK, COLUMNS = 4 << 20, 512
#: Labelled values that a task holds in order not to send them again.
REMEMBERED = 100_000

#: Fixed patterns of the base formats, over UTF-8 bytes; their classes are ASCII, so bytes and characters agree.
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
#: Fixed: characters of a candidate, those that do not end it, and its least length, as in labelled values.
CANDIDATE = np.array([chr(c).isalnum() and c < 128 or chr(c) in "+/_.=-" for c in range(256)])
OPEN_END, SHORTEST = ord("."), 6
#: Pairs behind a symbol from which on they say more than how frequent the second symbol is by itself.
PAIRS = 1000
#: Symbols behind the first FULL characters: a for a-f, z for g-z, A for A-Z, 0 for digits, others as they are.
FULL = 4
SYMBOL = np.array([97 if 97 <= c <= 102 else 122 if 103 <= c <= 122 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256)], np.uint8)


def characters(text: bytes, spans: list[tuple]) -> list[tuple]:
    """(kind, start, end, ...) in bytes as code points."""
    if not spans or text.isascii():
        return spans
    places, at, points = {}, 0, 0
    for p in sorted({x for s in spans for x in s[1:3]}):
        points += len(text[at:p].decode("utf-8", "replace"))
        places[p], at = points, p
    return [(s[0], places[s[1]], places[s[2]], *s[3:]) for s in spans]


def base_spans(text: bytes) -> list[tuple[str, int, int, bytes]]:
    """(kind, start, end, credential) of the base formats, in bytes, by start and then kind as listed."""
    out, low = [], text.lower()
    if any(k in low for k in KEYWORDS):
        out += [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in text:
        out += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def chunks(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of CHUNK bytes together, about; a longer text is one range."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or b"")
        if held >= CHUNK or i + 1 == len(texts):
            yield first, i + 1
            first, held = i + 1, 0


class Chunk:
    """Texts as one array, their base spans and their candidates beside these."""

    def __init__(self, texts: list[bytes | None]):
        self.texts = [t or b"" for t in texts]
        self.data = np.frombuffer(b"\0".join(self.texts), np.uint8)  # no candidate holds the byte between
        size = np.array([len(t) + 1 for t in self.texts], np.int64)
        self.first = np.cumsum(size) - size
        self.base = [base_spans(t) for t in self.texts]
        edges = np.diff(np.concatenate([[False], CANDIDATE[self.data], [False]]).astype(np.int8))
        start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        solid = np.where(self.data == OPEN_END, -1, np.arange(len(self.data)))
        if len(end):
            end = np.maximum(np.maximum.accumulate(solid)[end - 1] + 1, start)
        free = end - start >= SHORTEST
        for first, spans in zip(self.first.tolist(), self.base, strict=True):
            for _, a, b, _ in spans:  # runs are in order and apart
                free[np.searchsorted(end, first + a, "right") : np.searchsorted(start, first + b, "left")] = False
        self.start, self.end = start[free], end[free]
        self.of = np.searchsorted(self.first, self.start, "right") - 1

    def pairs(self) -> np.ndarray:
        """How often each symbol (column) stands behind each other one (row; 0 before the first) in the candidates."""
        sizes = self.end - self.start
        at = np.repeat(self.start - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        early = at - np.repeat(self.start, sizes) < FULL
        now = np.where(early, self.data[at], SYMBOL[self.data[at]]).astype(np.int64)
        before = np.append(0, now)[:-1]
        before[np.cumsum(sizes) - sizes] = 0
        return np.bincount(before * 256 + now, minlength=256 * 256).reshape(256, 256)

    def value(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def symbols(value: bytes) -> bytes:
    """The symbols of a value."""
    data = np.frombuffer(value, np.uint8)
    return data[:FULL].tobytes() + SYMBOL[data[FULL:]].tobytes()


class Automaton:
    """A deterministic probabilistic automaton inferred from strings."""

    def __init__(self, strings: list, alpha: float = ALPHA):
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.next: list[dict] = [{}]
        self.flow: list[Counter] = [Counter()]
        self.ends: list[int] = [0]
        for s in sorted(strings):
            state = 0
            for c in s:
                self.flow[state][c] += 1
                if c not in self.next[state]:
                    self.next[state][c] = len(self.next)
                    self.next.append({})
                    self.flow.append(Counter())
                    self.ends.append(0)
                state = self.next[state][c]
            self.ends[state] += 1
        self._merge()
        self.alphabet = max(2, len({c for f in self.flow for c in f}) + 1)

    def _total(self, s: int) -> int:
        return self.ends[s] + self.flow[s].total()

    def _differ(self, a: int, n: int, b: int, m: int) -> bool:
        return bool(n and m) and abs(a / n - b / m) > self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, r: int, b: int) -> bool:
        todo = [(r, b)]
        while todo:
            x, y = todo.pop()
            n, m = self._total(x), self._total(y)
            if self._differ(self.ends[x], n, self.ends[y], m):
                return False
            for c in self.flow[x].keys() | self.flow[y].keys():
                if self._differ(self.flow[x][c], n, self.flow[y][c], m):
                    return False
                if c in self.next[x] and c in self.next[y]:
                    todo.append((self.next[x][c], self.next[y][c]))
        return True

    def _fold(self, r: int, b: int) -> None:
        """Add the tree under b to the automaton at r."""
        todo = [(r, b)]
        while todo:
            x, y = todo.pop()
            self.ends[x] += self.ends[y]
            for c, n in self.flow[y].items():
                self.flow[x][c] += n
                if c in self.next[x]:
                    todo.append((self.next[x][c], self.next[y][c]))
                else:
                    self.next[x][c] = self.next[y][c]

    def _merge(self) -> None:
        red, done = [0], {0}
        while True:
            blue = next(((s, c, t) for s in red for c, t in sorted(self.next[s].items()) if t not in done), None)
            if blue is None:
                break
            s, c, t = blue
            for r in red:
                if self._compatible(r, t):
                    self.next[s][c] = r
                    self._fold(r, t)
                    break
            else:
                red.append(t)
                done.add(t)
        place = {s: i for i, s in enumerate(red)}
        self.next = [{c: place[t] for c, t in self.next[s].items()} for s in red]
        self.flow, self.ends = [self.flow[s] for s in red], [self.ends[s] for s in red]

    def log_likelihood(self, s) -> float:
        """Natural log of the probability; what no training string did counts as one half of an occurrence."""
        state, out = 0, 0.0
        for c in s:
            if state is None:
                out -= math.log(self.alphabet)
                continue
            out += math.log((self.flow[state][c] + 0.5 / self.alphabet) / (self._total(state) + 0.5))
            state = self.next[state].get(c)
        return out if state is None else out + math.log((self.ends[state] + 0.25) / (self._total(state) + 0.5))

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For strings of bytes: next state, natural log of each step and of an end; the last state is off the paths."""
        n = len(self.next)
        turn, step, end = np.full((n + 1, 256), n, np.int32), np.full((n + 1, 256), -math.log(self.alphabet)), np.zeros(n + 1)
        for i in range(n):
            step[i] = math.log(0.5 / self.alphabet / (self._total(i) + 0.5))
            for c, m in self.flow[i].items():
                step[i, c] = math.log((m + 0.5 / self.alphabet) / (self._total(i) + 0.5))
            for c, t in self.next[i].items():
                turn[i, c] = t
            end[i] = math.log((self.ends[i] + 0.25) / (self._total(i) + 0.5))
        return turn, step, end


class Scorer:
    """Automata of labelled credentials and a background of single symbols."""

    def __init__(self, labelled: dict[str, list[bytes]], background: np.ndarray, odds: float | None = None):
        """background: how often each pair of symbols stands in all candidates; odds: log of candidates to labelled values."""
        alone = (background.sum(axis=0) + 1) / (background.sum() + 256)
        self.back = np.log((background + PAIRS * alone) / (background.sum(axis=1, keepdims=True) + PAIRS))
        candidates = int(background[0].sum())
        self.odds = math.log(max(1, candidates) / max(1, sum(map(len, labelled.values())))) if odds is None else odds
        self.odds = max(0.0, self.odds)
        self.models: dict[str, tuple[Automaton, float, float]] = {}
        self.tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for kind in KINDS:
            values = sorted(labelled.get(kind, []))
            if not values:
                continue
            test, train = values[::4], [v for i, v in enumerate(values) if i % 4] or values
            model = Automaton([symbols(v) for v in train])
            reached = [(self._ratio(model, s)[0], len(s)) for s in map(symbols, test)]
            mean = sum(r for r, _ in reached) / sum(n for _, n in reached)
            spread = math.sqrt(sum((r / n - mean) ** 2 * n for r, n in reached) / len(reached))
            self.models[kind] = (model, mean, spread)
            self.tables.append(model.tables())

    def _ratio(self, model: Automaton, s: bytes) -> tuple[float, float]:
        """Log-likelihood ratio of a string of symbols, without and with its end."""
        turn, step, end = model.tables() if not hasattr(model, "made") else model.made
        model.made, state, total = (turn, step, end), 0, 0.0
        for before, c in zip(b"\0" + s, s, strict=False):
            total += float(step[state, c] - self.back[before, c])
            state = turn[state, c]
        return total, total + float(end[state])

    def _over(self, steps, whole, n, mean: float, spread: float):
        """By how much, for each symbol, ratios exceed a kind's levels."""
        level = np.maximum(0.5, mean - 1.645 * spread / np.sqrt(n))
        return np.minimum(steps / n - level, (whole - self.odds) / n)

    def score(self, value: bytes) -> float:
        """By how much, for each symbol, the best kind's ratio exceeds its levels; below 0 for no secret. -99 without
        automata."""
        s, n = symbols(value), len(value)
        return max((float(self._over(*self._ratio(m, s), n, a, b)) for m, a, b in self.models.values()), default=-99.0)

    def secret(self, value: bytes) -> bool:
        return self.score(value) >= 0

    def scores(self, chunk: Chunk) -> np.ndarray:
        """The score of each candidate of a chunk."""
        best = np.full(len(chunk.start), -99.0)
        if not self.models:
            return best
        size = chunk.end - chunk.start
        for i in np.flatnonzero(size > COLUMNS).tolist():
            best[i] = self.score(chunk.value(i))
        short = np.flatnonzero(size <= COLUMNS)
        short = short[np.argsort(-size[short], kind="stable")]
        start, size = chunk.start[short], size[short]
        back, total, before = np.zeros(len(short)), np.zeros((len(self.tables), len(short))), np.zeros(len(short), np.uint8)
        state = np.zeros((len(self.tables), len(short)), np.int32)
        reach = np.searchsorted(-size, -np.arange(int(size.max()) if len(size) else 0), "left")  # candidates longer than k
        for k, n in enumerate(reach.tolist()):
            c = chunk.data[start[:n] + k]
            c = c if k < FULL else SYMBOL[c]
            back[:n] += self.back[before[:n], c]
            before[:n] = c
            for j, (turn, step, _) in enumerate(self.tables):
                total[j, :n] += step[state[j, :n], c]
                state[j, :n] = turn[state[j, :n], c]
        for j, (_, mean, spread) in enumerate(self.models.values()):
            steps = total[j] - back
            over = self._over(steps, steps + self.tables[j][2][state[j]], size, mean, spread)
            best[short] = np.maximum(best[short], over)
        return best


def _values():
    """Distinct labelled values and counts of the candidates' pairs of symbols of a task."""

    def run(batches):
        seen, counts = set(), np.zeros((256, 256), np.int64)
        for batch in batches:
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            for a, b in chunks(texts):
                chunk = Chunk(texts[a:b])
                counts += chunk.pairs()
                fresh = {(k, v) for spans in chunk.base for k, _, _, v in spans} - seen
                seen |= fresh
                if fresh:
                    yield _rows([(k, v, 0) for k, v in sorted(fresh)])
            if len(seen) > REMEMBERED:
                seen.clear()
        yield _rows([("pair", bytes([a, b]), int(counts[a, b])) for a, b in np.argwhere(counts).tolist()])

    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 3
    kinds = (pa.string(), pa.binary(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["kind", "value", "n"])


def fit(docs: DataFrame, text: str = "text", examples: int = EXAMPLES) -> Scorer:
    """Automata from at most `examples` distinct labelled values of each kind; every text is searched for them, once."""
    made = docs.select(F.col(name(text)).cast("string")).mapInArrow(lambda batches: _values()(batches), "kind string, value binary, n long")
    values = cut_lineage(made.groupBy("kind", "value").agg(F.sum("n").alias("n")))
    sample: dict[str, list[bytes]] = {}
    for kind in KINDS:
        least = values.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(examples)
        sample[kind] = [bytes(r["value"]) for r in least.collect()]
    counts = np.zeros((256, 256), np.int64)
    for r in values.where("kind = 'pair'").collect():  # a row for each pair of key characters at most
        counts[r["value"][0], r["value"][1]] = r["n"]
    labelled = values.where("kind <> 'pair'").count()
    return Scorer(sample, counts, math.log(max(1, int(counts[0].sum())) / max(1, labelled)))


def all_spans(texts: list[bytes | None], scorer: Scorer) -> list[list[tuple[str, int, int, float]]]:
    """(kind, start, end, score) of the secrets of each text, in bytes, by start and then kind as listed."""
    out: list[list[tuple]] = []
    for a, b in chunks(texts):
        chunk = Chunk(texts[a:b])
        found = [[(k, x, y, scorer.score(v)) for k, x, y, v in spans] for spans in chunk.base]
        scores = scorer.scores(chunk)
        for i in np.flatnonzero(scores >= 0).tolist():
            at = int(chunk.first[chunk.of[i]])
            found[chunk.of[i]].append(("format", int(chunk.start[i]) - at, int(chunk.end[i]) - at, float(scores[i])))
        out += [sorted(spans, key=lambda s: (s[1], (*KINDS, "format").index(s[0]))) for spans in found]
    return out


def _finder(shared):
    scorer = shared.value

    def find(texts):
        marked = (characters(t or b"", spans) for t, spans in zip(texts, all_spans(texts, scorer), strict=True))
        return ([[{"kind": k, "start": a, "end": b, "score": x} for k, a, b, x in spans] for spans in marked],)

    return find


def find_secrets(docs: DataFrame, scorer: Scorer, text: str = "text", keep=None) -> DataFrame:
    """row and spans (kind, start, end, score) for each row of docs. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    fields = [structs("spans", string("kind"), long("start"), long("end"), double("score"))]
    return annotate(docs, text, partial(_finder, shared), fields, keep)


def _redactor(shared, mark):
    scorer = shared.value

    def clean(texts):
        out, numbers = [], []
        for t, spans in zip(texts, all_spans(texts, scorer), strict=True):
            body, parts, at = t or b"", [], 0
            for _, a, b, _ in spans:
                if a >= at:
                    parts += [body[at:a], mark]
                at = max(at, b)
            out.append(None if t is None else b"".join([*parts, body[at:]]).decode("utf-8", "replace"))
            numbers.append(len(spans))
        return out, numbers

    return clean


def redact(docs: DataFrame, text: str = "text", length: str | None = None, mark: str = "[secret]", **options) -> DataFrame:
    """docs, all columns and rows, with every secret replaced by a mark; `length` names a column of text lengths
    that is set anew where a text changed. Null texts stay null."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, text, **options))
    found = annotate(docs, text, partial(_redactor, shared, mark.encode()), [string("clean"), long("n")])
    new = {text: F.col("clean")}
    if length:
        new[length] = F.when(F.col("n") > 0, F.length("clean").cast(docs.schema[length].dataType)).otherwise(F.col("row")[length])
    return found.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
