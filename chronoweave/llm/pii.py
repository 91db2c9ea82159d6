"""Personal data by weak supervision.

Candidates are the base matches and looser shapes (spelt-out e-mail addresses, number groups that could be
telephone or card numbers, long numbers and dotted quads that fail the base rules). Labelers vote on each: a strict
regular expression, a gazetteer (top-level domains, number prefixes, first octets) and the words in front. Votes are
1, -1 or 0 for no opinion. Expectation-maximisation estimates from the counts of vote patterns of all candidates of
all texts how reliable each labeler is for each kind, and with that how likely each pattern is a true span. These
likelihoods are the soft labels from which the span classifier, a logistic model over the shape of a span, is trained.
Candidates that are no base matches become spans when vote pattern and classifier both reach `sure`. Base spans always
stay, and every span carries both probabilities.

The reliabilities come from counts of the vote patterns of all data, of which there are 27 for each kind. The classifier
is trained on `shapes` different pairs of shape and pattern at most, those of the smallest hashes, with their counts.

Defined cases: null and empty texts have no spans; without candidates nothing is added; repeated rows get equal
results; offsets are code points, end exclusive.
"""

from __future__ import annotations

import re
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.session import cut_lineage

from .rows import annotate, double, long, string, structs
from .secret import characters

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("regex", "gazetteer", "context")
SURE = 0.9
#: Different pairs of shape and vote pattern that train the classifier.
SHAPES = 20_000

#: Fixed patterns of the base kinds over UTF-8 bytes. A match never starts inside a run of digits that failed as a
#: whole, and possessive repeats give nothing back, so each finds what the plain pattern finds, in linear time.
DOMAIN = re.compile(rb"@[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)++")
LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(rb"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(rb"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
#: Looser shapes.
SPELT = re.compile(rb"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:[(\[]at[)\]]|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:[(\[]dot[)\]]|\x20dot\x20)\x20?[A-Za-z0-9-]{1,63}+)+")
GROUPS = re.compile(rb"(?<![0-9A-Za-z+.-])\(?[0-9]{2,4}\)?(?:[\x20.-]{1,2}\(?[0-9]{2,4}\)?){2,4}(?![0-9A-Za-z])")
LOCAL_NUMBER = re.compile(rb"(?<![0-9A-Za-z+().-])(?<![0-9)][\x20])[0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z-])")
LONG_NUMBER = re.compile(rb"(?<![0-9A-Za-z.])[0-9]{12,19}+(?![0-9A-Za-z]|\.[0-9])")
NOT_DIGIT = re.compile(rb"[^0-9]")
#: Fixed word lists of the gazetteer and context labelers.
DOMAINS = set(b"com org net edu gov int info biz io co uk de fr es it nl eu us ca au ch at be se no dk fi pl pt jp cn in br mx ru".split())
CUES = {
    "email": rb"e-?mails?|mail|contact|write|reach|correo|courriel",
    "ip": rb"ip|host|server|address|addr|gateway|dns|node",
    "card": rb"card|visa|amex|mastercard|credit|debit|tarjeta|carte|karte",
    "phone": rb"tel|phone|telephone|call|mobile|cell|fax|whatsapp|telefon|telefono",
}
AGAINST = rb"version|ver|v|id|no|order|isbn|issn|page|pages|section|figure|doi|ref"
CUE = {k: re.compile(rb"(?i)(?<![a-z])(?:%b)[^a-z]{0,4}(?:[a-z]+[^a-z]{1,3}){0,3}$" % v) for k, v in CUES.items()}
CUE_AGAINST = re.compile(rb"(?i)(?<![a-z])(?:%b)[^a-z]{0,4}$" % AGAINST)


def luhn(digits: bytes) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = (d - 48) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: bytes) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches. The part in front of an @ is the whole run of its characters, so each @
    is looked at once: the run cannot hold another, and if the domain fails, every start in the run fails."""
    out, done, at = [], 0, text.find(b"@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find(b"@", max(at + 1, done))
    return out


def base_spans(text: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base kinds, in bytes, by start and then kind as listed."""
    out = [("email", a, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip(b"0")) <= 3 and int(p.lstrip(b"0") or b"0") <= 255 for p in m[0].split(b".")):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub(b"", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if b"+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub(b"", m[0])) <= 15]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def loose_spans(text: bytes, base: list[tuple]) -> list[tuple[str, int, int]]:
    """Candidates beside the base spans, none of which overlaps one or another of its kind."""
    out = []
    if b"dot" in text:
        out += [("email", m.start(), m.end()) for m in SPELT.finditer(text)]
    for m in GROUPS.finditer(text):
        n = len(NOT_DIGIT.sub(b"", m[0]))
        if 9 <= n <= 19:
            out.append(("phone" if n <= 11 else "card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in LOCAL_NUMBER.finditer(text)]
    out += [("card", m.start(), m.end()) for m in LONG_NUMBER.finditer(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text)]
    taken, free, i = sorted((a, b) for _, a, b in base), [], 0
    reach = 0
    for kind, a, b in sorted(out, key=lambda x: x[1]):
        while i < len(taken) and taken[i][0] < b:
            reach = max(reach, taken[i][1])
            i += 1
        if reach <= a:
            free.append((kind, a, b))
            reach = b
    return free


def votes(text: bytes, kind: str, start: int, end: int) -> tuple[int, int, int]:
    """What the labelers say of a candidate, in the order of LABELERS."""
    span, before = text[start:end], text[max(0, start - 48) : start]
    digits = NOT_DIGIT.sub(b"", span)
    if kind == "email":
        strict = 1 if b"@" in span and b".." not in span and span[:1] not in b".%+-" else -1
        listed = 1 if re.split(rb"[.\x20)\]]+", span.strip(b")]"))[-1].lower() in DOMAINS else -1
    elif kind == "ip":
        strict = 1 if all(len(p) == 1 or p[:1] != b"0" for p in span.split(b".")) else -1
        first = span.split(b".")[0].lstrip(b"0")
        strict = strict if all(len(p) <= 3 and int(p) <= 255 for p in span.split(b".")) else -1
        listed = 1 if 1 <= len(first) <= 3 and int(first) <= 223 else -1
    elif kind == "card":
        strict = 1 if 12 <= len(digits) <= 19 and luhn(digits) else -1
        listed = 1 if digits[:1] in (b"4", b"5") or digits[:2] in (b"34", b"37", b"35", b"60", b"62", b"65") else -1
    else:
        strict = 1 if re.fullmatch(rb"(\+[0-9]{1,3}[\x20.-]?)?(\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20.-])?[0-9]{3,4}[\x20.-]?[0-9]{3,4}", span) else -1
        listed = 1 if span[:1] == b"+" and digits[:1] != b"0" else 1 if len(digits) == 10 and digits[0] > 49 and digits[3] > 49 else -1
    context = -1 if CUE_AGAINST.search(before) else 1 if CUE[kind].search(before) else 0
    return strict, listed, context


def shape(text: bytes, kind: str, start: int, end: int) -> str:
    """The features of a span that the classifier reads, each with few values."""
    span = text[start:end]
    number = NOT_DIGIT.sub(b"", span)
    digits, check = len(number), luhn(number) if kind == "card" else ""
    marks = "".join(chr(c) for c in b" .-()+@" if c in span)
    side = chr(text[start - 1]) if start and text[start - 1] in b" \n(:,\"'" else "" if not start else "x"
    groups = min(6, len(re.findall(rb"[0-9]+", span)))
    return "\t".join([f"k:{kind}", f"d:{kind}{min(digits, 20)}", f"m:{kind}{marks}", f"s:{side!r}", f"g:{kind}{groups}", f"f:{kind}{number[:1].decode()}{check}", f"l:{min(len(span) // 6, 8)}"])


def _patterns():
    def find(texts):
        out = []
        for t in texts:
            t = t or b""
            base = base_spans(t)
            rows = []
            for is_base, spans in ((1, base), (0, loose_spans(t, base))):
                for kind, a, b in spans:
                    v = votes(t, kind, a, b)
                    rows.append({"kind": kind, "base": is_base, "votes": ",".join(map(str, v)), "shape": shape(t, kind, a, b)})
            out.append(rows)
        return (out,)

    return find


class Labels:
    """Reliabilities by expectation-maximisation for each kind: P(true) and P(vote | true or false)."""

    def __init__(self, counts: dict[tuple[str, tuple[int, ...]], float], rounds: int = 50):
        self.prior: dict[str, float] = {}
        self.table: dict[str, np.ndarray] = {}
        for kind in KINDS:
            seen = {v: n for (k, v), n in counts.items() if k == kind and n}
            if not seen:
                continue
            patterns = np.array(list(seen)) + 1
            n = np.array(list(seen.values()), float)
            p = np.clip(0.5 + (patterns - 1).sum(axis=1) / (2 * len(LABELERS)), 0.1, 0.9)  # to begin with, the majority
            for _ in range(rounds):
                self.prior[kind] = prior = float(np.clip((n @ p + 1) / (n.sum() + 2), 1e-3, 1 - 1e-3))
                table = np.full((2, len(LABELERS), 3), 0.5)
                for y, w in ((1, n * p), (0, n * (1 - p))):
                    for j in range(len(LABELERS)):
                        np.add.at(table[y, j], patterns[:, j], w)
                # a labeler is better than chance: agreeing votes keep a little more weight than opposing ones
                table[1, :, 2] += 2
                table[0, :, 0] += 2
                table /= table.sum(axis=2, keepdims=True)
                self.table[kind] = table
                p = self._posterior(patterns, prior, table)

    @staticmethod
    def _posterior(patterns: np.ndarray, prior: float, table: np.ndarray) -> np.ndarray:
        log = [np.log(table[y][np.arange(len(LABELERS)), patterns]).sum(axis=1) + np.log(q) for y, q in ((0, 1 - prior), (1, prior))]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))

    def true(self, kind: str, votes: tuple[int, ...]) -> float:
        if kind not in self.prior:
            return 0.0
        return float(self._posterior(np.array([votes]) + 1, self.prior[kind], self.table[kind])[0])


class Classifier:
    """A logistic model over span shapes, trained on soft labels."""

    def __init__(self, rows: list[tuple[str, float, float]], ridge: float = 1.0, rounds: int = 50):
        """rows: (shape, likelihood of a true span, count)."""
        self.place: dict[str, int] = {}
        for s, _, _ in rows:
            for f in s.split("\t"):
                self.place.setdefault(f, len(self.place))
        self.weights = np.zeros(len(self.place) + 1)
        if not rows:
            return
        x = np.zeros((len(rows), len(self.weights)))
        x[:, -1] = 1
        for i, (s, _, _) in enumerate(rows):
            for f in s.split("\t"):
                x[i, self.place[f]] = 1
        y, n = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        n = n / n.sum() * min(n.sum(), 1e4)
        for _ in range(rounds):  # Newton's method
            p = 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))
            slope = x.T @ (n * (p - y)) + ridge * self.weights
            step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1]), slope)
            self.weights = self.weights - np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break

    def true(self, shape: str) -> float:
        z = self.weights[-1] + sum(self.weights[i] for f in shape.split("\t") if (i := self.place.get(f)) is not None)
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def fit(docs: DataFrame, text: str = "text", shapes: int = SHAPES) -> tuple[Labels, Classifier]:
    """Both models, from the candidates of all texts."""
    fields = [structs("found", string("kind"), long("base"), string("votes"), string("shape"))]
    each = annotate(docs, text, _patterns, fields, keep=[]).select(F.explode("found").alias("x")).select("x.kind", "x.votes", "x.shape")
    counted = cut_lineage(each.groupBy("kind", "votes", "shape").count())
    pattern = lambda r: (r["kind"], tuple(map(int, r["votes"].split(","))))
    labels = Labels({pattern(r): r["n"] for r in counted.groupBy("kind", "votes").agg(F.sum("count").alias("n")).collect()})
    rows: dict = {}
    for r in counted.orderBy(F.xxhash64("kind", "votes", "shape"), "kind", "votes", "shape").limit(shapes).collect():
        p, n = rows.get(r["shape"], (0.0, 0.0))
        rows[r["shape"]] = (p + r["count"] * labels.true(*pattern(r)), n + r["count"])
    return labels, Classifier([(s, p / n, n) for s, (p, n) in sorted(rows.items())])


def _finder(shared, sure):
    labels, classifier = shared.value

    def rate(text, kind, a, b):
        return labels.true(kind, votes(text, kind, a, b)), classifier.true(shape(text, kind, a, b))

    def find(texts):
        out = []
        for t in texts:
            t = t or b""
            base = base_spans(t)
            spans = [(k, a, b, 1, *rate(t, k, a, b)) for k, a, b in base]
            loose = [(k, a, b, 0, *rate(t, k, a, b)) for k, a, b in loose_spans(t, base)]
            spans += [s for s in loose if min(s[4:]) >= sure]
            spans.sort(key=lambda s: (s[1], KINDS.index(s[0])))
            out.append([dict(zip(("kind", "start", "end", "base", "votes", "shape"), s, strict=True)) for s in characters(t, spans)])
        return (out,)

    return find


def find_personal(docs: DataFrame, models: tuple[Labels, Classifier], text: str = "text", sure: float = SURE, keep=None) -> DataFrame:
    """row and spans (kind, start, end, base, and the probabilities by its votes and by its shape) for each row of
    docs. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    fields = [structs("spans", string("kind"), long("start"), long("end"), long("base"), double("votes"), double("shape"))]
    return annotate(docs, text, partial(_finder, shared, sure), fields, keep)
