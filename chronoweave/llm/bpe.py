"""Byte-level BPE by monoid tree reduction.

A text is halved until a part is short; parts are encoded alone and neighbours are joined. Two levels join:

* Pieces. The split pattern is scanned from left to right and has no memory: from a given position it finds the
  same pieces whatever stood before. A join scans again from a piece start of the left part whose piece could not
  have seen the seam, and stops at the first position that the right part also has as a piece start: beyond it
  the two scans agree for ever. If the window ends first, it grows to both sides.
* Tokens of a piece. Two token lists are right together if every neighbouring pair is, that is, if the pair's
  bytes encode to that very pair. A join encodes a window around the seam again and widens it until the pairs at
  both of its ends hold. A piece in which a window would grow beyond WINDOW bytes is merged at once instead, by a heap.

Decoding maps ids to bytes and concatenates up the same tree.

Defined cases: null and empty texts have no tokens and decode to no bytes; repeated rows get equal results; very
long texts and very long pieces cost time in proportion to their length. Columns beside the text cannot clash.
"""

from __future__ import annotations

import base64
import heapq
from functools import partial

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import annotate

#: Characters of a part that is scanned alone.
LEAF = 512
#: Pieces that each of the two generations of a task's memo holds: when the newer one is full, it becomes the older.
MEMO = 150_000
#: Longest piece, in bytes, that is merged directly; longer ones are halved.
SHORT = 32
#: Bytes of a window around a seam beyond which the whole piece is encoded at once: in runs of one character and the
#: like the tokens never settle, and each level of the tree would encode everything again.
WINDOW = 2048


class Unsettled(Exception):
    """The window around a seam grew too long."""


class Tokenizer:
    """Ranks of byte strings and the pattern that splits a text into pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF):
        self.ranks, self.pattern, self.leaf = ranks, regex.compile(pattern), leaf
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.packed = {b: i.to_bytes(4, "little") for b, i in ranks.items()}
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}

    # tokens of one piece, as lists of byte strings

    def merge(self, parts: list[bytes]) -> list[bytes]:
        """Join the neighbours of lowest rank, the leftmost first, until none has a rank. For short lists."""
        ranks, none = self.ranks, 1 << 60
        parts = list(parts)
        costs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while costs:
            i = costs.index(least := min(costs))
            if least == none:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del costs[i]
            if i < len(costs):
                costs[i] = ranks.get(parts[i] + parts[i + 1], none)
            if i:
                costs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        return parts

    def merge_long(self, parts: list[bytes]) -> list[bytes]:
        """The same by a heap of pairs (rank, place), which takes little more than linear time."""
        ranks, n = self.ranks, len(parts)
        parts, after, before = [*parts, b""], list(range(1, n + 1)), list(range(-1, n))
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            # a pair that is no longer there: its left part is gone, or one of them has grown
            if not parts[i] or (j := after[i]) == n or ranks.get(both := parts[i] + parts[j]) != rank:
                continue
            parts[i], parts[j], after[i] = both, b"", after[j]
            before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := ranks.get(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (r, a))
        return [p for p in parts if p]

    def whole(self, data: bytes) -> list[bytes]:
        parts = [data[i : i + 1] for i in range(len(data))]
        return self.merge(parts) if len(parts) <= 2 * SHORT else self.merge_long(parts)

    def fits(self, a: bytes, b: bytes) -> bool:
        """Whether these two tokens, side by side, are what their bytes encode to."""
        if (known := self.pairs.get((a, b))) is None:
            if len(self.pairs) >= MEMO:
                self.pairs.clear()
            known = self.pairs[a, b] = self.whole(a + b) == [a, b]
        return known

    def join_tokens(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        i, j, step = len(left), 0, 1
        if left and right and self.fits(left[-1], right[0]):
            return left + right
        while True:
            i, j, step = max(0, i - step), min(len(right), j + step), step * 2
            window = b"".join([*left[i:], *right[:j]])
            if len(window) > WINDOW:
                raise Unsettled
            middle = self.whole(window)
            if not middle:
                return left + right
            if (not i or self.fits(left[i - 1], middle[0])) and (j == len(right) or self.fits(middle[-1], right[j])):
                return left[:i] + middle + right[j:]

    def tokens(self, data: bytes) -> list[bytes]:
        if len(data) <= SHORT:
            return self.whole(data)
        half = len(data) // 2
        return self.join_tokens(self.tokens(data[:half]), self.tokens(data[half:]))

    def piece(self, piece: str) -> bytes:
        """Packed ids of one piece."""
        if (known := self.older.get(piece)) is not None:
            self.remember(piece, known)
            return known
        data = piece.encode("utf-8", "surrogatepass")
        if (one := self.packed.get(data)) is not None:
            ids = one
        else:
            try:
                found = self.tokens(data)
            except Unsettled:
                found = self.whole(data)
            ids = b"".join([self.packed[t] for t in found])
        if len(piece) <= 64:
            self.remember(piece, ids)
        return ids

    def remember(self, piece: str, ids: bytes) -> None:
        if len(self.memo) >= MEMO:
            self.memo, self.older = {}, self.memo
        self.memo[piece] = ids

    # pieces of a text

    def join_pieces(self, text: str, left: list[str], right: list[str], lo: int, seam: int, hi: int) -> list[str]:
        """Pieces of text[lo:hi] from those of text[lo:seam] and of text[seam:hi]."""
        grow = 64
        while True:
            # a left piece followed by one more whole piece saw nothing beyond the seam
            i, start = len(left), seam
            while i and (seam - start < grow or len(left) - i < 3):
                i -= 1
                start -= len(left[i])
            ends, at = {seam: 0}, seam
            for n, p in enumerate(right, 1):
                at += len(p)
                ends[at] = n
                if at - seam > grow:
                    break
            stop = at
            middle = []
            for m in self.pattern.finditer(text, start, hi):
                middle.append(m.group())
                if (n := ends.get(m.end())) is not None and m.end() > seam:
                    return left[:i] + middle + right[n:]
                if m.end() >= stop:
                    break
            else:
                return left[:i] + middle
            if stop == hi and start == lo:
                return list(self.pattern.findall(text, lo, hi))
            grow *= 4

    def pieces(self, text: str, lo: int = 0, hi: int | None = None) -> list[str]:
        hi = len(text) if hi is None else hi
        if hi - lo <= self.leaf:
            return self.pattern.findall(text, lo, hi) if (lo, hi) == (0, len(text)) else self.pattern.findall(text[lo:hi])
        seam = (lo + hi) // 2
        return self.join_pieces(text, self.pieces(text, lo, seam), self.pieces(text, seam, hi), lo, seam, hi)

    def encode(self, text: str | None) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        out = []
        for p in self.pieces(text):
            ids = self.memo.get(p)
            out.append(self.piece(p) if ids is None else ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """Bytes of packed ids."""
        numbers = np.frombuffer(ids, "<u4")
        if len(numbers) <= self.leaf:
            return b"".join(map(self.bytes_of.__getitem__, numbers.tolist()))
        half = len(numbers) // 2 * 4
        return self.decode(ids[:half]) + self.decode(ids[half:])


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file with a base64 byte string and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


_made: dict[tuple[str, str], Tokenizer] = {}


def tokenizer(vocabulary: str | None = None, pattern: str | None = None) -> Tokenizer:
    """One tokenizer a process. vocabulary: a path that every executor has; the public 50k ranks by default."""
    if vocabulary is None or pattern is None:
        import public_tokenizers

        vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
        pattern = pattern or public_tokenizers.PATTERN
    if (vocabulary, pattern) not in _made:
        _made[vocabulary, pattern] = Tokenizer(load_ranks(vocabulary), pattern)
    return _made[vocabulary, pattern]


def _encoder(vocabulary, pattern):
    t = tokenizer(vocabulary, pattern)
    return lambda texts: ([t.encode(x) for x in texts],)


def _round_trip(vocabulary, pattern):
    t = tokenizer(vocabulary, pattern)

    def both(texts):
        ids = [t.encode(x) for x in texts]
        return ids, [t.decode(x) for x in ids]

    return both


def encode(docs: DataFrame, text: str = "text", vocabulary: str | None = None, pattern: str | None = None, keep=None) -> DataFrame:
    """row and ids (packed little-endian unsigned 32-bit integers) for each row of docs. No shuffle."""
    return annotate(docs, text, partial(_encoder, vocabulary, pattern), [T.StructField("ids", T.BinaryType())], keep, binary=False)


def round_trip(docs: DataFrame, text: str = "text", vocabulary: str | None = None, pattern: str | None = None, keep=None) -> DataFrame:
    """row, ids and decoded (bytes of the ids) for each row of docs. No shuffle."""
    fields = [T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())]
    return annotate(docs, text, partial(_round_trip, vocabulary, pattern), fields, keep, binary=False)


def decode(encoded: DataFrame, ids: str = "ids", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """row and decoded bytes for packed ids in a binary column; null ids decode to no bytes."""

    def make():
        t = tokenizer(vocabulary, pattern)
        return lambda texts: ([t.decode(bytes.fromhex(x)) if x else b"" for x in texts],)

    hexed = encoded.withColumn("text of ids", F.lower(F.hex(ids)))
    return annotate(hexed, "text of ids", make, [T.StructField("decoded", T.BinaryType())], encoded.columns, binary=False)
