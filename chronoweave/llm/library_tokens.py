"""Token ids as the tokenizers library gives them, found by distinct pieces.

The library splits a text into pieces (white space, letters, digits, others, contractions) and encodes each alone.
Here the places where pieces begin are found for many texts at once by array operations on character classes; Arrow
numbers the distinct pieces, and only pieces that a task has not met lately go to the library. A text with a
character whose class is not the same in Unicode 3.2 and in this Python goes to the library as a whole, and so does
everything under a tokenizer of another kind.
"""

from __future__ import annotations

import json
import os
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa

#: Code points of White_Space, as fixed by Unicode.
SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Classes of characters.
BLANK, SPACE, LETTER, DIGIT, OTHER, UNSURE, UNSEEN = range(7)
#: Pieces that a task remembers; beyond this it begins anew.
MEMO = 800_000
#: Bytes of text that are split together; a longer text is split alone.
SLICE = 4 << 20


def class_of(code: int) -> int:
    if code in SPACES:
        return BLANK if code == 32 else SPACE
    now, then = unicodedata.category(chr(code)), unicodedata.ucd_3_2_0.category(chr(code))
    if now[0] != then[0] and (now[0] in "LN" or then[0] in "LNZ") or now == "Cn" or now == "Cs":
        return UNSURE
    return LETTER if now[0] == "L" else DIGIT if now[0] == "N" else OTHER


class Encoder:
    """One tokenizer file; ids end with `end` (None: nothing is added)."""

    def __init__(self, path: str, end: int | None = 0):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.end = end
        self.kind = np.uint16 if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.uint32
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        split = made.get("pre_tokenizer") or {}
        self.plain = (
            split.get("type") == "ByteLevel"
            and split.get("use_regex", True)
            and not split.get("add_prefix_space")
            and not made.get("normalizer")
            and not made.get("post_processor")
            and (made.get("model") or {}).get("type") == "BPE"
        )
        self.classes = np.full(0x110000, UNSEEN, np.uint8)
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        self.letters = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in shown)}
        self.forget()

    def forget(self) -> None:
        self.memo: dict[bytes, int] = {}
        self.flat, self.place, self.length = np.empty(0, self.kind), np.empty(0, np.int64), np.empty(0, np.int64)

    # pieces

    def kinds(self, codes: np.ndarray) -> np.ndarray:
        found = self.classes[codes]
        if (found == UNSEEN).any():
            for c in np.unique(codes[found == UNSEEN]).tolist():
                self.classes[c] = class_of(c)
            found = self.classes[codes]
        return found

    @staticmethod
    def begins(codes: np.ndarray, kinds: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """Whether a piece begins at each character; texts: where (non-empty) texts begin."""
        n = len(codes)
        first = np.zeros(n + 1, bool)
        first[texts], first[n] = True, True
        before = np.empty(n, np.uint8)
        before[0], before[1:] = UNSEEN, kinds[:-1]
        before[first[:n]] = UNSEEN
        white, was_white = kinds <= SPACE, before <= SPACE
        # a run's first character; the space before it belongs to a run of anything but white space
        start = np.where(white, ~was_white, (kinds != before) & (before != BLANK))
        # the last of several white characters, if something follows in the same text
        follows = np.zeros(n, bool)
        follows[:-1] = ~white[1:] & ~first[1:n]
        start |= white & follows
        # contractions
        for i in np.flatnonzero(start & (codes == 39)).tolist():
            rest = "".join(map(chr, codes[i + 1 : i + 3].tolist()))
            k = 2 if rest[:1] in ("s", "t", "m", "d") else 3 if rest in ("re", "ve", "ll") else 0
            if k and not first[i + 1 : i + k].any():
                start[i + 1] = False
                if i + k < n and not white[i + k]:
                    start[i + k] = True
        start |= first[:n]
        return start

    # ids of pieces

    def learn(self, pieces: list[bytes]) -> None:
        """Ask the library's model, which takes a piece's bytes as one character each."""
        tokenize, letters = self.library.model.tokenize, self.letters
        found = [[x.id for x in tokenize(p.decode("latin-1").translate(letters))] for p in pieces]
        length = np.fromiter(map(len, found), np.int64, len(found))
        place = len(self.flat) + np.cumsum(length) - length
        self.memo.update(zip(pieces, range(len(self.memo), len(self.memo) + len(pieces)), strict=True))
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(found), self.kind, int(length.sum()))])
        self.place, self.length = np.concatenate([self.place, place]), np.concatenate([self.length, length])

    def numbers(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Places and lengths in `flat` of every piece."""
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.memo) > MEMO:
            self.forget()
        get = self.memo.get
        known = np.array([get(p, -1) for p in distinct], np.int64)
        if len(new := np.flatnonzero(known < 0)):
            known[new] = np.arange(len(self.memo), len(self.memo) + len(new))
            self.learn([distinct[i] for i in new.tolist()])
        at = known[coded.indices.to_numpy(zero_copy_only=False)]
        return self.place[at], self.length[at]

    # texts

    def _split(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each). data: bytes of all texts, ends: where each ends, from 0."""
        codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        widths = 1 + (codes >= 0x80).astype(np.uint8) + (codes >= 0x800) + (codes >= 0x10000)
        at = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(widths, out=at[1:])
        starts = np.concatenate([[0], ends[:-1]])
        chars = np.searchsorted(at, starts)
        kinds = self.kinds(codes)
        filled = ends > starts
        odd = np.zeros(len(ends), bool)
        if (kinds == UNSURE).any():
            odd[np.searchsorted(ends, at[np.flatnonzero(kinds == UNSURE)], side="right")] = True
        begin = np.flatnonzero(self.begins(codes, kinds, chars[filled]))
        offsets = np.append(at[begin], at[-1]).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        owner = np.searchsorted(ends, at[begin], side="right")
        if odd.any():  # their pieces are not looked up
            keep = ~odd[owner]
            pieces, owner = pieces.filter(pa.array(keep)), owner[keep]
        place, length = self.numbers(pieces)
        stop = np.cumsum(length)
        total = int(stop[-1]) if len(stop) else 0
        ids = self.flat[np.repeat(place - (stop - length), length) + np.arange(total)]
        counts = np.bincount(owner, weights=length, minlength=len(ends)).astype(np.int64)
        if odd.any():
            whole = {i: self._alone(data[starts[i] : ends[i]].tobytes()) for i in np.flatnonzero(odd).tolist()}
            bounds = np.append(0, np.cumsum(counts))
            ids = np.concatenate([whole.get(i, ids[bounds[i] : bounds[i + 1]]) for i in range(len(ends))])
            for i, found in whole.items():
                counts[i] = len(found)
        return ids, counts

    def _alone(self, text: bytes) -> np.ndarray:
        return np.array(self.library.encode(text.decode(), add_special_tokens=False).ids, self.kind)

    def _ended(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.end is None:
            return ids, counts
        out = np.full(len(ids) + len(counts), self.end, self.kind)
        gap = np.repeat(np.arange(len(counts)), counts)
        out[np.arange(len(ids)) + gap] = ids
        return out, counts + 1

    def encode(self, texts: pa.Array) -> pa.Array:
        """Packed ids (little-endian, of `kind`) of every text; nulls count as empty."""
        texts = texts.cast(pa.large_binary())
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
        data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.empty(0, np.uint8)
        if texts.null_count:
            return self.encode(pa.array([t or b"" for t in texts.to_pylist()], pa.large_binary()))
        made, a = [], 0
        while a < n:
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE, side="right")) - 1)
            part, ends = data[offsets[a] : offsets[b]], offsets[a + 1 : b + 1] - offsets[a]
            if not len(part):
                ids, counts = np.empty(0, self.kind), np.zeros(b - a, np.int64)
            elif self.plain:
                ids, counts = self._split(part, ends)
            else:
                lists = [self._alone(part[i:j].tobytes()) for i, j in zip(np.append(0, ends[:-1]), ends, strict=True)]
                ids, counts = np.concatenate(lists).astype(self.kind), np.array([len(x) for x in lists])
            ids, counts = self._ended(ids, counts)
            at = np.append(0, np.cumsum(counts)) * ids.itemsize
            made.append(pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(ids)]))
            a = b
        return pa.concat_arrays(made).cast(pa.binary()) if made else pa.array([], pa.binary())


_made: dict[tuple[str, int | None], Encoder] = {}


def encoder(path: str | None = None, end: int | None = 0) -> Encoder:
    """One encoder a process; by default of the public 50k vocabulary."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    if (path, end) not in _made:
        _made[path, end] = Encoder(path, end)
    return _made[path, end]
