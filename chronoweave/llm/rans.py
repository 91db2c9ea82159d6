"""Static range asymmetric numeral system over integer ids, many lanes in step.

A table gives each id a share of 2**bits slots. A block of ids is dealt to lanes row by row: id number i goes to lane
i % lanes in step i // lanes, and all lanes of a step are coded by the same few array operations. A lane's state is a
64-bit number of at least FLOOR; 32-bit words leave it where it would grow beyond 2**63. Words stand in the order in
which a decoder takes them: by step, then by lane.

Every `every` steps the states of all lanes are kept as a checkpoint, so that a decoder can begin there. The parts
between checkpoints (states, then words) are byte strings of their own, each with a checksum.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

#: Least state of a lane between two steps.
FLOOR = 1 << 31
#: Lanes of a block, at most.
LANES = 1024
#: Steps between two checkpoints.
EVERY = 256


@dataclass
class Table:
    """Shares of ids: `size` slots of 2**bits, the first of them `first`; `owner` names each slot's id."""

    bits: int
    size: np.ndarray
    first: np.ndarray
    owner: np.ndarray

    @staticmethod
    def of(counts: dict[int, int], bits: int = 20) -> Table:
        """Every id that occurs gets one slot and a share of the rest by its count; the most frequent takes what is left."""
        counts = {i: n for i, n in counts.items() if n > 0}
        bits = max(bits, len(counts).bit_length() + 2)
        if bits > 30:
            raise ValueError("too many different ids")
        size = np.zeros(max(counts, default=0) + 1, np.uint64)
        room, total = (1 << bits) - len(counts), sum(counts.values())
        for i, n in counts.items():
            size[i] = 1 + n * room // total
        if counts:
            size[max(counts, key=lambda i: (counts[i], -i))] += np.uint64((1 << bits) - int(size.sum()))
        return Table.sized(bits, size)

    @staticmethod
    def sized(bits: int, size: np.ndarray) -> Table:
        size = size.astype(np.uint64)
        first = np.cumsum(size) - size
        return Table(bits, size, first, np.repeat(np.arange(len(size), dtype=np.uint32), size.astype(np.int64)))

    def pack(self) -> bytes:
        return bytes([self.bits]) + zlib.compress(self.size.astype("<u4").tobytes())

    @staticmethod
    def unpack(data: bytes) -> Table:
        return Table.sized(data[0], np.frombuffer(zlib.decompress(data[1:]), "<u4"))


def lanes_for(n: int) -> int:
    """Lanes of a block of n ids: fewer for short blocks, so that states stay a small part of it."""
    return int(min(LANES, max(1, n // EVERY)))


def encode(ids: np.ndarray, table: Table) -> list[bytes]:
    """The parts of one block, first to last."""
    n, bits = len(ids), np.uint64(table.bits)
    lanes, low, wide = lanes_for(n), np.uint64(0xFFFFFFFF), np.uint64(32)
    size, first = table.size[ids], table.first[ids]
    if n and not size.all():
        raise ValueError("an id without a share")
    limit = size << np.uint64(63 - table.bits)
    states = np.full(lanes, FLOOR, np.uint64)
    parts, words = [], []
    for step in range(-(-n // lanes) - 1, -1, -1):
        at = slice(step * lanes, min(n, (step + 1) * lanes))
        now = states[: at.stop - at.start]
        full = now >= limit[at]
        if full.any():
            out = now[full]
            words.append((out & low).astype("<u4"))
            now[full] = out >> wide
        share = size[at]
        times = now // share
        now[:] = (times << bits) + (now - times * share) + first[at]
        if step % EVERY == 0:
            parts.append(states.astype("<u8").tobytes() + b"".join([w.tobytes() for w in reversed(words)]))
            words = []
    return parts[::-1]


def decode(part: bytes, n: int, lanes: int, table: Table) -> np.ndarray:
    """The n ids of one part of a block of so many lanes."""
    states = np.frombuffer(part, "<u8", lanes).copy()
    words = np.frombuffer(part, "<u4", offset=8 * lanes)
    bits, mask, wide, floor = np.uint64(table.bits), np.uint64((1 << table.bits) - 1), np.uint64(32), np.uint64(FLOOR)
    ids, taken = np.empty(n, np.uint32), 0
    for a in range(0, n, lanes):
        now = states[: min(lanes, n - a)]
        slot = now & mask
        found = ids[a : a + lanes] = table.owner[slot]
        now[:] = table.size[found] * (now >> bits) + slot - table.first[found]
        short = now < floor
        if short.any():
            k = int(np.count_nonzero(short))
            now[short] = (now[short] << wide) | words[taken : taken + k]
            taken += k
    if taken != len(words):
        raise ValueError("words are left in a part")
    return ids
