"""ISO base media containers: text payloads stored as samples, and a walk over boxes that never decodes them.

`pack` lays a payload out as ftyp, moov and mdat with one track of 64-byte samples; `walk` and `describe` read
any such file: nested boxes by their sizes (32-bit, 64-bit, or to the end), of each track the sample description's
codec and the sample tables (stsz, stsc, stco or co64, stss) for the byte ranges of key frames, the movie header's
duration, and the runs of movie fragments (moof, traf, trun). Sample bytes are located, not interpreted.

Defined cases: null and empty texts are 64 zero bytes; equal texts give equal files; a file cut short or with a
box that is smaller than its header ends the walk there. Tables and headers that are missing or too short read as
empty; counts are bounded by the bytes that are there, and ranges by the file.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .rows import annotate, long, string

SAMPLE = 64
#: Samples in a chunk, between key frames, and for each second of the time scale.
CHUNK, KEY, RATE = 16, 30, 25
CODEC = b"raw "
#: Fixed names of boxes that hold boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf"}


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    """A box with a version and flags."""
    return box(kind, struct.pack(">I", flags), *parts)


def pad(text: bytes) -> bytes:
    """Zero bytes appended up to a positive multiple of the sample size."""
    return text + bytes(max(SAMPLE, -(-len(text) // SAMPLE) * SAMPLE) - len(text))


def pack(payload: bytes) -> bytes:
    """A file whose samples are the payload, SAMPLE bytes each."""
    samples = len(payload) // SAMPLE
    chunks = -(-samples // CHUNK)
    rest = samples - (chunks - 1) * CHUNK
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    entry = box(CODEC, struct.pack(">6xH", 1), struct.pack(">16xHHII4xH32xHh", SAMPLE, 1, 0x480000, 0x480000, 1, 8, -1))
    to_chunk = [(1, CHUNK, 1)] if chunks > 1 or rest == CHUNK else []
    if rest != CHUNK:
        to_chunk.append((chunks, rest, 1))
    keys = np.arange(1, samples + 1, KEY, dtype=">u4")

    def head(first: int) -> bytes:
        offsets = np.arange(chunks, dtype=np.uint64) * np.uint64(CHUNK * SAMPLE) + np.uint64(first)
        wide = first + len(payload) >= 1 << 32
        table = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, samples, 1)),
            full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            full(b"stsc", struct.pack(">I", len(to_chunk)), *[struct.pack(">III", *x) for x in to_chunk]),
            full(b"stsz", struct.pack(">II", SAMPLE, samples)),
            full(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if wide else ">u4").tobytes()),
        )
        media = box(
            b"mdia",
            full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, samples, 0x55C4, 0)),
            full(b"hdlr", struct.pack(">I4s12x", 0, b"vide"), b"samples\0"),
            box(b"minf", full(b"vmhd", bytes(8), flags=1), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), table),
        )
        track = box(b"trak", full(b"tkhd", struct.pack(">IIIII8xHHHH", 0, 0, 1, 0, samples, 0, 0, 0, 0), matrix, struct.pack(">II", SAMPLE << 16, 1 << 16), flags=7), media)
        movie = full(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, RATE, samples, 0x10000, 0x100), matrix, bytes(24), struct.pack(">I", 2))
        return box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41") + box(b"moov", movie, track)

    data = box(b"mdat", payload)
    before = len(head(0)) + len(data) - len(payload)
    return head(before) + data


def walk(data: bytes, at: int = 0, end: int | None = None) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, body start, body end) of every box, parents before children."""
    todo = [(at, len(data) if end is None else end, ())]
    while todo:
        at, end, path = todo.pop()
        if at + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1 and at + 16 <= end:
            size, body = struct.unpack_from(">Q", data, at + 8)[0], at + 16
        elif size == 0:
            size = end - at
        if size < body - at or at + size > end:
            continue
        yield (*path, kind), body, at + size
        todo.append((at + size, end, path))
        # containers in containers as deep as any real file has them
        if kind in CONTAINERS and len(path) < 16:
            todo.append((body, at + size, (*path, kind)))


Places = dict[bytes, tuple[int, int]]


def _places(data: bytes, start: int, end: int) -> Places:
    """The first box of each kind in a part of a file."""
    out: Places = {}
    for path, a, b in walk(data, start, end):
        out.setdefault(path[-1], (a, b))
    return out


def _fields(data: bytes, place: tuple[int, int] | None, form: str, at: int) -> tuple[int, ...]:
    """Values at a place of a box's body; zeros where the body is too short or missing."""
    if place is None or place[0] + at + struct.calcsize(form) > place[1]:
        return (0,) * len(form.lstrip(">"))
    return struct.unpack_from(form, data, place[0] + at)


def _table(data: bytes, place: tuple[int, int] | None, form: str, skip: int = 8, columns: int = 1) -> np.ndarray:
    """A counted table's entries; `skip` bytes of version, flags and counts stand before them."""
    if place is None or place[1] - place[0] < skip:
        return np.zeros((0, columns), np.int64)
    a, b = place
    n = min(struct.unpack_from(">I", data, a + skip - 4)[0], (b - a - skip) // (np.dtype(form).itemsize * columns))
    values = np.frombuffer(data, form, n * columns, a + skip)
    return np.minimum(values.astype(np.uint64), np.uint64(1 << 62)).astype(np.int64).reshape(-1, columns)


def _sample_ranges(data: bytes, places: Places) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, sizes and numbers of key frames of the samples of a track, by its tables."""
    each, n = _fields(data, places.get(b"stsz"), ">II", 4)
    sizes = np.full(min(n, len(data) // each), each, np.int64) if each else _table(data, places.get(b"stsz"), ">u4", 12)[:, 0]
    offsets = _table(data, places.get(b"co64"), ">u8")[:, 0] if b"co64" in places else _table(data, places.get(b"stco"), ">u4")[:, 0]
    runs = _table(data, places.get(b"stsc"), ">u4", columns=3)
    if not len(runs) or not len(offsets) or not len(sizes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    run = np.searchsorted(runs[:, 0], np.arange(1, len(offsets) + 1), "right") - 1
    in_chunk = np.where(run >= 0, np.minimum(runs[run, 1], len(sizes)), 0)
    used = int(np.searchsorted(np.cumsum(in_chunk), len(sizes))) + 1  # chunks until all samples are placed
    of = np.repeat(np.arange(len(in_chunk[:used])), in_chunk[:used])[: len(sizes)]
    sizes = sizes[: len(of)]
    before = np.cumsum(sizes) - sizes
    first = np.flatnonzero(np.diff(of, prepend=-1))
    starts = offsets[of] + before - before[first][np.searchsorted(first, np.arange(len(of)), "right") - 1]
    keys = _table(data, places.get(b"stss"), ">u4")[:, 0] - 1 if b"stss" in places else np.arange(len(starts))
    return starts, sizes, keys[(keys >= 0) & (keys < len(starts))]


#: Fixed flags of fragments' headers and of a sample that is no key frame.
BASE_OFFSET, DESCRIPTION, DURATION, SIZE, FLAGS = 1, 2, 8, 16, 32
RUN_OFFSET, RUN_FIRST, RUN_COLUMNS = 1, 4, (0x100, 0x200, 0x400, 0x800)
NO_KEY = 0x10000


def _fragment(data: bytes, moof: int, start: int, end: int, extends: dict[int, tuple[int, ...]]) -> tuple[int, list[tuple[int, int, bool]]]:
    """Track and samples (start, size, key frame) of a traf box; moof is where its fragment begins."""
    header = _places(data, start, end).get(b"tfhd")
    flags, track = _fields(data, header, ">II", 0)
    at, given = 8, {}
    for flag, form in ((BASE_OFFSET, ">Q"), (DESCRIPTION, ">I"), (DURATION, ">I"), (SIZE, ">I"), (FLAGS, ">I")):
        if flags & flag:
            given[flag] = _fields(data, header, form, at)[0]
            at += struct.calcsize(form)
    usual = extends.get(track, (0, 0))
    size, kind, place = given.get(SIZE, usual[0]), given.get(FLAGS, usual[1]), given.get(BASE_OFFSET, moof)
    out = []
    for path, a, b in walk(data, start, end):
        if path != (b"trun",):
            continue
        flags, n = _fields(data, (a, b), ">II", 0)
        at, base = a + 8, given.get(BASE_OFFSET, moof)
        if flags & RUN_OFFSET:
            place = base + _fields(data, (a, b), ">i", at - a)[0]
            at += 4
        first = None
        if flags & RUN_FIRST:
            first = _fields(data, (a, b), ">I", at - a)[0]
            at += 4
        columns = [c for c in RUN_COLUMNS if flags & c]
        n = min(n, (b - at) // (4 * len(columns)) if columns and b > at else len(data) // max(1, size) if not columns else 0)
        rows = np.frombuffer(data, ">u4", n * len(columns), at).reshape(n, len(columns)).tolist() if columns else [()] * n
        for i, row in enumerate(rows):
            own = dict(zip(columns, row, strict=True))
            each = own.get(RUN_COLUMNS[1], size)
            mark = own.get(RUN_COLUMNS[2], first if i == 0 and first is not None else kind)
            out.append((max(0, place), each, not mark & NO_KEY))
            place += each
    return track, out


def describe_tracks(data: bytes) -> list[dict]:
    """codec, time scale, duration, sample ranges and key frame ranges of every track, in the file's order."""
    movie: Places = {}
    tracks, fragments, extends, moof = [], [], {}, 0
    for path, a, b in walk(data):
        if path == (b"moov", b"mvhd"):
            movie.setdefault(b"mvhd", (a, b))
        elif path == (b"moov", b"trak"):
            tracks.append(_places(data, a, b))
        elif path == (b"moov", b"mvex", b"trex"):
            track, _, _, size, flags = _fields(data, (a, b), ">IIIII", 4)
            extends[track] = size, flags
        elif path == (b"moof",):
            moof = a - 8
        elif path == (b"moof", b"traf"):
            fragments.append(_fragment(data, moof, a, b, extends))
    head = movie.get(b"mvhd")
    long_form = bool(head and head[1] > head[0] and data[head[0]] == 1)
    scale, duration = _fields(data, head, ">IQ" if long_form else ">II", 20 if long_form else 12)
    out = []
    for places in tracks:
        starts, sizes, keys = _sample_ranges(data, places)
        head = places.get(b"tkhd")
        number = _fields(data, head, ">I", 20 if head and head[1] > head[0] and data[head[0]] == 1 else 12)[0]
        more = [x for track, samples in fragments if track == number for x in samples]
        if more:
            keys = np.concatenate([keys, len(starts) + np.flatnonzero([k for _, _, k in more])])
            starts, sizes = np.concatenate([starts, [x[0] for x in more]]), np.concatenate([sizes, [x[1] for x in more]])
        codec = places.get(b"stsd")
        begin, stop = np.minimum(starts, len(data)), np.minimum(starts + sizes, len(data))
        out.append(
            {
                "codec": data[codec[0] + 12 : min(codec[0] + 16, codec[1])].decode("latin-1") if codec else "",
                "scale": int(scale), "duration": int(duration), "starts": begin, "sizes": stop - begin, "keys": np.stack([begin[keys], stop[keys]], axis=1),
            }
        )
    return out


def describe(data: bytes) -> dict:
    """The description of a file's first track; an empty one where there is none."""
    none = np.zeros(0, np.int64)
    empty = {"codec": "", "scale": 0, "duration": 0, "starts": none, "sizes": none, "keys": np.zeros((0, 2), np.int64)}
    return next(iter(describe_tracks(data)), empty)


def read_back(data: bytes, about: dict) -> bytes:
    """The samples' bytes in order, found by the sample tables. Neighbouring samples are copied together."""
    starts, stops = about["starts"], about["starts"] + about["sizes"]
    if not len(starts):
        return b""
    breaks = np.flatnonzero(starts[1:] != stops[:-1])
    first, last = np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(starts) - 1]])
    return b"".join([data[a:b] for a, b in zip(starts[first].tolist(), stops[last].tolist(), strict=True)])


def feature(about: dict) -> str:
    """codec, seconds, samples, key frames and their byte ranges, joined as a-b."""
    seconds = about["duration"] / about["scale"] if about["scale"] else 0.0
    ranges = ",".join(f"{a}-{b}" for a, b in about["keys"].tolist())
    return f"codec={about['codec'].strip()};duration={seconds:.2f};samples={len(about['starts'])};keyframes={len(about['keys'])};ranges={ranges}"


FIELDS = [
    long("n_bytes"), long("payload_bytes"), string("payload_sha256"), long("tail_crc32"), long("media_bytes"),
    string("media_sha256"), string("feature"),
]


def _stored(with_file: bool):
    def store(texts):
        out: list[list] = [[] for _ in range(len(FIELDS) + with_file)]
        for t in texts:
            data = pack(pad(t or b""))
            about = describe(data)
            back = read_back(data, about)
            row = [
                len(t or b""), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-SAMPLE:]), len(data),
                hashlib.sha256(data).hexdigest(), feature(about),
            ]
            for column, value in zip(out, [*row, data] if with_file else row, strict=True):
                column.append(value)
        return out

    return store


def store(docs: DataFrame, text: str = "text", keep=None, with_file: bool = False) -> DataFrame:
    """row and what was read back from each text's file; with_file: the file itself too, as `media`. No shuffle."""
    from functools import partial

    fields = [*FIELDS, T.StructField("media", T.BinaryType())] if with_file else FIELDS
    return annotate(docs, text, partial(_stored, with_file), fields, keep)
