"""Repeated substrings by column-wise suffix sorting of a collection of strings.

Every byte that lies in a string of `length` bytes which also starts anywhere else is removed.

1. Equal texts become one row with their number; it is written as a table bucketed by the text's hash, so that
   later joins on that hash move no text.
2. Starts of a text are grouped into units: runs of starts whose windows of `length` bytes have the same minimizer
   at the same place (the 32-byte gram of the least hash, the leftmost of equals). Equal windows have equal
   minimizers, so they meet in one family, the units of one minimizer value. Families of a single occurrence hold
   no repeat and go no further. Equal units become one with their number before any unit is shuffled.
3. Families are dealt to groups of bounded size. In a group every unit is a string of 8-byte symbols, laid out
   from its minimizer. The Burrows-Wheeler transform of the collection is built column by column: each round
   inserts one symbol of every string, the last first, at the places that the last-to-first mapping gives, and
   extends the common prefixes of neighbours by minima over the rows between. Transform, prefixes and origins are
   files that each round reads and writes once from front to end; a round's working set is its new rows and
   one file. Rows that share 24 symbols, and the up to 8 bytes around these that complete a window, are equal.
4. A family of more than `largest` different units is divided before it is built: windows are told apart by how many
   bytes they hold before the minimizer, in two halves, and each half by the bytes that all its windows then hold
   (equal windows agree in both). What is still too large is divided again; after at most 8 times a part is one
   window. So one construction serves families of every size.

Defined cases: null texts are empty; texts shorter than `length` keep everything; repeated rows repeat each
other whole; overlapping repeats count, and strings are judged on the input. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.session import shared_folder

from .rows import annotate, long, name, string, structs

LENGTH = 200
GRAM, SYMBOL = 32, 8
#: Bytes of units in a group, and different units of a family beyond which it is divided.
GROUP_BYTES = 2_000_000
LARGEST = 5_000
#: Bytes of a file of the growing table that stay in memory.
SPOOL = 64 << 10
#: Texts are cut to pieces of so many starts, each with all bytes of its windows, so that places fit 23 bits.
PIECE = 1 << 22

_MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]
_BYTES = np.array([xxhash.xxh3_64_intdigest(bytes([b])) for b in range(256)], np.uint64)
_PLACE = np.uint64((1 << 23) - 1)


def grams(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 32 bytes from each place, by doubling."""
    h, n = _BYTES[data], 1
    for m in _MULTIPLIERS:
        h = h[:-n] * m + h[n:]
        n *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def unit_runs(text: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimizer, first start, end of starts and place of the minimizer of every unit of a text."""
    out = []
    for base in range(0, max(1, len(text) - length + 1), PIECE):
        part = np.frombuffer(text[base : base + PIECE + length - 1], np.uint8)
        if len(part) < length:
            continue
        h = grams(part)
        least = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        width, n = length - GRAM + 1, 1
        while 2 * n <= width:
            least = np.minimum(least[:-n], least[n:])
            n *= 2
        if width > n:
            least = np.minimum(least[: n - width], least[width - n :])
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        place = (least[first] & _PLACE).astype(np.int64)
        out.append((h[place].view(np.int64), base + first, base + np.append(first[1:], len(least)), base + place))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (none, none, none, none)


class Files:
    """Columns of the growing table, each a file that is read and written from front to end.

    A file stays in memory up to SPOOL bytes and is on the task's disk beyond.
    """

    def __init__(self, **columns: np.ndarray):
        self.kinds = {key: values.dtype for key, values in columns.items()}
        self.files: dict[str, tempfile.SpooledTemporaryFile] = {}
        for key, values in columns.items():
            self.write(key, values)

    def read(self, key: str) -> np.ndarray:
        self.files[key].seek(0)
        return np.frombuffer(self.files[key].read(), self.kinds[key])

    def write(self, key: str, values: np.ndarray) -> None:
        """values as the next file, in place of the last one."""
        new = tempfile.SpooledTemporaryFile(max_size=SPOOL)
        new.write(values.data)
        if key in self.files:
            self.files[key].close()
        self.files[key] = new

    def insert(self, key: str, old: np.ndarray, at: np.ndarray, values: np.ndarray, stays: np.ndarray) -> None:
        """old at the places where `stays`, values at the rows `at`, written as the next file."""
        new = np.empty(len(stays), self.kinds[key])
        new[stays] = old
        new[at] = values
        self.write(key, new)

    def close(self) -> None:
        for f in self.files.values():
            f.close()


def column_sort(symbols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """String, place and common prefix (in symbols, with the row before) of every suffix, in sorted order.

    symbols: codes of each string. Strings end in marks of their own, smaller than all symbols, which match nothing.
    """
    count = len(symbols)
    size = np.array([len(s) for s in symbols], np.int64)
    flat = np.concatenate([*symbols, np.zeros(0, np.uint16)])
    start = np.cumsum(size) - size
    kind = np.uint16 if not len(flat) or flat.max() < 65534 else np.uint32
    none = np.iinfo(kind).max  # before the first symbol there is nothing: sorts behind all symbols
    before = np.full(count, none, kind)
    some = size > 0
    before[some] = flat[start[some] + size[some] - 1]
    files = Files(bwt=before, prefix=np.zeros(count, np.int16), who=np.arange(count, dtype=np.int32), place=size.astype(np.int32))
    strings = np.flatnonzero(some)
    row = strings.copy()  # of each active string's newest suffix
    left = size[strings]
    while len(strings):
        bwt = files.read("bwt")
        order = np.argsort(bwt, kind="stable")[: np.count_nonzero(bwt != none)]
        prefix = files.read("prefix")
        rank = np.empty(len(bwt), np.int64)
        rank[order] = np.arange(len(order))
        new = rank[row]  # among the suffixes that aren't empty, after this round
        # common prefixes of the new rows and of the rows behind them
        seen = np.unique(np.concatenate([new, new[new + 1 < len(order)] + 1]))
        pairs = seen[(seen > 0)]
        pairs = pairs[bwt[order[pairs]] == bwt[order[pairs - 1]]]
        a, b = order[pairs - 1] + 1, order[pairs] + 1
        by = np.argsort(a, kind="stable")
        shared = np.zeros(len(order), np.int16)
        if len(pairs):
            bounds = np.stack([a[by], b[by]], axis=1).ravel()
            shared[pairs[by]] = 1 + np.minimum.reduceat(np.append(prefix, 0), bounds)[::2]
        at = count + np.sort(new)
        turn = np.argsort(new, kind="stable")
        strings, left = strings[turn], left[turn] - 1
        stays = np.ones(len(bwt) + len(at), bool)
        stays[at] = False
        more = left > 0
        following = np.full(len(strings), none, kind)
        following[more] = flat[start[strings[more]] + left[more] - 1]
        files.insert("bwt", bwt, at, following, stays)
        merged = np.empty(len(stays), np.int16)
        merged[stays] = prefix
        merged[count + seen] = shared[seen]
        files.write("prefix", merged)
        files.insert("who", files.read("who"), at, strings, stays)
        files.insert("place", files.read("place"), at, left, stays)
        strings, left, row = strings[more], left[more], at[more]
    out = files.read("who"), files.read("place"), files.read("prefix")
    files.close()
    return out


def repeated_starts(units: list[tuple[int, bytes]], weights: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each unit (place of its minimizer, bytes) which of its starts begin a window that occurs again."""
    core = length // SYMBOL - 1
    phases = np.array([p % SYMBOL for p, _ in units], np.int64)
    words, sizes = [], []
    for (_, data), phase in zip(units, phases.tolist(), strict=True):
        n = (len(data) - phase) // SYMBOL
        words.append(np.frombuffer(data, "<u8", n, phase))
        sizes.append(n)
    values, codes = np.unique(np.concatenate(words), return_inverse=True)
    codes = codes.astype(np.uint16 if len(values) < 65534 else np.uint32)
    who, place, prefix = column_sort(np.split(codes, np.cumsum(sizes)[:-1]))
    kind = np.cumsum(prefix < core)  # rows of one kind share a core
    weight = np.array(weights, np.int64)
    total = np.bincount(kind, weight[who])
    size = np.array([len(d) for _, d in units], np.int64)
    at = phases[who] + SYMBOL * place
    # a unit of several occurrences is repeated as it is; it still makes windows of others repeats
    single = np.zeros(len(total), bool)
    single[kind[weight[who] == 1]] = True
    use = (total[kind] >= 2) & single[kind] & (at + core * SYMBOL <= size[who])
    who, at, kind = who[use], at[use].astype(np.int64), kind[use]
    data = np.frombuffer(b"".join([d for _, d in units]), np.uint8)
    first = np.cumsum(size) - size
    flags = np.repeat(weight >= 2, size - length + 1)
    flag_at = np.cumsum(size - length + 1) - (size - length + 1)
    for d in range(SYMBOL):
        s = at - d
        ok = (s >= 0) & (s + length <= size[who])
        w, k, s = who[ok], kind[ok], s[ok]
        if not len(w):
            continue
        columns = np.concatenate([np.arange(d), d + core * SYMBOL + np.arange(SYMBOL - d)])
        around = np.ascontiguousarray(data[(first[w] + s)[:, None] + columns]).view("<u8").ravel()
        by = np.lexsort((around, k))
        k, around, w, s = k[by], around[by], w[by], s[by]
        group = np.cumsum(np.concatenate([[False], (k[1:] != k[:-1]) | (around[1:] != around[:-1])]))
        again = np.bincount(group, weight[w])[group] >= 2
        flags[flag_at[w[again]] + s[again]] = True
    return np.split(flags, flag_at[1:])


def runs_of(mark: np.ndarray) -> list[dict]:
    """Runs of set starts as start and end."""
    turns = np.flatnonzero(np.diff(np.concatenate([[False], mark, [False]]).astype(np.int8)))
    return [{"start": a, "end": b} for a, b in turns.reshape(-1, 2).tolist()]


RUNS = T.ArrayType(T.StructType([long("start"), long("end")]))


def _sort_group(length: int, table: pa.Table) -> pa.Table:
    rows = table.select(["minimizer", "unit", "n", "place", "data"]).to_pydict()
    out: dict[str, list] = {"minimizer": [], "unit": [], "runs": []}
    # a group is dealt by hash and may hold more bytes than wanted: it is built in parts of whole families
    order = sorted(range(len(rows["unit"])), key=lambda i: rows["minimizer"][i])
    part, held = [], 0
    for j, i in enumerate(order):
        part.append(i)
        held += len(rows["data"][i])
        last = j + 1 == len(order)
        if last or held >= GROUP_BYTES and rows["minimizer"][order[j + 1]] != rows["minimizer"][i]:
            marks = repeated_starts([(rows["place"][x], rows["data"][x]) for x in part], [rows["n"][x] for x in part], length)
            for x, mark in zip(part, marks, strict=True):
                if mark.any():
                    out["minimizer"].append(rows["minimizer"][x])
                    out["unit"].append(rows["unit"][x])
                    out["runs"].append(runs_of(mark))
            part, held = [], 0
    kinds = pa.schema([("minimizer", pa.int64()), ("unit", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
    return pa.table(out, schema=kinds)


def _lists(sizes: list[int], columns: dict[str, np.ndarray] | np.ndarray) -> pa.Array:
    """Concatenated values, or columns of structs, as one list for each size."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    if isinstance(columns, dict):
        return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(c) for c in columns.values()], list(columns)))
    return pa.ListArray.from_arrays(offsets, pa.array(columns))


def _minimizers(length):
    def find(texts):
        found = [unit_runs(t or b"", length)[0] for t in texts]
        return (_lists([len(v) for v in found], np.concatenate([np.zeros(0, np.int64), *found])),)

    return find


def _units(length):
    def find(texts):
        h, digests, found = xxhash.xxh3_64_intdigest, [], []
        for t in texts:
            found.append(runs := unit_runs(t or b"", length))
            digests += [h(t[a:b]) for a, b in zip(runs[1].tolist(), (runs[2] + length - 1).tolist(), strict=True)]
        sizes = [len(f[0]) for f in found]
        v, a, b, p = (np.concatenate([np.zeros(0, np.int64), *[f[i] for f in found]]) for i in range(4))
        unit = np.array(digests, np.uint64).view(np.int64)
        return (_lists(sizes, {"minimizer": v, "unit": unit, "start": a, "end": b, "place": p - a}),)

    return find


def _cut_units(wanted, text):
    """Bytes of each wanted unit."""
    return [{**{k: w[k] for k in ("minimizer", "unit", "n", "place")}, "data": text[w["start"] : w["stop"]]} for w in wanted]


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, read again."""
    path = shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def _bucketed(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, bucketed by h1 and h2 into as many buckets as a shuffle has parts."""
    spark = df.sparkSession
    table = f"texts_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.option("compression", "zstd").option("path", shared_folder(spark)).bucketBy(parts, "h1", "h2").saveAsTable(table)
    kept = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the name only: files at a path of their own stay, and `kept` knows their buckets
    return kept


def text_hashes(text: str) -> list[F.Column]:
    body = F.coalesce(F.col(name(text)).cast("string"), F.lit(""))
    return [F.xxhash64(body).alias("h1"), F.xxhash64(F.lit(1), body).alias("h2")]


def distinct_texts(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """h1, h2, n and text of every different text of at least `length` bytes, bucketed by its hashes."""
    body = F.col(name(text)).cast("string")
    long_enough = docs.where(F.octet_length(body) >= length).select(*text_hashes(text), body.alias("text"))
    return _bucketed(long_enough.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.first("text").alias("text")))


def repeated_spans(texts: DataFrame, length: int = LENGTH, largest: int = LARGEST) -> DataFrame:
    """h1, h2 and spans (runs of repeated starts as start and end, by start) of each text that has any."""
    found = annotate(texts, "text", partial(_units, length), [structs("units", *[long(c) for c in ("minimizer", "unit", "start", "end", "place")])], keep=["h1", "h2", "n"])
    occurrences = found.select("row.h1", "row.h2", "row.n", F.explode("units").alias("u")).select("h1", "h2", "n", "u.*")
    values = annotate(texts, "text", partial(_minimizers, length), [T.StructField("minimizers", T.ArrayType(T.LongType()))], keep=["n"])
    # written, so that the join with all occurrences is between two plain shuffles, whose hot parts Spark can split
    families = written(
        values.select("row.n", F.explode("minimizers").alias("minimizer"))
        .groupBy("minimizer").agg(F.sum("n").alias("total")).where("total > 1").select("minimizer")
    )
    kept = written(occurrences.join(families, "minimizer", "left_semi"))
    first = F.min(F.struct("h1", "h2", "start", "end", "place")).alias("at")
    distinct = kept.groupBy("minimizer", "unit").agg(F.sum("n").alias("n"), first)
    wanted = distinct.select(
        "at.h1", "at.h2", F.struct("minimizer", "unit", "n", "at.place", "at.start", (F.col("at.end") + length - 1).alias("stop")).alias("w")
    )
    by_text = wanted.groupBy("h1", "h2").agg(F.collect_list("w").alias("wanted"))
    data = written(_extract(by_text.join(texts.select("h1", "h2", "text"), ["h1", "h2"])))
    sizes = data.groupBy("minimizer").agg(F.count("*").alias("members"))
    crowded = written(sizes.where(F.col("members") > largest).select("minimizer"))
    built = _build(data.join(crowded, "minimizer", "left_anti"), length)
    if not crowded.isEmpty():
        for part in divide(data.join(crowded, "minimizer", "left_semi"), length, largest):
            built = built.unionByName(_build_part(part, length))
    runs = kept.select("minimizer", "unit", "h1", "h2", "start").join(built, ["minimizer", "unit"])
    each = runs.select("h1", "h2", F.explode(F.transform("runs", lambda r: F.struct((r["start"] + F.col("start")).alias("start"), (r["end"] + F.col("start")).alias("end")))).alias("s"))
    return each.groupBy("h1", "h2").agg(F.array_sort(F.collect_list("s")).alias("spans"))


def _extract(joined: DataFrame) -> DataFrame:
    """minimizer, unit, n, place and data of the units wanted of each text."""
    fields = [long("minimizer"), long("unit"), long("n"), long("place"), T.StructField("data", T.BinaryType())]

    def run(batches):
        for batch in batches:
            wanted, texts = batch.column(0), batch.column(1).cast(pa.binary())
            for i in range(batch.num_rows):
                rows = _cut_units(wanted[i].as_py(), texts[i].as_py())
                columns = [pa.array([r[f.name] for r in rows], pa.binary() if f.name == "data" else pa.int64()) for f in fields]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return joined.select("wanted", "text").mapInArrow(run, T.StructType(fields))


def divide(data: DataFrame, length: int, largest: int) -> list[DataFrame]:
    """Units of families that are too large, in parts of which each can be built: minimizer, unit, start (of the part in
    the unit), n, family, part, offset (of the minimizer in the part) and bytes.

    low to high is the range of bytes that a window holds before its minimizer. Its lower half and its upper half are
    parts of their own, and each part is a family with those that agree in all bytes that every window of the range
    holds. Families of `largest` different parts at most are done; all rows of the others are halved again.
    """
    rows, done = data.withColumns({"family": F.col("minimizer"), "low": F.lit(0), "high": F.lit(length - GRAM)}), []
    while True:
        half = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        halves = F.array(F.struct("low", half.alias("high")), F.struct((half + 1).alias("low"), "high"))
        each = rows.select("minimizer", "unit", "n", "place", "data", "family", F.explode(F.filter(halves, lambda h: h["low"] <= h["high"])).alias("half"))
        each = each.select("minimizer", "unit", "n", "place", "data", "family", "half.*")
        first, last = F.greatest(F.lit(0), F.col("place") - F.col("high")), F.least(F.octet_length("data") - length, F.col("place") - F.col("low"))
        held = F.substring("data", (F.col("place") - F.col("low") + 1).cast("int"), F.lit(length) - F.col("high") + F.col("low"))
        taken = F.substring("data", (F.col("start") + 1).cast("int"), (F.col("last") - F.col("start") + length).cast("int"))
        cut = each.withColumns({"start": first.cast("long"), "last": last.cast("long")}).where("start <= last").withColumns({"held": held, "bytes": taken})
        parts = written(
            cut.withColumns({"family": F.xxhash64("family", "low", "high", "held"), "part": F.xxhash64("bytes"), "offset": F.col("place") - F.col("start")}).drop("held", "last")
        )
        members = parts.groupBy("family").agg(F.count_distinct("part").alias("members"))
        crowded = written(members.where(F.col("members") > largest).select("family"))
        done.append(parts.join(crowded, "family", "left_anti"))
        if crowded.isEmpty():
            return done
        rows = parts.join(crowded, "family", "left_semi").select("minimizer", "unit", "n", "place", "data", "family", "low", "high")


def _build(units: DataFrame, length: int) -> DataFrame:
    """minimizer, unit and runs of repeated starts, from groups of whole families."""
    total = units.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    groups = max(1, -(-total // GROUP_BYTES))
    schema = T.StructType([long("minimizer"), long("unit"), T.StructField("runs", RUNS)])

    def build(table: pa.Table) -> pa.Table:
        return _sort_group(length, table)

    dealt = units.withColumn("deal", F.expr(f"pmod(xxhash64(minimizer), {groups})"))
    return dealt.groupBy("deal").applyInArrow(build, schema)


def _build_part(parts: DataFrame, length: int) -> DataFrame:
    """The same for parts of units, whose runs are moved to the places that they have in the units."""
    same = parts.groupBy("family", "part").agg(F.sum("n").alias("n"), F.min(F.struct("offset", "bytes")).alias("x"))
    laid = same.select(F.col("family").alias("minimizer"), F.col("part").alias("unit"), "n", F.col("x.offset").alias("place"), F.col("x.bytes").alias("data"))
    # written, so that the join with all parts is between two plain shuffles
    built = written(_build(laid, length).select(F.col("minimizer").alias("family"), F.col("unit").alias("part"), "runs"))
    moved = F.transform("runs", lambda r: F.struct((r["start"] + F.col("start")).alias("start"), (r["end"] + F.col("start")).alias("end")))
    return parts.select("family", "part", "minimizer", "unit", "start").join(built, ["family", "part"]).select("minimizer", "unit", moved.alias("runs"))


def cover(spans: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes under windows that begin in the spans, which are sorted by start."""
    out: list[list[int]] = []
    for s in spans or []:
        a, b = s["start"], s["end"] + length - 1
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def removed_parts(docs: DataFrame, text: str = "text", length: int = LENGTH, largest: int = LARGEST) -> DataFrame:
    """h1, h2, removed (start and end in bytes), kept_sha256 and kept (bytes) of each text that loses any."""
    texts = distinct_texts(docs, text, length)
    joined = texts.select("h1", "h2", "text").join(repeated_spans(texts, length, largest), ["h1", "h2"])
    schema = T.StructType([long("h1"), long("h2"), structs("removed", long("start"), long("end")), string("kept_sha256"), T.StructField("kept", T.BinaryType())])

    def cut(batches):
        types = None
        for batch in batches:
            from pyspark.sql.pandas.types import to_arrow_schema

            types = types or to_arrow_schema(schema)
            texts, spans = batch.column(2).cast(pa.binary()), batch.column(3)
            removed, digests, kept = [], [], []
            for i in range(batch.num_rows):
                data, at, parts = texts[i].as_py(), 0, []
                gone = cover(spans[i].as_py(), length)
                for a, b in gone:
                    parts.append(data[at:a])
                    at = b
                rest = b"".join([*parts, data[at:]])
                removed.append([{"start": a, "end": b} for a, b in gone])
                digests.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, types.field(n).type) for c, n in ((removed, "removed"), (digests, "kept_sha256"), (kept, "kept"))]], names=types.names)

    return joined.select("h1", "h2", "text", "spans").mapInArrow(cut, schema)


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, largest: int = LARGEST, keep: list[str] | None = None, with_kept: bool = True) -> DataFrame:
    """row, n_bytes, removed (start and end in bytes), kept_sha256 and, with_kept, kept bytes for each row of docs."""
    parts = removed_parts(docs, text, length, largest)
    parts = parts if with_kept else parts.drop("kept")
    body = F.coalesce(F.col(name(text)).cast("string"), F.lit("")).cast("binary")
    kept = [name(c) for c in (docs.columns if keep is None else keep)]
    rows = docs.select(F.struct(*[F.col(c) for c in kept]).alias("row"), *text_hashes(text), F.octet_length(body).cast("long").alias("n_bytes"), F.sha2(body, 256).alias("whole"), *([body.alias("body")] if with_kept else []))
    joined = rows.join(parts, ["h1", "h2"], "left")
    return joined.select(
        "row", "n_bytes",
        F.coalesce("removed", F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")).alias("removed"),
        F.coalesce("kept_sha256", "whole").alias("kept_sha256"),
        *([F.coalesce("kept", "body").alias("kept")] if with_kept else []),
    )
