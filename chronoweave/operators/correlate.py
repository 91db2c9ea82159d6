"""Where short envelopes lie in long ones: correlation at all lags by overlapping Fourier blocks.

A long envelope is cut into blocks of 2 p samples, p apart, where p is the power of two that holds the clip. The
product of two transforms of a block and a clip gives the p lags that begin in the block's first half, so each
block is worked on alone, rows grow with the envelope and not with lags times samples, and an envelope of any length
is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Samples between two blocks, at least.
LEAST = 4096


def _lags(block: np.ndarray, clip: np.ndarray, n: int, mean: float, deviation: float, local: bool) -> np.ndarray:
    """r for the first n lags of a block; nan where a side does not vary."""
    m = len(clip)
    a, b = block - mean, clip - clip.mean()
    size = 1 << (len(a) + m - 2).bit_length()
    dot = np.fft.irfft(np.fft.rfft(a, size) * np.conj(np.fft.rfft(b, size)), size)[:n]
    own = float(np.sqrt((b**2).sum()))
    if own <= 1e-12 * max(1.0, float(np.abs(clip).max(initial=0.0))) * m:
        return np.full(n, np.nan)
    if not local:
        scale = deviation if deviation > 1e-9 else 1.0
        return dot / (scale * own * np.sqrt(m))
    sums, squares = np.append(0.0, np.cumsum(a)), np.append(0.0, np.cumsum(a**2))
    spread = (squares[m : m + n] - squares[:n]) - (sums[m : m + n] - sums[:n]) ** 2 / m
    flat = spread <= 1e-12 * max(float(squares[-1]), 1e-300)
    return np.where(flat, np.nan, dot / (own * np.sqrt(np.where(flat, 1.0, spread))))


def match_lags(long: DataFrame, clips: DataFrame, by: Sequence[str], source: str, at: str, x: str, clip: str, envelope: str, local: bool = False) -> DataFrame:
    """by, clip, source, lag and r of each clip against each source of the same `by`, at all lags at which it lies within.

    long: by, source, at (the sample's number, from 0; what is missing is 0) and x. clips: by, clip and envelope (an
    array). r is normed by the whole source's mean and deviation, or by those of the samples under the clip (local);
    rows without an r (a side does not vary) are left out.
    """
    by = list(by)
    length = F.size(envelope)
    grid = F.greatest(F.lit(LEAST), F.pow(F.lit(2), F.ceil(F.log2(length))).cast("long"))
    asked = clips.where(length > 0).select(*by, clip, F.col(envelope).cast("array<double>").alias("_clip"), grid.alias("_p"))
    whole = long.groupBy(*by, source).agg(
        (F.max(at) + 1).alias("_n"), (F.sum(x) / (F.max(at) + 1)).alias("_mean"), F.sum(F.col(x) * F.col(x)).alias("_squares")
    )
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("_squares") / F.col("_n") - F.col("_mean") * F.col("_mean")))
    whole = whole.select(*by, source, "_n", "_mean", spread.alias("_deviation"))
    # each sample belongs to its own block and to the one before
    dealt = long.join(asked.select(*by, "_p").distinct(), by).withColumn("_k", F.floor(F.col(at) / F.col("_p")))
    dealt = dealt.withColumn("_block", F.explode(F.filter(F.array(F.col("_k"), F.col("_k") - 1), lambda k: k >= 0)))
    sample = F.struct((F.col(at) - F.col("_block") * F.col("_p")).cast("int").alias("i"), F.col(x).cast("double").alias("x"))
    blocks = dealt.groupBy(*by, source, "_p", "_block").agg(F.collect_list(sample).alias("_samples"))
    pairs = asked.join(blocks, [*by, "_p"]).join(whole, [*by, source])
    pairs = pairs.select(*by, clip, source, (F.col("_block") * F.col("_p")).alias("_first"), "_p", F.col("_samples.i").alias("_i"), F.col("_samples.x").alias("_x"), "_clip", "_n", "_mean", "_deviation")
    kept = [*by, clip, source]
    schema = T.StructType([*[pairs.schema[c] for c in kept], T.StructField("_first", T.LongType()), T.StructField("_r", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):  # one row is a block and a clip: a few array operations
                row = batch.slice(k, 1)
                first, p, i, values, own, n, mean, deviation = (row.column(len(kept) + c)[0] for c in range(8))
                block = np.full(2 * p.as_py(), 0.0)
                block[i.values.to_numpy()] = values.values.to_numpy()
                envelope = own.values.to_numpy(zero_copy_only=False)
                lags = min(p.as_py(), n.as_py() - len(envelope) + 1 - first.as_py())
                r = _lags(block, envelope, max(0, lags), mean.as_py(), deviation.as_py(), local) if lags > 0 else np.empty(0)
                made = pa.ListArray.from_arrays([0, len(r)], pa.array(r))
                yield pa.RecordBatch.from_arrays([*[row.column(c) for c in range(len(kept) + 1)], made], names=[*kept, "_first", "_r"])

    found = pairs.mapInArrow(run, schema).select(*kept, "_first", F.posexplode("_r").alias("_i", "r"))
    return found.where(~F.isnan("r")).select(*kept, (F.col("_first") + F.col("_i")).alias("lag"), "r")


def windows_lost(x: np.ndarray, y: np.ndarray, size: int, reach: int, least: float, quiet_db: float) -> list[tuple[int, float, int]]:
    """(first sample, best correlation, its lag) of each window of x that is not silent, following drift in y.

    All lags of a window are one product of a matrix of shifted views, and their norms come from running sums.
    """
    n = len(x) // size
    if not n:
        return []
    parts = x[: n * size].reshape(n, size)
    power = np.sqrt((parts**2).mean(axis=1))
    loud = (power > 0) & (power >= power.max() * 10 ** (-quiet_db / 20))
    views = np.lib.stride_tricks.sliding_window_view(y, size) if len(y) >= size else np.empty((0, size))
    squares = np.append(0.0, np.cumsum(y**2))
    norms = np.sqrt(np.maximum(squares[size:] - squares[:-size], 0.0)) if len(y) >= size else np.empty(0)
    drift, found = 0, []
    for k in np.flatnonzero(loud).tolist():
        a = max(0, k * size + drift - reach)
        b = min(len(views), k * size + drift + reach + 1)
        best, at = -1.0, drift
        if b > a:
            r = views[a:b] @ parts[k] / (np.linalg.norm(parts[k]) * norms[a:b] + 1e-12)
            i = int(r.argmax())
            best, at = float(r[i]), a + i - k * size
        found.append((k * size, best, at))
        drift = at if best >= least else drift
    return found


def waveform_match(df: DataFrame, a: str, b: str, rate: int = 8000, window: float = 0.25, reach: float = 0.08, least: float = 0.6, quiet_db: float = 20.0) -> DataFrame:
    """Whether the sound of `a` is in `b`, window by window: status, windows, lost, drift, least_r, median_r and lost_s.

    Each window searches lags around the last good window's lag; it is lost if its best correlation stays under
    `least` (lost_s: seconds from the start). Windows quiet_db under the loudest do not count. What is shorter than
    a window is `unchecked`. Empty and null arrays hold no sample.
    """
    size, lag = int(rate * window), int(rate * reach)
    extra = T._parse_datatype_string("status string, windows int, lost int, drift int, least_r double, median_r double, lost_s array<double>")
    schema = T.StructType([*df.schema.fields, *extra.fields])

    def measure(x: np.ndarray, y: np.ndarray) -> tuple:
        found = windows_lost(x, y, size, lag, least, quiet_db)
        if not len(x) >= size:
            return "unchecked", 0, 0, 0, None, None, []
        r, lost = sorted(f[1] for f in found), [f[0] / rate for f in found if f[1] < least]
        good = [f[2] for f in found if f[1] >= least]
        return "ok", len(found), len(lost), good[-1] if good else 0, r[0] if r else None, r[len(r) // 2] if r else None, lost

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        types = to_arrow_schema(extra)
        for batch in batches:
            xs, ys = (batch.column(c).to_pylist() for c in (a, b))
            found = [measure(np.array(x or [], float), np.array(y or [], float)) for x, y in zip(xs, ys, strict=True)]
            made = [pa.array([f[i] for f in found], t.type) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=schema.names)

    return df.mapInArrow(run, schema)
