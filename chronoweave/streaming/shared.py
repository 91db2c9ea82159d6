"""Streams that share state: what was used before, and which session a clip lies in."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that keyed maps and timers need; a session sets spark.sql.streaming.stateStore.providerClass to it.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
USES = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("out_s", T.DoubleType())])
OUT = [T.StructField("shot", T.StringType()), T.StructField("use", T.IntegerType()), T.StructField("from_s", T.DoubleType()), T.StructField("what", T.StringType())]


class ShotUses(StatefulProcessor):
    """What each shot of a film has given so far, as a map from shot to (uses, furthest out-point).

    A row gets the number of its use and where the shot could go on. A film that is silent for `keep` seconds beyond
    the watermark is closed: each of its shots is told once more (`closed`) and its state goes.
    """

    def __init__(self, keep: float):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.uses = handle.getMapState("uses", T.StructType([T.StructField("shot", T.StringType())]), USES)
        self.last = handle.getValueState("last", T.StructType([T.StructField("ms", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(list(rows)).sort_values(["at_ms", "ord"], kind="stable")
        found = []
        for r in arrived.itertuples(index=False):
            n, out = self.uses.getValue((r.shot,)) if self.uses.containsKey((r.shot,)) else (0, None)
            found.append((*key, r.shot, n + 1, r.in_s if out is None else out, "repeats" if out is not None and r.in_s < out else "fresh"))
            self.uses.updateValue((r.shot,), (int(n) + 1, float(r.out_s if out is None else max(out, r.out_s))))
        latest = int(arrived["at_ms"].max())
        if self.last.exists():
            before = int(self.last.get()[0])
            self.handle.deleteTimer(before)
            latest = max(latest, before - int(self.keep * 1000))
        due = latest + int(self.keep * 1000)
        self.last.update((due,))
        self.handle.registerTimer(due)
        yield self._frame(found, len(key))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        found = [(*key, shot[0], int(use[0]), float(use[1]), "closed") for shot, use in self.uses.iterator()]
        self.uses.clear()
        self.last.clear()
        yield self._frame(found, len(key))

    @staticmethod
    def _frame(rows: list[tuple], keys: int) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[*(f"k{i}" for i in range(keys)), *(f.name for f in OUT)])

    def close(self) -> None:
        pass


def shot_uses(stream: DataFrame, film: str, at: str, late: str, keep: float) -> DataFrame:
    """film, shot, use, from_s and what of every row of a stream of film, shot, in_s, out_s, ord and `at` (a timestamp).

    Within a batch a film's rows are taken by time, then ord. State is held for films that were heard of in the last
    `keep` seconds before the watermark only.
    """
    rows = stream.where(F.col("shot").isNotNull() & F.col(at).isNotNull()).withWatermark(at, late)
    rows = rows.withColumn("at_ms", F.unix_millis(at))
    schema = T.StructType([T.StructField(film, stream.schema[film].dataType), *OUT])
    out = T.StructType([T.StructField("k0", stream.schema[film].dataType), *OUT])
    found = rows.groupBy(film).transformWithStateInPandas(ShotUses(keep), out, "append", "EventTime")
    return found.select(F.col("k0").alias(film), *[f.name for f in schema.fields[1:]])


def assign_stream(clips: DataFrame, sessions: DataFrame, keys: Sequence[str], at: str, t0: str, t1: str, late: str, longest: str = "1 day") -> DataFrame:
    """Each clip of a stream with the session of another stream in which it lies; null once no session can come any more.

    Both streams have a watermark, and a session lasts `longest` at most, so both sides' state is dropped when neither
    watermark can bring a partner. A clip that lies in several sessions comes once for each.
    """
    c, s = clips.withWatermark(at, late), sessions.withWatermark(t0, late)
    s = s.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = [F.col(k) == F.col(f"_{k}") for k in keys]
    when = (F.col(at) >= F.col(t0)) & (F.col(at) <= F.col(t0) + F.expr(f"interval {longest}")) & (F.col(at) < F.col(t1))
    for one in same:
        when = one & when
    return c.join(s, when, "leftOuter").drop(*[f"_{k}" for k in keys])
