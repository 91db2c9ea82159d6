"""Picture rows over spoken picks: which footage runs where, and why nothing does.

Picks carry their verdicts, and a film's shots stream through a task ahead of its picks. There the chosen shot and its
alternatives become a chain of offers with the reasons against each, or the pick stays bare with one reason. Shots are
used up from pick to pick, so a film's chains are served in order, from a ledger of footage; what is held are the shots
of one film and what each has given, not its picks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.functions.schemas import record

#: Seconds: the shortest row, what counts as filled, what a steady part should give before footage is repeated.
SHORT, SLACK, FRESH = 1.0, 0.02, 3.0
ROW = record("pick string, k int, type string, shot string, in_s double, out_s double, dest_in_s double, dest_out_s double")
PICKS_AND_NOTE = [T.StructField("picks", T.ArrayType(T.StringType())), T.StructField("note", T.StringType())]


def offers(picks: DataFrame, verdicts: DataFrame | None, shots: DataFrame, film: str) -> DataFrame:
    """What `build_rows` reads: the picks with their verdicts (`judged`), and the shots of every film (`listed`).

    picks: film, ord, beat, pick, t0, duration_s, shot, alternatives, status, note, protected (a rule's name), never (a
    prefix of sources that may not stand here), card_s (seconds of a promised card), segments (until_s, shot, note).
    verdicts: film, pick, shot, score, watchable, from_s (first accepted second; null: the shot's start), reason; None
    where picks carry theirs as `judged`, an array of structs of these fields from shot on.
    shots: film, shot, in_s, out_s, runs (its steady parts; null: all of it), barred (why it is no cover at all).

    `bare` says why nothing stands over a pick, as far as the pick alone tells it; such a pick carries no verdicts. A
    shot is not joined to the picks that ask for it: a task reads a film's shots ahead of its picks.
    """
    if verdicts is not None:
        # an unwatchable shot stands nowhere, as one without a verdict
        fine = verdicts.where(F.col("shot").isNotNull() & F.col("watchable"))
        said = fine.select(film, "pick", F.struct("shot", "score", "watchable", "from_s", "reason").alias("v"))
        picks = picks.join(said.groupBy(film, "pick").agg(F.collect_list("v").alias("judged")), [film, "pick"], "left")
    bare = (
        F.when(F.col("protected").isNotNull(), F.concat(F.lit("held bare by rule "), "protected"))
        .when(F.col("status") == "unchecked", F.concat(F.lit("PROVISIONAL: no accepted verdict; "), F.coalesce("note", F.lit(""))))
        .when(F.col("shot").isNull(), F.coalesce("note", F.lit("the speaker carries it")))
    )
    wanted = lambda c: F.when(F.col("bare").isNull(), F.col(c)).alias(c)
    card = F.when(F.col("protected").isNull(), F.coalesce("card_s", F.lit(0.0)))
    asked = picks.withColumns({"bare": bare, "card_s": F.coalesce(card, F.lit(0.0))})
    asked = asked.select(film, F.lit(False).alias("listed"), "ord", "beat", "pick", "t0", "duration_s", "shot", "bare", "card_s", "never", *map(wanted, ("alternatives", "segments", "judged")))
    there = shots.where(F.col(film).isNotNull() & F.col("shot").isNotNull()).select(film, F.lit(True).alias("listed"), "shot", "in_s", "out_s", "runs", "barred")
    return asked.unionByName(there, allowMissingColumns=True)


class Offer(NamedTuple):
    """A shot that may stand over a pick, from its first accepted second on."""

    shot: str
    from_s: float
    out_s: float
    runs: list[dict] | None
    reason: str


class Film:
    """The shots of the film that passes through, and what they offer to a pick."""

    def __init__(self):
        self.shots: dict[str, tuple] = {}
        self.twice: set[str] = set()

    def add(self, shot: str, in_s: float, out_s: float, steady: bool, barred: str | None, runs: list[dict]) -> None:
        if shot in self.shots:
            self.twice.add(shot)
        self.shots[shot] = (shot, in_s, out_s, runs if steady else None, barred)

    def offers(self, r: Pick, judged: list[tuple], least: int) -> None:
        """Fill in a pick's offers, or why it stays bare.

        A chosen shot that may not be used leaves the pick bare; one that was found unwatchable gives way to the
        alternatives with a score of `least` or more. Segments bring offers of their own, under `cut`.
        """
        if r.film is None or r.pick is None:  # what has no name has no offers
            known, verdicts = {}, {}
        else:
            known, verdicts = self.shots, {v[0]: v for v in judged if v[2]}
            if len(verdicts) < sum(v[2] or False for v in judged):
                raise ValueError(f"{r.pick} has several verdicts on one shot")
        if self.twice and self.twice & {r.shot, *r.alternatives, *(s["shot"] for s in r.segments)}:
            raise ValueError(f"{r.pick} asks for a shot that is listed more than once")
        r.bare = self._against(r.shot, known, r.never) if known is self.shots else None
        if r.bare is not None:
            return
        for i, shot in enumerate((r.shot, *r.alternatives)):
            verdict = verdicts.get(shot)
            if verdict and (not i or (verdict[1] or 0) >= least and self._against(shot, known, r.never) is None):
                r.chain.append(self._offer(known[shot], verdict))
        if r.has_cut:
            for s in r.segments:
                shot, why, offer = s["shot"], None, None
                if shot is not None:
                    why, verdict = self._against(shot, known, r.never), verdicts.get(shot)
                    if why is None and verdict and (verdict[1] or 0) >= least:
                        offer = self._offer(known[shot], verdict)
                    why = why or f"{shot} has no accepted verdict for these words"
                r.cut.append((s["until_s"], why or s["note"] or "the speaker, by plan", offer))
        elif not r.chain:
            r.bare = "no watchable shot; the speaker carries it"

    @staticmethod
    def _against(shot: str, known: dict[str, tuple], never: str | None) -> str | None:
        """Why a shot may not stand over a pick, whatever its verdict."""
        there = known.get(shot)
        if there is None:
            return f"{shot} is not in the catalogue"
        if there[4] is not None:
            return f"{shot} is no cover: {there[4]}"
        return f"{shot} may not stand over this source" if never is not None and shot.startswith(never) else None

    @staticmethod
    def _offer(there: tuple, verdict: tuple) -> Offer:
        from_s = verdict[3]
        return Offer(there[0], there[1] if from_s is None else from_s, there[2], there[3], verdict[4] or "")


@dataclass(slots=True)
class Pick:
    film: object
    beat: object
    pick: str
    t0: float
    duration_s: float
    shot: str | None
    bare: str | None
    card_s: float
    never: str | None
    has_cut: bool
    alternatives: list[str]
    segments: list[dict]
    chain: list[Offer] = field(default_factory=list)
    cut: list[tuple[float, str, Offer | None]] = field(default_factory=list)


@dataclass(slots=True)
class Row:
    """One picture row; its place follows from its length."""

    kind: str
    shot: str | None
    start: float
    seconds: float
    note: str
    picks: list[str] = field(default_factory=list)
    at: float = 0.0


class Ledger:
    """What every shot of a film has given so far."""

    def __init__(self):
        self.spent: dict[str, float] = {}

    @staticmethod
    def _inside(start: float, stop: float, runs: list[dict] | None) -> tuple[float, float] | None:
        """Where [start, stop) may stand: anywhere without runs, in a run that holds it, else in the largest common part."""
        if runs is None or any(r["t0"] <= start and r["t1"] >= stop for r in runs):
            return (start, stop)
        parts = [(max(start, r["t0"]), min(stop, r["t1"])) for r in runs]
        return max(parts, key=lambda p: p[1] - p[0], default=None)

    def draw(self, offer: Offer, seconds: float) -> Row | None:
        """Up to so many seconds: behind its last use where that is enough, else again from its accepted start."""
        shot, first, end = offer.shot, offer.from_s, offer.out_s
        spent = self.spent.get(shot)
        places = [first] if spent is None else [max(first, spent), first]
        best, repeated = None, False
        for again, place in enumerate(places):
            got = self._inside(place, min(place + seconds, end), offer.runs)
            if got and (best is None or got[1] - got[0] > best[1] - best[0] + 0.01):
                best, repeated = got, again > 0
            enough = seconds if offer.runs is None else min(seconds, FRESH)
            if best and best[1] - best[0] >= enough - 0.01:
                break
        if best is None or best[1] - best[0] < SHORT:
            return None
        self.spent[shot] = best[1]
        notes = [offer.reason, "steady part of the take" if offer.runs is not None else "", "shows footage again" if repeated else ""]
        return Row("video", shot, best[0], best[1] - best[0], "; ".join(n for n in notes if n))

    def room(self, row: Row, offer: Offer) -> float:
        """Seconds for which a row could run on."""
        stop = row.start + row.seconds
        ends = [offer.out_s] if offer.runs is None else [r["t1"] for r in offer.runs if r["t0"] - 0.01 <= stop <= r["t1"] + 0.01]
        return max(0.0, min(ends, default=stop) - stop)

    def extend(self, row: Row, offer: Offer, seconds: float) -> float:
        """Let a row run on; the seconds that it gained."""
        more = min(seconds, self.room(row, offer))
        if more <= 0.01:
            return 0.0
        row.seconds += more
        self.spent[row.shot] = max(self.spent.get(row.shot, 0.0), row.start + row.seconds)
        return more

    def fill(self, chain: list[Offer], seconds: float, parts: int) -> list[Row]:
        """Rows of equal parts from the chain's first offers. What a part lacks is asked of the next one, then of the
        rows before, the last first; what nobody gives is bare."""
        rows, by, owed = [], {o.shot: o for o in chain}, 0.0
        for offer in chain[:parts]:
            asked = seconds / parts + owed
            row = self.draw(offer, asked)
            owed = asked - (row.seconds if row else 0.0)
            rows += [row] if row else []
        for row in reversed(rows):
            owed -= self.extend(row, by[row.shot], owed) if owed > SLACK else 0.0
        if owed > SLACK:
            why = f"{chain[parts - 1].shot} ran short" if rows else "no accepted second to show"
            rows.append(Row("bare", None, 0.0, owed, f"{why}; the speaker fills the rest"))
        return rows


def _serve(ledger: Ledger, r: Pick, before: Row | None, most: float, card: float) -> tuple[float, list[Row]]:
    """(seconds by which the row before runs on, the rows of one pick)."""
    left, rows = r.duration_s, []
    if r.card_s:  # promised material holds its place whatever the verdicts say
        rows.append(Row("placeholder", r.shot, 0.0, min(left, card, r.card_s), "a card holds the place"))
        left -= rows[0].seconds
    if left <= SLACK:
        return 0.0, rows
    if r.bare is not None:
        return 0.0, [*rows, Row("bare", None, 0.0, left, r.bare)]
    if r.cut and not rows:
        at = 0.0
        for until, why, offer in [*r.cut, (math.inf, "behind the last segment", None)]:
            length = min(until, r.duration_s) - at
            if length <= SLACK:
                continue
            rows += ledger.fill([offer], length, 1) if offer else [Row("bare", None, 0.0, length, why)]
            at += length
        return 0.0, rows
    if left < SHORT:
        return 0.0, [*rows, Row("bare", None, 0.0, left, "under a second; the speaker carries it")]
    chain = r.chain
    if not rows and before and before.kind == "video" and before.shot == chain[0].shot == r.shot and ledger.room(before, chain[0]) + 0.01 >= left:
        ledger.extend(before, chain[0], left)
        return left, rows
    parts = min(max(1, math.ceil(left / most)), len(chain))
    return 0.0, rows + ledger.fill(chain, left, parts)


def _values(a: pa.Array) -> list:
    """An array as a list, by way of numpy where that keeps every value."""
    t = a.type
    if pa.types.is_string(t) or pa.types.is_large_string(t) or not a.null_count and (pa.types.is_integer(t) or pa.types.is_floating(t) or pa.types.is_boolean(t)):
        return a.to_numpy(zero_copy_only=False).tolist()
    return a.to_pylist() if a.null_count < len(a) else [None] * len(a)


def _lists(a: pa.Array, unpack: Callable[[pa.Array], list]) -> Iterator[list]:
    """The lists of an array of lists, none where one is null; all members are unpacked at once."""
    if not len(a):
        return
    at = a.offsets.to_numpy().tolist()
    members = unpack(a.values.slice(at[0], at[-1] - at[0]))
    for i, j in zip(at, at[1:]):
        yield members[i - at[0] : j - at[0]]


def build_rows(offered: DataFrame, film: str, most: float = 12.0, card: float = 8.0, least: int = 2) -> DataFrame:
    """Picture rows for every pick of a film: film, beat, pick, k, type, shot, in_s, out_s, dest_in_s, dest_out_s, picks, note.

    offered: as `offers` makes them. Rows of a pick add up to its length, so every pick's picture begins with its
    words; bare rows say why. A pick over the same shot as the row before lets that row run on (picks names both). A
    pick longer than `most` is shared by as many offers as it has; a card takes `card` seconds at most; a second choice
    needs a score of `least`.
    """
    schema = T.StructType([offered.schema[film], offered.schema["beat"], *ROW.fields, *PICKS_AND_NOTE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        types, out = to_arrow_schema(schema), []
        known, ledger, before, now, first = Film(), Ledger(), None, None, True

        def made(rows: list) -> pa.RecordBatch:
            found = [(r.film, r.beat, r.pick, k, w.kind, w.shot, round(w.start, 2), round(w.start + w.seconds, 2), round(w.at, 2), round(w.at + w.seconds, 2), w.picks, w.note) for r, k, w in rows]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), types, strict=True)], names=types.names)

        for batch in batches:
            is_shot = batch.column("listed")
            shots, picks = batch.filter(is_shot), batch.filter(pc.invert(is_shot))
            next_shot = zip(*[_values(shots.column(n)) for n in ("shot", "t0", "duration_s", "cut", "bare")])
            runs, alternatives, segments = _lists(shots.column("runs"), pa.Array.to_pylist), _lists(picks.column("alternatives"), _values), _lists(picks.column("segments"), pa.Array.to_pylist)
            next_pick = zip(*[_values(picks.column(n)) for n in ("beat", "pick", "t0", "duration_s", "shot", "bare", "card_s", "never", "cut")])
            judged = _lists(picks.column("judged"), lambda a: list(zip(*[_values(a.field(n)) for n in ("shot", "score", "watchable", "from_s", "reason")])))
            for film_, listed in zip(_values(batch.column(film)), _values(is_shot)):
                if first or film_ != now:
                    known, ledger, before, now, first = Film(), Ledger(), None, film_, False
                if listed:
                    known.add(*next(next_shot), next(runs))
                    continue
                r, said = Pick(film_, *next(next_pick), next(alternatives), next(segments)), next(judged)
                if r.bare is None:
                    known.offers(r, said, least)
                start = before.seconds if before else 0.0
                more, rows = _serve(ledger, r, before, most, card)
                if more:
                    before.seconds = start + more
                    before.picks.append(r.pick)
                at = r.t0 + more
                for k, row in enumerate(rows):
                    row.at, row.picks = at, [r.pick]
                    at += row.seconds
                    out.append((r, k, row))
                before = rows[-1] if rows else before
            if len(out) > 1:  # the last row may still run on
                yield made(out[:-1])
                out = out[-1:]
        if out:
            yield made(out)

    # to Arrow a null list costs as many steps as there are nulls before it, so lists are empty and flags say what was null
    lists = ("alternatives", "judged", "segments", "runs")
    filled = [F.coalesce(c, F.array().cast(offered.schema[c].dataType)).alias(c) for c in lists]
    # and every column costs at every row, so what only shots have shares the columns of picks
    shared = {"t0": F.col("in_s"), "duration_s": F.col("out_s"), "bare": F.col("barred"), "cut": F.col("runs").isNotNull()}
    both = [F.when(F.col("listed"), c).otherwise(F.col(n)).alias(n) for n, c in shared.items()]
    rows = offered.withColumn("cut", F.col("segments").isNotNull()).select(film, "listed", "ord", "beat", "pick", "shot", "card_s", "never", *both, *filled)
    sorted_ = rows.repartition(film).sortWithinPartitions(film, F.desc("listed"), "ord")
    return sorted_.drop("ord").mapInArrow(run, schema)
