"""From timed words to selects: sentences, beats, candidates, levels and rows to export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import gap_islands, islands
from .textops import DANGLING, first_token

#: Fixed kinds of candidates with the seconds that each may last, both bounds included.
DURATIONS = {"hook": (3.0, 12.0), "bite": (6.0, 30.0), "closer": (3.0, 15.0)}
TERMINAL = r"[.!?…][\"'”’)\]]*$"


def sentences(words: DataFrame, keys: Sequence[str], pause: float = 0.6, longest: float = 30.0) -> DataFrame:
    """Sentences of timed words (w, s, e): t0, t1, text, words and pause_before, numbered by `n` from 1.

    A word closes one by its punctuation, a pause does, or the end. One that lasts too long is halved at its longest
    pause, the nearest to its middle of equals, until none is too long. Halving looks at one sentence only, so it is
    done inside the sentence's row, each round at all parts that are left; no row is sorted again for it.
    """
    marked = words.withColumn("_closes", F.col("w").rlike(TERMINAL))
    rows = gap_islands(marked, keys, "s", "e", pause, "_closes")
    whole = rows.groupBy(*keys, "island").agg(F.array_sort(F.collect_list(F.struct("s", "e", "w"))).alias("_words"))
    stop = lambda p: F.array_max(F.transform(p, lambda x: x["e"]))
    lasts = lambda p: (stop(p) - p[0]["s"] > longest) & (F.size(p) > 1)

    def halves(p: Column) -> Column:
        middle = (p[0]["s"] + stop(p)) / 2
        gap = lambda i: p[i]["s"] - p[i - 1]["e"]
        places = F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: F.struct(gap(i).alias("gap"), (-F.abs((p[i]["s"] + p[i - 1]["e"]) / 2 - middle)).alias("near"), (-i).alias("i")))
        cut = -F.array_max(places)["i"]
        return F.transform(F.array(cut), lambda c: F.array(F.slice(p, F.lit(1), c), F.slice(p, c + 1, F.size(p))))[0]

    # as many rounds as a sentence could need; those behind the last cut do nothing
    once = lambda parts: F.when(F.exists(parts, lasts), F.flatten(F.transform(parts, lambda p: F.when(lasts(p), halves(p)).otherwise(F.array(p))))).otherwise(parts)
    rounds = F.sequence(F.lit(1), F.size("_words") - 1)
    parts = F.when(lasts(F.col("_words")), F.aggregate(rounds, F.array("_words"), lambda done, _: once(done))).otherwise(F.array("_words"))
    out = whole.select(*keys, F.explode(parts).alias("_p")).select(
        *keys, F.col("_p")[0]["s"].alias("t0"), stop(F.col("_p")).alias("t1"), F.size("_p").cast("long").alias("words"),
        F.array_join(F.transform("_p", lambda x: x["w"]), " ").alias("text"),
    )
    w = Window.partitionBy(*keys).orderBy("t0", "t1")
    numbered = out.withColumns({"n": F.row_number().over(w), "pause_before": F.col("t0") - F.coalesce(F.lag("t1").over(w), F.lit(0.0))})
    return numbered.select(*keys, "n", F.format_string("S%04d", "n").alias("id"), "t0", "t1", "words", "text", "pause_before")


def beat_faults(beats: DataFrame, sentences_: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Why beats (n, title, first, last) are no partition of the sentences: gaps, overlaps, unknown ids, no title.
    Any fault of a key rejects all of its beats."""
    place = sentences_.select(*keys, F.col("id").alias("_id"), F.col("n").alias("_n"))
    named = beats.join(place.withColumnsRenamed({"_id": "first", "_n": "_a"}), [*keys, "first"], "left").join(place.withColumnsRenamed({"_id": "last", "_n": "_b"}), [*keys, "last"], "left")
    count = sentences_.groupBy(*keys).agg(F.count("*").alias("_count"))
    w = Window.partitionBy(*keys).orderBy("n")
    seen = named.join(count, list(keys), "left").withColumns({"_before": F.coalesce(F.lag("_b").over(w), F.lit(0)), "_next": F.lead("n").over(w)})
    faults = F.array_compact(
        F.array(
            F.when(F.col("_a").isNull() | F.col("_b").isNull(), "unknown sentence id"),
            F.when(F.coalesce(F.trim("title"), F.lit("")) == "", "no title"),
            F.when(F.col("_a") > F.col("_before") + 1, "gap before"), F.when(F.col("_a") <= F.col("_before"), "overlap"),
            F.when(F.col("_b") < F.col("_a"), "ends before it starts"), F.when(F.col("_next").isNull() & (F.col("_b") < F.col("_count")), "sentences left over"),
        )
    )
    return seen.select(*keys, "n", F.explode(faults).alias("fault"))


def token_windows(sizes: Column, budget: int, overlap: int) -> Column:
    """Windows (first, last), from 0, over a list of token counts: each as long as fits, beginning `overlap` items
    before the end of the one before. One item too long for the budget is a window alone."""
    n = F.size(sizes)
    state = F.struct(F.array().cast("array<struct<first:int,last:int>>").alias("out"), F.lit(0).alias("first"), F.lit(0).cast("long").alias("sum"))
    last_of = lambda x: F.get(sizes, x)

    def add(s: Column, i: Column) -> Column:
        full = (s["sum"] + last_of(i) > budget) & (i > s["first"])
        start = F.greatest(i - overlap, s["first"] + 1)
        again = F.aggregate(F.slice(sizes, start + 1, i - start + 1), F.lit(0).cast("long"), lambda a, x: a + x)
        # an overlap that leaves no room for the new item is given up
        room = again <= budget
        return F.when(
            full,
            F.struct(
                F.concat(s["out"], F.array(F.struct(s["first"].alias("first"), (i - 1).alias("last")))).alias("out"),
                F.when(room, start).otherwise(i).alias("first"), F.when(room, again).otherwise(last_of(i).cast("long")).alias("sum"),
            ),
        ).otherwise(F.struct(s["out"].alias("out"), s["first"].alias("first"), (s["sum"] + last_of(i)).alias("sum")))

    walked = F.aggregate(F.sequence(F.lit(0), n - 1), state, add)
    return F.when(n > 0, F.concat(walked["out"], F.array(F.struct(walked["first"].alias("first"), (n - 1).alias("last"))))).otherwise(F.array().cast("array<struct<first:int,last:int>>"))


def merge_windows(beats: DataFrame, windows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Beats (window, first, last as places) of overlapping windows as one list: neighbours are cut in the middle of
    what they share, beats are held to their window's part, and those left empty go. windows: window, lo, hi."""
    w = Window.partitionBy(*keys).orderBy("window")
    cut_before = F.floor((F.col("lo") + F.lag("hi").over(w) - 1) / 2)
    cut_after = F.floor((F.lead("lo").over(w) + F.col("hi") - 1) / 2)
    held = windows.select(*keys, "window", F.coalesce(cut_before + 1, F.col("lo")).alias("_from"), F.coalesce(cut_after, F.col("hi")).alias("_to"))
    out = beats.join(held, [*keys, "window"]).withColumns({"first": F.greatest("first", "_from"), "last": F.least("last", "_to")})
    return out.where("first <= last").drop("_from", "_to")


def gate(candidates: DataFrame, sentences_: DataFrame, beats: DataFrame, keys: Sequence[str], vocabulary: Sequence[str] = (), off_mic: bool = False) -> DataFrame:
    """Candidates (kind, first, last, register, cover_brief, beat) with status ok, invalid or excluded, reasons and
    flags. Invalid ones are not looked at further; excluded ones are off-mic or too short or long for their kind.

    sentences: id, n, t0, t1, text, head_room, tail_room, off_mic. beats: beat, lo, hi (places of sentences).
    """
    place = sentences_.select(*keys, F.col("id").alias("_id"), "n", "t0", "t1", "head_room", "tail_room", F.col("text").alias("_text"))
    a = place.select(*keys, F.col("_id").alias("first"), F.col("n").alias("_a"), F.col("t0").alias("t0"), "head_room", F.col("_text").alias("_first_text"))
    b = place.select(*keys, F.col("_id").alias("last"), F.col("n").alias("_b"), F.col("t1").alias("t1"), "tail_room")
    rows = candidates.join(a, [*keys, "first"], "left").join(b, [*keys, "last"], "left").join(beats, [*keys, "beat"], "left")
    # off-mic sentences so far, so that a span's number is a difference and no span is expanded
    w = Window.partitionBy(*keys).orderBy("n")
    off = sentences_.select(*keys, "n", F.sum(F.coalesce(F.col("off_mic"), F.lit(False)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_off"))
    rows = rows.join(off.withColumnsRenamed({"n": "_b", "_off": "_off_b"}), [*keys, "_b"], "left")
    rows = rows.join(off.select(*keys, (F.col("n") + 1).alias("_a"), F.col("_off").alias("_off_a")), [*keys, "_a"], "left")
    kind, register = F.lower(F.trim("kind")), F.lower(F.trim(F.coalesce("register", F.lit("none"))))
    unknown = F.col("_a").isNull() | F.col("_b").isNull()
    ordered = (F.col("lo") <= F.col("_a")) & (F.col("_a") <= F.col("_b")) & (F.col("_b") <= F.col("hi"))
    invalid = F.array_compact(
        F.array(
            F.when(~F.coalesce(kind.isin(*DURATIONS), F.lit(False)), F.concat(F.lit("unknown kind "), F.coalesce(kind, F.lit("none")))),
            F.when(unknown, "unknown sentence id").when(~F.coalesce(ordered, F.lit(False)), "ids out of order or outside the beat"),
            F.when(F.lit(bool(vocabulary)) & ~register.isin(*vocabulary, "none"), F.concat(F.lit("register not in the vocabulary: "), register)),
            F.when(F.trim(F.coalesce("cover_brief", F.lit(""))) == "", "no cover brief"),
        )
    )
    seconds = F.round(F.col("t1") - F.col("t0"), 2)
    low = F.coalesce(*[F.when(kind == k, F.lit(v[0])) for k, v in DURATIONS.items()])
    high = F.coalesce(*[F.when(kind == k, F.lit(v[1])) for k, v in DURATIONS.items()])
    excluded = F.array_compact(
        F.array(
            F.when(F.lit(not off_mic) & (F.col("_off_b") - F.coalesce("_off_a", F.lit(0)) > 0), "contains an off-mic sentence"),
            F.when(seconds < low, "too short"), F.when(seconds > high, "too long"),
        )
    )
    token = first_token(F.col("_first_text"))
    flags = F.array_compact(
        F.array(
            F.when(token.isin(*DANGLING), F.concat(F.lit("dangling_start:"), token)),
            F.when(F.col("head_room").isNull() | F.col("tail_room").isNull(), "room_unmeasured"),
            F.when(F.col("head_room") < 0.15, "tight_in"), F.when(F.col("tail_room") < 0.15, "tight_out"),
        )
    )
    none = F.array().cast("array<string>")
    out = rows.withColumns({"_invalid": invalid, "_excluded": excluded, "_flags": flags, "duration_s": seconds})
    bad = F.size("_invalid") > 0
    return out.select(
        *candidates.columns, "t0", "t1", "duration_s", "head_room", "tail_room",
        F.when(bad, "invalid").when(F.size("_excluded") > 0, "excluded").otherwise("ok").alias("status"),
        F.when(bad, F.col("_invalid")).otherwise(F.col("_excluded")).alias("reasons"), F.when(bad, none).otherwise(F.col("_flags")).alias("flags"),
    )


def merge_repeats(candidates: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Of ok candidates with the same first and last sentence the first stays, with the others' kinds; the rest of
    the rows stay as they are."""
    ok = candidates.where("status = 'ok'")
    w = Window.partitionBy(*keys, "first", "last").orderBy(order)
    marked = ok.withColumns({"_r": F.row_number().over(w), "_kind": F.first("kind").over(w)})
    kinds = marked.groupBy(*keys, "first", "last").agg(F.array_sort(F.collect_set(F.when(F.col("_r") > 1, F.col("kind")))).alias("also_proposed_as"))
    first = marked.where("_r = 1").drop("_r", "_kind").join(kinds, [*keys, "first", "last"])
    return first.unionByName(candidates.where("status != 'ok'"), allowMissingColumns=True)


def measure(sentences_: DataFrame, frames: DataFrame, words: DataFrame, keys: Sequence[str], rate: int = 100) -> DataFrame:
    """Sentences with level, floor and speech levels, off_mic, and whether room can be measured.

    frames: i, db, at `rate` a second. words: s, e. floor: tenth percentile of all frames; speech: ninetieth of those
    under words; a sentence's level likewise, in tenths. Off-mic: 10 dB or more under the median sentence. Both are
    decided on millionths, so that no trace of interpolation moves a half or a limit.
    """
    from .intervals import contains_join
    from .series import percentiles

    timed = frames.withColumn("_t", F.col("i") / rate)
    floor = percentiles(frames, keys, "db", {"floor": 0.1})
    under = contains_join(timed, words.select(*keys, "s", "e"), keys, "_t", ("s", "e"), 10.0)
    speech = percentiles(under.select(*keys, "i", "db").distinct(), keys, "db", {"speech": 0.9})
    heard = contains_join(timed, sentences_.select(*keys, "n", "t0", "t1"), keys, "_t", ("t0", "t1"), 10.0)
    level = percentiles(heard, [*keys, "n"], "db", {"level": 0.9}).withColumn("level", F.round(F.round("level", 6), 1))
    out = sentences_.join(level, [*keys, "n"], "left").join(floor, list(keys), "left").join(speech, list(keys), "left")
    out = out.join(percentiles(out, keys, "level", {"_wearer": 0.5}), list(keys), "left")
    return out.withColumns({"off_mic": F.round(F.col("_wearer") - F.col("level"), 6) >= 10, "room_known": F.col("speech") - F.col("floor") >= 12, "quiet": F.col("floor") + 6}).drop("_wearer")


def selects(ranked: DataFrame, chunks: DataFrame, keys: Sequence[str], handle: float = 0.3) -> DataFrame:
    """Rows to export: each candidate with a handle on both sides, cut at the chunks that it spans, `part` of `parts`.

    chunks: source, c0, c1 (place in the talk). Parts of a millisecond or less are left out.
    """
    from .intervals import overlap_join

    a = F.col("t0") - F.least(F.lit(handle), F.coalesce("head_room", F.lit(0.0)))
    b = F.col("t1") + F.least(F.lit(handle), F.coalesce("tail_room", F.lit(0.0)))
    wide = ranked.withColumns({"_a": F.greatest(a, F.lit(0.0)), "_b": b})
    met = overlap_join(wide, chunks, keys, ("_a", "_b"), ("c0", "c1"), 600.0)
    cut = met.withColumns({"in_s": F.greatest("_a", "c0") - F.col("c0"), "out_s": F.least("_b", "c1") - F.col("c0")}).where("out_s - in_s > 0.001")
    w = Window.partitionBy(*keys, "id")
    return cut.withColumns({"part": F.row_number().over(w.orderBy("c0")), "parts": F.count(F.lit(1)).over(w)}).drop("_a", "_b", "c0", "c1")


def section_lines(lines: DataFrame, keys: Sequence[str], order: str, text: str, heading: str) -> DataFrame:
    """Lines under a markdown heading, up to the next heading of its level or above."""
    level = F.length(F.regexp_extract(text, r"^(#+)\s", 1))
    opens = (level > 0) & (F.lower(F.trim(F.regexp_replace(text, r"^#+\s*", ""))) == heading.lower())
    w = Window.partitionBy(*keys).orderBy(order)
    # a deeper heading inside an open section does not close it
    rows = lines.withColumns({"_level": level, "_opens": opens})
    opened = F.last(F.when(F.col("_opens"), F.struct(F.col(order).alias("at"), F.col("_level").alias("level"))), ignorenulls=True).over(w)
    rows = rows.withColumn("_open", opened)
    closes = F.last(F.when((F.col("_level") > 0) & ~F.col("_opens") & (F.col("_level") <= F.col("_open.level")), F.col(order)), ignorenulls=True).over(w)
    out = rows.withColumn("_closed", closes)
    return out.where(F.col("_open").isNotNull() & ~F.col("_opens") & (F.coalesce(F.col("_closed"), F.lit(-1)) < F.col("_open.at"))).select(*lines.columns)


def last_heading(lines: DataFrame, keys: Sequence[str], order: str, text: str) -> DataFrame:
    """Each line with the latest heading above it."""
    head = F.when(F.col(text).rlike(r"^#+\s"), F.trim(F.regexp_replace(text, r"^#+\s*", "")))
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("heading", F.last(head, ignorenulls=True).over(w))


def marked_runs(runs: DataFrame, keys: Sequence[str], order: str, marker: str, text: str) -> DataFrame:
    """Neighbouring runs of one marker as one text; runs without a marker divide and are left out."""
    w = Window.partitionBy(*keys).orderBy(order)
    turned = runs.withColumn("_turn", ~F.col(marker).eqNullSafe(F.lag(marker).over(w)))
    grouped = islands(turned, keys, [order], F.col("_turn")).where(F.col(marker).isNotNull())
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "")
    return grouped.groupBy(*keys, "island").agg(F.first(marker).alias(marker), joined.alias(text), F.min(order).alias(order)).drop("island")
