"""The lay plan of a cut: sound with handles and crossfades, picture on two clocks, holes and what the gains leave.

Times of the film are counted in its frames, times of a source in the source's own. Every field hangs on the rows next
to it only, so a film is a window and nothing is walked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .verdicts import frames


def lay_audio(picks: DataFrame, film: str, handle: int = 6) -> DataFrame:
    """Spoken picks in frames: rec, dur, head, tail, fade_in, fade_out, hole, track and src_in, src_out beside all columns.

    picks: film, ord, t0 (its place in the film, seconds), duration_s, in_s and out_s (in the source), max_head and
    max_tail (frames free of other words), hard_in (its first word stands at the in-point). rec and dur are laid and
    trimmed without their handles: rec - head is where sound begins.

    A tail reaches over the gap to the next head; what its own room cannot give, the next head gives, up to its room.
    Where both overlap they fade into each other (two frames at least; a hard in-point keeps two), and what nothing
    covers is a hole behind the tail. A gap is counted in frames as placed: starts and lengths are rounded apart.
    """
    w = Window.partitionBy(film).orderBy("ord")
    first, last = F.row_number().over(w) == 1, F.lead("ord").over(w).isNull()
    laid = picks.withColumns({
        "rec": frames(F.col("t0")), "dur": frames(F.col("duration_s")), "src_in": frames(F.col("in_s")), "src_out": frames(F.col("out_s")),
        "_head": F.when(first, F.lit(0)).otherwise(F.least(F.lit(handle), "max_head")).cast("long"), "_first": first, "_last": last,
        "track": (1 + (F.row_number().over(w) - 1) % 2).cast("int"),
    })
    laid = laid.withColumn("_gap", F.lead("rec").over(w) - F.col("rec") - F.col("dur"))
    want = F.col("_gap") + 2 * handle - F.lead("_head").over(w)
    laid = laid.withColumn("_want", F.when(F.col("_last"), F.lit(2 * handle).cast("long")).otherwise(want))
    laid = laid.withColumn("tail", F.least("_want", F.col("max_tail").cast("long")))
    # what a tail could not give is asked of the next head
    asked = F.greatest(F.lit(0).cast("long"), F.coalesce(F.lag(F.col("_want") - F.col("tail")).over(w), F.lit(0)))
    laid = laid.withColumn("head", F.when(asked > 0, F.least(F.col("max_head").cast("long"), F.col("_head") + asked)).otherwise(F.col("_head")))
    laid = laid.withColumn("_over", F.col("tail") + F.lead("head").over(w) - F.col("_gap"))
    two, fade = F.lit(2).cast("long"), F.greatest(F.lit(2).cast("long"), F.col("_over"))
    into = F.when(F.col("_first"), F.lit(2 * handle).cast("long")).when(F.coalesce("hard_in", F.lit(False)), two).otherwise(F.lag(fade).over(w))
    laid = laid.withColumns({
        "fade_in": into, "fade_out": F.when(F.col("_last"), F.lit(2 * handle).cast("long")).otherwise(fade),
        "hole": F.coalesce(F.greatest(F.lit(0).cast("long"), -F.col("_over")), F.lit(0).cast("long")),
    })
    return laid.drop("_head", "_first", "_last", "_gap", "_want", "_over")


def lay_video(rows: DataFrame, beats: DataFrame, film: str, rate: int = 24, least: float = 1.0) -> DataFrame:
    """Picture rows with rec, dur (frames of the film), sf, ef (frames of the source) and covers_gap.

    rows: film, beat, k, type, in_s, fps (of the source), card, dest_in_s, dest_out_s. beats: film, beat, end_s (of its
    last pick) and gap_after_s. Bare rows and rows under a second are not laid; a placeholder counts from 0 in the
    film's frames. The last row of a beat, if it reaches the beat's end within a frame and is no card, also covers the
    gap, up to the very frame at which the next beat begins.
    """
    laid = rows.where((F.col("type") != "bare") & (F.col("dest_out_s") - F.col("dest_in_s") >= least)).join(beats, [film, "beat"])
    held = F.col("type") == "placeholder"
    fps = F.when(held, F.lit(float(rate))).otherwise(F.col("fps"))
    rec = frames(F.col("dest_in_s"), rate)
    laid = laid.withColumns({"fps": fps, "rec": rec, "dur": frames(F.col("dest_out_s"), rate) - rec, "sf": F.when(held, F.lit(0).cast("long")).otherwise(F.bround(F.col("in_s") * fps).cast("long"))})
    in_source = lambda n: F.bround(n * F.col("fps") / rate).cast("long")
    laid = laid.withColumn("ef", F.col("sf") + in_source(F.col("dur")))
    last = F.lead("k").over(Window.partitionBy(film, "beat").orderBy("k")).isNull()
    stop = F.col("rec") + F.col("dur")
    reaches = last & (F.coalesce("gap_after_s", F.lit(0.0)) > 0) & (stop >= frames(F.col("end_s"), rate) - 1) & ~F.coalesce("card", F.lit(False))
    more = F.when(reaches, frames(F.col("end_s") + F.col("gap_after_s"), rate) - stop).otherwise(F.lit(0).cast("long"))
    laid = laid.withColumns({"covers_gap": reaches, "_more": more})
    return laid.withColumns({"ef": F.col("ef") + in_source(F.col("_more")), "dur": F.col("dur") + F.col("_more")}).drop("_more", "end_s", "gap_after_s")


def holes(audio: DataFrame, video: DataFrame, film: str, width: int = 24 * 60) -> DataFrame:
    """Holes of the sound that no picture spans: the source's own picture behind the tail, laid without sound.

    film, pick, rec, dur, sf, ef. Both sides meet in buckets of `width` frames.
    """
    end = F.col("rec") + F.col("dur") + F.col("tail")
    open_ = audio.where("hole > 0").select(film, "pick", end.alias("rec"), F.col("hole").alias("dur"), (F.col("src_out") + F.col("tail")).alias("sf"), (F.col("src_out") + F.col("tail") + F.col("hole")).alias("ef"))
    spans = video.select(film, F.col("rec").alias("_a"), (F.col("rec") + F.col("dur")).alias("_b"))
    spans = spans.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("_a") / width), F.floor(F.col("_b") / width))))
    asked = open_.withColumn("_bucket", F.floor(F.col("rec") / width))
    covered = (F.col("_a") <= F.col("rec")) & (F.col("_b") >= F.col("rec") + F.col("dur"))
    return asked.join(spans.withColumnRenamed(film, "_film"), (F.col(film) == F.col("_film")) & (asked["_bucket"] == spans["_bucket"]) & covered, "left_anti").drop("_bucket")


def end_frame(audio: DataFrame, video: DataFrame, film: str) -> DataFrame:
    """film and the frame at which its last sound or picture ends."""
    a = audio.select(film, (F.col("rec") + F.col("dur") + F.col("tail")).alias("stop"))
    return a.union(video.select(film, (F.col("rec") + F.col("dur")).alias("stop"))).groupBy(film).agg(F.max("stop").alias("end_frame"))


def gain_limit(loudness: Column, peak: Column, gain: Column, target: float = -24.0, most: float = 30.0) -> Column:
    """What keeps a pick under the target: unmeasured, capped (the gain's most), peak (its peak's room), or null.

    With it how many dB are missing, in tenths: the gain that a capped pick would need, what a peak leaves short.
    """
    need = F.lit(target) - loudness
    limit = lambda why, missing: F.struct(F.lit(why).alias("limit"), missing.alias("db"))
    bound = peak.isNotNull() & (gain < need - 0.05) & (gain < most - 0.05)
    return (
        F.when(loudness.isNull(), limit("unmeasured", F.lit(None).cast("double")))
        .when(need > most + 0.05, limit("capped", F.bround(need, 1)))
        .when(bound, limit("peak", F.bround(need - gain, 1)))
    )


def markers(beats: DataFrame, rows: DataFrame, film: str) -> DataFrame:
    """film, frame, name and note: one at each beat's start, one behind each placeholder's first frame.

    beats: film, beat, start_s, title, notes; rows: film, type, dest_in_s, text.
    """
    names = F.concat(F.lit("B"), F.lpad(F.col("beat").cast("string"), 2, "0"), F.lit(" "), F.coalesce("title", F.lit("")))
    of_beats = beats.select(film, frames(F.col("start_s")).alias("frame"), names.alias("name"), F.coalesce("notes", F.lit("")).alias("note"))
    held = rows.where("type = 'placeholder'").select(film, (frames(F.col("dest_in_s")) + 1).alias("frame"), F.lit("PLACEHOLDER").alias("name"), F.col("text").alias("note"))
    return of_beats.union(held)
