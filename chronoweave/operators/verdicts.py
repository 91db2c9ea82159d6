"""Measurements, verdicts and their status: ok, unchecked, invalid, excluded.

A score belongs only to ok. What was not measured is null or unchecked, never clean: `least` and `greatest` skip
nulls, so formulas here ask for all their inputs first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _all(*columns: Column) -> Column:
    known = F.lit(True)
    for c in columns:
        known = known & c.isNotNull()
    return known


def _labels(*pairs: tuple[Column, str | Column]) -> Column:
    """The labels whose conditions hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(t) if isinstance(t, str) else t) for c, t in pairs]))


# levels and pictures

def gain_for(loudness: Column, peak: Column, target: float = -24.0, ceiling: float = -1.5, most: float = 30.0) -> Column:
    """dB to the target, held by a cap and by the peak's room (a peak that isn't known counts as full scale), in
    tenths; null without a loudness."""
    room = F.lit(ceiling) - F.coalesce(peak, F.lit(0.0))
    return F.when(loudness.isNotNull(), F.bround(F.least(F.lit(most), F.lit(target) - loudness, room), 1))


def leveler_for(loudness: Column, target: float = -24.0, cap: float = 30.0, most: float = 6.0) -> Column:
    """dB that a leveler has to add beyond the gain's cap, up to `most`, in tenths; 0 for very little or none."""
    short = F.lit(target) - loudness - F.lit(cap)
    return F.when(short > 0.05, F.bround(F.least(F.lit(most), short), 1)).otherwise(0.0)


def decibels(x: Column) -> Column:
    """20 log10; null, not minus infinity, for silence."""
    return F.when(x > 0, 20 * F.log10(x))


def linear(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def peak_gain(native: Column, resampled: Column, target_db: float = -1.0) -> Column:
    """Gain that brings the larger of two peaks to the target."""
    return F.when(_all(native, resampled), F.lit(target_db) - decibels(F.greatest(native, resampled)))


def peak_gain_reason(native: Column, resampled: Column) -> Column:
    """Which peak decides the gain; null where one of them, or any sound, is missing."""
    heard = _all(native, resampled) & (F.greatest(native, resampled) > 0)
    return F.when(heard, F.when(native >= resampled, "talk sample peak").otherwise("resampled peak (inter-sample overshoot) above the sample peak"))


def exposure_flags(average: Column, high: Column, low: Column, saturation: Column) -> Column:
    """Labels of a frame's luma and saturation; null where they were not measured."""
    flags = _labels(
        (average < 45, "dark"), (average > 185, "bright"), ((high >= 250) & (average > 150), "clipped highlights"),
        ((low <= 3) & (average < 70), "crushed blacks"), (saturation < 12, "desaturated"),
    )
    return F.when(_all(average, high, low, saturation), flags)


def motion_gloss(energy: Column, camera_ratio: Column) -> Column:
    """How much moves in a shot, and whether the camera does."""
    much = F.when(energy < 0.002, "static").when(energy < 0.008, "gentle").when(energy < 0.02, "moderate").otherwise("energetic")
    camera = F.when(camera_ratio > 0.6, "camera moves with the scene").otherwise("camera mostly still")
    return F.concat(much, F.lit(" movement, "), camera)


def move_label(lat: Column, vert: Column, zoom: Column, rot: Column, region: dict[str, Column]) -> Column:
    """Pace and name of a mean velocity: the largest part, and the second if it is half of that.

    region: median flows vx_c, vx_e, vx_t, vx_b, vy_t, vy_b (centre, edge, top, bottom), null where there were too few
    points. Sideways motion is an orbit if the centre runs slower than 0.4 of the edge, a slide if top and bottom
    differ by more than 1.4 times, else a pan; up or down likewise rises or tilts.
    """
    size = lambda k: F.abs(region[k])

    def apart(a: str, b: str) -> Column:
        low, high = F.least(size(a), size(b)), F.greatest(size(a), size(b))
        return F.coalesce(_all(region[a], region[b]) & (low > 0) & (high / low > 1.4), F.lit(False))

    orbit = F.coalesce(_all(region["vx_c"], region["vx_e"]) & (size("vx_e") > 0) & (size("vx_c") < 0.4 * size("vx_e")), F.lit(False))
    side, other = F.when(lat > 0, "left").otherwise("right"), F.when(lat > 0, "right").otherwise("left")
    words = {
        "lat": F.when(orbit, F.concat(F.lit("orbit "), other)).when(apart("vx_t", "vx_b"), F.concat(F.lit("slide "), side)).otherwise(F.concat(F.lit("pan "), side)),
        "vert": F.when(vert > 0, F.when(apart("vy_t", "vy_b"), "rise").otherwise("tilt up")).otherwise(F.when(apart("vy_t", "vy_b"), "descend").otherwise("tilt down")),
        "zoom": F.when(zoom > 0, "push-in").otherwise("pull-out"),
        "rot": F.when(rot > 0, "rotate clockwise").otherwise("rotate anticlockwise"),
    }
    parts = {"lat": lat, "vert": vert, "zoom": zoom, "rot": rot}
    ranked = F.reverse(F.array_sort(F.array(*[F.struct(F.abs(v).alias("size"), F.lit(-i).alias("first"), words[k].alias("word")) for i, (k, v) in enumerate(parts.items())])))
    first, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    speed = F.sqrt(lat * lat + vert * vert + zoom * zoom + rot * rot)
    pace = F.when(speed < 2, "slow ").when(speed < 5, "steady ").otherwise("fast ")
    more = F.when(second["size"] >= 0.5 * first["size"], F.concat(F.lit(" + "), second["word"])).otherwise("")
    return F.when(speed < 0.5, "hover").otherwise(F.concat(pace, first["word"], more))


def frames(seconds: Column, rate: int = 24) -> Column:
    """Whole frames, half to even. Ends are rounded and subtracted; a length is never rounded by itself."""
    return F.bround(seconds * rate).cast("long")


def frame_rate(rational: Column) -> Column:
    """'24000/1001' or '25' as a number; null for a zero or missing denominator's side."""
    top, bottom = F.split(rational, "/")[0].try_cast("double"), F.get(F.split(rational, "/"), F.lit(1))
    return F.when(bottom.isNull() | (bottom == ""), top).otherwise(F.try_divide(top, bottom.try_cast("double")))


def sample_times(start: Column, stop: Column, n: Column) -> Column:
    """n times spread over a span, a quarter second or a twentieth inside its ends; the middle for one."""
    inset = F.least(F.lit(0.25), (stop - start) * 0.05)
    step = (stop - start - 2 * inset) / F.greatest(n - 1, F.lit(1))
    spread = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: start + inset + step * i)
    return F.when(n <= 0, F.array().cast("array<double>")).when(n == 1, F.array((start + stop) / 2)).otherwise(spread)


def thinned(n: Column, k: int = 4) -> Column:
    """Indices of at most k of n things, evenly spread, the first and last among them."""
    some = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (n - 1) / (k - 1)).cast("int")))
    return F.when(n > 0, some).otherwise(F.array().cast("array<int>"))


def steady_picks(times: Column, runs: Column, k: int = 4) -> Column:
    """Indices of at most k of the times, evenly spread over those that lie in a steady run (t0, t1); without runs
    (null) all times count."""
    inside = lambda t: runs.isNull() | F.coalesce(F.exists(runs, lambda r: (r["t0"] <= t) & (t < r["t1"])), F.lit(False))
    open_ = F.filter(F.transform(times, lambda t, i: F.when(inside(t), i)), lambda i: i.isNotNull())
    return F.transform(thinned(F.size(open_), k), lambda i: F.get(open_, i))


# verdicts

def judgement(score: Column, relation: Column, ids: Column, known: Column, relations: Sequence[str]) -> Column:
    """A model's answer as (status, score, problems): a whole score from 0 to 3, a known relation, known ids.

    The score is read as text: "2" and "2.7" count as 2, as the whole part is taken.
    """
    whole = F.floor(score.try_cast("double")).cast("int")
    problems = _labels(
        (whole.isNull(), "score is not a number"), (whole.isNotNull() & ~whole.between(0, 3), "score is outside 0 to 3"),
        (~F.coalesce(relation.isin(*relations), F.lit(False)), "unknown relation"),
        (F.size(F.array_except(F.coalesce(ids, F.array().cast("array<string>")), known)) > 0, "unknown ids"),
    )
    good = F.size(problems) == 0
    return F.struct(F.when(good, "ok").otherwise("invalid").alias("status"), F.when(good, whole).alias("score"), problems.alias("problems"))


def cover_verdict(score: Column, usable: Column, frames_sent: Column) -> Column:
    """A verdict on cover as (status, score, usable, why): a whole score from 0 to 3 and numbers of frames that were
    sent, from 1; those beyond are dropped, and if none is left of any that were named, the verdict is invalid."""
    whole, named = score.try_cast("int"), F.coalesce(usable, F.array().cast("array<int>"))
    kept = F.array_sort(F.array_distinct(F.filter(named, lambda k: k.between(1, frames_sent))))
    problems = _labels(
        (whole.isNull(), "score missing or not an integer"), (~whole.between(0, 3), F.format_string("score %d out of range 0-3", whole)),
        ((F.size(named) > 0) & (F.size(kept) == 0) & (frames_sent > 0), F.format_string("usable names no frame in 1-%d", frames_sent)),
    )
    return F.struct(
        F.when(F.size(problems) == 0, "ok").otherwise("invalid").alias("status"), F.when(whole.between(0, 3), whole).alias("score"),
        kept.alias("usable"), F.array_join(problems, "; ").alias("why"),
    )


def candidate_verdict(standalone: Column, strength: Column, reason: Column) -> Column:
    """A verdict on a candidate as (status, why): two whole scores from 0 to 3 and a reason; the first fault is told."""
    bad = lambda x: ~F.coalesce((x == F.floor(x)) & x.between(0, 3), F.lit(False))
    why = (
        F.when(bad(standalone), "standalone is not an integer 0-3").when(bad(strength), "strength is not an integer 0-3")
        .when(F.trim(F.coalesce(reason, F.lit(""))) == "", "no reason")
    )
    return F.struct(F.when(why.isNull(), "ok").otherwise("invalid").alias("status"), why.alias("why"))


def strict_score(score: Column) -> Column:
    """A score only if it is written as a whole number from 0 to 3."""
    return F.when(score.rlike("^[0-3]$"), score.cast("int"))


def delivery(loudness: Column, peak: Column, target: float, tolerance: float, ceiling: float) -> Column:
    met = (F.abs(loudness - target) <= tolerance) & (peak <= ceiling + 0.1)
    return F.when(~_all(loudness, peak), "unchecked").when(met, "honoured").otherwise("broken")


def species_verdict(named: Column, ranked: Column, sure: float = 0.15) -> Column:
    """ranked: array of (name, score), best first. Agrees if the name or its genus is among five; disagrees if the
    best is sure of another; else nothing can be told."""
    genus = lambda x: F.split(F.lower(x), " ")[0]
    five = F.slice(ranked, 1, 5)
    agrees = F.exists(five, lambda r: (F.lower(r["name"]) == F.lower(named)) | (genus(r["name"]) == genus(named)))
    return F.when(ranked.isNull() | (F.size(ranked) == 0), "cannot tell").when(agrees, "agrees").when(F.get(five, F.lit(0))["score"] >= sure, "disagrees").otherwise("cannot tell")


def sync_verdict(verified: Column, r: Column, margin: Column) -> Column:
    return (
        F.when(F.coalesce(verified, F.lit(False)), "verified").when((r > 0.5) & (margin > 0.3), "strong")
        .when(r.isNull() | (r < 0.25), "no coverage").otherwise("ambiguous")
    )


def channels(left: Column, right: Column, apart: float = 3.0) -> Column:
    """Whether two channels carry the same speech loud enough: ok, one channel, or unchecked."""
    return F.when(~_all(left, right), "unchecked").when(F.abs(left - right) <= apart, "ok").otherwise("one channel")


def confident(no_speech: Column, compression: Column) -> Column:
    """Whether a heard segment is kept; unknown measures keep it."""
    return ~(F.coalesce(no_speech > 0.6, F.lit(False)) | F.coalesce(compression > 2.4, F.lit(False)))


def shaky(whole: Column, worst: Column, limit: float = 2.0) -> Column:
    """An error, not a pass, where the measure is missing."""
    asked = F.when(whole.isNull(), F.raise_error(F.lit("shake was not measured")).cast("boolean"))
    return F.coalesce(asked, (whole > limit) | F.coalesce(worst > limit, F.lit(False)))


def watchable(accepted: Column, problems: Column, usable: Column) -> Column:
    """An accepted verdict, and not one that speaks of blur with fewer than two usable frames."""
    blur = F.exists(F.coalesce(problems, F.array().cast("array<string>")), lambda p: F.lower(p).rlike("blur|soft|shak"))
    return F.coalesce(accepted, F.lit(False)) & ~(blur & (F.coalesce(F.size(usable), F.lit(0)) < 2))


def in_sync(source_a: Column, offset_a: Column, source_b: Column, offset_b: Column) -> Column:
    return (source_a == source_b) & (F.abs(offset_a - offset_b) <= 0.5)


def interview_setup(never_cover: Column, to_camera: Column) -> Column:
    return never_cover & ~to_camera


# summaries

def weighted_score(df: DataFrame, keys: Sequence[str], score: str = "score", seconds: str = "dur", status: str = "status") -> DataFrame:
    """Mean score by seconds over what was judged, with the seconds that were not."""
    ok = F.col(status) == "ok"
    return df.groupBy(*keys).agg(
        (F.sum(F.when(ok, F.col(score) * F.col(seconds))) / F.sum(F.when(ok, F.col(seconds)))).alias("score"),
        F.coalesce(F.sum(F.when(~ok, F.col(seconds))), F.lit(0)).alias("unchecked_s"),
    )


def score_histogram(df: DataFrame, score: str = "score", seconds: str = "dur", most: int = 3) -> DataFrame:
    """Seconds at each score from 0, those without any too."""
    spark = df.sparkSession
    have = df.groupBy(F.col(score).cast("long").alias("score")).agg(F.sum(seconds).alias("seconds"))
    return spark.range(most + 1).toDF("score").join(have, "score", "left").na.fill(0, ["seconds"])


def coverage(df: DataFrame, keys: Sequence[str], status: str = "status", seconds: str = "dur") -> DataFrame:
    """Counts and seconds of judged and unjudged rows."""
    ok = F.coalesce(F.col(status) == "ok", F.lit(False))
    return df.groupBy(*keys).agg(
        F.count_if(ok).alias("judged"), F.count_if(~ok).alias("unchecked"),
        F.coalesce(F.sum(F.when(ok, F.col(seconds))), F.lit(0)).alias("judged_s"), F.coalesce(F.sum(F.when(~ok, F.col(seconds))), F.lit(0)).alias("unchecked_s"),
    )


def reason_counts(df: DataFrame, keys: Sequence[str], reason: str, status: str = "status") -> DataFrame:
    """Rows without an ok by their reason; a missing reason counts as `no reason given`."""
    rows = df.where(~F.coalesce(F.col(status) == "ok", F.lit(False)))
    return rows.groupBy(*keys, F.coalesce(F.nullif(F.trim(reason), F.lit("")), F.lit("no reason given")).alias("reason")).agg(F.count("*").alias("n"))


def seconds_by(df: DataFrame, keys: Sequence[str], seconds: str) -> DataFrame:
    """Rows and seconds of each category."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.coalesce(F.sum(seconds), F.lit(0)).alias("seconds"))


def loudness_summary(df: DataFrame, context: str, loudness: str, peak: str, left: str, right: str, target: float = -24.0) -> DataFrame:
    """Upper median of each recording context, and how many rows are quiet (3 under it), hot or on one channel."""
    from .series import upper_medians

    middle = upper_medians(df, [context], loudness)
    each = df.join(middle, context)
    return each.groupBy(context).agg(
        F.first("median").alias("median"), F.count_if(F.col(loudness) < F.col("median") - 3).alias("quiet"),
        F.count_if(F.col(peak) > -1).alias("hot"), F.count_if(channels(F.col(left), F.col(right)) == "one channel").alias("one_channel"),
    )


def species_summary(detections: DataFrame, sure: float = 0.5) -> DataFrame:
    """Per species: detections, confident ones, the best confidence and the sources, the surest first."""
    out = detections.groupBy("species").agg(
        F.count("*").alias("n"), F.count_if(F.col("confidence") >= sure).alias("confident"), F.max("confidence").alias("best"),
        F.count_distinct("source").alias("sources"),
    )
    return out.orderBy(F.desc("confident"), F.desc("best"), "species")


def mean_over_views(scores: DataFrame, keys: Sequence[str], views: str, k: int = 5) -> DataFrame:
    """The k species of the largest mean over all views of a key; a view that doesn't list one counts as 0."""
    from .choose import top

    n = scores.groupBy(*keys).agg(F.count_distinct(views).alias("_n"))
    sums = scores.groupBy(*keys, "species").agg(F.sum("score").alias("_s")).join(n, list(keys))
    mean = sums.select(*keys, "species", (F.col("_s") / F.col("_n")).alias("mean"))
    return top(mean, keys, [F.desc("mean"), F.col("species")], k)


def talking_cover(rows: DataFrame, exempt: DataFrame | None = None, least: float = 1.0) -> DataFrame:
    """Status of picture laid over speech by what its own sound says: talking, unknown or ok.

    rows: clip, spoken_s (null: not transcribed), pick_clip, offset, pick_offset. Pictures in sync with their pick, and
    exempt clips or sources, are ok.
    """
    from .textops import source_of

    sync = in_sync(source_of(F.col("clip")), F.col("offset"), source_of(F.col("pick_clip")), F.col("pick_offset"))
    free = F.lit(False)
    out = rows
    if exempt is not None:
        names = exempt.select(F.col("clip").alias("_x")).distinct()
        out = rows.join(names.withColumnRenamed("_x", "_a").withColumn("_fa", F.lit(True)), F.col("clip") == F.col("_a"), "left")
        out = out.join(names.withColumnRenamed("_x", "_b").withColumn("_fb", F.lit(True)), source_of(F.col("clip")) == F.col("_b"), "left")
        free = F.coalesce("_fa", "_fb", F.lit(False))
    status = F.when(F.coalesce(sync, F.lit(False)) | free, "ok").when(F.col("spoken_s").isNull(), "unknown").when(F.col("spoken_s") >= least, "talking").otherwise("ok")
    return out.withColumn("status", status).select(*rows.columns, "status")


def cover_rules(rows: DataFrame, row_id: str, exempt: DataFrame | None = None, limit: float = 2.0) -> DataFrame:
    """Every finding on pictures laid over speech, one row each: talking, talking_unknown, shaky, sync_shaky,
    shake_unmeasured, drone_unclean, drone_unmeasured.

    rows: row_id, and what talking_cover reads; people (who is in view), shake_status, shake_whole, shake_worst, drone
    (whether it is drone picture), pieces, t0, t1. A picture in sync with its pick may talk, and its shake is told apart;
    one that shows nobody cannot talk. What was not measured is a finding of its own.
    """
    from .textops import nobody, source_of

    sync = F.coalesce(in_sync(source_of(F.col("clip")), F.col("offset"), source_of(F.col("pick_clip")), F.col("pick_offset")), F.lit(False))
    empty = F.coalesce(nobody(F.col("people")), F.lit(False))
    known = F.coalesce(F.col("shake_status") == "ok", F.lit(False))
    moved = F.when(known, shaky(F.col("shake_whole"), F.col("shake_worst"), limit)).otherwise(False)
    flown = F.when(F.coalesce("drone", F.lit(False)) & ~sync, clean_share(F.col("pieces"), F.col("t0"), F.col("t1")))
    findings = _labels(
        (~empty & (F.col("status") == "talking"), "talking"), (~empty & (F.col("status") == "unknown"), "talking_unknown"),
        (moved & ~sync, "shaky"), (moved & sync, "sync_shaky"), (~known, "shake_unmeasured"),
        (flown == "unclean", "drone_unclean"), (flown == "unmeasured", "drone_unmeasured"),
    )
    return talking_cover(rows, exempt).select(row_id, F.explode(findings).alias("finding"))


def clean_share(pieces: Column, start: Column, stop: Column, inset: float = 0.25, least: float = 0.9) -> Column:
    """Drone picture: `clean` if its longest clean piece fills nine tenths of the span, less a quarter second at
    each end; `unmeasured` without pieces. pieces: array of (t0, t1)."""
    a, b = start + inset, stop - inset
    longest = F.array_max(F.transform(pieces, lambda p: F.least(p["t1"], b) - F.greatest(p["t0"], a)))
    return F.when(pieces.isNull() | (F.size(pieces) == 0), "unmeasured").when(longest / (b - a) >= least, "clean").otherwise("unclean")


def rhythm(stretches: DataFrame, keys: Sequence[str], kind: str = "kind", seconds: str = "dur") -> DataFrame:
    """Per key: seconds, seconds and part without picture, shots, mean hold and the longest stretch without picture."""
    bare = F.col(kind) == "bare"
    total, empty = F.sum(seconds), F.coalesce(F.sum(F.when(bare, F.col(seconds))), F.lit(0))
    return stretches.groupBy(*keys).agg(
        total.alias("seconds"), empty.alias("bare"), (empty / total * 100).alias("bare_pct"), F.count_if(~bare).alias("shots"),
        F.avg(F.when(~bare, F.col(seconds))).alias("mean_hold"), F.coalesce(F.max(F.when(bare, F.col(seconds))), F.lit(0)).alias("longest_bare"),
    )


def jump_cuts(picks: DataFrame, stretches: DataFrame, keys: Sequence[str], order: str, slack: float = 0.05) -> DataFrame:
    """Joints (`at`) of neighbouring picks from one source while there is no picture: a cut that can be seen.

    picks: order, clip, t0, t1. stretches: kind, t0, t1. keys name a beat, whose stretches are few; a joint counts once.
    """
    from .textops import window_source

    w = Window.partitionBy(*keys).orderBy(order)
    source = window_source(F.col("clip"))
    joints = picks.select(*keys, order, F.col("t1").alias("at"), (source == F.lead(source).over(w)).alias("_same")).where("_same").drop("_same")
    bare = stretches.where("kind = 'bare'").select(*keys, (F.col("t0") - slack).alias("_from"), (F.col("t1") + slack).alias("_to"))
    met = joints.join(bare, list(keys)).where((F.col("_from") <= F.col("at")) & (F.col("at") <= F.col("_to")))
    return met.select(*keys, order, "at").distinct()


def rhythm_total(beats: DataFrame, jumps: DataFrame) -> DataFrame:
    """The rows of rhythm summed up: seconds, bare seconds and their part, and the number of jump cuts."""
    whole = beats.agg(F.sum("seconds").alias("seconds"), F.sum("bare").alias("bare"))
    cuts = jumps.agg(F.count("*").alias("jump_cuts"))
    return whole.join(cuts).select("seconds", "bare", F.try_divide(F.col("bare") * 100, "seconds").alias("bare_pct"), "jump_cuts")


def narrow_catalogue(units: DataFrame, reasons: Sequence[DataFrame]) -> DataFrame:
    """units with `why` they cannot serve; of several tables (id, why), the last that names a unit is heard."""
    out, names = units, []
    for i, r in enumerate(reasons):
        out = out.join(r.groupBy("id").agg(F.min("why").alias(f"_why{i}")), "id", "left")
        names.append(f"_why{i}")
    return out.select(*units.columns, F.coalesce(*reversed(names)).alias("why"))
