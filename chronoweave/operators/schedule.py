"""Schedules: camera clocks, session windows, assignment with reasons, reports and validation.

A recording that fits no session, or several, gets a reason instead of a guess. Schedule tables are small but
come as tables; joins leave it to Spark whether they are small enough to send to every task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY_END = 1440
#: Sessions of a day, at most; more is no schedule but an error.
PAGE = 10_000
#: Fixed names of the stages of an item, in order.
STATUSES = ("planned", "footage", "selects", "cut", "review", "graded", "mixed", "delivered")


def first_match(rows: DataFrame, rules: DataFrame, condition: Callable[[dict[str, Column]], Column], order: str = "ord", most: int = 1000) -> DataFrame:
    """rows beside the first rule, in listed order, whose condition holds; nulls where none does.

    condition makes a column from a rule's values by name. A list of rules has `most` entries at most (more is an
    error) and becomes one conditional expression, so rows are neither joined nor shuffled.
    """
    listed = rules.orderBy(order).limit(most + 1).collect()
    if len(listed) > most:
        raise ValueError(f"over {most} rules")
    extra = [f for f in rules.schema.fields if f.name != order]
    value = lambda rule, f: F.lit(rule[f.name]).cast(f.dataType)
    found = F.lit(None).cast(T.StructType(extra))
    for rule in reversed(listed):
        holds = condition({f.name: value(rule, f) for f in rules.schema.fields})
        found = F.when(holds, F.struct(*[value(rule, f).alias(f.name) for f in extra])).otherwise(found)
    return rows.withColumn("_rule", found).select(*rows.columns, *[F.col("_rule")[f.name].alias(f.name) for f in extra])


def match_cameras(clips: DataFrame, cameras: DataFrame) -> DataFrame:
    """clips (id, path) with the columns of the first camera whose every condition holds; one without conditions
    never matches. cameras: ord, camera, prefix (of the id, any case), path_contains (any case), ..."""

    def fits(rule: dict[str, Column]) -> Column:
        has = rule["prefix"].isNotNull() | rule["path_contains"].isNotNull()
        begins = F.coalesce(F.upper("id").startswith(F.upper(rule["prefix"])), rule["prefix"].isNull())
        return has & begins & F.coalesce(F.lower("path").contains(F.lower(rule["path_contains"])), rule["path_contains"].isNull())

    return first_match(clips, cameras, fits)


def timecode_seconds(timecode: Column, fps: Column) -> Column:
    """HH:MM:SS:FF (or ;FF) as seconds; without a frame rate the frames are dropped; null for another shape."""
    parts = F.regexp_extract_all(timecode, F.lit(r"^\s*(\d{1,2}):(\d{2}):(\d{2})(?:[:;](\d{1,3}))?\s*$"), F.lit(0))
    at = lambda g: F.regexp_extract(timecode, r"^\s*(\d{1,2}):(\d{2}):(\d{2})(?:[:;](\d{1,3}))?\s*$", g)
    frames = F.when((fps > 0) & (at(4) != ""), F.try_to_number(at(4), F.lit("999")).cast("double") / fps).otherwise(0.0)
    whole = at(1).try_cast("int") * 3600 + at(2).try_cast("int") * 60 + at(3).try_cast("int")
    return F.when(F.size(parts) > 0, whole + F.coalesce(frames, F.lit(0.0)))


def true_start(creation: Column, timecode: Column, fps: Column, clock: Column, offset_s: Column, stamp: Column, duration_s: Column, zone: str) -> tuple[Column, Column]:
    """(wall-clock start as timestamp without zone, reason where there is none) by the camera's clock rule.

    creation_time_utc: without an offset it is UTC; converted to the zone. creation_time_local: an offset is dropped.
    timecode: the time of day, on the day out of three around the creation time that comes nearest to it. Then less
    the duration if the stamp is of the end, plus the camera's offset: all in wall-clock time.
    """
    label = r"(Z|[+-]\d{2}:?\d{2})$"
    bare = F.regexp_replace(creation, label, "").try_cast("timestamp_ntz")
    shift = F.regexp_extract(creation, label, 1)
    sign = F.when(shift.startswith("-"), -1).otherwise(1)
    digits = F.regexp_replace(shift, "[^0-9]", "")
    minutes = F.when(F.length(digits) == 4, sign * (F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int"))).otherwise(0)
    utc = F.timestamp_add("MINUTE", -minutes, bare)
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)
    seconds = timecode_seconds(timecode, fps)
    day = F.date_trunc("DAY", local).cast("timestamp_ntz")
    options = F.array(*[_add_seconds(_add_days(day, d), seconds) for d in (-1, 0, 1)])
    # the first of equals, as least of (distance, place)
    ranked = F.transform(options, lambda x, i: F.struct(F.abs(_seconds_between(x, local)).alias("d"), i.alias("i"), x.alias("x")))
    by_timecode = F.array_min(ranked)["x"]
    start = (
        F.when(clock == "creation_time_utc", local).when(clock == "creation_time_local", bare).when(clock == "timecode", by_timecode)
    )
    moved = _add_seconds(start, F.coalesce(offset_s, F.lit(0.0)) - F.when(stamp == "end", F.coalesce(duration_s, F.lit(0.0))).otherwise(0.0))
    reason = (
        F.when(creation.isNull(), "no creation time")
        .when(bare.isNull(), "creation time not readable")
        .when((clock == "timecode") & seconds.isNull(), "no readable timecode")
        .when(start.isNull(), "unknown clock rule")
    )
    return F.when(reason.isNull(), moved), reason


def _add_days(at: Column, days: int) -> Column:
    return F.timestamp_add("DAY", F.lit(days), at)


def _add_seconds(at: Column, seconds: Column) -> Column:
    return F.timestamp_add("MICROSECOND", F.round(seconds * 1_000_000).cast("long"), at)


def _seconds_between(a: Column, b: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", b, a) / 1_000_000


def minute_of_day(at: Column) -> Column:
    return F.hour(at) * 60 + F.minute(at) + F.extract(F.lit("SECOND"), at).cast("double") / 60


def _parallel(a: Column, b: Column) -> Column:
    """Both list cameras, and share none."""
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)


def session_windows(sessions: DataFrame) -> DataFrame:
    """sessions with start and end minute; a missing end is the next start that day of a session that could not run
    in parallel, or the day's end. Sessions without a start are left out."""
    a = sessions.where(F.col("start_min").isNotNull())
    # a day's sessions are a schedule's page: they go along with each session without an end
    page = a.groupBy("day").agg(F.count("*").alias("_n"))
    full = F.when(F.col("_n") > PAGE, F.raise_error(F.format_string("day %s has over %d sessions", F.col("day").cast("string"), F.lit(PAGE))).cast("boolean")).otherwise(True)
    days = a.join(page.where(full), "day").groupBy("day").agg(F.collect_list(F.struct(F.col("start_min").alias("s"), F.col("cameras").alias("cams"))).alias("_day"))
    apart = lambda x: F.coalesce(_parallel(F.col("cameras"), x["cams"]), F.lit(False))
    later = F.filter("_day", lambda x: (x["s"] > F.col("start_min")) & ~apart(x))
    open_ = a.where("end_min is null").join(days, "day").withColumn("end_min", F.coalesce(F.array_min(F.transform(later, lambda x: x["s"])), F.lit(DAY_END)))
    return a.where("end_min is not null").unionByName(open_.select(*a.columns))


def session_conflicts(windows: DataFrame) -> DataFrame:
    """Pairs a < b of sessions that overlap on a day and could not run in parallel."""
    side = lambda p: windows.select(*[F.col(c).alias(f"{p}{c}") for c in ("id", "day", "start_min", "end_min", "cameras")])
    pairs = side("a_").join(side("b_"), F.col("a_day") == F.col("b_day")).where("a_id < b_id and a_start_min < b_end_min and b_start_min < a_end_min")
    apart = F.coalesce(_parallel(F.col("a_cameras"), F.col("b_cameras")), F.lit(False))
    return pairs.where(~apart).select(F.col("a_day").alias("day"), "a_id", "b_id", F.greatest("a_start_min", "b_start_min").alias("from_min"), F.least("a_end_min", "b_end_min").alias("to_min"))


def assign(clips: DataFrame, windows: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """Each clip's session, or the reason why it has none.

    clips: id, camera (null: none matched), day, minute (null: no time, `why` may say so), duration_s. windows: id,
    day, start_min, end_min, cameras (empty: any). Reasons in order: no camera, no time, day not in the schedule,
    outside, ambiguous with the ids. A clip that runs on beyond its session's end `spans_boundary`; `ends_in` is the
    one other session that holds its end, if there is one.
    """
    any_camera = F.coalesce("cameras", F.array().cast("array<string>"))
    # a day's sessions go along with each clip of the day: one join, and no shuffle by clip
    per_day = windows.groupBy("day").agg(F.collect_list(F.struct(F.col("id").cast("string").alias("id"), F.col("start_min").alias("s"), F.col("end_min").alias("e"), any_camera.alias("cams"))).alias("_windows"))
    if days is not None:
        per_day = days.select("day").distinct().join(per_day, "day", "left")
    per_day = per_day.withColumn("_known", F.lit(True))
    end = F.least(F.col("minute") + F.coalesce("duration_s", F.lit(0.0)) / 60, F.lit(DAY_END - 1e-9))
    open_to = F.filter("_windows", lambda x: (F.size(x["cams"]) == 0) | F.array_contains(x["cams"], F.col("camera")))
    holding = lambda at: F.filter("_open", lambda x: (x["s"] <= at) & (at < x["e"]))
    ids = lambda some: F.array_sort(F.array_distinct(F.transform(some, lambda x: x["id"])))
    all_ = (
        clips.join(per_day, "day", "left")
        .withColumn("_open", F.coalesce(open_to, F.expr("filter(_windows, x -> false)")))
        .withColumns({"_hits": ids(holding(F.col("minute"))), "_ends": ids(holding(end)), "_until": F.array_max(F.transform(holding(F.col("minute")), lambda x: x["e"]))})
    )
    n = F.when(F.col("_hits").isNull(), 0).otherwise(F.size("_hits"))
    why = F.col("why") if "why" in clips.columns else F.lit(None).cast("string")
    reason = (
        F.when(F.col("camera").isNull(), "no camera")
        .when(F.col("minute").isNull(), F.coalesce(why, F.lit("no time")))
        .when(F.col("_known").isNull(), "day not in the schedule")
        .when(n == 0, "outside every session")
        .when(n > 1, F.concat(F.lit("ambiguous: "), F.array_join("_hits", ", ")))
    )
    session = F.when(reason.isNull(), F.get("_hits", F.lit(0)))
    others = F.array_except("_ends", "_hits")
    beyond = F.when(reason.isNull(), F.col("minute") + F.coalesce("duration_s", F.lit(0.0)) / 60 > F.col("_until"))
    return all_.select(
        *clips.columns, session.alias("session"), reason.alias("reason"), beyond.alias("spans_boundary"),
        F.when(beyond & (F.size(others) == 1), F.get(others, F.lit(0))).alias("ends_in"),
    )


def clock_table(clips: DataFrame, windows: DataFrame) -> DataFrame:
    """Per camera and date: clips, first and last minute, and how many lie before the day's first session or after
    its last. Clips without camera or time are counted under a label."""
    span = windows.groupBy("day").agg(F.min("start_min").alias("_first"), F.max("end_min").alias("_last"))
    whole = F.floor("minute")
    each = clips.join(span, "day", "left").select(
        F.coalesce("camera", F.lit("(no camera)")).alias("camera"),
        F.when(F.col("camera").isNull(), "(not read)").when(F.col("minute").isNull(), "(no time)").otherwise(F.col("day").cast("string")).alias("date"),
        F.when(F.col("camera").isNotNull(), F.col("minute")).alias("_m"),
        F.when(F.col("camera").isNotNull() & (whole < F.col("_first")), 1).otherwise(0).alias("_early"),
        F.when(F.col("camera").isNotNull() & (whole >= F.col("_last")), 1).otherwise(0).alias("_late"),
    )
    return each.groupBy("camera", "date").agg(
        F.count("*").alias("clips"), F.min("_m").alias("first"), F.max("_m").alias("last"), F.sum("_early").alias("early"), F.sum("_late").alias("late")
    )


def session_counts(windows: DataFrame, assigned: DataFrame) -> DataFrame:
    """Clips and minutes of every session, those without any too."""
    n = assigned.where("session is not null").groupBy(F.col("session").alias("id")).agg(F.count("*").alias("clips"), (F.sum("duration_s") / 60).alias("minutes"))
    return windows.join(n, "id", "left").select("id", F.coalesce("clips", F.lit(0)).alias("clips"), F.coalesce("minutes", F.lit(0.0)).alias("minutes"))


def unassigned_reasons(assigned: DataFrame, shown: int = 12) -> DataFrame:
    """Reasons (what follows a colon left out) by count, with the first ids in order. Only the shown ids are kept
    of any group: each task ranks its own before they meet."""
    kind = F.split("reason", ":")[0]
    rows = assigned.where("reason is not null").select(kind.alias("reason"), "id")
    counts = rows.groupBy("reason").agg(F.count("*").alias("clips"))
    w = Window.partitionBy("reason").orderBy("id")
    first = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= shown).groupBy("reason").agg(F.array_join(F.array_sort(F.collect_list("id")), ", ").alias("ids"))
    return counts.join(first, "reason").orderBy(F.desc("clips"), "reason")


def status_rows(items: DataFrame, types: DataFrame, statuses: Sequence[str] = STATUSES) -> DataFrame:
    """Per type: target, listed items and one column for each status; a last row `total` sums all."""
    counts = items.groupBy("type").agg(F.count("*").alias("listed"), *[F.count_if(F.col("status") == s).alias(s) for s in statuses])
    names = ["listed", *statuses]
    each = types.select(F.col("id").alias("type"), F.col("count").alias("target")).join(counts, "type", "left").na.fill(0, names)
    total = each.agg(F.lit("total").alias("type"), *[F.sum(c).alias(c) for c in ["target", *names]])
    return each.unionByName(total)


def evidence_gaps(items: DataFrame, facts: DataFrame) -> DataFrame:
    """What a claimed status needs and an item does not have. facts: id, has_cut, has_render, masters (the delivery
    verdicts of its masters). A null status is planned."""
    stage = F.array(*[F.lit(s) for s in STATUSES])
    status = F.coalesce("status", F.lit(STATUSES[0]))
    reached = lambda s: F.array_position(stage, status) >= STATUSES.index(s) + 1
    claim = lambda text: F.concat(status, F.lit(": "), text)
    masters = F.coalesce("masters", F.array().cast("array<string>"))
    heard = F.when(F.size(masters) == 0, "no master with a verdict").otherwise(F.concat(F.lit("loudness "), F.array_join(F.array_sort(F.array_distinct(masters)), ", ")))
    gaps = F.array(
        F.when(reached("cut") & ~F.coalesce("has_cut", F.lit(False)), claim(F.lit("no cut"))),
        F.when(reached("review") & ~F.coalesce("has_render", F.lit(False)), claim(F.lit("no render"))),
        F.when(reached("delivered") & ~F.array_contains(masters, "honoured"), claim(heard)),
    )
    return items.join(facts, "id", "left").select("id", status.alias("status"), F.array_compact(gaps).alias("gaps"))


def feeders(sessions: DataFrame) -> DataFrame:
    """Sessions that feed each deliverable type, by the session's list or any of its capture lines'."""
    own = sessions.select("id", F.explode("feeds").alias("type"))
    lines = sessions.select("id", F.explode("capture").alias("c")).select("id", F.explode("c.feeds").alias("type"))
    return own.union(lines).distinct().groupBy("type").agg(F.array_sort(F.collect_list("id")).alias("sessions"))


def candidates(assigned: DataFrame, sessions: DataFrame, operator: str = "operator") -> DataFrame:
    """Feeds and registers open to each assigned clip: its operator's own capture lines if those have any, else the
    session's; registers only for cover footage."""
    s = sessions.select(F.col("id").alias("session"), "feeds", "registers", "capture")
    joined = assigned.join(s, "session", "left")
    mine = F.filter("capture", lambda c: c["operator"] == F.col(operator))
    empty = F.array().cast("array<string>")
    pick = lambda f: F.coalesce(F.when(F.size(F.flatten(F.transform(mine, lambda c: c[f]))) > 0, F.array_distinct(F.flatten(F.transform(mine, lambda c: c[f])))), F.col(f), empty)
    return joined.select(*assigned.columns, pick("feeds").alias("feeds"), F.when(F.col("role") == "broll", pick("registers")).otherwise(empty).alias("registers"))


def stubs(items: DataFrame, types: DataFrame, width: int = 2) -> DataFrame:
    """Ids of items still missing from each type's target: the smallest free numbers, zero-padded."""
    listed = items.groupBy("type").agg(F.count("*").alias("n"))
    number = F.regexp_extract("id", r"(\d+)$", 1).try_cast("int")
    used = items.select("type", number.alias("k")).where("k is not null").distinct()
    want = types.select(F.col("id").alias("type"), F.col("count").alias("target")).join(listed, "type", "left").na.fill(0, ["n"]).where("target > n")
    free = want.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("target") + F.col("n")))).join(used, ["type", "k"], "left_anti")
    place = F.row_number().over(Window.partitionBy("type").orderBy("k"))
    chosen = free.withColumn("_r", place).where(F.col("_r") <= F.col("target") - F.col("n"))
    digits = F.greatest(F.lit(width), F.length(F.col("k").cast("string")))
    return chosen.select("type", F.concat("type", F.lit("-"), F.lpad(F.col("k").cast("string"), digits, F.lit("0"))).alias("id"))


def plan_bins(assigned: DataFrame, sessions: DataFrame, placed: DataFrame) -> DataFrame:
    """Where each clip belongs and whether it has to move. placed: id, bin. `action`: ok, move, unassigned, unknown."""
    s = sessions.select(F.col("id").alias("session"), F.col("day"), F.concat(F.col("day").cast("string"), F.lit("/"), F.regexp_replace("id", "[/\\\\]", "-")).alias("target"))
    have = placed.join(assigned.select("id", "session"), "id", "full").withColumn("known", F.lit(True))
    out = have.join(s, "session", "left")
    listed = assigned.select(F.col("id").alias("_id")).distinct()
    out = out.join(listed, F.col("id") == F.col("_id"), "left")
    action = F.when(F.col("_id").isNull(), "unknown").when(F.col("session").isNull(), "unassigned").when(F.col("bin").eqNullSafe(F.col("target")), "ok").otherwise("move")
    return out.select("id", "bin", "target", action.alias("action"))


def validate(days: DataFrame, cameras: DataFrame, people: DataFrame, registers: DataFrame, sessions: DataFrame, types: DataFrame, items: DataFrame) -> DataFrame:
    """Every fault of a schedule as (path, message): missing and repeated ids, unknown references and values."""
    found: list[DataFrame] = []

    def report(rows: DataFrame, path: Column, message: Column) -> None:
        found.append(rows.select(path.alias("path"), message.alias("message")))

    for table, df, key in (("days", days, "day"), ("cameras", cameras, "camera"), ("sessions", sessions, "id"), ("deliverable_types", types, "id"), ("items", items, "id")):
        at = F.concat(F.lit(f"{table}."), F.coalesce(F.col(key).cast("string"), F.lit("?")))
        report(df.where(F.col(key).isNull()), at, F.lit("has no id"))
        report(df.groupBy(key).count().where("count > 1"), at, F.format_string("is listed %d times", "count"))
    s = F.concat(F.lit("sessions."), F.col("id"))
    report(sessions.join(days.select("day").distinct(), "day", "left_anti"), s, F.concat(F.lit("unknown day "), F.coalesce(F.col("day").cast("string"), F.lit("?"))))
    report(sessions.where("start_min is null"), s, F.lit("has no readable start"))
    report(sessions.where("end_min <= start_min"), s, F.lit("ends before it starts"))
    report(sessions.where(f"end_min > {DAY_END} or start_min < 0"), s, F.lit("leaves the day"))
    references = [
        (sessions, "cameras", cameras.select(F.col("camera").alias("ref")), "camera"), (sessions, "registers", registers.select(F.col("id").alias("ref")), "register"),
        (sessions, "feeds", types.select(F.col("id").alias("ref")), "deliverable type"), (items, "people", people.select(F.col("id").alias("ref")), "person"),
        (items, "sessions", sessions.select(F.col("id").alias("ref")), "session"),
    ]
    for df, column, known, word in references:
        table = "sessions" if df is sessions else "items"
        each = df.select("id", F.explode(column).alias("ref")).join(known.distinct(), "ref", "left_anti")
        report(each, F.concat(F.lit(f"{table}."), F.col("id"), F.lit(f".{column}")), F.concat(F.lit(f"unknown {word} "), F.coalesce("ref", F.lit("?"))))
    lines = sessions.select("id", F.explode("capture").alias("c"))
    for column, known, word in (("feeds", types.select(F.col("id").alias("ref")), "deliverable type"), ("registers", registers.select(F.col("id").alias("ref")), "register")):
        each = lines.select("id", F.explode(F.col("c")[column]).alias("ref")).join(known.distinct(), "ref", "left_anti")
        report(each, F.concat(F.lit("sessions."), F.col("id"), F.lit(f".capture.{column}")), F.concat(F.lit(f"unknown {word} "), F.coalesce("ref", F.lit("?"))))
    report(lines.join(people.select(F.col("id").alias("_o")), F.col("c.operator") == F.col("_o"), "left_anti").where("c.operator is not null"), F.concat(F.lit("sessions."), F.col("id"), F.lit(".capture")), F.concat(F.lit("unknown operator "), F.col("c.operator")))
    report(items.join(types.select(F.col("id").alias("type")).distinct(), "type", "left_anti"), F.concat(F.lit("items."), F.col("id"), F.lit(".type")), F.concat(F.lit("unknown deliverable type "), F.coalesce("type", F.lit("?"))))
    report(items.where(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False))), F.concat(F.lit("items."), F.col("id"), F.lit(".status")), F.concat(F.lit("unknown status "), F.coalesce("status", F.lit("?"))))
    report(cameras.where(~F.coalesce(F.col("clock").isin("creation_time_utc", "creation_time_local", "timecode"), F.lit(False))), F.concat(F.lit("cameras."), F.col("camera"), F.lit(".clock")), F.concat(F.lit("unknown clock rule "), F.coalesce("clock", F.lit("?"))))
    report(cameras.where("prefix is null and path_contains is null"), F.concat(F.lit("cameras."), F.col("camera")), F.lit("has no condition and can match nothing"))
    report(types.where("count < 0 or count is null"), F.concat(F.lit("deliverable_types."), F.col("id"), F.lit(".count")), F.lit("is not a count"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out
