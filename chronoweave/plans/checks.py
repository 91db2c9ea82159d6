"""Queries on verdicts, names, frames, trims and look-ups between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoweave.operators import choose, cuts, evidence, schedule, series, talk, textops, verdicts
from chronoweave.session import table
from chronoweave.sources import documents

from .common import SQL_EVENTS, collector, events

QUERIES, ORACLES, query = collector()
DAY = 86_400_000_000


@query(f"""WITH {SQL_EVENTS}, p AS (SELECT *, CASE WHEN event_id % 13 <> 0 THEN value / 100 END AS a, (event_id % 97) / 100.0 AS b FROM e)
SELECT event_id, CASE WHEN a IS NOT NULL AND greatest(a, b) > 0 THEN round(-1 - 20 * log10(greatest(a, b)), 6) END AS gain,
  CASE WHEN a IS NOT NULL AND greatest(a, b) > 0 THEN CASE WHEN a >= b THEN 'talk sample peak' ELSE 'resampled peak (inter-sample overshoot) above the sample peak' END END AS why FROM p""")
def peak_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values as a talk's peak, a number of the event as the resampled one; one in thirteen was not measured."""
    a, b = F.when(F.col("event_id") % 13 != 0, F.col("value") / 100), (F.col("event_id") % 97) / 100
    return events(spark, sf_dir).select("event_id", F.round(verdicts.peak_gain(a, b), 6).alias("gain"), verdicts.peak_gain_reason(a, b).alias("why"))


@query(f"""WITH {SQL_EVENTS} SELECT event_id, CASE WHEN value / 4000 < 0.002 THEN 'static' WHEN value / 4000 < 0.008 THEN 'gentle' WHEN value / 4000 < 0.02 THEN 'moderate' ELSE 'energetic' END || ' movement, ' ||
  CASE WHEN (event_id % 10) / 10.0 > 0.6 THEN 'camera moves with the scene' ELSE 'camera mostly still' END AS gloss FROM e""")
def motion_glosses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", verdicts.motion_gloss(F.col("value") / 4000, (F.col("event_id") % 10) / 10).alias("gloss"))


@query(f"""WITH {SQL_EVENTS} SELECT event_id, CASE event_id % 4 WHEN 0 THEN 24000.0 / 1001 WHEN 1 THEN 25.0 WHEN 2 THEN NULL ELSE 50.0 END AS fps,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(event_id % 24 AS DOUBLE) * 3600 + event_id % 60 * 60 + event_id % 50 + CASE event_id % 4 WHEN 0 THEN (event_id % 20) / (24000.0 / 1001) WHEN 1 THEN (event_id % 20) / 25.0 WHEN 2 THEN 0 ELSE (event_id % 20) / 50.0 END END AS seconds FROM e""")
def frame_clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame rates written as fractions and timecodes in frames; one in seven timecodes has another shape."""
    e = F.col("event_id")
    rate = verdicts.frame_rate(F.when(e % 4 == 0, "24000/1001").when(e % 4 == 1, "25").when(e % 4 == 2, "30/0").otherwise("50/"))
    code = F.when(e % 7 == 0, "soon").otherwise(F.format_string("%02d:%02d:%02d;%02d", e % 24, e % 60, e % 50, e % 20))
    return events(spark, sf_dir).select("event_id", rate.alias("fps"), schedule.timecode_seconds(code, rate).alias("seconds"))


@query(f"""WITH {SQL_EVENTS} SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'verified' WHEN value / 100 > 0.5 AND (event_id % 10) / 10.0 > 0.3 THEN 'strong' WHEN value IS NULL OR value / 100 < 0.25 THEN 'no coverage' ELSE 'ambiguous' END AS sync,
  CAST(CASE WHEN event_id % 3 = 0 AND event_id % 6 < 4 THEN event_id % 6 ELSE -1 END AS INT) AS score,
  CASE WHEN event_id % 5 = 0 THEN 'cannot tell' WHEN event_id % 3 < 2 THEN 'agrees' WHEN value / 100 >= 0.15 THEN 'disagrees' ELSE 'cannot tell' END AS species FROM e""")
def strict_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sync, strictly written scores and species: a name agrees by its genus, and only a sure other one disagrees."""
    e, v = F.col("event_id"), F.col("value") / 100
    sync = verdicts.sync_verdict(F.when(e % 7 == 0, F.lit(True)), v, (e % 10) / 10)
    score = verdicts.strict_score(F.when(e % 3 == 0, (e % 6).cast("string")).otherwise(F.concat((e % 6).cast("string"), F.lit(" of 3"))))
    named = F.when(e % 3 == 0, "Parus major").when(e % 3 == 1, "larus canus").otherwise("Corvus corax")
    seen = F.array(F.struct(F.lit("Parus ater").alias("name"), v.alias("score")), F.struct(F.lit("Larus fuscus").alias("name"), F.lit(0.1).alias("score")))
    return events(spark, sf_dir).select("event_id", sync.alias("sync"), F.coalesce(score, F.lit(-1)).alias("score"), verdicts.species_verdict(named, F.when(e % 5 != 0, seen)).alias("species"))


@query(f"""WITH {SQL_EVENTS}, r AS (SELECT event_id, list_filter([CASE WHEN event_id % 17 = 0 OR (event_id % 100) / 100.0 < 0.9 THEN 'direction' END, CASE WHEN (event_id % 40) / 100.0 > 0.25 THEN 'dip' END,
  CASE WHEN (event_id % 30) / 10.0 > 2 THEN 'shake' END, CASE WHEN (event_id % 50) / 100.0 > 0.2 THEN 'unreliable' END, CASE WHEN (event_id % 60) / 10.0 < 3 THEN printf('%.1f s long', (event_id % 60) / 10.0) END], lambda x: x IS NOT NULL) AS why FROM e)
SELECT event_id, array_to_string(why, ',') AS why, len(list_filter(why, lambda x: x NOT LIKE '% s long')) = 0 AS but_for_length FROM r""")
def clean_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a move is not clean; an unmeasured direction is a reason."""
    e = F.col("event_id")
    why = series.clean_reasons(F.when(e % 17 != 0, (e % 100) / 100), (e % 40) / 100, (e % 30) / 10, (e % 50) / 100, (e % 60) / 10)
    return events(spark, sf_dir).select("event_id", F.array_join(why, ",").alias("why"), series.clean_except_length(why).alias("but_for_length"))


@query(f"""WITH {SQL_EVENTS}, o AS (SELECT event_id, list_filter(range(event_id % 9), lambda t: event_id % 4 = 0 OR (t >= 1 AND t < 1 + event_id % 7)) AS o FROM e)
SELECT event_id, array_to_string(list_transform(list_sort(list_distinct(list_transform(CASE WHEN len(o) > 0 THEN range(4) ELSE [] END, lambda i: CAST(round(i * (len(o) - 1) / 3.0) AS INT)))), lambda k: o[k + 1]), ',') AS frames FROM o""")
def steady_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most four frames of a source, spread over its steady parts."""
    e = F.col("event_id")
    n = (e % 9).cast("int")
    times = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: i.cast("double"))).otherwise(F.array().cast("array<double>"))
    runs = F.when(e % 4 != 0, F.array(F.struct(F.lit(1.0).alias("t0"), (1 + e % 7).cast("double").alias("t1"))))
    return events(spark, sf_dir).select("event_id", F.array_join(F.transform(verdicts.steady_picks(times, runs), lambda i: i.cast("string")), ",").alias("frames"))


@query("""SELECT l_orderkey AS film, ord, CAST(1 + (ord - 1) % 2 AS INT) AS track, CAST(sum(q + 24) OVER (PARTITION BY l_orderkey ORDER BY ord) - q - 24 AS BIGINT) AS rec FROM (
  SELECT l_orderkey, CAST(l_quantity AS BIGINT) AS q, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INT) AS ord FROM lineitem)""")
def selects_on_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as selects, one behind the other on two tracks in turn."""
    l = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = l.select(F.col("l_orderkey").alias("film"), F.col("l_quantity").cast("long").alias("dur"), F.row_number().over(w).alias("ord"))
    laid = cuts.alternate_tracks(cuts.selects_timeline(rows, ["film"], ["ord"]), ["film"], ["ord"])
    return laid.select("film", "ord", F.col("track").cast("int").alias("track"), F.col("rec").cast("long").alias("rec"))


@query(f"""WITH {SQL_EVENTS}, t AS (SELECT event_id AS ord, user_id, event_type AS grade, CASE WHEN event_id % 100 <> 0 THEN us - {DAY} END AS t0, us + {DAY} AS t1 FROM e WHERE event_id % 50 = 0)
SELECT e.event_id AS item, min_by(grade, ord) AS grade FROM e LEFT JOIN t ON t.user_id = e.user_id AND (t0 IS NULL OR (t1 > us AND t0 < until)) GROUP BY 1""")
def grade_trims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the first trim of its user that meets it; trims without a span meet all."""
    e = events(spark, sf_dir)
    items = e.select(F.col("event_id").alias("item"), F.col("user_id").alias("clip"), F.col("us").alias("src_t0"), F.col("until").alias("src_t1"))
    trims = e.where("event_id % 50 = 0").select(F.col("event_id").alias("ord"), F.col("user_id").alias("clip"), F.col("event_type").alias("grade"), F.when(F.col("event_id") % 100 != 0, F.col("us") - DAY).alias("t0"), (F.col("us") + DAY).alias("t1"))
    return cuts.trim_for(items, trims).select("item", "grade")


@query(f"""WITH {SQL_EVENTS}, p AS (SELECT event_id AS pick, user_id, us / 1e6 AS a, until / 1e6 AS b FROM e WHERE event_id % 10 = 0)
SELECT event_id, event_id % 10 AS pick FROM e WHERE event_id % 2 = 0
UNION ALL SELECT e.event_id, p.pick FROM e JOIN p ON p.user_id = e.user_id AND least(until / 1e6, b) - greatest(us / 1e6, a) > 0.2 WHERE event_id % 2 = 1""")
def stretches_under_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches with a key keep it; the others get every pick of their user with which they share a fifth of a second."""
    e = events(spark, sf_dir).withColumns({"t0": F.col("us") / 1e6, "t1": F.col("until") / 1e6})
    stretches = e.select("event_id", F.col("user_id").alias("beat"), "t0", "t1", F.when(F.col("event_id") % 2 == 0, F.col("event_id") % 10).alias("pick"))
    picks = e.where("event_id % 10 = 0").select(F.col("event_id").alias("pick"), F.col("user_id").alias("beat"), "t0", "t1")
    return evidence.stretch_picks(stretches, picks).select("event_id", "pick")


@query(f"""WITH {SQL_EVENTS}, p AS (SELECT event_id AS pick, user_id, us / 1e6 AS a, us / 1e6 + 21600 AS b FROM e WHERE event_id % 25 = 0)
SELECT pick, e.event_id AS word, (us / 1e6 + until / 1e6) / 2 BETWEEN a - 0.05 AND b + 0.05 AND NOT (us / 1e6 >= a - 0.05 AND until / 1e6 <= b + 0.05) AS by_middle_only FROM p JOIN e ON e.user_id = p.user_id AND (us / 1e6 + until / 1e6) / 2 BETWEEN a - 0.05 AND b + 0.05""")
def words_of_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as words under six-hour picks: those whose middle lies inside, and whether all of the word does."""
    e = events(spark, sf_dir)
    words = e.select("user_id", F.col("event_id").alias("w"), (F.col("us") / 1e6).alias("s"), (F.col("until") / 1e6).alias("e"))
    picks = e.where("event_id % 25 = 0").select("user_id", F.col("event_id").alias("pick"), (F.col("us") / 1e6).alias("in_s"), (F.col("us") / 1e6 + 21600).alias("out_s"))
    found = evidence.words_kept(words, picks, ["user_id"], middle=True, width=21600.0, inside="whole")
    return found.select("pick", F.col("w").alias("word"), (~F.col("whole")).alias("by_middle_only"))


@query(f"""WITH {SQL_EVENTS}, d AS (SELECT *, us // {DAY} AS day FROM e), s AS (SELECT DISTINCT event_type, day, event_type || '-' || day AS session, CASE WHEN event_type IN ('view', 'click') THEN 'a' ELSE 'b' END AS side FROM d),
c AS (SELECT event_id AS clip, CASE WHEN event_id % 9 = 0 THEN NULL ELSE day END AS own, day FROM d WHERE event_id % 3 = 0),
r AS (SELECT clip, session, side, own, s.day, ((clip * 31 + s.day * 7 + length(event_type) * 13) % 101) / 100.0 AS r FROM c JOIN s ON s.day BETWEEN c.day AND c.day + 1),
h AS (SELECT *, bool_or(own = day) OVER (PARTITION BY clip) AS has FROM r)
SELECT clip, side, max_by(session, (r, session)) AS session, max(r) AS r FROM h WHERE own = day OR NOT coalesce(has, false) GROUP BY clip, side""")
def sessions_of_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best session of each side among those of a clip's day, or among all where the day is not known."""
    d = events(spark, sf_dir).withColumn("day", F.floor(F.col("us") / DAY))
    side = F.when(F.col("event_type").isin("view", "click"), "a").otherwise("b")
    s = d.select("event_type", "day").distinct().select("event_type", "day", F.concat("event_type", F.lit("-"), F.col("day").cast("string")).alias("session"), side.alias("side"))
    c = d.where("event_id % 3 = 0").select(F.col("event_id").alias("clip"), F.when(F.col("event_id") % 9 != 0, F.col("day")).alias("own"), F.explode(F.sequence("day", F.col("day") + 1)).alias("day"))
    scores = c.join(s, "day").select("clip", "session", (((F.col("clip") * 31 + F.col("day") * 7 + F.length("event_type") * 13) % 101) / 100).alias("r"), F.lit(0).alias("lag"), F.lit(0.0).alias("margin"))
    found = evidence.best_sessions(c.select("clip", F.col("own").alias("day")).distinct(), s.select("session", "side", "day"), scores)
    return found.select("clip", "side", "session", "r")


@query(f"""WITH {SQL_EVENTS}, s AS (SELECT event_id // 3 AS pick, user_id AS clip, event_id % 2 = 0 AS video, event_id % 4 AS score, CASE WHEN event_id % 5 = 0 THEN 'shaky' ELSE 'none' END AS technical FROM e),
b AS (SELECT DISTINCT clip FROM s WHERE score = 0 AND technical = 'shaky')
SELECT pick, clip, count(*) = 1 AND max(score) = 3 AND bool_and(video) AS keep, min(score) <= 1 AS bad, clip IN (SELECT clip FROM b) AS barred FROM s GROUP BY pick, clip""")
def scorecard_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    s = events(spark, sf_dir).select(F.floor(e / 3).alias("pick"), F.col("user_id").alias("clip"), F.when(e % 2 == 0, "video").otherwise("bare").alias("kind"), (e % 4).cast("int").alias("score"), F.when(e % 5 == 0, "shaky").otherwise("none").alias("technical"))
    return choose.feedback(s)


@query(f"""WITH {SQL_EVENTS}, c AS (SELECT user_id, event_id, us, event_id % 3 + event_id % 4 AS score, least(value, CASE WHEN event_id % 5 = 0 THEN 0 ELSE value / 2 END) AS room FROM e WHERE event_id % 7 <> 0)
SELECT user_id, event_id AS id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, room DESC, us, event_id) AS INT) AS rank FROM c""")
def ranked_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of a microsecond each, so that none overlaps another, by score and room."""
    e = F.col("event_id")
    c = events(spark, sf_dir).select(
        "user_id", e.alias("id"), F.col("us").alias("t0"), (F.col("us") + 1).alias("t1"), F.when(e % 7 != 0, "ok").otherwise("unchecked").alias("verdict_status"),
        (e % 3).alias("standalone"), (e % 4).alias("strength"), F.col("value").alias("head_room"), F.when(e % 5 != 0, F.col("value") / 2).alias("tail_room"),
    )
    return choose.rank_candidates(c, ["user_id"]).select("user_id", "id", "rank")


@query("""WITH u AS (SELECT page_id AS shot_id, CASE WHEN page_id % 3 = 0 AND page_id > 0 THEN page_id // 3 END AS parent FROM pages)
SELECT shot_id, coalesce(parent, -1) AS parent, parent IS NOT NULL AND parent NOT IN (SELECT shot_id FROM u WHERE parent IS NULL) AS orphan FROM u""")
def unit_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as takes, every third as a window of an earlier page; a window of a window has no take."""
    p = table(spark, sf_dir, "pages")
    window = (F.col("page_id") % 3 == 0) & (F.col("page_id") > 0)
    shots = p.where(~window).select(F.col("page_id").alias("shot_id"))
    windows = p.where(window).select(F.col("page_id").alias("shot_id"), F.floor(F.col("page_id") / 3).alias("parent_shot_id"))
    orphans = evidence.orphan_windows(shots, windows).select("shot_id", F.lit(True).alias("orphan"))
    units = evidence.units(shots, windows).join(orphans, "shot_id", "left")
    return units.select("shot_id", F.coalesce("parent_shot_id", F.lit(-1)).alias("parent"), F.coalesce("orphan", F.lit(False)).alias("orphan"))


@query("""WITH n AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'A' || page_id || '_s' || page_id % 7 || '_w' || page_id % 5 WHEN 1 THEN 'A' || page_id || '_w' || page_id % 5 WHEN 2 THEN 'DJI_' || page_id ELSE 'A' || page_id || '_s' || page_id % 7 END AS unit FROM pages)
SELECT page_id, split_part(split_part(unit, '_w', 1), '_s', 1) AS clip, regexp_replace(unit, '_[ws][0-9]+$', '') AS source, split_part(unit, '_w', 1) AS take FROM n""")
def unit_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of the names of units: the clip, the unit above, the take of a window."""
    i = F.col("page_id")
    text = lambda c: c.cast("string")
    a, s, w = F.concat(F.lit("A"), text(i)), F.concat(F.lit("_s"), text(i % 7)), F.concat(F.lit("_w"), text(i % 5))
    unit = F.when(i % 4 == 0, F.concat(a, s, w)).when(i % 4 == 1, F.concat(a, w)).when(i % 4 == 2, F.concat(F.lit("DJI_"), text(i))).otherwise(F.concat(a, s))
    return table(spark, sf_dir, "pages").select("page_id", textops.base_clip(unit).alias("clip"), textops.source_of(unit).alias("source"), textops.window_source(unit).alias("take"))


@query(f"""WITH {SQL_EVENTS}, f AS (SELECT user_id, event_id % 600 AS i, value AS db FROM e), w AS (SELECT DISTINCT user_id, event_id % 60 AS s FROM e WHERE event_id % 5 = 0),
s AS (SELECT DISTINCT user_id, event_id % 3 AS n, event_id % 3 * 20.0 AS t0, event_id % 3 * 20.0 + 20 AS t1 FROM e),
floor AS (SELECT user_id, quantile_cont(db, 0.1) AS floor FROM f GROUP BY 1),
speech AS (SELECT user_id, quantile_cont(db, 0.9) AS speech FROM (SELECT DISTINCT f.user_id, i, db FROM f JOIN w ON w.user_id = f.user_id AND i / 10.0 >= w.s AND i / 10.0 < w.s + 1) GROUP BY 1),
level AS (SELECT s.user_id, s.n, CAST(round(CAST(quantile_cont(db, 0.9) AS DECIMAL(18, 6)), 1) AS DOUBLE) AS level FROM s JOIN f ON f.user_id = s.user_id AND i / 10.0 >= t0 AND i / 10.0 < t1 GROUP BY 1, 2),
a AS (SELECT s.user_id, s.n, level, floor, speech FROM s LEFT JOIN level USING (user_id, n) LEFT JOIN floor USING (user_id) LEFT JOIN speech USING (user_id)),
m AS (SELECT user_id, quantile_cont(level, 0.5) AS wearer FROM a GROUP BY 1)
SELECT a.user_id, CAST(n AS BIGINT) AS n, round(coalesce(level, -1), 4) AS level, round(coalesce(floor, -1), 4) AS floor, round(coalesce(speech, -1), 4) AS speech, coalesce(round(wearer - level, 6) >= 10, false) AS off_mic FROM a LEFT JOIN m USING (user_id)""")
def talk_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values as levels of a user's minute, ten a second; words of a second, sentences of twenty."""
    e, i = events(spark, sf_dir), F.col("event_id")
    frames = e.select("user_id", (i % 600).alias("i"), F.col("value").alias("db"))
    words = e.where(i % 5 == 0).select("user_id", (i % 60).cast("double").alias("s")).distinct().withColumn("e", F.col("s") + 1)
    sentences = e.select("user_id", (i % 3).alias("n")).distinct().withColumns({"t0": F.col("n") * 20.0, "t1": F.col("n") * 20.0 + 20})
    found = talk.measure(sentences, frames, words, ["user_id"], rate=10)
    known = lambda c: F.round(F.coalesce(c, F.lit(-1.0)), 4).alias(c)
    return found.select("user_id", "n", known("level"), known("floor"), known("speech"), F.coalesce("off_mic", F.lit(False)).alias("off_mic"))


@query("""WITH l AS (SELECT l_orderkey AS doc, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS INT) AS i, l_partkey AS p, l_suppkey AS s FROM lineitem),
x AS (SELECT *, 'sessions[' || i || ']' AS w FROM l)
SELECT doc, w || '.day' AS path, chr(39) || 'd' || p % 4 || chr(39) || ' is not a known day' AS what FROM x WHERE p % 4 = 3
UNION ALL SELECT doc, w || '.start', chr(39) || s % 30 || ':00' || chr(39) || ' is no time (HH:MM)' FROM x WHERE s % 30 >= 24
UNION ALL SELECT doc, w || '.end', chr(39) || '12:00' || chr(39) || ' does not come after' FROM x WHERE s % 30 >= 12
UNION ALL SELECT doc, w || '.cameras[0]', chr(39) || 'c' || p % 5 || chr(39) || ' is not a known camera name' FROM x WHERE p % 5 > 2
UNION ALL SELECT doc, w || '.mood', 'is an unknown key' FROM x WHERE p % 17 = 0
UNION ALL SELECT doc, w || '.id', 'is required' FROM x WHERE s % 13 = 0
UNION ALL SELECT doc, w || '.id', chr(39) || 's' || p % 2 || chr(39) || ' is listed more than once' FROM (SELECT *, count(*) OVER (PARTITION BY doc, p % 2) AS n FROM x WHERE s % 13 <> 0) WHERE n > 1""")
def document_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as schedule documents, lines as their sessions with faults of many kinds; every fault by its path."""
    l = table(spark, sf_dir, "lineitem")
    i = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    text = lambda a, c: F.concat(F.lit(a), c.cast("string"))
    session = F.struct(
        F.when(s % 13 != 0, text("s", p % 2)).alias("id"), text("d", p % 4).alias("day"), F.concat((s % 30).cast("string"), F.lit(":00")).alias("start"), F.lit("12:00").alias("end"),
        F.array(text("c", p % 5)).alias("cameras"), F.when(p % 17 == 0, 1).alias("mood"),
    )
    rows = l.withColumn("i", i).groupBy(F.col("l_orderkey").alias("doc")).agg(F.sort_array(F.collect_list(F.struct("i", session.alias("s")))).alias("s"))
    camera = lambda n: F.struct(F.lit(n).alias("name"), F.lit("X").alias("prefix"))
    days = F.struct(*[F.lit("2026-05-01").alias(f"d{k}") for k in range(3)])
    doc = F.struct(F.lit("p").alias("project"), days.alias("days"), F.array(*[camera(f"c{k}") for k in range(3)]).alias("cameras"), F.transform("s", lambda x: x["s"]).alias("sessions"))
    return documents.faults(rows.select("doc", F.to_json(doc).alias("text")), documents.SCHEDULE)
