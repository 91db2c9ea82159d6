"""Queries on intervals, series and schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoweave.operators import intervals, schedule, series
from chronoweave.session import table
from chronoweave.sources import tables

from .common import HOUR, SQL_EVENTS, collector, events

QUERIES, ORACLES, query = collector()

# schedules

#: id, start and end minute, cameras (empty: any) of every day's sessions.
SESSIONS = [
    ("dawn", 0, 360, []), ("morning", 360, 720, []), ("noon-a", 660, 840, ["cam0", "cam1"]), ("noon-b", 660, 840, ["cam2", "cam3"]),
    ("evening", 1020, 1320, []), ("late", 1260, None, []),
]
SQL_SESSIONS = """s(id, s, e, cams) AS (VALUES ('dawn', 0, 360, []), ('morning', 360, 720, []),
  ('noon-a', 660, 840, ['cam0', 'cam1']), ('noon-b', 660, 840, ['cam2', 'cam3']),
  ('evening', 1020, 1320, []), ('late', 1260, 1440, []))"""


def daily_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sessions of every day on which something happened."""
    rows = F.array(*[
        F.struct(F.lit(i).alias("id"), F.lit(a).cast("int").alias("start_min"), F.lit(b).cast("int").alias("end_min"),
                 F.array(*[F.lit(c) for c in cams]).cast("array<string>").alias("cameras"))
        for i, a, b, cams in SESSIONS
    ])
    days = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day")).distinct()
    each = days.select("day", F.explode(rows).alias("s")).select(F.concat_ws(" ", F.col("day").cast("string"), "s.id").alias("id"), "day", "s.start_min", "s.end_min", "s.cameras")
    return schedule.session_windows(each)


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as recordings: user modulo 5 is the camera, the fifth is unknown."""
    k = F.col("user_id") % 5
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.when(k < 4, F.concat(F.lit("cam"), k.cast("string"))).alias("camera"),
        F.to_date("ts").alias("day"), schedule.minute_of_day(F.col("ts")).alias("minute"), (F.col("value") * 10).alias("duration_s"),
    )


SQL_ASSIGNED = f"""
WITH {SQL_SESSIONS},
c AS (
  SELECT event_id AS id, CASE WHEN user_id % 5 < 4 THEN 'cam' || (user_id % 5) END AS camera, CAST(ts AS DATE) AS day,
    hour(ts) * 60 + minute(ts) + (epoch_us(ts) % 60000000) / 1000000.0::DOUBLE / 60 AS m, value * 10 AS d
  FROM events
),
h AS (
  SELECT c.id, strftime(day, '%Y-%m-%d') || ' ' || s.id AS sid, e, s.s <= m AND m < e AS starts,
    s.s <= least(m + d / 60, 1440 - 1e-9) AND least(m + d / 60, 1440 - 1e-9) < e AS ends
  FROM c JOIN s ON len(cams) = 0 OR list_contains(cams, camera) WHERE camera IS NOT NULL
),
g AS (
  SELECT id, count(*) FILTER (WHERE starts) AS n, list_sort(list(sid) FILTER (WHERE starts)) AS hits, max(e) FILTER (WHERE starts) AS until,
    list_sort(list(sid) FILTER (WHERE ends AND NOT starts)) AS others FROM h GROUP BY id
),
a AS (
  SELECT c.id, camera, day, m, d,
    CASE WHEN camera IS NULL THEN 'no camera' WHEN coalesce(n, 0) = 0 THEN 'outside every session'
      WHEN n > 1 THEN 'ambiguous: ' || array_to_string(hits, ', ') END AS reason, hits, until, others
  FROM c LEFT JOIN g USING (id)
),
assigned AS (
  SELECT id, camera, day, m, d, reason, CASE WHEN reason IS NULL THEN hits[1] END AS session,
    CASE WHEN reason IS NULL THEN m + d / 60 > until END AS spans_boundary,
    CASE WHEN reason IS NULL AND m + d / 60 > until AND len(others) = 1 THEN others[1] END AS ends_in
  FROM a
)
"""


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.assign(clips(spark, sf_dir), daily_windows(spark, sf_dir))


@query(SQL_ASSIGNED + "SELECT id, session, reason, spans_boundary, ends_in FROM assigned")
def session_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assigned(spark, sf_dir).select("id", "session", "reason", "spans_boundary", "ends_in")


@query(SQL_ASSIGNED + """SELECT coalesce(split_part(session, ' ', 2), '') AS session, coalesce(split_part(reason, ':', 1), '') AS reason,
  count(*) AS clips, min(id) AS first_id, max(id) AS last_id FROM assigned GROUP BY ALL""")
def session_assign_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.coalesce(F.split("reason", ":")[0], F.lit(""))
    name = F.coalesce(F.split("session", " ")[1], F.lit(""))
    return assigned(spark, sf_dir).groupBy(name.alias("session"), kind.alias("reason")).agg(F.count("*").alias("clips"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query(SQL_ASSIGNED + """SELECT reason, count(*) AS clips, array_to_string(list_sort(list(id))[1:12], ', ') AS ids
  FROM (SELECT split_part(reason, ':', 1) AS reason, id FROM assigned WHERE reason IS NOT NULL) GROUP BY reason""")
def unassigned_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.unassigned_reasons(assigned(spark, sf_dir))


@query(SQL_ASSIGNED + """SELECT strftime(day_, '%Y-%m-%d') || ' ' || s.id AS id, count(x.id) AS clips, round(coalesce(sum(x.d), 0) / 60, 6) AS minutes
  FROM (SELECT DISTINCT day AS day_ FROM c) CROSS JOIN s LEFT JOIN assigned x ON x.session = strftime(day_, '%Y-%m-%d') || ' ' || s.id GROUP BY 1""")
def session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = schedule.session_counts(daily_windows(spark, sf_dir), assigned(spark, sf_dir))
    return found.select("id", "clips", F.round("minutes", 6).alias("minutes"))


@query(SQL_ASSIGNED + """SELECT coalesce(camera, '(no camera)') AS camera, CASE WHEN camera IS NULL THEN '(not read)' ELSE strftime(day, '%Y-%m-%d') END AS date,
  count(*) AS clips, min(CASE WHEN camera IS NOT NULL THEN m END) AS first, max(CASE WHEN camera IS NOT NULL THEN m END) AS last,
  CAST(count(*) FILTER (WHERE camera IS NOT NULL AND floor(m) < 0) AS BIGINT) AS early,
  CAST(count(*) FILTER (WHERE camera IS NOT NULL AND floor(m) >= 1440) AS BIGINT) AS late FROM c GROUP BY 1, 2""")
def clock_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.clock_table(clips(spark, sf_dir), daily_windows(spark, sf_dir))


@query(f"""WITH {SQL_SESSIONS}, d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events)
SELECT strftime(day, '%Y-%m-%d') AS day, strftime(day, '%Y-%m-%d') || ' ' || a.id AS a_id, strftime(day, '%Y-%m-%d') || ' ' || b.id AS b_id,
  CAST(greatest(a.s, b.s) AS INT) AS from_min, CAST(least(a.e, b.e) AS INT) AS to_min
FROM d, s a, s b WHERE a.id < b.id AND a.s < b.e AND b.s < a.e
  AND NOT (len(a.cams) > 0 AND len(b.cams) > 0 AND NOT list_has_any(a.cams, b.cams))""")
def schedule_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.session_conflicts(daily_windows(spark, sf_dir)).withColumn("day", F.col("day").cast("string"))


def _order_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sessions of their customer's day: minute by key, half without an end, cameras by priority."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"), F.concat_ws("/", (F.col("o_custkey") % 50).cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"),
        (F.col("o_orderkey") % 1440).cast("int").alias("start_min"),
        F.when(F.col("o_orderkey") % 2 == 0, (F.col("o_orderkey") % 1440 + 30).cast("int")).alias("end_min"),
        F.when(F.col("o_custkey") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.substring("o_orderpriority", 1, 1))).alias("cameras"),
    )


@query("""WITH s AS (
  SELECT o_orderkey AS id, (o_custkey % 50) || '/' || strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(o_orderkey % 1440 AS INT) AS s,
    CAST(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 1440 + 30 END AS INT) AS e,
    CASE WHEN o_custkey % 3 = 0 THEN [] ELSE [o_orderpriority[1:1]] END AS cams FROM orders
)
SELECT a.id, CAST(coalesce(a.e, (SELECT min(b.s) FROM s b WHERE b.day = a.day AND b.s > a.s
  AND NOT (len(a.cams) > 0 AND len(b.cams) > 0 AND NOT list_has_any(a.cams, b.cams))), 1440) AS INT) AS end_min FROM s a""")
def missing_end_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.session_windows(_order_sessions(spark, sf_dir)).select("id", "end_min")


@query("""SELECT o_orderpriority AS type, CAST(1000 AS BIGINT) AS target, count(*) AS listed, count(*) FILTER (WHERE o_orderstatus = 'O') AS O,
  count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY 1
UNION ALL SELECT 'total', CAST(1000 * count(DISTINCT o_orderpriority) AS BIGINT), count(*), count(*) FILTER (WHERE o_orderstatus = 'O'),
  count(*) FILTER (WHERE o_orderstatus = 'F'), count(*) FILTER (WHERE o_orderstatus = 'P') FROM orders""")
def status_pivot_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("type"), F.col("o_orderstatus").alias("status"))
    types = o.select(F.col("type").alias("id")).distinct().withColumn("count", F.lit(1000).cast("long"))
    return schedule.status_rows(o, types, ["O", "F", "P"])


@query("""WITH p AS (SELECT p_brand AS type, count(*) AS n FROM part GROUP BY 1),
used AS (SELECT DISTINCT p_brand AS type, p_size AS k FROM part),
want AS (SELECT type, n, n + 3 AS target FROM p),
free AS (SELECT type, k, row_number() OVER (PARTITION BY type ORDER BY k) AS r, target - n AS missing FROM want, unnest(range(1, target + n + 1)) AS t(k)
  WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.type = want.type AND u.k = t.k))
SELECT type, type || '-' || lpad(CAST(k AS VARCHAR), greatest(2, length(CAST(k AS VARCHAR)))::INT, '0') AS id FROM free WHERE r <= missing""")
def stub_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    items = part.select(F.col("p_brand").alias("type"), F.concat_ws("-", "p_brand", F.col("p_size").cast("string")).alias("id"))
    types = part.groupBy(F.col("p_brand").alias("id")).agg((F.count("*") + 3).alias("count"))
    return schedule.stubs(items, types)


# intervals

def busy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as intervals of their user."""
    return events(spark, sf_dir).select("event_id", "user_id", "event_type", F.col("us").alias("t0"), F.col("until").alias("t1"))


SQL_UNION = """
, i AS (SELECT user_id, us AS t0, until AS t1, event_type FROM e WHERE until > us),
m AS (SELECT kind, user_id, t0, t1, max(t1) OVER (PARTITION BY kind, user_id ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
  FROM (SELECT {kind} AS kind, user_id, t0, t1 FROM i)),
n AS (SELECT *, sum(CASE WHEN reach IS NULL OR t0 > reach THEN 1 ELSE 0 END) OVER (PARTITION BY kind, user_id ORDER BY t0, t1 ROWS UNBOUNDED PRECEDING) AS g FROM m),
u AS (SELECT kind, user_id, min(t0) AS t0, max(t1) AS t1 FROM n GROUP BY kind, user_id, g)
"""


@query(f"WITH {SQL_EVENTS}" + SQL_UNION.format(kind="1") + "SELECT user_id, t0, t1 FROM u")
def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.union(busy(spark, sf_dir), ["user_id"], width=24 * HOUR)


SQL_TWO = f"WITH {SQL_EVENTS}" + SQL_UNION.format(kind="CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END")


@query(SQL_TWO + """, cuts AS (SELECT k.user_id, k.t0 AS a, k.t1 AS b, c.t0, c.t1 FROM u k LEFT JOIN u c ON c.kind = 0 AND c.user_id = k.user_id AND c.t0 < k.t1 AND c.t1 > k.t0 WHERE k.kind = 1),
pieces AS (
  SELECT user_id, a, b, coalesce(lag(t1) OVER w, a) AS p0, coalesce(t0, b) AS p1 FROM cuts WINDOW w AS (PARTITION BY user_id, a ORDER BY t0)
  UNION ALL SELECT user_id, a, b, max(t1), b FROM cuts WHERE t1 IS NOT NULL GROUP BY user_id, a, b
)
SELECT user_id, p0 AS t0, p1 AS t1 FROM pieces WHERE p1 > p0""")
def interval_minus(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = busy(spark, sf_dir)
    cover = F.col("event_type").isin("view", "click")
    return intervals.minus(b.where(cover), b.where(~cover), ["user_id"], width=24 * HOUR)


@query(SQL_TWO + """SELECT a.user_id, greatest(a.t0, b.t0) AS t0, least(a.t1, b.t1) AS t1 FROM u a JOIN u b ON a.user_id = b.user_id AND a.kind = 1 AND b.kind = 0
WHERE a.t0 < b.t1 AND b.t0 < a.t1 AND least(a.t1, b.t1) - greatest(a.t0, b.t0) >= 60000000""")
def interval_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = busy(spark, sf_dir)
    cover = F.col("event_type").isin("view", "click")
    a, c = (intervals.union(x, ["user_id"], width=24 * HOUR) for x in (b.where(cover), b.where(~cover)))
    return intervals.intersect(a, c, ["user_id"], 6 * HOUR, least=60_000_000)


@query("""WITH o AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q, CAST(round(l_tax * 100) AS BIGINT) AS gap FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(t1 - q AS BIGINT) AS t0, CAST(t1 AS BIGINT) AS t1 FROM (
  SELECT *, sum(q + gap) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, q, gap ROWS UNBOUNDED PRECEDING) - gap AS t1 FROM o)""")
def timeline_prefix_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("q"), F.round(F.col("l_tax") * 100).cast("long").alias("gap"))
    laid = intervals.prefix_layout(o, ["l_orderkey"], ["l_linenumber", "q", "gap"], "q", "gap")
    return laid.select("l_orderkey", "l_linenumber", "t0", "t1")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns laid end to end, one unit of time a character."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n"))
    return intervals.prefix_layout(c, ["conv_id"], ["turn"], "n")


SQL_TURNS = """t AS (SELECT conv_id, turn, role, n, t1 - n AS t0, t1 FROM (SELECT conv_id, turn, role, CAST(length(coalesce(text, '')) AS BIGINT) AS n,
  CAST(sum(length(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS t1 FROM conversations)),
g AS (SELECT conv_id, CAST(k * 500 AS BIGINT) AS g0, CAST(k * 500 + 400 AS BIGINT) AS g1 FROM (SELECT conv_id, max(t1) AS top FROM t GROUP BY conv_id), unnest(range(0, top // 500 + 1)) AS x(k))"""


def grid(laid: DataFrame) -> DataFrame:
    """Picture rows of 400 units every 500."""
    top = laid.groupBy("conv_id").agg(F.max("t1").alias("top"))
    k = top.select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("top") / 500))).alias("k"))
    return k.select("conv_id", (F.col("k") * 500).alias("g0"), (F.col("k") * 500 + 400).alias("g1"))


@query(f"""WITH {SQL_TURNS} SELECT conv_id, turn, greatest(t0, g0) AS t0, least(t1, g1) AS t1, greatest(t0, g0) - g0 AS into FROM t JOIN g USING (conv_id)
WHERE t0 < g1 AND g0 < t1 AND t1 > t0 AND least(t1, g1) - greatest(t0, g0) > 4""")
def boundary_split_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    laid = turns(spark, sf_dir)
    picks = laid.select("conv_id", "turn", F.col("t0").alias("p0"), F.col("t1").alias("p1"))
    cut = intervals.split(grid(laid), picks, ["conv_id"], ("g0", "g1"), ("p0", "p1"), 1000, least=4)
    return cut.select("conv_id", "turn", "t0", "t1", "into")


@query(f"""WITH {SQL_TURNS} SELECT conv_id, g0, coalesce(string_agg(role, ' ' ORDER BY t0) FILTER (WHERE t0 IS NOT NULL), '') AS words
FROM g LEFT JOIN t USING (conv_id) WHERE 1 = 1 GROUP BY conv_id, g0""".replace("FROM g LEFT JOIN t USING (conv_id) WHERE 1 = 1", "FROM g LEFT JOIN (SELECT conv_id AS c, role, t0, t1 FROM t WHERE t1 > t0) t ON c = conv_id AND t0 < g1 AND g0 < t1"))
def words_under_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    laid = turns(spark, sf_dir)
    spans = grid(laid).withColumnsRenamed({"g0": "t0", "g1": "t1"})
    words = laid.select("conv_id", F.col("role").alias("w"), F.col("t0").alias("s"), F.col("t1").alias("e"))
    return intervals.words_under(spans, words, ["conv_id"], ["conv_id", "t0"], 1000).select("conv_id", F.col("t0").alias("g0"), "words")


@query(f"""WITH {SQL_TURNS} SELECT conv_id, g0, CAST(sum(least(t1, g1) - greatest(t0, g0)) AS BIGINT) AS heard, string_agg(role, ' ' ORDER BY r) FILTER (WHERE r <= 2) AS text, count(*) > 2 AS truncated
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, g0 ORDER BY t0, role) AS r FROM t JOIN g USING (conv_id) WHERE t0 < g1 AND g0 < t1 AND t1 > t0) GROUP BY conv_id, g0""")
def heard_in_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    laid = turns(spark, sf_dir)
    spans = grid(laid).withColumnsRenamed({"g0": "t0", "g1": "t1"})
    words = laid.select("conv_id", F.col("role").alias("w"), F.col("t0").alias("s"), F.col("t1").alias("e"))
    found = intervals.heard_in(spans, words, ["conv_id"], ["conv_id", "t0"], 1000, most=2)
    return found.select("conv_id", F.col("t0").alias("g0"), F.col("heard_s").alias("heard"), "text", "truncated")


@query(f"""WITH {SQL_EVENTS}, p AS (SELECT user_id, us FROM e WHERE event_type = 'error'), c AS (SELECT user_id, us AS place FROM e WHERE event_type = 'purchase')
SELECT user_id, us, nearest FROM (SELECT p.user_id, us, place AS nearest, row_number() OVER (PARTITION BY p.user_id, us ORDER BY abs(place - us), place) AS r FROM p LEFT JOIN c ON c.user_id = p.user_id) WHERE r = 1""")
def nearest_pause_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    points = e.where("event_type = 'error'").select("user_id", "us")
    marks = e.where("event_type = 'purchase'").select("user_id", F.col("us").alias("at"))
    return intervals.nearest(points, marks, ["user_id"], "us", "at")


@query(f"""WITH {SQL_EVENTS}, p AS (SELECT user_id, event_id, us FROM e WHERE event_type = 'click'), c AS (SELECT user_id, event_id AS chunk, us AS c0 FROM e WHERE event_type = 'view')
SELECT p.user_id, p.event_id, coalesce((SELECT max_by(chunk, c0) FROM c WHERE c.user_id = p.user_id AND c0 <= us), (SELECT min_by(chunk, c0) FROM c WHERE c.user_id = p.user_id)) AS chunk FROM p""")
def asof_chunk_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    points = e.where("event_type = 'click'").select("user_id", "event_id", "us")
    chunks = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("chunk"), F.col("us").alias("c0"))
    return intervals.as_of(points, chunks, ["user_id"], "us", "c0", width=24 * HOUR).select("user_id", "event_id", "chunk")


# series

@query(f"""WITH {SQL_EVENTS}, g AS (SELECT *, us - lag(until) OVER (PARTITION BY user_id ORDER BY us, until) >= {HOUR} AS new FROM e),
n AS (SELECT *, sum(CASE WHEN coalesce(new, false) OR new IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, until ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT user_id, CAST(island AS BIGINT) AS island, min(us) AS t0, max(until) AS t1, count(*) AS n FROM n GROUP BY user_id, island""")
def sentence_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = series.gap_islands(events(spark, sf_dir), ["user_id"], "us", "until", HOUR)
    return found.groupBy("user_id", "island").agg(F.min("us").alias("t0"), F.max("until").alias("t1"), F.count("*").alias("n"))


@query(f"""WITH {SQL_EVENTS}, n AS (SELECT *, sum(CASE WHEN until - us >= 600000000 OR r = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, until ROWS UNBOUNDED PRECEDING) AS island
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, until) AS r FROM e))
SELECT user_id, CAST(island AS BIGINT) AS island, min(us) AS t0, max(until) AS t1, count(*) AS n FROM n GROUP BY user_id, island""")
def short_span_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumnRenamed("us", "s").withColumnRenamed("until", "u")
    return series.merge_short(e, ["user_id"], "s", "u", 600_000_000)


@query(f"""WITH {SQL_EVENTS}, r AS (SELECT *, max(until) OVER (PARTITION BY user_id ORDER BY us, until ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e)
SELECT user_id, event_id, us - reach AS gap FROM r WHERE us - reach >= {HOUR}""")
def pauses_running_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.pauses(events(spark, sf_dir), ["user_id"], "us", "until", HOUR).select("user_id", "event_id", "gap")


DAY = 24 * HOUR


@query(f"""WITH {SQL_EVENTS}, f AS (SELECT user_id, min(us) AS a, max(us) AS b FROM e GROUP BY 1),
w AS (SELECT user_id, a + k * {DAY} AS t0, a + k * {DAY} + {4 * DAY} AS t1 FROM f, unnest(range(0, (b - a) // {DAY} + 1)) AS x(k) WHERE a + k * {DAY} + {4 * DAY} <= b)
SELECT w.user_id, t0, t1, count(*) AS n, round(sqrt(avg(value * value)), 6) AS rms, round(avg(value), 6) AS mean FROM w JOIN e ON e.user_id = w.user_id AND us >= t0 AND us < t1 GROUP BY 1, 2, 3 HAVING count(*) >= 6""")
def sliding_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = series.sliding_profile(events(spark, sf_dir), ["user_id"], "us", "value", 4 * DAY, DAY, 6)
    return found.select("user_id", "t0", "t1", "n", F.round("rms", 6).alias("rms"), F.round("mean", 6).alias("mean"))


@query(f"""WITH {SQL_EVENTS}, f AS (SELECT user_id, min(us) AS a, max(us) AS b FROM e GROUP BY 1),
x AS (SELECT w.user_id, t0, t1, round(avg(value), 6) AS mean, count(*) AS n FROM (SELECT user_id, a + k * {DAY} AS t0, a + k * {DAY} + {4 * DAY} AS t1 FROM f, unnest(range(0, (b - a) // {DAY} + 1)) AS x(k) WHERE a + k * {DAY} + {4 * DAY} <= b) w
  JOIN e ON e.user_id = w.user_id AND us >= t0 AND us < t1 GROUP BY 1, 2, 3 HAVING count(*) >= 6),
s AS (SELECT user_id, place, sum(k) AS k, sum(c) AS c FROM (SELECT user_id, t0 AS place, CASE WHEN mean <= 60 THEN 1 ELSE 0 END AS k, CASE WHEN mean > 60 THEN 1 ELSE 0 END AS c FROM x
  UNION ALL SELECT user_id, t1, CASE WHEN mean <= 60 THEN -1 ELSE 0 END, CASE WHEN mean > 60 THEN -1 ELSE 0 END FROM x) GROUP BY user_id, place),
r AS (SELECT user_id, place AS t0, lead(place) OVER (PARTITION BY user_id ORDER BY place) AS t1, sum(k) OVER (PARTITION BY user_id ORDER BY place ROWS UNBOUNDED PRECEDING) > 0 AND sum(c) OVER (PARTITION BY user_id ORDER BY place ROWS UNBOUNDED PRECEDING) = 0 AS good FROM s),
g AS (SELECT user_id, t0, t1, t0 - sum(t1 - t0) OVER (PARTITION BY user_id ORDER BY t0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS run, coalesce(t0 = lag(t1) OVER (PARTITION BY user_id ORDER BY t0), false) AS joins FROM r WHERE good AND t1 IS NOT NULL),
h AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY t0 ROWS UNBOUNDED PRECEDING) AS i FROM g)
SELECT user_id, t0, t1 FROM (SELECT user_id, min(t0) AS t0, max(t1) AS t1 FROM h GROUP BY user_id, i) WHERE t1 - t0 >= {3 * DAY}""")
def stable_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of windows whose mean, to the millionth, is at most 60: which side 60 itself is on hangs on no order of adding."""
    found = series.sliding_profile(events(spark, sf_dir), ["user_id"], "us", "value", 4 * DAY, DAY, 6).withColumn("mean", F.round("mean", 6))
    return intervals.stable_runs(found, ["user_id"], "mean", 60, 3 * DAY, width=7 * DAY)


@query(f"""WITH {SQL_EVENTS}, p AS (SELECT user_id, us, event_id, sum(value - 50) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS x, row_number() OVER (PARTITION BY user_id ORDER BY us) - 1 AS i, count(*) OVER (PARTITION BY user_id) - 1 AS l FROM e),
h AS (SELECT *, first_value(x) OVER (PARTITION BY user_id ORDER BY i) AS x0, last_value(x) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS xl FROM p),
c AS (SELECT user_id, i AS place, x, true AS own, event_id FROM h UNION ALL SELECT user_id, -i, 2 * x0 - x, false, NULL FROM h WHERE i BETWEEN 1 AND 6 UNION ALL SELECT user_id, 2 * l - i, 2 * xl - x, false, NULL FROM h WHERE i < l AND i >= l - 6)
SELECT user_id, event_id, round(x - s, 4) + 0.0 AS residual FROM (SELECT *, avg(x) OVER (PARTITION BY user_id ORDER BY place ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS s FROM c) WHERE own""")
def centered_moving_avg_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("user_id", "us", "event_id", (F.col("value") - 50).alias("v"))
    walked = series.cumulative(e, ["user_id"], ["us"], ["v"])
    smooth = series.centred_mean(walked, ["user_id"], ["us"], "v_path", 6)
    return smooth.select("user_id", "event_id", (F.round(F.col("v_path") - F.col("smooth"), 4) + F.lit(0.0)).alias("residual"))


@query(f"""WITH {SQL_EVENTS} SELECT event_id, round((least(max(value) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING),
  max(value) OVER (PARTITION BY user_id ORDER BY us DESC ROWS UNBOUNDED PRECEDING)) - value) / max(value) OVER (PARTITION BY user_id), 6) AS dip FROM e""")
def dip_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.dip(events(spark, sf_dir), ["user_id"], ["us"], "value").select("event_id", F.round("dip", 6).alias("dip"))


@query("""SELECT l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice, 0.1), 4) AS floor, round(quantile_cont(l_extendedprice, 0.9), 4) AS speech,
  round(sqrt(avg(l_extendedprice * l_extendedprice)), 4) AS rms FROM lineitem GROUP BY 1, 2""")
def noise_floor_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = series.levels(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice")
    return found.select("l_returnflag", "l_linestatus", *[F.round(c, 4).alias(c) for c in ("floor", "speech", "rms")])


@query("SELECT o_orderpriority, o_orderstatus, list_sort(list(o_totalprice))[count(*) // 2 + 1] AS median FROM orders GROUP BY 1, 2")
def upper_median_by_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.upper_medians(table(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus"], "o_totalprice")


@query(f"""WITH {SQL_EVENTS}, f AS (SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY us) - 1 AS BIGINT) AS i, value > 100 AS loud FROM e),
r AS (SELECT *, max(CASE WHEN loud THEN i END) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, min(CASE WHEN loud THEN i END) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a, max(i) OVER (PARTITION BY user_id) AS top FROM f)
SELECT event_id, CAST(least(20, i - coalesce(b, -1) - 1) AS BIGINT) AS room_before, CAST(least(20, coalesce(a, top + 1) - i - 1) AS BIGINT) AS room_after FROM r WHERE loud""")
def edge_room(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("us")
    frames = events(spark, sf_dir).select("user_id", "event_id", (F.row_number().over(w) - 1).cast("long").alias("i"), (F.col("value") > 100).alias("loud"))
    marks = frames.where("loud").select("user_id", "event_id", F.col("i").alias("first"), F.col("i").alias("last"))
    found = series.edge_room(frames, marks, ["user_id"], "i", F.col("loud"), "first", "last", 20)
    return found.select("event_id", F.col("room_before").cast("long").alias("room_before"), F.col("room_after").cast("long").alias("room_after"))


@query(f"""WITH {SQL_EVENTS} SELECT user_id, event_id, round((us - lag(us + CAST(round(value * 1000000) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY us)) / 1e6, 6) AS gap_s FROM e QUALIFY abs(gap_s) > {6 * 3600}""")
def contiguity_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as recordings of `value` seconds."""
    chunks = events(spark, sf_dir).select("user_id", "event_id", F.timestamp_micros("us").cast("timestamp_ntz").alias("start"), F.col("value").alias("duration_s"))
    return tables.contiguous(chunks, ["user_id"], 6 * 3600).select("user_id", "event_id", F.round("gap_s", 6).alias("gap_s"))
