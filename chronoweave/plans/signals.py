"""Queries on correlation, waveforms and moves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.operators import correlate, moves, series
from chronoweave.session import table

from .common import HOUR, SQL_EVENTS, collector, events

QUERIES, ORACLES, query = collector()

#: Hours of a clip.
WEEK = 168


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_type, hour (from the first hour of all), n and total of every hour in which something happened."""
    e = events(spark, sf_dir).withColumn("h", F.floor(F.col("us") / HOUR))
    first = e.agg(F.min("h").alias("first"))
    return e.join(F.broadcast(first)).groupBy("event_type", (F.col("h") - F.col("first")).alias("hour")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query(f"""WITH {SQL_EVENTS}, b AS (SELECT min(us // {HOUR}) AS first FROM e),
h AS (SELECT event_type, us // {HOUR} - first AS hour, count(*) AS n, sum(value) AS total FROM e, b GROUP BY 1, 2),
g AS (SELECT k.event_type, hour, coalesce(n, 0) AS n, coalesce(total, 0) AS total
  FROM (SELECT event_type, unnest(range(max(hour) + 1)) AS hour FROM h GROUP BY event_type) k LEFT JOIN h USING (event_type, hour)),
c AS (SELECT event_type, hour // {WEEK} AS week, hour % {WEEK} AS j, n, count(*) OVER (PARTITION BY event_type, hour // {WEEK}) AS m FROM g),
r AS (SELECT c.event_type, week, g.hour - j AS lag, round(corr(g.total, c.n), 9) AS r FROM c JOIN g ON g.event_type = c.event_type AND g.hour >= j
  GROUP BY 1, 2, 3, m HAVING count(*) = m AND stddev_pop(g.total) > 0 AND stddev_pop(c.n) > 0),
p AS (SELECT *, first_value(lag) OVER w AS peak, first_value(r) OVER w AS best FROM r WINDOW w AS (PARTITION BY event_type, week ORDER BY r DESC, lag))
SELECT event_type, week, peak AS lag, round(best, 6) AS r, round(best - max(r) FILTER (WHERE lag < peak - 24 OR lag >= peak + 24), 6) AS margin FROM p GROUP BY event_type, week, peak, best""")
def envelope_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each week of hourly counts lies best in the hourly sums of the same type, and how far it leads other days."""
    h = hourly(spark, sf_dir)
    weeks = h.groupBy("event_type", F.floor(F.col("hour") / WEEK).alias("week")).agg(F.collect_list(F.struct("hour", "n")).alias("h"))
    ends = h.groupBy("event_type").agg(F.max("hour").alias("end"))
    # hours without an event count as none, up to the last one of the type
    size = F.least(F.lit(WEEK), F.col("end") - F.col("week") * WEEK + 1)
    at = F.map_from_entries(F.transform("h", lambda x: F.struct(x["hour"] % WEEK, x["n"])))
    clips = weeks.join(ends, "event_type").withColumn("m", at).select(
        "event_type", "week", F.transform(F.sequence(F.lit(0).cast("long"), size - 1), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)).cast("double")).alias("env")
    )
    long = h.select("event_type", F.lit("sums").alias("source"), F.col("hour").alias("at"), "total")
    r = correlate.match_lags(long, clips, ["event_type"], "source", "at", "total", "week", "env", local=True)
    found = series.best_match(r.withColumn("r", F.round("r", 9)), ["event_type", "week"], "r", "lag", guard=24)
    return found.select("event_type", "week", "lag", F.round("r", 6).alias("r"), F.round("margin", 6).alias("margin"))


@query()
def vector_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which quarters of a vector are found in the next one, a little shifted; tested against a plain walk."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")
    found = correlate.waveform_match(pairs, "x", "y", rate=64, window=0.25, reach=0.08, least=0.3)
    return found.select("vec_id", "status", "windows", "lost", "drift", F.round("least_r", 9).alias("least_r"), "lost_s")


def hourly_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_type, at (hours), vx and vy: how far the hour's sum and count are from the type's mean hour, in deviations."""
    h = hourly(spark, sf_dir)
    mean = h.groupBy("event_type").agg(*[f(c).alias(f"{c}_{f.__name__}") for c in ("n", "total") for f in (F.avg, F.stddev_pop)])
    away = lambda c: F.coalesce(F.try_divide(F.col(c) - F.col(f"{c}_avg"), F.col(f"{c}_stddev_pop")), F.lit(0.0))
    return h.join(mean, "event_type").select("event_type", F.col("hour").cast("double").alias("at"), away("total").alias("vx"), away("n").alias("vy"))


@query()
def hourly_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches in which the hourly figures of a type go one way; tested against one walk over each type."""
    found = moves.move_segments(hourly_path(spark, sf_dir), "event_type", "at", "vx", "vy", width=120.0, beyond=24.0)
    return found.select("event_type", "segment", "t0", "t1", "moving", *[F.round(c, 6).alias(c) for c in ("direction", "dip", "mean_vx", "mean_vy")])
