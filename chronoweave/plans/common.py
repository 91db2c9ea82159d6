"""What the query modules share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.session import table


def collector():
    """(QUERIES, ORACLES, decorator): @query(sql) registers a function and its SQL under the function's name."""
    queries, oracles = {}, {}

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return add

    return queries, oracles, query


def micros(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970 of a wall-clock time, whatever the session's zone."""
    at = F.col(column)
    if dict(df.dtypes)[column] == "timestamp_ntz":
        at = F.convert_timezone(F.lit("UTC"), F.current_timezone(), at)
    return F.unix_micros(at.cast("timestamp"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, event_type, value, us (microseconds) and until: us and `value` minutes."""
    df = table(spark, sf_dir, "events")
    us = df.select("event_id", "user_id", "event_type", "value", micros(df, "ts").alias("us"))
    return us.withColumn("until", F.col("us") + F.round(F.col("value") * 60_000_000).cast("long"))


#: The same for DuckDB.
SQL_EVENTS = """e AS (
  SELECT event_id, user_id, event_type, value, epoch_us(ts) AS us,
    epoch_us(ts) + CAST(round(value * 60000000) AS BIGINT) AS until FROM events
)"""
HOUR = 3_600_000_000
