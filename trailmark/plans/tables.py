"""The driver's tables bound to the shapes that the operators take: a user's events are a ride's points.

Columns that events lack are integer arithmetic on ids, the same in Spark and in the SQL texts below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

POINTS = """
  SELECT user_id AS ride_id, event_id AS seq, ts, event_type, value, props,
    CAST(event_id * 37 % 600 AS INT) AS power_all,
    CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(event_id * 37 % 600 AS INT) END AS power,
    value / 4 AS speed,
    CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(100 + event_id % 90 AS INT) END AS heart_rate,
    CAST(60 + event_id * 13 % 70 AS INT) AS cadence,
    CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(event_id * 29 % 400 AS DOUBLE) END AS altitude,
    CAST(event_id * 10 AS DOUBLE) AS distance,
    CAST(40 AS DOUBLE) + (user_id % 10) / CAST(10 AS DOUBLE) + (event_id % 97) / CAST(1000 AS DOUBLE) AS lat,
    CAST(-74 AS DOUBLE) + (event_id % 89) / CAST(1000 AS DOUBLE) AS lon
  FROM events"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(POINTS.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))


def with_points(sql: str) -> str:
    """SQL that may read `points`; text that begins with RECURSIVE may hold recursive tables."""
    if sql.lstrip().startswith("RECURSIVE"):
        return f"WITH RECURSIVE points AS ({POINTS}), {sql.lstrip().removeprefix('RECURSIVE')}"
    return f"WITH points AS ({POINTS}), {sql}" if not sql.lstrip().upper().startswith("SELECT") else f"WITH points AS ({POINTS}) {sql}"
