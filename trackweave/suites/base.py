"""Query registry and the telemetry view over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.plans.track import Track

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# rows of a track in the given tables are hours apart, so slices are three days wide
TRACK = Track(("source_id",), ("t", "row_pos"), 3 * 86400.0)
POSITION = Track(("source_id",), ("row_pos",), 200_000.0)

TELEMETRY = """
tel AS (
  SELECT CAST(user_id AS VARCHAR) AS source_id, event_id AS row_pos, epoch_us(ts) AS t_us,
         epoch_us(ts) / 1e6 AS t, value AS x,
         -60 + (event_id * 37 % 1200) / 10.0 AS lat, -180 + (event_id * 91 % 3600) / 10.0 AS lon,
         CASE WHEN event_id % 13 <> 0 THEN CAST(1000 + event_id * 53 % 9000 AS DOUBLE) END AS alt,
         CASE WHEN event_id % 17 <> 0 THEN CAST(1010 + event_id * 53 % 9000 + event_id % 40 AS DOUBLE) END AS alt_geom_m,
         CAST(50 + event_id * 17 % 200 AS DOUBLE) AS ground_speed_ms, CAST(event_id * 13 % 360 AS DOUBLE) AS track_deg,
         CAST(event_id * 7 % 40 AS DOUBLE) / 4 - 5 AS vertical_rate_ms, CAST(event_id * 11 % 60 - 30 AS DOUBLE) AS roll_deg,
         event_type = 'signup' AS on_ground, event_type = 'error' AS alarm, event_id % 3 = 0 AS flags_new_leg,
         user_id % 7 = 0 AS is_military, event_type AS source_type, props
  FROM events)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events seen as track rows; every field is derived with integer arithmetic."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    t_us = F.unix_micros(F.col("ts").cast("timestamp"))
    kind = F.col("event_type")
    return e.select(
        F.col("user_id").cast("string").alias("source_id"), i.alias("row_pos"), t_us.alias("t_us"),
        (t_us / 1e6).alias("t"), F.col("value").alias("x"),
        (F.lit(-60) + F.pmod(i * 37, F.lit(1200)) / 10.0).alias("lat"),
        (F.lit(-180) + F.pmod(i * 91, F.lit(3600)) / 10.0).alias("lon"),
        F.when(i % 13 != 0, 1000.0 + i * 53 % 9000).alias("alt"),
        F.when(i % 17 != 0, 1010.0 + i * 53 % 9000 + i % 40).alias("alt_geom_m"),
        (50.0 + i * 17 % 200).alias("ground_speed_ms"), (i * 13 % 360 * 1.0).alias("track_deg"),
        (i * 7 % 40 / 4.0 - 5.0).alias("vertical_rate_ms"), (i * 11 % 60 - 30.0).alias("roll_deg"),
        (kind == "signup").alias("on_ground"), (kind == "error").alias("alarm"), (i % 3 == 0).alias("flags_new_leg"),
        (F.col("user_id") % 7 == 0).alias("is_military"), kind.alias("source_type"), "props",
    )


def query(name: str, sql: str | None = None, *, tel: bool = True):
    """Register a query; ``sql`` may start with CTEs and sees the telemetry view as ``tel``."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            body = sql.strip()
            if tel:
                head = "WITH RECURSIVE " if body.startswith("WITH RECURSIVE ") else "WITH "
                rest = f", {body[len(head):]}" if body.startswith(head) else f" {body}"
                body = f"{head}{TELEMETRY.strip()}{rest}"
            ORACLES[name] = body
        return fn

    return add


def r6(c, n: int = 6):
    """Rounded for comparison across engines, negative zero removed."""
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, n) + F.lit(0.0)


def rounded(df: DataFrame, *names: str, n: int = 6) -> DataFrame:
    return df.withColumns({c: r6(c, n) for c in names})
