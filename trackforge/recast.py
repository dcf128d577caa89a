"""The general tables as tables of observations, so that every operator runs on them at any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LENGTH, WIDTH = 56.0, 32.36


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as frames: a user is a match, an event a frame with a team in control, a ball position, and a state.

    seen: "i" inside, "o" outside, null for unseen; unseen frames have no position.
    """
    return frames_of(table(spark, sf_dir, "events"))


def frames_of(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    known = kind != "error"
    return events.select(
        F.col("user_id").alias("match_id"),
        F.col("event_id").alias("frame"),
        F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("t"),
        F.when(F.dayofmonth("ts") > 15, 2).otherwise(1).alias("half"),
        kind.alias("kind"),
        F.when(kind == "click", 0).when(kind == "view", 1).when(kind == "signup", (F.col("event_id") % 2).cast("int")).alias("team"),
        F.when(known, F.when(kind == "purchase", "o").otherwise("i")).alias("seen"),
        F.when(known, F.col("value") % LENGTH).alias("x"),
        F.when(known, (F.col("value") * 7) % WIDTH).alias("y"),
        F.col("value").alias("value"),
    )


#: The same in SQL, to stand before a query.
FRAMES_SQL = """frames AS (
  SELECT user_id AS match_id, event_id AS frame, epoch_us(ts) // 1000 AS t, CASE WHEN day(ts) > 15 THEN 2 ELSE 1 END AS half, event_type AS kind,
         CASE WHEN event_type = 'click' THEN 0 WHEN event_type = 'view' THEN 1 WHEN event_type = 'signup' THEN CAST(event_id % 2 AS INT) END AS team,
         CASE WHEN event_type <> 'error' THEN CASE WHEN event_type = 'purchase' THEN 'o' ELSE 'i' END END AS seen,
         CASE WHEN event_type <> 'error' THEN value % 56.0::DOUBLE END AS x,
         CASE WHEN event_type <> 'error' THEN (value * 7) % 32.36::DOUBLE END AS y, value
  FROM events)"""
