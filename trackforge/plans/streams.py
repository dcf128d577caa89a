"""Queries on streams: the file of events is read as a stream, and the result equals that of the batch operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackforge.params import Possession, Tracks
from trackforge.plans.catalog import ORACLES, query, r6
from trackforge.plans.decisions import st01_possession
from trackforge.plans.measures import flt02_two_lens_duplicates
from trackforge.recast import frames_of, table
from trackforge.stored import shared_folder
from trackforge.streaming import online, possession, tracks

C = F.col


def events(spark, sf_dir):
    rows = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event[s].parquet")
    return rows.withColumn("ts", C("ts").cast("timestamp"))


@query("""SELECT user_id, time_bucket(INTERVAL '12 hours', ts) + o.o AS g, count(*) AS n, round(avg(CAST(event_type = 'click' AS INT)), 6) AS share FROM events, (SELECT unnest([INTERVAL '12 hours', INTERVAL '24 hours']) AS o) o GROUP BY 1, 2""", frames=False)
def streaming_share(spark, sf_dir):
    shares = online.hopping_share(events(spark, sf_dir), ["user_id"], "ts", C("event_type") == "click", "24 hours", "12 hours", "1 hour")
    out = online.drained(shares, shared_folder(spark), "complete")
    return out.select("user_id", C("g").cast("timestamp_ntz").alias("g"), "n", r6(C("share")).alias("share"))


@query("""WITH s AS (SELECT user_id, ts, sum(nw) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM (SELECT *, CASE WHEN coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL '6 hours', true) THEN 1 ELSE 0 END AS nw FROM events)) SELECT user_id, min(ts) AS t0, max(ts) AS t1, count(*) AS n FROM s GROUP BY user_id, g""", frames=False)
def streaming_sessions(spark, sf_dir):
    out = online.drained(online.sessions(events(spark, sf_dir), ["user_id"], "ts", "6 hours", "1 hour"), shared_folder(spark), "complete")
    return out.select("user_id", C("t0").cast("timestamp_ntz").alias("t0"), C("t1").cast("timestamp_ntz").alias("t1"), "n")


@query()
def streaming_possession(spark, sf_dir):
    kind = C("event_type")
    rows = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event[s].parquet").select(
        C("user_id").alias("match_id"),
        C("event_id").alias("frame"),
        F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("t"),
        F.when(F.dayofmonth("ts") > 15, 2).otherwise(1).alias("half"),
        (kind == "purchase").alias("dead"),
        (kind != "error").alias("ball"),
        F.when(kind == "click", 0).when(kind == "view", 1).when(kind == "signup", (C("event_id") % 2).cast("int")).alias("controller"),
    )
    return online.drained(online.online_possession(rows, "match_id", Possession(switch_s=14400, reset_s=72000)), shared_folder(spark))


def frames(spark, sf_dir):
    """The frames of recast.frames as a stream, with their event time."""
    return frames_of(spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event[s].parquet"))


@query()
def streaming_duplicates(spark, sf_dir):
    rows = frames(spark, sf_dir).where("x is not null").select(F.floor(C("t") / 3_600_000).alias("moment"), C("value").alias("quality"), C("frame").alias("id"), (C("match_id") % 2).alias("cam"), "x", "y")
    rows = rows.withColumn("ts", F.timestamp_seconds(C("moment") * 3600))
    kept = online.without_doubles(rows, ["moment"], "ts", "1 hour", ["quality", "id"], "id", 12.5, other="cam")
    return online.drained(kept, shared_folder(spark), "complete").select("moment", "id")


@query()
def streaming_pieces(spark, sf_dir):
    f = frames(spark, sf_dir).where("x is not null")
    d = f.select((C("match_id") % 16).alias("match_id"), "half", (F.floor(C("t") / 7_200_000) * 100).alias("t"), "x", "y", "team", (C("value") > 200).alias("keeper"))
    pieces = tracks.online_pieces(d.withColumn("ts", F.timestamp_millis("t")), ["match_id", "half"], "ts", "0 seconds", Tracks())
    return online.drained(pieces, shared_folder(spark)).where("what = 'detection'").select("match_id", "half", "piece", "t", "x", "y")


@query()
def streaming_ordered_possession(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("x", F.when(C("seen") == "o", -20.0).otherwise(C("x")))
    rows = f.select("match_id", F.timestamp_millis("t").alias("ts"), "half", "frame", "t", "x", "y", C("team").alias("controller"))
    p = Possession(switch_s=14400, reset_s=72000, out_min_s=7200, still_s=21600, still_radius=12.0)
    return online.drained(possession.ordered_possession(rows, "match_id", "ts", "0 seconds", p, idle_s=0.0), shared_folder(spark))


ORACLES["streaming_duplicates"] = ORACLES[flt02_two_lens_duplicates.__name__]
ORACLES["streaming_possession"] = ORACLES[st01_possession.__name__].replace("SELECT match_id, half, frame, ctl", "SELECT match_id, frame, ctl")
