"""The whole chain for matches on the general tables: every user is a match, every hour of events a frame."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from trackforge.plans import match
from trackforge.plans.catalog import query
from trackforge.recast import frames

C = F.col


@query()
def match_chain(spark, sf_dir):
    """Rows of each table that the chain makes of detections of players and ball, for each match."""
    f = frames(spark, sf_dir).where("x is not null")
    moment = F.floor(C("t") / 3_600_000)
    box = [F.lit(v).alias(n) for n, v in (("x1", 0.0), ("y1", 0.0), ("x2", 1.0), ("y2", 1.0))]
    rows = f.select((C("match_id") % 64).alias("match_id"), "half", moment.cast("int").alias("frame"), (moment * 200).alias("t"), F.lit("top").alias("cam"), F.when(C("kind") == "purchase", "ball").otherwise("player").alias("class"), (C("value") % 1).alias("conf"), *box, C("x").alias("x_m"), C("y").alias("y_m"), "team", F.lit(0).alias("gk"))
    found = match.analyse(rows.drop("team", "gk"), rows.where("class = 'player'"))
    counted = [found[name].groupBy("match_id").agg(F.count("*").alias("n")).select("match_id", F.lit(name).alias("what"), "n") for name in ("ball", "possession", "directions", "kickoffs", "goals", "tracks", "sequences", "passes", "shots")]
    return functools.reduce(lambda a, b: a.unionByName(b), counted)
