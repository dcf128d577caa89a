"""Queries on kick-offs."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackforge.operators import islands, kickoffs, nearest
from trackforge.params import Pitch
from trackforge.plans.catalog import query, r6
from trackforge.recast import frames

C = F.col
HOUR = 3_600_000
KEYS = ["match_id", "half"]


@query(""", k AS (SELECT match_id, half, frame, t, x, y FROM frames WHERE x IS NOT NULL), m AS (SELECT a.match_id, a.half, a.frame, a.x, a.y, max(sqrt(power(b.x - a.x, 2) + power(b.y - a.y, 2))) AS moved FROM k a JOIN k b ON b.match_id = a.match_id AND b.half = a.half AND b.t BETWEEN a.t - 28800000 AND a.t GROUP BY 1, 2, 3, 4, 5)
SELECT match_id, half, frame, round(moved, 6) AS moved FROM m WHERE sqrt(power(x - 28, 2) + power(y - 16.18::DOUBLE, 2)) <= 12 AND moved <= 10""")
def st10_ball_on_spot(spark, sf_dir):
    found = kickoffs.ball_on_spot(frames(spark, sf_dir), KEYS, "t", Pitch(), radius=12.0, still=10.0, still_ms=8 * HOUR)
    return found.select(*KEYS, "frame", r6(C("moved")).alias("moved"))


@query(""", p AS (SELECT match_id % 16 AS m, t // 86400000 AS d, x, y, sqrt(power(x - 28, 2) + power(y - 16.18::DOUBLE, 2)) < 4.75 AS c FROM frames WHERE x IS NOT NULL),
f AS (SELECT m, d, count(*) AS n, count(*) FILTER (c) AS centre, count(*) FILTER (NOT c AND x < 28) AS l, count(*) FILTER (NOT c AND x > 28) AS r, count(*) FILTER (NOT c AND abs(x - 28) < 0.5) AS on_line FROM p GROUP BY 1, 2)
SELECT * FROM f WHERE n >= 8 AND centre <= 2 AND on_line = 0 AND l >= 3 AND r >= 3 AND abs(l - r) <= 3""")
def st10_formation_frames(spark, sf_dir):
    p = frames(spark, sf_dir).where("x is not null").select((C("match_id") % 16).alias("m"), F.floor(C("t") / (24 * HOUR)).alias("d"), "x", "y")
    return kickoffs.formation_frames(p, ["m", "d"], Pitch())


@query(""", e AS (SELECT match_id, half, frame, t, value, sum(nw) OVER (PARTITION BY match_id, half ORDER BY t) AS g FROM (SELECT *, CASE WHEN coalesce(t - lag(t) OVER (PARTITION BY match_id, half ORDER BY t) > 43200000, true) THEN 1 ELSE 0 END AS nw FROM frames)),
f AS (SELECT match_id, half, g, t // 3600000 AS h, count(*) FILTER (value <= 25) AS a, count(*) FILTER (value <= 80) AS b FROM e GROUP BY 1, 2, 3, 4)
SELECT match_id, half, CAST(g AS BIGINT) AS run, count(*) AS frames, round(median(a), 6) AS within_0, round(median(b), 6) AS within_1 FROM f GROUP BY 1, 2, 3""")
def isl06_episode_crowds(spark, sf_dir):
    f = frames(spark, sf_dir)
    new = F.coalesce(C("t") - F.lag("t").over(islands.ordered(KEYS, "t")) > 12 * HOUR, F.lit(True))
    e = islands.numbered(f.withColumn("_new", new), KEYS, ["t"], C("_new")).withColumn("h", F.floor(C("t") / HOUR)).withColumn("d", C("value"))
    c = kickoffs.crowd(e, [*KEYS, "run"], "h", (25.0, 80.0))
    return c.select(*KEYS, C("run").cast("long").alias("run"), "frames", r6(C("within_0")).alias("within_0"), r6(C("within_1")).alias("within_1"))


@query(""", c AS (SELECT frame, match_id, t FROM frames v WHERE kind = 'view' AND NOT EXISTS (SELECT 1 FROM frames p WHERE p.kind = 'purchase' AND p.match_id = v.match_id AND abs(p.t - v.t) <= 14400000)),
n AS (SELECT c.frame, count(f.t) AS k FROM c LEFT JOIN frames f ON f.match_id = c.match_id AND f.kind = 'click' AND f.t BETWEEN c.t - 28800000 AND c.t + 7200000 GROUP BY 1)
SELECT count(*) AS controls, round(avg(CAST(k >= 1 AS INT)), 6) AS at_least_1, round(avg(CAST(k >= 3 AS INT)), 6) AS at_least_3, round(avg(CAST(k >= 6 AS INT)), 6) AS at_least_6, max(k) AS most FROM n""")
def ag25_control_summary(spark, sf_dir):
    f = frames(spark, sf_dir)
    views = nearest.near_events(f.where("kind = 'view'").select("match_id", "frame", "t"), f.where("kind = 'purchase'"), ["match_id"], "t", 4 * HOUR)
    w = views.select("match_id", C("frame").alias("w"), (C("t") - 8 * HOUR).alias("t0"), (C("t") + 2 * HOUR).alias("t1"))
    n = nearest.interval_join(f.where("kind = 'click'").select("match_id", "t"), w, ["match_id"], "t", "t0", "t1", 10 * HOUR).groupBy("w").agg(F.count("*").alias("k"))
    c = kickoffs.control_summary(w.join(n, "w", "left"), F.coalesce(C("k"), F.lit(0)))
    return c.select("controls", *(r6(C(f"at_least_{k}")).alias(f"at_least_{k}") for k in (1, 3, 6)), "most")


@query(""", g AS (SELECT match_id, half, t AS goal FROM frames WHERE kind = 'purchase'), s AS (SELECT match_id, half, t AS t0 FROM frames WHERE kind = 'signup'),
w AS (SELECT g.match_id, g.half, goal, min(t0) AS f FROM g LEFT JOIN s ON s.match_id = g.match_id AND s.half = g.half AND t0 BETWEEN goal + 3600000 AND goal + 86400000 GROUP BY 1, 2, 3)
SELECT match_id, half, goal, goal - 600000 AS start, coalesce(f, goal + 14400000) AS "end", f IS NOT NULL AS kickoff_found FROM w""")
def jn06_restart_windows(spark, sf_dir):
    f = frames(spark, sf_dir)
    return kickoffs.restart_windows(f.where("kind = 'purchase'"), f.where("kind = 'signup'").withColumn("t0", C("t")), KEYS, HOUR, 24 * HOUR, 600_000, 4 * HOUR)
