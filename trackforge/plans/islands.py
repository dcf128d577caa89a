"""Queries on runs and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackforge.operators import islands as isl
from trackforge.plans.catalog import query, r6
from trackforge.recast import LENGTH, WIDTH, frames

HOUR = 3_600_000
KEYS = ["match_id", "half"]


@query(""", a AS (SELECT *, last_value(seen IGNORE NULLS) OVER w AS s, lead(t) OVER (PARTITION BY match_id, half ORDER BY frame) AS nt FROM frames WINDOW w AS (PARTITION BY match_id, half ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
b AS (SELECT *, CASE WHEN s = 'o' AND coalesce(lag(s) OVER (PARTITION BY match_id, half ORDER BY frame), '-') <> 'o' THEN 1 ELSE 0 END AS nw FROM a),
c AS (SELECT *, sum(nw) OVER (PARTITION BY match_id, half ORDER BY frame) AS g FROM b)
SELECT match_id, half, min(t) AS t0, coalesce(max_by(nt, frame), max(t)) AS t1, count(*) AS n FROM c WHERE s = 'o' GROUP BY match_id, half, g HAVING coalesce(max_by(nt, frame), max(t)) - min(t) >= 7200000""")
def isl01_out_of_play_runs(spark, sf_dir):
    return isl.outside_runs(frames(spark, sf_dir), KEYS, "frame", "t", F.col("seen"), 2 * HOUR)


SEQUENCES = """, a AS (SELECT *, CASE WHEN team IS NOT NULL AND lag(team) OVER (PARTITION BY match_id, half ORDER BY frame) IS DISTINCT FROM team THEN 1 ELSE 0 END AS nw FROM frames),
b AS (SELECT *, sum(nw) OVER (PARTITION BY match_id, half ORDER BY frame) AS g FROM a),
raw AS (SELECT match_id, half, g, any_value(team) AS team, min(t) AS t0, max(t) AS t1, min(frame) AS start FROM b WHERE team IS NOT NULL GROUP BY 1, 2, 3),
c AS (SELECT *, CASE WHEN coalesce(t0 - lag(t1) OVER (PARTITION BY match_id, half ORDER BY g) > 36000000, true) THEN 1 ELSE 0 END AS br FROM raw),
d AS (SELECT *, sum(br) OVER (PARTITION BY match_id, half ORDER BY g) AS isl FROM c),
e AS (SELECT *, CASE WHEN lag(isl) OVER w IS DISTINCT FROM isl OR lag(team) OVER w IS DISTINCT FROM team THEN 1 ELSE 0 END AS n2 FROM d WHERE t1 - t0 >= 3600000 WINDOW w AS (PARTITION BY match_id, half ORDER BY g)),
k AS (SELECT *, sum(n2) OVER (PARTITION BY match_id, half ORDER BY g) AS s FROM e),
seqs AS (SELECT match_id, half, any_value(team) AS team, min(t0) AS t0, max(t1) AS t1, min(start) AS start FROM k GROUP BY match_id, half, s)
"""


def sequences(spark, sf_dir):
    return isl.possession_sequences(frames(spark, sf_dir), KEYS, "frame", "t", "team", HOUR, 10 * HOUR)


@query(SEQUENCES + "SELECT * FROM seqs")
def isl03_possession_sequences(spark, sf_dir):
    return sequences(spark, sf_dir)


@query(SEQUENCES + "SELECT team, count(*) AS possessions, round(avg((t1 - t0) / 1000.0), 6) AS avg_s, max(t1 - t0) / 1000.0 AS longest_s, count(*) FILTER (t1 - t0 >= 36000000) AS long_ones FROM seqs GROUP BY team")
def ag06_sequence_stats(spark, sf_dir):
    length = (F.col("t1") - F.col("t0")) / 1000
    return sequences(spark, sf_dir).groupBy("team").agg(F.count("*").alias("possessions"), r6(F.avg(length)).alias("avg_s"), F.max(length).alias("longest_s"), F.count_if(length >= 36000).alias("long_ones"))


@query(SEQUENCES + """, p AS (SELECT *, lag(team) OVER w AS pt, lag(t1) OVER w AS p1 FROM seqs WINDOW w AS (PARTITION BY match_id, half ORDER BY t0, start)),
rec AS (SELECT * FROM p WHERE pt <> team AND t0 - p1 < 43200000),
per AS (SELECT match_id, half, team, count(*) AS recoveries FROM rec GROUP BY 1, 2, 3)
SELECT coalesce(r.match_id, l.match_id) AS match_id, coalesce(r.half, l.half) AS half, coalesce(r.team, 1 - l.team) AS team, coalesce(r.recoveries, 0) AS recoveries, coalesce(l.recoveries, 0) AS losses
FROM per r FULL JOIN per l ON r.match_id = l.match_id AND r.half = l.half AND r.team = 1 - l.team""")
def ag07_recoveries_losses(spark, sf_dir):
    found = isl.recoveries(sequences(spark, sf_dir), KEYS, "team", 12 * HOUR)
    other = F.col("team") == 1
    both = found.withColumn("r", F.array(F.struct(F.col("team").alias("team"), F.lit(1).alias("a"), F.lit(0).alias("b")), F.struct(F.when(other, 0).otherwise(1).alias("team"), F.lit(0).alias("a"), F.lit(1).alias("b"))))
    return both.select(*KEYS, F.inline("r")).groupBy(*KEYS, "team").agg(F.sum("a").alias("recoveries"), F.sum("b").alias("losses"))


@query(""", a AS (SELECT *, lag(t) OVER (PARTITION BY match_id, half ORDER BY frame) AS pt FROM frames),
b AS (SELECT *, CASE WHEN lag(team) OVER w IS DISTINCT FROM team OR pt - lag(t) OVER w > 36000000 THEN 1 ELSE 0 END AS nw FROM a WHERE team IN (0, 1) WINDOW w AS (PARTITION BY match_id, half ORDER BY frame)),
c AS (SELECT *, sum(nw) OVER (PARTITION BY match_id, half ORDER BY frame) AS g FROM b)
SELECT match_id, half, any_value(team) AS team, min(t) AS t0, max(t) AS t1, min(frame) AS i0, max(frame) AS i1 FROM c GROUP BY match_id, half, g HAVING max(t) - min(t) >= 3600000""")
def isl14_control_segments(spark, sf_dir):
    return isl.control_segments(frames(spark, sf_dir), KEYS, "frame", "t", "team", 10 * HOUR, HOUR)


@query(""", a AS (SELECT *, CASE WHEN coalesce(t - lag(t) OVER (PARTITION BY match_id, half ORDER BY t) > 21600000, true) THEN 1 ELSE 0 END AS nw FROM frames WHERE x < 3.0),
b AS (SELECT *, sum(nw) OVER (PARTITION BY match_id, half ORDER BY t) AS g FROM a)
SELECT match_id, half, min(t) AS t0, max(t) AS t1, count(*) AS n FROM b GROUP BY match_id, half, g""")
def isl05_centre_groups(spark, sf_dir):
    return isl.gap_sessions(frames(spark, sf_dir).where("x < 3.0"), KEYS, "t", 6 * HOUR)


@query(""", a AS (SELECT *, CASE WHEN coalesce(t - lag(t) OVER (PARTITION BY match_id, half ORDER BY t) > 43200000, true) THEN 1 ELSE 0 END AS nw FROM frames WHERE kind IN ('purchase', 'signup')),
b AS (SELECT *, sum(nw) OVER (PARTITION BY match_id, half ORDER BY t) AS g FROM a)
SELECT match_id, half, round(avg(t), 3) AS t_mean, count(*) AS n, bool_or(kind = 'purchase') AS by_ball FROM b GROUP BY match_id, half, g HAVING max(t) - min(t) >= CASE WHEN bool_or(kind = 'purchase') THEN 1800000 ELSE 7200000 END""")
def isl08_kickoff_events(spark, sf_dir):
    ball = F.col("kind") == "purchase"
    found = isl.gap_sessions(frames(spark, sf_dir).where("kind in ('purchase', 'signup')"), KEYS, "t", 12 * HOUR, extra=[F.avg("t").alias("t_mean"), F.bool_or(ball).alias("by_ball")])
    long = F.col("t1") - F.col("t0") >= F.when(F.col("by_ball"), HOUR // 2).otherwise(2 * HOUR)
    return found.where(long).select(*KEYS, F.round("t_mean", 3).alias("t_mean"), "n", "by_ball")


@query(""", a AS (SELECT *, CASE WHEN coalesce(t - lag(t) OVER (PARTITION BY match_id, team ORDER BY t) > 21600000, true) THEN 1 ELSE 0 END AS nw FROM frames WHERE team IS NOT NULL AND x >= 47.0)
SELECT match_id, team, count(*) FILTER (nw = 1) AS entries FROM a GROUP BY 1, 2""")
def isl17_box_entries(spark, sf_dir):
    inside = frames(spark, sf_dir).where("team is not null and x >= 47.0")
    return isl.gap_sessions(inside, ["match_id", "team"], "t", 6 * HOUR).groupBy("match_id", "team").agg(F.count("*").alias("entries"))


@query(""", ep AS (SELECT match_id, half, g, min(t) AS t0, max(t) AS t1, count(*) AS n FROM (SELECT *, sum(nw) OVER (PARTITION BY match_id, half ORDER BY t) AS g FROM (SELECT *, CASE WHEN coalesce(t - lag(t) OVER (PARTITION BY match_id, half ORDER BY t) > 14400000, true) THEN 1 ELSE 0 END AS nw FROM frames WHERE kind = 'click')) GROUP BY 1, 2, 3),
m AS (SELECT *, CASE WHEN coalesce(t0 - lag(t1) OVER (PARTITION BY match_id, half ORDER BY t0) >= 86400000, true) THEN 1 ELSE 0 END AS nw FROM ep),
k AS (SELECT *, sum(nw) OVER (PARTITION BY match_id, half ORDER BY t0) AS s FROM m)
SELECT match_id, half, min(t0) AS t0, max(t1) AS t1, CAST(sum(n) AS BIGINT) AS n, count(*) AS parts FROM k GROUP BY match_id, half, s""")
def isl04_merged_episodes(spark, sf_dir):
    return isl.merged_sessions(isl.gap_sessions(frames(spark, sf_dir).where("kind = 'click'"), KEYS, "t", 4 * HOUR), KEYS, 24 * HOUR)


@query(""", b AS (SELECT *, sum(nw) OVER (PARTITION BY match_id, half ORDER BY t) AS g FROM (SELECT *, CASE WHEN coalesce(t - lag(t) OVER (PARTITION BY match_id, half ORDER BY t) > 36000000, true) THEN 1 ELSE 0 END AS nw FROM frames WHERE x IS NOT NULL)),
c AS (SELECT *, median(x) OVER (PARTITION BY match_id, half, g) AS mx, median(y) OVER (PARTITION BY match_id, half, g) AS my FROM b)
SELECT match_id, half, min(t) AS t0, max(t) AS t1, count(*) AS n FROM c GROUP BY match_id, half, g HAVING max(t) - min(t) >= 3600000 AND max(sqrt((x - mx) * (x - mx) + (y - my) * (y - my))) <= 20.0""")
def isl04_steady_formations(spark, sf_dir):
    return isl.steady_episodes(frames(spark, sf_dir).where("x is not null"), KEYS, "t", "x", "y", 10 * HOUR, HOUR, 20.0)


@query(""", s AS (SELECT match_id, t, t - lag(t) OVER (PARTITION BY match_id, half ORDER BY t) AS away_ms, half FROM frames WHERE seen = 'i')
SELECT match_id, half, t, away_ms FROM s WHERE away_ms >= 43200000""")
def isl07_reappearances(spark, sf_dir):
    return isl.reappearances(frames(spark, sf_dir), KEYS, "t", F.col("seen") == "i", 12 * HOUR)


ANCHORS = """, ev AS (SELECT match_id, half, t FROM frames WHERE kind = 'signup'),
k AS (SELECT match_id, half, min(t) AS t FROM ev GROUP BY 1, 2
  UNION ALL SELECT k.match_id, k.half, (SELECT min(e.t) FROM ev e WHERE e.match_id = k.match_id AND e.half = k.half AND e.t >= k.t + 172800000) AS t FROM k WHERE k.t IS NOT NULL),
kk AS (SELECT DISTINCT * FROM k WHERE t IS NOT NULL)
"""


@query(ANCHORS + "SELECT kk.match_id, kk.half, kk.t, (SELECT count(*) FROM ev e WHERE e.match_id = kk.match_id AND e.half = kk.half AND e.t >= kk.t AND e.t < kk.t + 172800000) AS n FROM kk")
def isl09_anchored_merge(spark, sf_dir):
    return isl.anchored_merge(frames(spark, sf_dir).where("kind = 'signup'").select(*KEYS, "t"), KEYS, "t", 48 * HOUR)


@query(ANCHORS + "SELECT match_id, half, t FROM kk")
def isl18_spaced_shots(spark, sf_dir):
    return isl.spaced(frames(spark, sf_dir).where("kind = 'signup'").select(*KEYS, "t"), KEYS, "t", 48 * HOUR)


@query(", e AS (SELECT match_id, half, t FROM frames WHERE kind = 'signup') SELECT match_id, half, t, t - min(t) OVER (PARTITION BY match_id, half) < 86400000 AS start FROM e")
def isl10_half_starts(spark, sf_dir):
    return isl.half_starts(frames(spark, sf_dir).where("kind = 'signup'").select(*KEYS, "t"), KEYS, "t", 24 * HOUR)


@query(""", b AS (SELECT *, sum(nw) OVER (PARTITION BY match_id, half ORDER BY t) AS g FROM (SELECT *, CASE WHEN coalesce(t - lag(t) OVER (PARTITION BY match_id, half ORDER BY t) > 43200000, true) THEN 1 ELSE 0 END AS nw FROM frames WHERE x >= 40.0)),
c AS (SELECT match_id, half, g, min(t) AS t0, max(t) AS t1, count(*) AS n FROM b GROUP BY 1, 2, 3)
SELECT match_id, half, t0, t1, n FROM c QUALIFY row_number() OVER (PARTITION BY match_id, half ORDER BY t1 DESC) = 1""")
def isl12_last_stay(spark, sf_dir):
    return isl.last_stay(frames(spark, sf_dir).where("x >= 40.0"), KEYS, "t", 12 * HOUR)


@query(""", lastk AS (SELECT match_id, half, max(t) AS last FROM frames WHERE kind = 'signup' GROUP BY 1, 2),
late AS (SELECT f.match_id, f.half, f.t FROM frames f JOIN lastk USING (match_id, half) WHERE f.x >= 40.0 AND f.t > last + 3600000),
b AS (SELECT *, sum(nw) OVER (PARTITION BY match_id, half ORDER BY t) AS g FROM (SELECT *, CASE WHEN coalesce(t - lag(t) OVER (PARTITION BY match_id, half ORDER BY t) > 172800000, true) THEN 1 ELSE 0 END AS nw FROM late))
SELECT match_id, half, min(t) AS t0, max(t) AS t1, count(*) AS n FROM b GROUP BY match_id, half, g HAVING count(*) >= 2""")
def isl13_late_goal_stays(spark, sf_dir):
    f = frames(spark, sf_dir)
    last = f.where("kind = 'signup'").groupBy(*KEYS).agg(F.max("t").alias("last"))
    late = f.where("x >= 40.0").join(last, KEYS).where(F.col("t") > F.col("last") + HOUR)
    return isl.gap_sessions(late, KEYS, "t", 48 * HOUR).where("n >= 2")


@query(""", a AS (SELECT *, CASE WHEN coalesce(lag(kind) OVER w IS DISTINCT FROM kind OR t - lag(t) OVER w >= 43200000, true) THEN 1 ELSE 0 END AS nw FROM frames WINDOW w AS (PARTITION BY match_id, half ORDER BY frame)),
b AS (SELECT *, sum(nw) OVER (PARTITION BY match_id, half ORDER BY frame) AS g FROM a)
SELECT match_id, half, any_value(kind) AS kind, min(t) AS t0, max(t) AS t1, count(*) AS n FROM b GROUP BY match_id, half, g""")
def isl15_touches(spark, sf_dir):
    return isl.touches(frames(spark, sf_dir), KEYS, "frame", "t", "kind", 12 * HOUR)


@query(""", l AS (SELECT *, CASE WHEN value < 30 THEN 0 WHEN value < 80 THEN 1 ELSE -1 END AS other, coalesce(team, -1) AS own FROM frames),
a AS (SELECT *, CASE WHEN coalesce(lag(own) OVER w <> own OR lag(other) OVER w <> other, true) THEN 1 ELSE 0 END AS nw FROM l WINDOW w AS (PARTITION BY match_id, half ORDER BY frame)),
b AS (SELECT *, sum(nw) OVER (PARTITION BY match_id, half ORDER BY frame) AS g FROM a)
SELECT match_id, half, any_value(own) AS own, any_value(other) AS other, min(t) AS t0, max(t) AS t1, count(*) AS n FROM b GROUP BY match_id, half, g HAVING any_value(own) <> any_value(other) AND greatest(any_value(own), any_value(other)) >= 0 AND max(t) - min(t) >= 3600000""")
def isl20_disagreement_runs(spark, sf_dir):
    other = F.when(F.col("value") < 30, 0).when(F.col("value") < 80, 1).otherwise(-1)
    labelled = frames(spark, sf_dir).withColumn("own", F.coalesce("team", F.lit(-1))).withColumn("other", other)
    runs = isl.constant_runs(labelled, KEYS, "frame", "t", ["own", "other"])
    return runs.where((F.col("own") != F.col("other")) & (F.greatest("own", "other") >= 0) & (F.col("t1") - F.col("t0") >= HOUR))


@query(""", a AS (SELECT *, x IS NOT NULL AS valid FROM frames),
b AS (SELECT *, CASE WHEN coalesce(lag(valid) OVER w IS DISTINCT FROM valid, true) THEN 1 ELSE 0 END AS nw FROM a WINDOW w AS (PARTITION BY match_id, half ORDER BY frame)),
c AS (SELECT *, sum(nw) OVER (PARTITION BY match_id, half ORDER BY frame) AS g FROM b)
SELECT match_id, half, min(t) AS t0, max(t) AS t1, count(*) AS n FROM c WHERE valid GROUP BY match_id, half, g""")
def isl21_valid_segments(spark, sf_dir):
    return isl.constant_runs(frames(spark, sf_dir).withColumn("valid", F.col("x").isNotNull()), KEYS, "frame", "t", ["valid"]).where("valid").drop("valid")


@query(""", a AS (SELECT *, seen = 'o' AS o, x - 3.0 AS bx, y - 3.0 AS b_y FROM frames WHERE x IS NOT NULL),
b AS (SELECT *, CASE WHEN coalesce(lag(o) OVER w IS DISTINCT FROM o, true) THEN 1 ELSE 0 END AS nw FROM a WINDOW w AS (PARTITION BY match_id, half ORDER BY frame)),
c AS (SELECT *, sum(nw) OVER (PARTITION BY match_id, half ORDER BY frame) AS g FROM b),
v AS (SELECT match_id, half, g, min(t) AS t0, max(t) AS t1, count(*) AS n, max(-bx) AS v0, max(bx - 50.0::DOUBLE) AS v1, max(-b_y) AS v2, max(b_y - 26.36::DOUBLE) AS v3 FROM c WHERE o GROUP BY 1, 2, 3)
SELECT match_id, half, t0, t1, n, CASE greatest(v0, v1, v2, v3) WHEN v0 THEN 0 WHEN v1 THEN 1 WHEN v2 THEN 2 ELSE 3 END AS side FROM v""")
def isl16_crossed_lines(spark, sf_dir):
    f = frames(spark, sf_dir).where("x is not null").withColumn("bx", F.col("x") - 3.0).withColumn("by", F.col("y") - 3.0)
    return isl.violated_side(f, KEYS, "frame", "t", "bx", "by", F.col("seen") == "o", LENGTH - 6, 26.36)


@query(""", g AS (SELECT match_id, half, t, t - lag(t) OVER w AS gap_ms, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) / ((t - lag(t) OVER w) / 1000.0) AS speed FROM frames WHERE x IS NOT NULL WINDOW w AS (PARTITION BY match_id, half ORDER BY t))
SELECT match_id, half, CAST(floor(t - gap_ms / 2.0) AS BIGINT) AS t, gap_ms, round(gap_ms / 1000.0 * (1 + speed / 5), 6) AS score FROM g WHERE gap_ms BETWEEN 3600000 AND 43200000""")
def isl22_hard_gaps(spark, sf_dir):
    return isl.hard_gaps(frames(spark, sf_dir).where("x is not null"), KEYS, "t", "x", "y", HOUR, 12 * HOUR).withColumn("score", r6(F.col("score")))


@query(None)
def isl22_hard_moments(spark, sf_dir):
    gaps = isl.hard_gaps(frames(spark, sf_dir).where("x is not null"), KEYS, "t", "x", "y", HOUR, 12 * HOUR)
    return isl.spaced_by_rank(gaps, KEYS, "t", [-F.col("score")], 24 * HOUR)


@query(""", c AS (SELECT t // 3600000 * 3600000 AS t, count(*) AS n FROM frames GROUP BY 1),
m AS (SELECT t, median(n) OVER (ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM c),
h AS (SELECT t, CASE WHEN coalesce(t - lag(t) OVER (ORDER BY t) > 10800000, true) THEN 1 ELSE 0 END AS nw FROM m WHERE m >= 13),
g AS (SELECT t, sum(nw) OVER (ORDER BY t) AS g FROM h),
s AS (SELECT min(t) AS t0, max(t) AS t1 FROM g GROUP BY g HAVING max(t) - min(t) + 3600000 >= 7200000),
l AS (SELECT * FROM s ORDER BY t0 - t1, t0 LIMIT 2)
SELECT CAST(0 AS INT) AS match_id, CAST(row_number() OVER (ORDER BY t0) AS INT) AS half, greatest(0, t0 - 3600000) AS t0, t1 + 3600000 AS t1 FROM l""")
def isl19_find_halves(spark, sf_dir):
    counts = frames(spark, sf_dir).groupBy((F.floor(F.col("t") / HOUR) * HOUR).alias("t")).agg(F.count("*").alias("n")).withColumn("match_id", F.lit(0))
    return isl.playing_spans(counts, ["match_id"], "t", "n", 13, 5, 3 * HOUR, 2 * HOUR, HOUR, 2)


@query(""", c AS (SELECT match_id % 4 AS m, t // 3600000 * 3600000 AS t, count(*) AS n FROM frames GROUP BY 1, 2), d AS (SELECT m, t, median(n) OVER (PARTITION BY m ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS v FROM c),
h AS (SELECT *, sum(nw) OVER (PARTITION BY m ORDER BY t) AS g FROM (SELECT *, CASE WHEN coalesce(t - lag(t) OVER (PARTITION BY m ORDER BY t) > 10800000, true) THEN 1 ELSE 0 END AS nw FROM d WHERE v >= 1)),
s AS (SELECT m, min(t) AS a, max(t) AS b FROM h GROUP BY m, g HAVING max(t) - min(t) + 3600000 >= 7200000), l AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY m ORDER BY a - b, a) <= 2),
o AS (SELECT * FROM l QUALIFY count(*) OVER (PARTITION BY m) = 1 AND b - a > 57600000), r AS (SELECT o.*, d.t, d.v FROM d JOIN o USING (m) WHERE d.t BETWEEN a AND b),
p AS (SELECT m, v AS dv, t AS dt FROM r WHERE t BETWEEN a + 0.3::DOUBLE * (b - a) AND a + 0.7::DOUBLE * (b - a) QUALIFY row_number() OVER (PARTITION BY m ORDER BY v, t) = 1),
k AS (SELECT m, a, b, min(t) AS lo, max(t) AS hi FROM r JOIN p USING (m) WHERE abs(t - dt) < 43200000 AND v <= dv + 1 GROUP BY 1, 2, 3),
f AS (SELECT m, a, b FROM l ANTI JOIN k USING (m) UNION ALL SELECT m, a, lo FROM k UNION ALL SELECT m, hi, b FROM k)
SELECT m AS match_id, CAST(row_number() OVER (PARTITION BY m ORDER BY a) AS INT) AS half, greatest(0, a - 3600000) AS t0, b + 3600000 AS t1 FROM f""")
def isl19_split_span(spark, sf_dir):
    counts = frames(spark, sf_dir).groupBy((F.col("match_id") % 4).alias("match_id"), (F.floor(F.col("t") / HOUR) * HOUR).alias("t")).agg(F.count("*").alias("n"))
    return isl.playing_spans(counts, ["match_id"], "t", "n", 1, 5, 3 * HOUR, 2 * HOUR, HOUR, 2, split_near_ms=12 * HOUR)
