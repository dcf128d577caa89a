"""Queries on moving measures and gap filling."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackforge.operators import windows as wn
from trackforge.plans.catalog import query, r6
from trackforge.recast import frames

C = F.col
HOUR = 3_600_000
KEYS = ["match_id", "half"]


@query(""", r AS (SELECT match_id, half, t, CAST(team = 0 AS INT) AS f FROM frames WHERE team IS NOT NULL), h AS (SELECT match_id, half, min(t) AS a, max(t) AS b FROM frames GROUP BY 1, 2),
g AS (SELECT match_id, half, unnest(generate_series(a, b, 43200000)) AS g FROM h)
SELECT g.match_id, g.half, g.g, round(avg(r.f), 6) AS share, count(*) AS n FROM g JOIN r ON r.match_id = g.match_id AND r.half = g.half AND r.t > g.g - 172800000 AND r.t <= g.g GROUP BY 1, 2, 3""")
def wn01_moving_share(spark, sf_dir):
    return wn.moving_share(frames(spark, sf_dir), KEYS, "t", C("team") == 0, C("team").isNotNull(), 48 * HOUR, 12 * HOUR).withColumn("share", r6(C("share")))


@query(""", r AS (SELECT match_id, half, t - min(t) OVER (PARTITION BY match_id, half) AS t, CAST(team = 0 AS INT) AS f FROM frames WHERE team IS NOT NULL), h AS (SELECT match_id, half, max(t) AS b FROM r GROUP BY 1, 2),
g AS (SELECT match_id, half, unnest(generate_series(172800000, b, 43200000)) AS g FROM h WHERE b >= 172800000)
SELECT g.match_id, g.half, g.g, round(avg(r.f), 6) AS share, count(*) AS n FROM g JOIN r ON r.match_id = g.match_id AND r.half = g.half AND r.t >= g.g - 172800000 AND r.t < g.g GROUP BY 1, 2, 3""")
def wn02_cumulative_timeline(spark, sf_dir):
    return wn.cumulative_timeline(frames(spark, sf_dir), KEYS, "t", C("team") == 0, C("team").isNotNull(), 48 * HOUR, 12 * HOUR).withColumn("share", r6(C("share")))


@query(""" SELECT match_id, frame, round(coalesce(count(*) FILTER (team = 0) OVER w / nullif(count(team) OVER w, 0)::DOUBLE, 0.5), 6) AS share FROM frames WINDOW w AS (PARTITION BY match_id ORDER BY frame ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""")
def wn03_trailing_share(spark, sf_dir):
    return wn.trailing_share(frames(spark, sf_dir), ["match_id"], "frame", C("team") == 0, C("team").isNotNull(), 10).select("match_id", "frame", r6(C("share")).alias("share"))


@query(""" SELECT match_id, frame, round(median(value) OVER (PARTITION BY match_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS median FROM frames""")
def wn04_rolling_median(spark, sf_dir):
    return wn.rolling_median(frames(spark, sf_dir), ["match_id"], "frame", "value", 5).select("match_id", "frame", r6(C("median")).alias("median"))


@query(""", f AS (SELECT *, (t - 1704067200000) / 3600000.0::DOUBLE AS hours FROM frames), s AS (SELECT match_id, frame, count(x) OVER w AS n, regr_slope(x, hours) OVER w AS sx, regr_slope(y, hours) OVER w AS sy FROM f WINDOW w AS (PARTITION BY match_id ORDER BY frame ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING))
SELECT match_id, frame, round(CASE WHEN n >= 5 THEN sqrt(sx * sx + sy * sy) END, 4) AS speed FROM s""")
def fn32_wn05_fitted_speed(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("ms", (C("t") - 1704067200000) / 3600)
    return wn.fitted_speed(f, ["match_id"], "frame", "ms", "x", "y").select("match_id", "frame", F.round("speed", 4).alias("speed"))


@query(""", k AS (SELECT match_id, frame, t, x, y FROM frames WHERE x IS NOT NULL) SELECT a.match_id, a.frame, round(max(sqrt(power(b.x - a.x, 2) + power(b.y - a.y, 2))), 6) AS moved FROM k a JOIN k b ON b.match_id = a.match_id AND b.t BETWEEN a.t - 86400000 AND a.t GROUP BY 1, 2""")
def wn06_trailing_displacement(spark, sf_dir):
    return wn.trailing_displacement(frames(spark, sf_dir).where("x is not null"), ["match_id"], "t", "x", "y", 24 * HOUR).select("match_id", "frame", r6(C("moved")).alias("moved"))


@query(""", k AS (SELECT match_id, frame, t, team, count(*) OVER (PARTITION BY match_id) AS chain FROM frames WHERE team IS NOT NULL), s AS (SELECT *, sum(team) OVER w AS ones, count(*) OVER w AS n FROM k WINDOW w AS (PARTITION BY match_id ORDER BY t RANGE BETWEEN 43200000 PRECEDING AND 43200000 FOLLOWING))
SELECT match_id, frame, CAST(CASE WHEN chain < 3 THEN team WHEN 2 * ones > n THEN 1 WHEN 2 * ones < n THEN 0 ELSE team END AS INT) AS smooth FROM s""")
def wn07_smoothed_labels(spark, sf_dir):
    return wn.smoothed_label(frames(spark, sf_dir).where("team is not null"), ["match_id"], "t", "team", 12 * HOUR, 3).select("match_id", "frame", C("smooth").cast("int").alias("smooth"))


@query(""", s AS (SELECT match_id, frame, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) AS step, (t - lag(t) OVER w) / 1000.0::DOUBLE AS dt FROM frames WHERE x IS NOT NULL WINDOW w AS (PARTITION BY match_id ORDER BY frame))
SELECT match_id, frame, round(step, 6) AS step, round(CASE WHEN dt > 0 THEN step / dt * 1000 END, 5) AS pace FROM s""")
def wn10_steps(spark, sf_dir):
    return wn.steps(frames(spark, sf_dir).where("x is not null"), ["match_id"], "frame", "t", "x", "y").select("match_id", "frame", r6(C("step")).alias("step"), F.round(C("pace") * 1000, 5).alias("pace"))


@query(""" SELECT match_id, frame, round(max(x) OVER w, 6) AS peak, round(abs(x - avg(x) OVER w), 6) AS residue FROM frames WHERE x IS NOT NULL WINDOW w AS (PARTITION BY match_id ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""")
def wn11_shake(spark, sf_dir):
    return wn.shake(frames(spark, sf_dir).where("x is not null"), ["match_id"], "frame", "x", 3).select("match_id", "frame", r6(C("peak")).alias("peak"), r6(C("residue")).alias("residue"))


@query(""" SELECT match_id, frame, NOT coalesce(bool_or(value > 150) OVER (PARTITION BY match_id ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), false) AS valid FROM frames""")
def wn12_dilated(spark, sf_dir):
    return wn.dilated(frames(spark, sf_dir), ["match_id"], "frame", C("value") > 150, 3).select("match_id", "frame", "valid")


@query(""", d AS (SELECT match_id, t, x, y FROM frames WHERE x IS NOT NULL), b AS (SELECT match_id, min(t // 43200000) AS a, max(t // 43200000) AS b FROM d GROUP BY 1), s AS (SELECT match_id, unnest(generate_series(a, b)) AS s FROM b),
w AS (SELECT s.match_id, s.s, d.x, d.y, exp(-abs(d.t - (s.s * 43200000 + 21600000)) / 36000000.0::DOUBLE) AS w FROM s JOIN d ON d.match_id = s.match_id AND d.t // 43200000 BETWEEN s.s - 2 AND s.s + 2)
SELECT match_id, s, round(sum(w * x) / sum(w), 6) AS x, round(sum(w * y) / sum(w), 6) AS y FROM w GROUP BY 1, 2""")
def wn13_decayed_centres(spark, sf_dir):
    found = wn.decayed_centres(frames(spark, sf_dir).where("x is not null"), ["match_id"], "t", ["x", "y"], 12 * HOUR, 10 * HOUR, 2)
    return found.select("match_id", "s", r6(C("x")).alias("x"), r6(C("y")).alias("y"))


FILLED = """, a AS (SELECT match_id, half, frame, t, x, y, last_value(CASE WHEN x IS NOT NULL THEN frame END IGNORE NULLS) OVER (PARTITION BY match_id, half ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fa,
first_value(CASE WHEN x IS NOT NULL THEN frame END IGNORE NULLS) OVER (PARTITION BY match_id, half ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS fb FROM frames),
j AS (SELECT a.*, p.t AS ta, p.x AS xa, p.y AS ya, q.t AS tb, q.x AS xb, q.y AS yb FROM a LEFT JOIN frames p ON p.frame = a.fa LEFT JOIN frames q ON q.frame = a.fb)
SELECT match_id, half, frame, round(coalesce(x, CASE WHEN {0} THEN xa + (t - ta) / (tb - ta)::DOUBLE * (xb - xa) END), 6) AS x, round(coalesce(y, CASE WHEN {0} THEN ya + (t - ta) / (tb - ta)::DOUBLE * (yb - ya) END), 6) AS y, CASE WHEN x IS NOT NULL THEN 'detected' WHEN {0} THEN 'interpolated' END AS source FROM j"""


@query(FILLED.format("tb - ta <= 43200000"))
def fill01_interpolated_ball(spark, sf_dir):
    return wn.filled(frames(spark, sf_dir), KEYS, "frame", "t", ["x", "y"], 12 * HOUR).select(*KEYS, "frame", r6(C("x")).alias("x"), r6(C("y")).alias("y"), "source")


@query(FILLED.format("tb > ta"))
def fill04_linear_fill(spark, sf_dir):
    return wn.filled(frames(spark, sf_dir), KEYS, "frame", "t", ["x", "y"], None).select(*KEYS, "frame", r6(C("x")).alias("x"), r6(C("y")).alias("y"), "source")


@query(""", p AS (SELECT match_id, half, t, x, lead(t) OVER w AS nt, lead(x) OVER w AS nx, min(t) OVER (PARTITION BY match_id, half) AS f FROM frames WHERE x IS NOT NULL WINDOW w AS (PARTITION BY match_id, half ORDER BY t)),
h AS (SELECT match_id, half, min(t) AS a, max(t) AS b FROM p GROUP BY 1, 2), g AS (SELECT match_id, half, unnest(generate_series(a, b, 14400000)) AS g FROM h)
SELECT g.match_id, g.half, g.g, round(x + coalesce((g.g - t) / (nt - t)::DOUBLE * (nx - x), 0), 6) AS x, g.g = t OR coalesce(nt - t <= 43200000, true) AS valid, g.g = t AS detected FROM g JOIN p ON p.match_id = g.match_id AND p.half = g.half AND g.g >= t AND (nt IS NULL OR g.g < nt)""")
def fill02_regular_grid(spark, sf_dir):
    return wn.regular_grid(frames(spark, sf_dir).where("x is not null"), KEYS, "t", ["x"], 4 * HOUR, 12 * HOUR).withColumn("x", r6(C("x")))
