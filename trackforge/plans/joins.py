"""Queries on joins by nearness, time and intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackforge.functions import scalar as fn
from trackforge.operators import nearest as jn
from trackforge.plans.catalog import query, r6
from trackforge.plans.scalars import BOXES_SQL, boxes
from trackforge.recast import frames, table

C = F.col
HOUR = 3_600_000
#: A moment holds what happens within ten minutes: balls (clicks) and people (views, signups).
MOMENT = 600_000
MOMENTS_SQL = f", ball AS (SELECT t // {MOMENT} AS moment, frame AS b, x, y FROM frames WHERE kind = 'click'), people AS (SELECT t // {MOMENT} AS moment, frame AS p, x, y, team FROM frames WHERE kind IN ('view', 'signup'))"


def moments(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("moment", F.floor(C("t") / MOMENT))
    return f.where("kind = 'click'").select("moment", C("frame").alias("b"), "x", "y"), f.where("kind in ('view', 'signup')").select("moment", C("frame").alias("p"), "x", "y", "team")


@query(MOMENTS_SQL + """, d AS (SELECT b.moment, b.b, p.p, p.team, sqrt(power(b.x - p.x, 2) + power(b.y - p.y, 2)) AS d FROM ball b JOIN people p USING (moment)),
n AS (SELECT * FROM d WHERE d <= 15 QUALIFY row_number() OVER (PARTITION BY b ORDER BY d, p) = 1)
SELECT b.moment, b.b, n.p AS nearest, n.team AS nearest_team, round(n.d, 6) AS distance FROM ball b LEFT JOIN n USING (b)""")
def jn02_nearest_controller(spark, sf_dir):
    ball, people = moments(spark, sf_dir)
    return jn.nearest_in_key(ball, people, ["moment"], "b", "p", within=15.0, carry=["team"]).select("moment", "b", "nearest", "nearest_team", r6(C("distance")).alias("distance"))


@query(MOMENTS_SQL + " SELECT b.moment, b.b, round(min(sqrt(power(b.x - p.x, 2) + power(b.y - p.y, 2))), 6) AS distance FROM ball b LEFT JOIN people p USING (moment) GROUP BY 1, 2")
def jn03_nearest_person(spark, sf_dir):
    ball, people = moments(spark, sf_dir)
    return jn.nearest_in_key(ball, people, ["moment"], "b", "p").select("moment", "b", r6(C("distance")).alias("distance"))


@query(MOMENTS_SQL + """, d AS (SELECT b.b, b.moment, p.p, sqrt(power(b.x - p.x, 2) + power(b.y - p.y, 2)) AS d FROM people b2 JOIN ball b ON b.moment = b2.moment JOIN people p ON p.p = b2.p)
SELECT moment, b, p AS nearest, round(d, 6) AS distance FROM d WHERE d <= 2.5 QUALIFY row_number() OVER (PARTITION BY b ORDER BY d, p) = 1""")
def jn25_used_candidate(spark, sf_dir):
    ball, people = moments(spark, sf_dir)
    return jn.nearest_in_key(ball, people, ["moment"], "b", "p", within=2.5).where("nearest is not null").select("moment", "b", "nearest", r6(C("distance")).alias("distance"))


HIT_SQL = "(SELECT 1 FROM b c WHERE a.frame = c.frame AND a.id <> c.id AND greatest(0.0, least(a.x2, c.x2) - greatest(a.x1, c.x1)) * greatest(0.0, least(a.y2, c.y2) - greatest(a.y1, c.y1)) >= 0.3 * ((a.x2 - a.x1) * (a.y2 - a.y1) + (c.x2 - c.x1) * (c.y2 - c.y1) - greatest(0.0, least(a.x2, c.x2) - greatest(a.x1, c.x1)) * greatest(0.0, least(a.y2, c.y2) - greatest(a.y1, c.y1))))"


def box(side):
    return [C(f"{side}.{k}") for k in ("x1", "y1", "x2", "y2")]


@query(f"WITH b AS ({BOXES_SQL}) SELECT frame, id FROM b a WHERE EXISTS {HIT_SQL}", frames=False)
def jn04_overlapping_boxes(spark, sf_dir):
    b = boxes(spark, sf_dir)
    return jn.overlapping(b, b, ["frame"], (C("l.id") != C("r.id")) & (fn.box_iou(box("l"), box("r")) >= 0.3)).select("frame", "id")


@query(f"WITH b AS ({BOXES_SQL}) SELECT frame, id FROM b a WHERE NOT EXISTS {HIT_SQL}", frames=False)
def jn04_separate_boxes(spark, sf_dir):
    b = boxes(spark, sf_dir)
    return jn.overlapping(b, b, ["frame"], (C("l.id") != C("r.id")) & (fn.box_iou(box("l"), box("r")) >= 0.3), "left_anti").select("frame", "id")


@query(""", ball AS (SELECT match_id, frame, x, y FROM frames WHERE kind IN ('click', 'view')) SELECT f.match_id, f.frame, round(b.x, 6) AS ball_x, round(b.y, 6) AS ball_y FROM frames f LEFT JOIN ball b USING (match_id, frame)""")
def jn01_frames_with_ball(spark, sf_dir):
    f = frames(spark, sf_dir)
    ball = f.where("kind in ('click', 'view')").select("match_id", "frame", r6(C("x")).alias("ball_x"), r6(C("y")).alias("ball_y"))
    return f.select("match_id", "frame").join(ball, ["match_id", "frame"], "left")


#: Restarts: six hours from every purchase.
WINDOWS_SQL = ", win AS (SELECT match_id, frame AS w, t AS t0, t + 21600000 AS t1 FROM frames WHERE kind = 'purchase')"


def restarts(spark, sf_dir):
    return frames(spark, sf_dir).where("kind = 'purchase'").select("match_id", C("frame").alias("w"), C("t").alias("t0"), (C("t") + 6 * HOUR).alias("t1"))


@query(WINDOWS_SQL + " SELECT match_id, frame FROM frames f WHERE EXISTS (SELECT 1 FROM win w WHERE w.match_id = f.match_id AND f.t BETWEEN w.t0 AND w.t1)")
def jn05_restart_frames(spark, sf_dir):
    return jn.interval_join(frames(spark, sf_dir), restarts(spark, sf_dir), ["match_id"], "t", "t0", "t1", 6 * HOUR, "left_semi").select("match_id", "frame")


@query(WINDOWS_SQL + " SELECT w.match_id, w.w, w.t0, w.t1, min(f.t) AS found FROM win w LEFT JOIN frames f ON f.match_id = w.match_id AND f.kind = 'click' AND f.t BETWEEN w.t0 AND w.t1 GROUP BY 1, 2, 3, 4")
def jn06_first_in_window(spark, sf_dir):
    return jn.first_in_interval(frames(spark, sf_dir).where("kind = 'click'").select("match_id", "t"), restarts(spark, sf_dir), ["match_id"], "t", "t0", "t1", 6 * HOUR, "w")


@query(WINDOWS_SQL + " SELECT w.match_id, w.w, w.t0, w.t1, max(f.t) AS found FROM win w LEFT JOIN frames f ON f.match_id = w.match_id AND f.kind = 'view' AND f.t BETWEEN w.t0 AND w.t1 GROUP BY 1, 2, 3, 4")
def jn07_goal_of_latest_shot(spark, sf_dir):
    return jn.first_in_interval(frames(spark, sf_dir).where("kind = 'view'").select("match_id", "t"), restarts(spark, sf_dir), ["match_id"], "t", "t0", "t1", 6 * HOUR, "w", last=True)


@query(WINDOWS_SQL + " SELECT w.match_id, w.w, count(f.t) FILTER (f.kind = 'click') AS clicks, count(f.t) FILTER (f.kind = 'view') AS views FROM win w JOIN frames f ON f.match_id = w.match_id AND f.t >= w.t0 AND f.t < w.t1 GROUP BY 1, 2")
def jn16_actions_in_windows(spark, sf_dir):
    both = jn.interval_join(frames(spark, sf_dir).select("match_id", "t", "kind"), restarts(spark, sf_dir), ["match_id"], "t", "t0", "t1", 6 * HOUR, open_end=True)
    return both.groupBy("match_id", "w").agg(F.count_if(C("kind") == "click").alias("clicks"), F.count_if(C("kind") == "view").alias("views"))


@query(", e AS (SELECT match_id, frame AS w, t FROM frames WHERE kind = 'signup') SELECT e.match_id, e.w, count(DISTINCT f.t) FILTER (f.t <= e.t + 3600000) AS narrow, count(DISTINCT f.t) AS wide FROM e JOIN frames f ON f.match_id = e.match_id AND f.kind <> 'signup' AND f.t BETWEEN e.t - 28800000 AND e.t + 7200000 GROUP BY 1, 2")
def jn12_raw_evidence(spark, sf_dir):
    f = frames(spark, sf_dir)
    windows = f.where("kind = 'signup'").select("match_id", C("frame").alias("w"), C("t").alias("at"), (C("t") - 8 * HOUR).alias("t0"), (C("t") + 2 * HOUR).alias("t1"))
    both = jn.interval_join(f.where("kind <> 'signup'").select("match_id", "t"), windows, ["match_id"], "t", "t0", "t1", 10 * HOUR)
    return both.groupBy("match_id", "w").agg(F.countDistinct(F.when(C("t") <= C("at") + HOUR, C("t"))).alias("narrow"), F.countDistinct("t").alias("wide"))


@query(""", e AS (SELECT match_id, half, frame AS w, t, greatest(t - 172800000, coalesce(lag(t) OVER (PARTITION BY match_id, half ORDER BY t) + 3600000, 0)) AS lo FROM frames WHERE kind = 'signup')
SELECT e.match_id, e.w, count(*) AS near, max(f.t) AS last_seen FROM e JOIN frames f ON f.match_id = e.match_id AND f.half = e.half AND f.x >= 40 AND f.t >= e.lo AND f.t < e.t GROUP BY 1, 2""")
def jn13_evidence_since_restart(spark, sf_dir):
    from pyspark.sql import Window

    f = frames(spark, sf_dir)
    before = F.lag("t").over(Window.partitionBy("match_id", "half").orderBy("t"))
    e = f.where("kind = 'signup'").select("match_id", "half", C("frame").alias("w"), C("t").alias("t1"), F.greatest(C("t") - 48 * HOUR, F.coalesce(before + HOUR, F.lit(0))).alias("t0"))
    both = jn.interval_join(f.where("x >= 40").select("match_id", "half", "t"), e, ["match_id", "half"], "t", "t0", "t1", 48 * HOUR, open_end=True)
    return both.groupBy("match_id", "w").agg(F.count("*").alias("near"), F.max("t").alias("last_seen"))


@query(""", l AS (SELECT match_id, frame, t FROM frames WHERE kind = 'error'), r AS (SELECT match_id, frame AS found, t AS rt FROM frames WHERE kind = 'click'),
a AS (SELECT l.match_id, l.frame, (SELECT min_by(found, rt) FROM r WHERE r.match_id = l.match_id AND r.rt >= l.t) AS up, (SELECT max_by(found, rt) FROM r WHERE r.match_id = l.match_id AND r.rt < l.t) AS down FROM l)
SELECT match_id, frame, coalesce(up, down) AS found FROM a""")
def jn08_forward_asof(spark, sf_dir):
    f = frames(spark, sf_dir)
    found = jn.asof(f.where("kind = 'error'").select("match_id", "frame", "t"), f.where("kind = 'click'").select("match_id", "t", C("frame").alias("found")), ["match_id"], "t", ["found"], forward=True, clamp=True)
    return found.select("match_id", "frame", "found")


@query(""", l AS (SELECT match_id, frame, t - 36000000 AS s FROM frames WHERE kind = 'view') SELECT l.match_id, l.frame, (SELECT min(f.frame) FROM frames f WHERE f.match_id = l.match_id AND f.t >= l.s) AS found FROM l""")
def jn10_frame_before(spark, sf_dir):
    f = frames(spark, sf_dir)
    left = f.where("kind = 'view'").select("match_id", "frame", (C("t") - 10 * HOUR).alias("t"))
    return jn.asof(left, f.select("match_id", "t", C("frame").alias("found")), ["match_id"], "t", ["found"], forward=True).select("match_id", "frame", "found")


@query(""", b AS (SELECT frame, t FROM frames WHERE kind = 'purchase'), p AS (SELECT match_id % 16 AS player, t, frame AS f FROM frames WHERE kind = 'view'),
n AS (SELECT b.frame, p.player, p.t AS right_t, p.f AS right_f FROM b JOIN p ON p.t >= b.t - 1800000 AND p.t < b.t + 1800000 QUALIFY row_number() OVER (PARTITION BY b.frame, p.player ORDER BY abs(p.t - b.t), p.t) = 1) SELECT * FROM n""")
def jn09_tracks_at_frames(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("all", F.lit(0))
    tracks = f.where("kind = 'view'").select("all", (C("match_id") % 16).alias("player"), "t", C("frame").alias("f"))
    return jn.nearest_in_time(f.where("kind = 'purchase'").select("all", "frame", "t"), tracks, ["all"], "player", "t", HOUR // 2, "frame").drop("all")


@query(""", a AS (SELECT t // 3600000 AS h, x, y, frame FROM frames WHERE x IS NOT NULL), d AS (SELECT a.h, a.frame, min(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2))) AS d FROM a JOIN a b ON b.h = a.h - 1 GROUP BY 1, 2) SELECT h AS moment, round(median(d), 6) AS calm FROM d GROUP BY 1""")
def jn11_formation_calm(spark, sf_dir):
    p = frames(spark, sf_dir).where("x is not null").withColumn("h", F.floor(C("t") / HOUR)).withColumn("all", F.lit(0))
    return jn.chamfer(p, ["all"], "x", "y", C("h"), C("h") + 1, "moment").select("moment", r6(C("calm")).alias("calm"))


LABELS_SQL = "SELECT doc_id, quality AS a, toxic AS b, CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END AS c FROM labels JOIN documents USING (doc_id)"


def analyses(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", C("quality").alias("a"), C("toxic").alias("b"), F.when(C("n_chars") > 1500, 1).otherwise(0).alias("c"))


@query(f"WITH l AS ({LABELS_SQL}) SELECT count(*) AS n, count(*) FILTER (a = b) AS ab, count(*) FILTER (a = c) AS ac, count(*) FILTER (b = c) AS bc, count(*) FILTER (a = b AND b = c) AS all_three FROM l", frames=False)
def jn14_common_frames(spark, sf_dir):
    x = analyses(spark, sf_dir)
    a, b, c = (x.select("doc_id", k) for k in "abc")
    return a.join(b, "doc_id").join(c, "doc_id").agg(F.count("*").alias("n"), F.count_if(C("a") == C("b")).alias("ab"), F.count_if(C("a") == C("c")).alias("ac"), F.count_if(C("b") == C("c")).alias("bc"), F.count_if((C("a") == C("b")) & (C("b") == C("c"))).alias("all_three"))


@query("SELECT d.doc_id, coalesce(l.quality, CAST(d.doc_id % 2 AS INT)) AS answer, l.quality IS NULL AS stored FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND l.toxic = 0", frames=False)
def jn15_key_with_fallback(spark, sf_dir):
    key = table(spark, sf_dir, "labels").where("toxic = 0").select("doc_id", "quality")
    return table(spark, sf_dir, "documents").select("doc_id").join(key, "doc_id", "left").select("doc_id", F.coalesce("quality", (C("doc_id") % 2).cast("int")).alias("answer"), C("quality").isNull().alias("stored"))


@query(""", s AS (SELECT match_id, half, min(t) AS t0, max(t) AS t1, match_id % 4 AS g FROM frames WHERE half = 1 GROUP BY match_id, half)
SELECT a.g AS team, a.match_id AS a, b.match_id AS b, least(a.t1, b.t1) - greatest(a.t0, b.t0) AS overlap FROM s a JOIN s b ON a.g = b.g AND a.match_id < b.match_id WHERE least(a.t1, b.t1) - greatest(a.t0, b.t0) >= 1000000000""")
def jn21_rivals(spark, sf_dir):
    spans = frames(spark, sf_dir).where("half = 1").groupBy("match_id").agg(F.min("t").alias("t0"), F.max("t").alias("t1")).withColumn("team", C("match_id") % 4)
    return jn.overlaps_in_time(spans, ["team"], "match_id", "t0", "t1", 1_000_000_000, 400 * HOUR)


@query(""" SELECT match_id, team, frame FROM frames p WHERE kind = 'view' AND NOT EXISTS (SELECT 1 FROM frames s WHERE s.kind = 'signup' AND s.team = p.team AND s.match_id = p.match_id AND abs(s.t - p.t) <= 21600000)""")
def jn22_passes_without_shots(spark, sf_dir):
    f = frames(spark, sf_dir)
    return jn.near_events(f.where("kind = 'view'"), f.where("kind = 'signup'"), ["match_id", "team"], "t", 6 * HOUR).select("match_id", "team", "frame")


@query(""", s AS (SELECT match_id, frame, lead(frame) OVER (PARTITION BY match_id ORDER BY t) AS i1, t FROM frames WHERE team IS NOT NULL) SELECT match_id, frame FROM s WHERE NOT EXISTS (SELECT 1 FROM frames k WHERE k.frame = s.i1 AND k.kind = 'signup')""")
def jn23_segments_without_shots(spark, sf_dir):
    from pyspark.sql import Window

    f = frames(spark, sf_dir)
    s = f.where("team is not null").select("match_id", "frame", F.lead("frame").over(Window.partitionBy("match_id").orderBy("t")).alias("i1"))
    shots = f.where("kind = 'signup'").select(C("frame").alias("i1"))
    return s.join(shots, "i1", "left_anti").select("match_id", "frame")


@query(""", g AS (SELECT match_id, frame AS goal, t FROM frames WHERE kind = 'purchase')
SELECT g.match_id, g.goal, count(f.frame) AS controls, max_by(f.team, f.t) AS last_team, round(max(f.x), 6) AS farthest FROM g LEFT JOIN frames f ON f.match_id = g.match_id AND f.team IS NOT NULL AND f.t BETWEEN g.t - 36000000 AND g.t - 1 GROUP BY 1, 2""")
def jn24_goal_trace(spark, sf_dir):
    f = frames(spark, sf_dir)
    goals = f.where("kind = 'purchase'").select("match_id", C("frame").alias("goal"), (C("t") - 10 * HOUR).alias("t0"), (C("t") - 1).alias("t1"))
    both = jn.interval_join(f.where("team is not null").select("match_id", "t", "team", "x"), goals, ["match_id"], "t", "t0", "t1", 10 * HOUR)
    found = both.groupBy("match_id", "goal").agg(F.count("*").alias("controls"), F.max_by("team", "t").alias("last_team"), r6(F.max("x")).alias("farthest"))
    return goals.select("match_id", "goal").join(found, ["match_id", "goal"], "left").withColumn("controls", F.coalesce("controls", F.lit(0)))


@query(""" SELECT f.match_id, f.frame, g.team AS label FROM frames f LEFT JOIN (SELECT match_id, frame, team FROM frames WHERE kind = 'view') g USING (match_id, frame) WHERE f.x > 30""")
def jn26_labels_of_frames(spark, sf_dir):
    f = frames(spark, sf_dir)
    return f.where("x > 30").select("match_id", "frame").join(f.where("kind = 'view'").select("match_id", "frame", C("team").alias("label")), ["match_id", "frame"], "left")
