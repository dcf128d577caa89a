"""Queries on cleaning and aggregates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trackforge.functions import scalar as fn
from trackforge.operators import clean, nearest, report, teams
from trackforge.operators import measures as ag
from trackforge.plans.catalog import query, r6
from trackforge.plans.joins import MOMENTS_SQL, analyses, moments
from trackforge.plans.scalars import BOXES_SQL, boxes
from trackforge.recast import LENGTH, WIDTH, frames, table

C = F.col
HOUR = 3_600_000


@query(""" SELECT match_id, frame FROM frames WHERE (kind = 'purchase' AND x > 2 AND x < 54 AND y > 2 AND y < 30.36::DOUBLE) OR (kind <> 'purchase' AND x > 1 AND x < 55 AND y > 1 AND y < 31.36::DOUBLE)""")
def flt01_pitch_margin(spark, sf_dir):
    ball = C("kind") == "purchase"
    keep = F.when(ball, fn.inside(C("x"), C("y"), LENGTH, WIDTH, -2.0)).otherwise(fn.inside(C("x"), C("y"), LENGTH, WIDTH, -1.0))
    return frames(spark, sf_dir).where(keep).select("match_id", "frame")


CANDIDATES_SQL = ", c AS (SELECT t // 3600000 AS moment, frame AS id, match_id % 2 AS cam, value AS quality, x, y FROM frames WHERE x IS NOT NULL)"


def candidates(spark, sf_dir):
    return frames(spark, sf_dir).where("x is not null").select(F.floor(C("t") / HOUR).alias("moment"), C("value").alias("quality"), C("frame").alias("id"), (C("match_id") % 2).alias("cam"), "x", "y")


GREEDY_SQL = CANDIDATES_SQL + """, n AS (SELECT *, row_number() OVER (PARTITION BY moment ORDER BY quality, id) AS r FROM c),
g AS (SELECT moment, 1 AS r, [{{'cam': cam, 'x': x, 'y': y}}] AS kept, true AS k, id FROM n WHERE r = 1
UNION ALL SELECT n.moment, n.r, CASE WHEN {clash} THEN g.kept ELSE list_append(g.kept, {{'cam': n.cam, 'x': n.x, 'y': n.y}}) END, NOT ({clash}), n.id FROM g JOIN n ON n.moment = g.moment AND n.r = g.r + 1)
SELECT moment, id FROM g WHERE k"""
NEAR_SQL = "len(list_filter(g.kept, lambda q: {extra}sqrt(power(q.x - n.x, 2) + power(q.y - n.y, 2)) < {d})) > 0"


@query(GREEDY_SQL.format(clash=NEAR_SQL.format(extra="q.cam <> n.cam AND ", d="12.5")))
def flt02_two_lens_duplicates(spark, sf_dir):
    return clean.keep_apart(candidates(spark, sf_dir), ["moment"], ["quality", "id"], "id", 12.5, other="cam").select("moment", "id")


@query(GREEDY_SQL.format(clash=NEAR_SQL.format(extra="", d="9.0")))
def flt07_flt08_near_duplicates(spark, sf_dir):
    return clean.keep_apart(candidates(spark, sf_dir), ["moment"], ["quality", "id"], "id", 9.0).select("moment", "id")


@query(GREEDY_SQL.format(clash=NEAR_SQL.format(extra="", d="9.0")).replace("SELECT moment, id FROM g WHERE k", "SELECT moment, count(*) AS people FROM g WHERE k GROUP BY 1"))
def flt04_person_count(spark, sf_dir):
    kept = clean.keep_apart(candidates(spark, sf_dir), ["moment"], ["quality", "id"], "id", 9.0)
    return kept.groupBy("moment").agg(F.count("*").alias("people"))


@query(CANDIDATES_SQL + " SELECT moment, id, CAST(row_number() OVER (PARTITION BY moment ORDER BY quality DESC, id) AS INT) AS rank FROM c QUALIFY row_number() OVER (PARTITION BY moment ORDER BY quality DESC, id) <= 3")
def flt03_top_balls(spark, sf_dir):
    return clean.top_by_key(candidates(spark, sf_dir), ["moment"], [F.desc("quality"), F.asc("id")], 3).select("moment", "id", "rank")


@query(f"""WITH b AS ({BOXES_SQL}) SELECT frame, id FROM b a WHERE kind = 'ball' AND NOT EXISTS (SELECT 1 FROM b c WHERE c.frame = a.frame AND c.kind = 'player' AND (a.x1 + a.x2) / 2 >= c.x1 + (c.x2 - c.x1) * 0.3::DOUBLE / 2 AND (a.x1 + a.x2) / 2 <= c.x2 - (c.x2 - c.x1) * 0.3::DOUBLE / 2 AND (a.y1 + a.y2) / 2 >= c.y1 AND (a.y1 + a.y2) / 2 <= c.y1 + 0.6::DOUBLE * (c.y2 - c.y1))""", frames=False)
def flt05_ball_not_on_body(spark, sf_dir):
    b = boxes(spark, sf_dir)
    u, v = (C("l.x1") + C("l.x2")) / 2, (C("l.y1") + C("l.y2")) / 2
    on = fn.on_upper_body(u, v, [C(f"r.{k}") for k in ("x1", "y1", "x2", "y2")])
    return nearest.overlapping(b.where("kind = 'ball'"), b.where("kind = 'player'"), ["frame"], on, "left_anti").select("frame", "id")


@query(MOMENTS_SQL + """, n AS (SELECT b.moment, b.b, b.x, b.y, min(sqrt(power(b.x - p.x, 2) + power(b.y - p.y, 2))) AS d FROM ball b LEFT JOIN people p USING (moment) GROUP BY 1, 2, 3, 4),
s AS (SELECT CAST(floor(x / 4) AS BIGINT) AS cx, CAST(floor(y / 4) AS BIGINT) AS cy FROM n WHERE coalesce(d, 1e9) > 3 GROUP BY 1, 2 HAVING count(DISTINCT moment) >= 0.03 * (SELECT count(DISTINCT moment) FROM ball)),
o AS (SELECT unnest([-1, 0, 1]) AS o), k AS (SELECT DISTINCT s.cx + a.o AS cx, s.cy + b.o AS cy FROM s, o a, o b)
SELECT moment, b FROM n LEFT JOIN k ON k.cx = floor(n.x / 4) AND k.cy = floor(n.y / 4) WHERE k.cx IS NULL OR coalesce(d < 1.5, false)""")
def flt06_spare_balls(spark, sf_dir):
    ball, people = moments(spark, sf_dir)
    n = nearest.nearest_in_key(ball, people, ["moment"], "b", "p")
    total = ball.agg(F.countDistinct("moment")).first()[0]
    cells = clean.standing_cells(n, "moment", total, 4.0, 0.03, F.coalesce(C("distance"), F.lit(1e9)) > 3)
    return clean.without_standing(n, cells, 4.0, C("distance") < 1.5).select("moment", "b")


@query(""" SELECT match_id, round(avg(CAST(NOT (x BETWEEN 2.7 AND 53.3 AND y BETWEEN 2.7 AND 29.66) AS INT)), 6) AS outside_share FROM frames WHERE x IS NOT NULL GROUP BY 1""")
def flt09_outside_share(spark, sf_dir):
    out = ~fn.inside_closed(C("x"), C("y"), LENGTH, WIDTH, -2.7)
    return frames(spark, sf_dir).where("x is not null").groupBy("match_id").agg(r6(F.avg(out.cast("int"))).alias("outside_share"))


@query(""" SELECT match_id, frame FROM frames WHERE half = 1 AND t >= 1704153600000 AND t < 1704240000000""")
def flt10_snk08_cut(spark, sf_dir):
    return frames(spark, sf_dir).where("half = 1 and t >= 1704153600000 and t < 1704240000000").select("match_id", "frame")


@query("SELECT doc_id FROM labels WHERE quality IN (0, 1) AND toxic IS NOT NULL", frames=False)
def flt11_judged_rows(spark, sf_dir):
    return table(spark, sf_dir, "labels").where("quality in (0, 1) and toxic is not null").select("doc_id")


@query(""" SELECT match_id, half, round(100 * count(*) FILTER (team = 0) / nullif(count(team), 0)::DOUBLE, 6) AS team0, round(100 * count(team) / count(*)::DOUBLE, 6) AS assigned, round(100 * avg(CASE WHEN seen IS NOT NULL THEN CAST(seen = 'o' AS INT) END), 6) AS out_percent FROM frames GROUP BY GROUPING SETS ((match_id, half), (match_id))""")
def ag01_ag02_possession_share(spark, sf_dir):
    team = C("team")
    return ag.by_scope(frames(spark, sf_dir), "match_id", "half", [], [r6(ag.percent(team == 0, team.isNotNull())).alias("team0"), r6(ag.percent(team.isNotNull())).alias("assigned"), r6(ag.percent(C("seen") == "o", C("seen").isNotNull())).alias("out_percent")])


DIRECTION_SQL = ", dir AS (SELECT match_id, half, coalesce(avg(x) FILTER (team = 0) < avg(x) FILTER (team = 1), false) AS r0 FROM frames GROUP BY 1, 2), nx AS (SELECT f.*, CASE WHEN (team = 0) = r0 THEN x ELSE 56 - x END AS xn, CASE WHEN (team = 0) = r0 THEN y ELSE 32.36::DOUBLE - y END AS yn FROM frames f JOIN dir USING (match_id, half) WHERE team IS NOT NULL AND x IS NOT NULL)"


def normalised(spark, sf_dir):
    f = frames(spark, sf_dir)
    d = ag.attack_directions(f, ["match_id", "half"], "team", "x", ["frame"])
    rows = f.where("team is not null and x is not null").join(d, ["match_id", "half", "team"])
    return rows.withColumn("xn", fn.mirrored(C("x"), C("right"), LENGTH)).withColumn("yn", fn.mirrored(C("y"), C("right"), WIDTH))


@query(DIRECTION_SQL + " SELECT match_id, half, team, round(100 * avg(CAST(xn < 56 / 3.0::DOUBLE AS INT)), 6) AS own, round(100 * avg(CAST(xn >= 56 / 3.0::DOUBLE AND xn < 112 / 3.0::DOUBLE AS INT)), 6) AS middle, round(100 * avg(CAST(xn >= 112 / 3.0::DOUBLE AS INT)), 6) AS final, round(100 * avg(CAST(xn >= 28 AS INT)), 6) AS opponent_half FROM nx GROUP BY GROUPING SETS ((match_id, half, team), (match_id, team))")
def ag03_thirds(spark, sf_dir):
    shares = [r6(c).alias(n) for c, n in zip(ag.thirds(C("xn"), LENGTH), ("own", "middle", "final", "opponent_half"), strict=True)]
    return ag.by_scope(normalised(spark, sf_dir), "match_id", "half", ["team"], shares)


@query(DIRECTION_SQL + " SELECT match_id, half, 0 AS team, r0 AS \"right\" FROM dir UNION ALL SELECT match_id, half, 1, NOT r0 FROM dir")
def ag04_attack_direction(spark, sf_dir):
    return ag.attack_directions(frames(spark, sf_dir), ["match_id", "half"], "team", "x", ["frame"])


@query(DIRECTION_SQL + ", f AS (SELECT match_id, half, team, t // 86400000 AS d, count(*) AS n, avg(xn) AS h, max(xn) - min(xn) AS l, max(yn) - min(yn) AS w FROM nx GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2) SELECT half, team, round(avg(h), 6) AS average_position, round(avg(l), 6) AS team_length, round(avg(w), 6) AS team_width, count(*) AS frames FROM f GROUP BY 1, 2")
def ag05_team_shape(spark, sf_dir):
    rows = normalised(spark, sf_dir).withColumn("day", F.floor(C("t") / (24 * HOUR)))
    s = ag.team_shape(rows, ["match_id", "half", "team", "day"], ["half", "team"], "xn", "yn", 2)
    return s.select("half", "team", *(r6(C(c)).alias(c) for c in ("average_position", "team_length", "team_width")), "frames")


@query(DIRECTION_SQL + """ SELECT match_id, half, team, count(*) FILTER (kind = 'view') AS passes, count(*) FILTER (kind = 'view' AND xn >= 28) AS passes_forward, round(100 * count(*) FILTER (kind = 'view' AND yn > 16) / nullif(count(*) FILTER (kind = 'view'), 0)::DOUBLE, 6) AS accuracy, count(*) FILTER (kind = 'signup') AS shots, round(coalesce(sum(xn / 56) FILTER (kind = 'signup'), 0), 6) AS xg, count(*) FILTER (kind = 'signup' AND xn / 56 >= 0.25) AS big_chances FROM nx GROUP BY GROUPING SETS ((match_id, half, team), (match_id, team))""")
def ag08_action_totals(spark, sf_dir):
    passed, shot = C("kind") == "view", C("kind") == "signup"
    totals = [F.count_if(passed).alias("passes"), F.count_if(passed & (C("xn") >= 28)).alias("passes_forward"), r6(ag.percent(C("yn") > 16, passed)).alias("accuracy"), F.count_if(shot).alias("shots"), r6(F.coalesce(F.sum(F.when(shot, C("xn") / 56)), F.lit(0.0))).alias("xg"), F.count_if(shot & (C("xn") / 56 >= 0.25)).alias("big_chances")]
    return ag.by_scope(normalised(spark, sf_dir), "match_id", "half", ["team"], totals)


@query(""" SELECT match_id, round(100 * count(x) / count(*)::DOUBLE, 6) AS ball_visible, round(100 * count(*) FILTER (kind = 'signup') / nullif(count(*) FILTER (kind IN ('signup', 'purchase')), 0)::DOUBLE, 6) AS goals_as_shots FROM frames GROUP BY 1""")
def ag09_actions_quality(spark, sf_dir):
    kind = C("kind")
    return frames(spark, sf_dir).groupBy("match_id").agg(r6(ag.percent(C("x").isNotNull())).alias("ball_visible"), r6(ag.percent(kind == "signup", kind.isin("signup", "purchase"))).alias("goals_as_shots"))


@query(""", s AS (SELECT match_id, frame, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) AS v FROM frames WHERE x IS NOT NULL WINDOW w AS (PARTITION BY match_id ORDER BY frame)),
r AS (SELECT match_id, sum(CAST(NOT coalesce(v >= 15, false) AS INT)) OVER (PARTITION BY match_id ORDER BY frame) AS g, coalesce(v >= 15, false) AS f FROM s), q AS (SELECT match_id, g, count(*) AS n FROM r WHERE f GROUP BY 1, 2 HAVING count(*) >= 3), p AS (SELECT match_id, count(*) AS sprints FROM q GROUP BY 1),
a AS (SELECT match_id, round(sum(v), 5) AS distance, round(avg(v), 6) AS average, round(quantile_cont(v, 0.99), 6) AS top, round(coalesce(sum(v) FILTER (v >= 10), 0), 5) AS intense, round(100 * count(v) / count(*)::DOUBLE, 6) AS counted FROM s GROUP BY 1)
SELECT a.*, coalesce(sprints, 0) AS sprints FROM a LEFT JOIN p USING (match_id)""")
def ag10_ag11_stint_statistics(spark, sf_dir):
    w = Window.partitionBy("match_id").orderBy("frame")
    v = F.hypot(C("x") - F.lag("x").over(w), C("y") - F.lag("y").over(w))
    rows = frames(spark, sf_dir).where("x is not null").select("match_id", "frame", v.alias("v"))
    sprints = ag.runs_at_speed(rows, ["match_id"], "frame", C("v") >= 15, 3)
    stats = rows.groupBy("match_id").agg(F.round(F.sum("v"), 5).alias("distance"), r6(F.avg("v")).alias("average"), r6(F.percentile("v", F.lit(0.99))).alias("top"), F.round(F.coalesce(F.sum(F.when(C("v") >= 10, C("v"))), F.lit(0.0)), 5).alias("intense"), r6(ag.percent(C("v").isNotNull())).alias("counted"))
    return stats.join(sprints, "match_id")


@query("""WITH s AS (SELECT o_custkey % 40 AS team, sum(o_totalprice) AS d, count(*) AS m FROM orders GROUP BY o_custkey) SELECT team, round(sum(d) / sum(m), 4) AS rate, round(sum(d) / sum(m) * 5 * 40, 4) AS team_distance, count(*) AS stints FROM s GROUP BY 1""", frames=False)
def ag12_team_distance(spark, sf_dir):
    s = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("d"), F.count("*").alias("m")).withColumn("team", C("o_custkey") % 40)
    rate = F.sum("d") / F.sum("m")
    return s.groupBy("team").agg(F.round(rate, 4).alias("rate"), F.round(rate * 5 * 40, 4).alias("team_distance"), F.count("*").alias("stints"))


@query("WITH e AS (SELECT label, unnest(embedding) AS value, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) SELECT label, CAST(pos AS INT) AS pos, round(median(value::DOUBLE), 6) AS median FROM e GROUP BY 1, 2", frames=False)
def ag13_median_vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("label", C("embedding").cast("array<double>").alias("v"))
    return ag.medians(e, ["label"], "v").withColumn("median", r6(C("median")))


@query(""", c AS (SELECT match_id, half, team, count(*) AS c, min(frame) AS o FROM frames WHERE team IS NOT NULL GROUP BY 1, 2, 3) SELECT match_id, half, team, c AS votes FROM c QUALIFY row_number() OVER (PARTITION BY match_id, half ORDER BY c DESC, o) = 1""")
def ag14_majority_vote(spark, sf_dir):
    return ag.majority(frames(spark, sf_dir), ["match_id", "half"], "team", "frame")


@query("SELECT quality AS a, toxic AS b, count(*) AS n FROM labels GROUP BY 1, 2", frames=False)
def ag15_confusion(spark, sf_dir):
    return ag.confusion(analyses(spark, sf_dir), "a", "b")


@query("SELECT count(*) AS judged, count(*) FILTER (quality = toxic) AS \"right\", round(avg(CAST(quality = toxic AS INT)), 6) AS accuracy FROM labels", frames=False)
def ag15_accuracy(spark, sf_dir):
    return ag.accuracy(analyses(spark, sf_dir), "a", "b").withColumn("accuracy", r6(C("accuracy")))


@query("WITH w AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem WHERE l_returnflag <> l_linestatus GROUP BY 1, 2) SELECT *, CAST(row_number() OVER (ORDER BY n DESC, a, b) AS INT) AS rank FROM w QUALIFY rank <= 4", frames=False)
def ag15_rk01_top_mistakes(spark, sf_dir):
    return ag.worst(table(spark, sf_dir, "lineitem").select(C("l_returnflag").alias("a"), C("l_linestatus").alias("b")), "a", "b", 4)


@query("""WITH l AS (SELECT source, quality = 1 AS real, toxic = 0 AS done, 1 AS found, CASE WHEN n_chars > 1500 THEN 2 ELSE 0 END AS counted FROM labels JOIN documents USING (doc_id))
SELECT source, count(real) AS judged, round(avg(CAST(real AS INT)), 6) AS precision, round(avg(CASE WHEN real THEN CAST(done AS INT) END), 6) AS agreement, round(CASE WHEN sum(counted) > 0 THEN least(1.0, sum(found) * avg(CAST(real AS INT)) / sum(counted)) END, 6) AS recall FROM l GROUP BY 1""", frames=False)
def ag16_precision_recall(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    l = table(spark, sf_dir, "labels").join(docs, "doc_id")  # noqa: E741
    p = ag.precision_recall(l, "source", C("quality") == 1, C("toxic") == 0, F.lit(1), F.when(C("n_chars") > 1500, 2).otherwise(0))
    return p.select("source", "judged", *(r6(C(c)).alias(c) for c in ("precision", "agreement", "recall")))


@query("""WITH l AS (SELECT quality AS a, CASE WHEN n_chars > 1500 THEN 1 WHEN n_chars > 500 THEN 0 END AS b FROM labels JOIN documents USING (doc_id)) SELECT round(100 * count(b) / count(*)::DOUBLE, 6) AS both_named, round(100 * avg(CAST(a = b AS INT)), 6) AS same, round(100 * avg(CAST((a IS NULL) <> (b IS NULL) AS INT)), 6) AS only_one FROM l""", frames=False)
def ag17_pairwise_agreement(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    l = table(spark, sf_dir, "labels").join(docs, "doc_id").select(C("quality").alias("a"), F.when(C("n_chars") > 1500, 1).when(C("n_chars") > 500, 0).alias("b"))  # noqa: E741
    named = C("a").isNotNull() & C("b").isNotNull()
    return l.agg(r6(ag.percent(named)).alias("both_named"), r6(ag.percent(C("a") == C("b"), named)).alias("same"), r6(ag.percent(C("a").isNull() != C("b").isNull())).alias("only_one"))


@query(f"WITH b AS ({BOXES_SQL}), f AS (SELECT frame, count(*) AS n, median(x2 - x1) AS w FROM b GROUP BY 1) SELECT count(*) AS lens_frames, round(avg(n), 6) AS mean_boxes, round(median(n), 6) AS median_boxes, round(avg(CAST(n > 1 AS INT)), 6) AS share_multiple, round(median(w), 6) AS median_width FROM f", frames=False)
def ag18_duplicates_per_frame(spark, sf_dir):
    f = boxes(spark, sf_dir).groupBy("frame").agg(F.count("*").alias("n"), F.median(C("x2") - C("x1")).alias("w"))
    return f.agg(F.count("*").alias("lens_frames"), r6(F.avg("n")).alias("mean_boxes"), r6(F.median("n")).alias("median_boxes"), r6(F.avg((C("n") > 1).cast("int"))).alias("share_multiple"), r6(F.median("w")).alias("median_width"))


@query(""", c AS (SELECT t // 3600000 AS h, t // 60000 AS m, count(*) AS n FROM frames GROUP BY 1, 2) SELECT h, CAST(trunc(median(n)) AS BIGINT) AS people FROM c GROUP BY 1""")
def ag20_people_per_hour(spark, sf_dir):
    c = frames(spark, sf_dir).groupBy(F.floor(C("t") / HOUR).alias("h"), F.floor(C("t") / 60000).alias("m")).agg(F.count("*").alias("n"))
    return c.groupBy("h").agg(F.median("n").cast("long").alias("people"))


@query("""WITH s AS (SELECT d.source, d.n_chars AS score, l.quality = 1 AS p FROM labels l JOIN documents d USING (doc_id)) SELECT a.source, round(avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END), 6) AS auc FROM s a JOIN s b ON a.source = b.source AND a.p AND NOT b.p GROUP BY 1""", frames=False)
def ag21_auc(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    s = table(spark, sf_dir, "labels").join(docs, "doc_id")
    return ag.auc(s, ["source"], "n_chars", C("quality") == 1).where("auc is not null").withColumn("auc", r6(C("auc")))


@query(""", c AS (SELECT team, least(greatest(CAST(trunc(x / 56 * 28) AS INT), 0), 27) AS ix, least(greatest(CAST(trunc(y / 32.36::DOUBLE * 16) AS INT), 0), 15) AS iy, count(*) AS n FROM frames WHERE team IS NOT NULL AND x IS NOT NULL GROUP BY 1, 2, 3) SELECT *, round(n / max(n) OVER (PARTITION BY team)::DOUBLE, 6) AS share FROM c""")
def ag22_heat_grid(spark, sf_dir):
    rows = frames(spark, sf_dir).where("team is not null and x is not null")
    return ag.heat_grid(rows, ["team"], fn.clipped_bin(C("x"), LENGTH, 28), fn.clipped_bin(C("y"), WIDTH, 16)).withColumn("share", r6(C("share")))


@query("SELECT CAST(least(floor(least(l_quantity, 30) / 2), 14) AS BIGINT) AS bin, count(*) AS n FROM lineitem GROUP BY 1", frames=False)
def ag23_clipped_histogram(spark, sf_dir):
    b = F.least(F.floor(F.least(C("l_quantity"), F.lit(30.0)) / 2), F.lit(14).cast("long"))
    return table(spark, sf_dir, "lineitem").groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


@query(" SELECT match_id, count(*) FILTER (team = 0) AS team0, count(*) FILTER (team = 1) AS team1, string_agg(printf('%d:%02d', t // 60000 % 90, t // 1000 % 60), ',' ORDER BY t) AS goals, (least(count(*) FILTER (team = 0), count(*) FILTER (team = 1)) = 2) AS as_expected FROM frames WHERE kind = 'signup' GROUP BY 1")
def ag24_ag33_ag37_score_and_goal_list(spark, sf_dir):
    text = F.format_string("%d:%02d", F.floor(C("t") / 60000) % 90, F.floor(C("t") / 1000) % 60)
    goals = frames(spark, sf_dir).where("kind = 'signup'").groupBy("match_id").agg(F.count_if(C("team") == 0).alias("team0"), F.count_if(C("team") == 1).alias("team1"), F.array_sort(F.collect_list(F.struct("t", text.alias("s")))).alias("g"))
    return goals.select("match_id", "team0", "team1", F.array_join(F.transform("g", lambda x: x["s"]), ",").alias("goals"), (F.least("team0", "team1") == 2).alias("as_expected"))


@query("""WITH e AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings WHERE embedding IS NOT NULL)
SELECT a.label, CAST(a.i AS INT) AS i, CAST(b.i AS INT) AS j, count(*) AS n, round(covar_samp(a.x, b.x), 6) AS cov FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY 1, 2, 3""", frames=False)
def ag27_discriminant_moments(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("label", C("embedding").cast("array<double>").alias("v"))
    return teams.covariances(e, "label", "v", e.agg(F.max(F.size("v"))).first()[0] or 0).withColumn("cov", r6(C("cov")))


@query("SELECT count(*) AS hidden, count(*) FILTER (l_discount > 0.02) AS filled, count(*) FILTER (l_discount > 0.02 AND abs(l_tax - l_discount) <= 0.03) AS right_ones, l_returnflag AS method FROM lineitem GROUP BY l_returnflag", frames=False)
def ag28_ag29_holdout_scores(spark, sf_dir):
    filled = C("l_discount") > 0.02
    return table(spark, sf_dir, "lineitem").groupBy(C("l_returnflag").alias("method")).agg(F.count("*").alias("hidden"), F.count_if(filled).alias("filled"), F.count_if(filled & (F.abs(C("l_tax") - C("l_discount")) <= 0.03)).alias("right_ones"))


@query("SELECT o_orderpriority AS line, round(median(o_totalprice), 6) AS at, round(sqrt(avg(power(o_totalprice / 1000 - 100, 2))), 6) AS rmse, round(avg(abs(o_totalprice / 1000 - 100)), 6) AS mean_distance FROM orders GROUP BY 1", frames=False)
def ag31_ag36_calibration_measures(spark, sf_dir):
    off = C("o_totalprice") / 1000 - 100
    return table(spark, sf_dir, "orders").groupBy(C("o_orderpriority").alias("line")).agg(r6(F.median("o_totalprice")).alias("at"), r6(F.sqrt(F.avg(off * off))).alias("rmse"), r6(F.avg(F.abs(off))).alias("mean_distance"))


@query("SELECT count(*) FILTER (value > 100) AS fast, count(*) FILTER (value > 100 AND x > 28) AS fast_and_far, count(*) FILTER (x > 28) AS far, count(*) AS goals FROM (SELECT value, value % 56.0::DOUBLE AS x FROM events WHERE event_type = 'purchase')", frames=False)
def ag30_trace_summary(spark, sf_dir):
    fast, far = C("value") > 100, C("x") > 28
    return frames(spark, sf_dir).where("kind = 'purchase'").agg(F.count_if(fast).alias("fast"), F.count_if(fast & far).alias("fast_and_far"), F.count_if(far).alias("far"), F.count("*").alias("goals"))


@query(""", g AS (SELECT match_id, frame AS w, t FROM frames WHERE kind = 'signup'), m AS (SELECT g.w, count(*) AS n, median(f.x) - 28 AS ox, median(f.y) - 16.18::DOUBLE AS oy FROM g JOIN frames f ON f.match_id = g.match_id AND f.x IS NOT NULL AND f.t BETWEEN g.t - 129600000 AND g.t + 43200000 GROUP BY 1 HAVING count(*) >= 3) SELECT count(*) AS events, round(median(ox), 6) AS x_off, round(median(oy), 6) AS y_off, round(max(abs(ox)), 6) AS x_most FROM m""")
def ag34_ball_offset(spark, sf_dir):
    f = frames(spark, sf_dir)
    windows = f.where("kind = 'signup'").select("match_id", C("frame").alias("w"), (C("t") - 36 * HOUR).alias("t0"), (C("t") + 12 * HOUR).alias("t1"))
    both = nearest.interval_join(f.where("x is not null").select("match_id", "t", "x", "y"), windows, ["match_id"], "t", "t0", "t1", 48 * HOUR)
    m = both.groupBy("w").agg(F.count("*").alias("n"), (F.median("x") - 28).alias("ox"), (F.median("y") - 16.18).alias("oy")).where("n >= 3")
    return m.agg(F.count("*").alias("events"), r6(F.median("ox")).alias("x_off"), r6(F.median("oy")).alias("y_off"), r6(F.max(F.abs("ox"))).alias("x_most"))


@query("""WITH e AS (SELECT label, vec_id, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM embeddings), v AS (SELECT label, r, n, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM e)
SELECT label, CAST(pos AS INT) AS pos, round(avg(v) FILTER (r <= n // 2), 6) AS first_half, round(avg(v) FILTER (r > n // 2), 6) AS second_half FROM v GROUP BY 1, 2""", frames=False)
def ag35_split_half_means(spark, sf_dir):
    w = Window.partitionBy("label")
    e = table(spark, sf_dir, "embeddings").select("label", "embedding", F.row_number().over(w.orderBy("vec_id")).alias("r"), F.count("*").over(w).alias("n"))
    e = e.select("label", "r", "n", F.posexplode(C("embedding").cast("array<double>")).alias("pos", "v"))
    early = C("r") <= F.floor(C("n") / 2)
    return e.groupBy("label", "pos").agg(r6(F.avg(F.when(early, C("v")))).alias("first_half"), r6(F.avg(F.when(~early, C("v")))).alias("second_half"))


@query("SELECT l_shipdate::DATE AS day, CAST(NULL AS VARCHAR) AS flag, sum(l_quantity) AS km FROM lineitem GROUP BY 1 UNION ALL SELECT l_shipdate::DATE, l_returnflag, sum(l_quantity) FROM lineitem GROUP BY 1, 2", frames=False)
def src14_ag32_rollup(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("day"), C("l_returnflag").alias("flag"), "l_quantity")
    return rows.groupingSets([["day", "flag"], ["day"]], "day", "flag").agg(F.sum("l_quantity").alias("km"))


@query("""WITH p AS (SELECT o_custkey AS c, count(*) AS orders, round(sum(o_totalprice), 4) AS total FROM orders GROUP BY 1), q AS (SELECT c_custkey AS c, c_acctbal AS balance FROM customer WHERE c_acctbal > 0) SELECT coalesce(p.c, q.c) AS c, orders, total, balance, CASE WHEN orders IS NULL THEN '-' ELSE printf('%d', orders) END AS label FROM p FULL JOIN q ON p.c = q.c""", frames=False)
def ag38_report_collection(spark, sf_dir):
    p = table(spark, sf_dir, "orders").groupBy(C("o_custkey").alias("c")).agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 4).alias("total"))
    q = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(C("c_custkey").alias("c"), C("c_acctbal").alias("balance"))
    return p.join(q, "c", "full").withColumn("label", fn.report_value(C("orders"), "int"))


@query(f"WITH b AS ({BOXES_SQL}) SELECT frame, id, CAST(rank() OVER (PARTITION BY frame ORDER BY x2 DESC) AS INT) AS rank FROM b QUALIFY rank <= 2", frames=False)
def rk02_boxes_by_confidence(spark, sf_dir):
    w = Window.partitionBy("frame").orderBy(F.desc("x2"))
    return boxes(spark, sf_dir).select("frame", "id", F.rank().over(w).alias("rank")).where("rank <= 2")


@query(f"WITH b AS ({BOXES_SQL}), m AS (SELECT frame, count(*) FILTER (kind = 'ball') AS balls, count(*) FILTER (kind = 'player') AS players FROM b GROUP BY 1) SELECT least(balls, 3) AS balls, count(*) AS frames, CAST(sum(players) AS BIGINT) AS players FROM m GROUP BY 1", frames=False)
def ag19_label_counters(spark, sf_dir):
    m = boxes(spark, sf_dir).groupBy("frame").agg(F.count_if(C("kind") == "ball").alias("balls"), F.count_if(C("kind") == "player").alias("players"))
    return m.groupBy(F.least("balls", F.lit(3).cast("long")).alias("balls")).agg(F.count("*").alias("frames"), F.sum("players").alias("players"))


@query(""", d AS (SELECT match_id, half, CAST(coalesce(avg(x) FILTER (team = 0) < avg(x) FILTER (team = 1), false) AS BOOLEAN) AS r0 FROM frames GROUP BY 1, 2),
f AS (SELECT match_id, half, team, CASE WHEN (team = 0) = r0 THEN x ELSE 56 - x END AS xn, kind, value FROM frames JOIN d USING (match_id, half) WHERE team IS NOT NULL),
g AS (SELECT match_id, half FROM d UNION SELECT match_id, 0 FROM d), w AS (SELECT match_id, g.half, t.team FROM g, (SELECT unnest([0, 1]) AS team) t),
h AS (SELECT w.match_id, w.half, w.team, f.xn, f.kind, f.value FROM w LEFT JOIN f ON f.match_id = w.match_id AND f.team = w.team AND (w.half = 0 OR f.half = w.half)),
n AS (SELECT w.match_id, w.half, count(*) AS n FROM (SELECT DISTINCT match_id, half FROM w) w JOIN f ON f.match_id = w.match_id AND (w.half = 0 OR f.half = w.half) GROUP BY 1, 2),
v AS (SELECT match_id, half, team, count(kind)::DOUBLE AS c, 100 * avg(CAST(xn >= 28 AS INT)) AS opp, 100 * avg(CAST(xn < 56 / 3.0::DOUBLE AS INT)) AS own, count(*) FILTER (kind = 'view')::DOUBLE AS pa, count(*) FILTER (kind = 'view' AND value > 50)::DOUBLE AS pc, 100 * avg(CAST(value > 50 AS INT)) FILTER (kind = 'view') AS acc FROM h GROUP BY 1, 2, 3),
u AS (SELECT v.*, n.n FROM v LEFT JOIN n USING (match_id, half))
SELECT match_id, CASE half WHEN 0 THEN 'match' ELSE 'half_' || half END AS scope, team, m.measure, round(m.value, 6) AS value FROM (SELECT match_id, half, team, unnest([{'measure': 'possession', 'value': 100 * c / n}, {'measure': 'possession_in_opponent_half', 'value': opp}, {'measure': 'own_third', 'value': own}, {'measure': 'passes_attempted', 'value': pa}, {'measure': 'passes_completed', 'value': pc}, {'measure': 'pass_accuracy', 'value': acc}]) AS m FROM u)""")
def ag38_report(spark, sf_dir):
    f = frames(spark, sf_dir)
    directions = ag.attack_directions(f.select("match_id", "half", "team", "x", "frame"), ["match_id", "half"], "team", "x", ["frame"])
    tables = {"possession": f.withColumn("possession", C("team")), "directions": directions, "passes": f.where("kind = 'view'").withColumn("completed", C("value") > 50)}
    wanted = ("possession", "possession_in_opponent_half", "own_third", "passes_attempted", "passes_completed", "pass_accuracy")
    found = report.report(tables, measures=[m for m in report.MEASURES if m.name in wanted])
    return found.withColumn("value", r6(C("value")))
