"""Queries on sampling, teams, actions and stateful operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackforge.operators import actions as act
from trackforge.operators import goals as goal_operators
from trackforge.operators import ball, colours, evaluate, islands, kickoff_teams, players, sampling, separation, shots, smoothing, stateful, teams
from trackforge.params import Actions, Ball, Pitch, Possession, Tracks
from trackforge.plans.catalog import query, r6
from trackforge.plans.islands import KEYS, SEQUENCES, sequences
from trackforge.recast import LENGTH, frames, table

C = F.col
HOUR = 3_600_000
PITCH = Pitch(width=32.36)


# ---------------------------------------------------------------- limits, sets, sampling


@query(""" SELECT match_id, frame, value FROM frames QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY value DESC, frame) <= 5""")
def so02_longest_five(spark, sf_dir):
    from trackforge.operators.clean import top_by_key

    return top_by_key(frames(spark, sf_dir), ["match_id"], [F.desc("value"), F.asc("frame")], 5).select("match_id", "frame", "value")


@query(""" SELECT match_id, t, 'goal' AS what FROM frames WHERE kind = 'purchase' UNION ALL SELECT match_id, t, 'shot' FROM frames WHERE kind = 'signup'""")
def so03_union_of_actions(spark, sf_dir):
    f = frames(spark, sf_dir)
    return f.where("kind = 'purchase'").select("match_id", "t", F.lit("goal").alias("what")).unionByName(f.where("kind = 'signup'").select("match_id", "t", F.lit("shot").alias("what")))


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels", frames=False)
def so04_common_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").intersect(table(spark, sf_dir, "labels").select("doc_id"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels", frames=False)
def so05_unlabelled(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id").distinct()


@query(" SELECT DISTINCT match_id, t // 3600000 AS hour FROM frames")
def so06_distinct_times(spark, sf_dir):
    return frames(spark, sf_dir).select("match_id", F.floor(C("t") / HOUR).alias("hour")).distinct()


@query(""", s AS (SELECT match_id, kind, frame, value, row_number() OVER (PARTITION BY match_id, kind ORDER BY value, frame) AS r FROM frames) SELECT match_id, kind, frame FROM s WHERE r = 1""")
def sp02_stratified_first(spark, sf_dir):
    from trackforge.operators.clean import top_by_key

    return top_by_key(frames(spark, sf_dir), ["match_id", "kind"], [F.asc("value"), F.asc("frame")], 1).select("match_id", "kind", "frame")


@query()
def sp01_spaced_permutation(spark, sf_dir):
    return sampling.spaced_sample(frames(spark, sf_dir), ["match_id"], "frame", "t", 24 * HOUR, 10, 7)


@query()
def sp02_round_robin(spark, sf_dir):
    rows = frames(spark, sf_dir).withColumn("day", F.floor(C("t") / (24 * HOUR)))
    return sampling.one_per_stratum(rows, ["match_id"], "day", "frame", 20, 7).select("match_id", "frame", "day", "turn", "place")


@query(""", n AS (SELECT match_id, frame, row_number() OVER (PARTITION BY match_id ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY match_id) AS n FROM frames) SELECT match_id, frame FROM n WHERE i IN (SELECT floor(k * (n - 1) / 6.0) FROM (SELECT unnest(generate_series(0, 6)) AS k))""")
def sp03_evenly_spaced(spark, sf_dir):
    return sampling.evenly(frames(spark, sf_dir), ["match_id"], "frame", 7).select("match_id", "frame")


@query(""" SELECT count(*) FILTER (NOT EXISTS (SELECT 1 FROM frames e WHERE e.match_id = f.match_id AND e.kind = 'signup' AND abs(e.t - f.t) <= 21600000)) AS free FROM frames f WHERE kind = 'view'""")
def sp04_controls_away_from_events(spark, sf_dir):
    f = frames(spark, sf_dir)
    return sampling.away_from(f.where("kind = 'view'"), f.where("kind = 'signup'"), ["match_id"], "frame", "t", 6 * HOUR, 1 << 30, 7).agg(F.count("*").alias("free"))


@query(""" SELECT match_id, t // 86400000 * 86400000 AS t0, count(*) AS n, round(avg(CAST(x IS NOT NULL AS INT)), 6) AS known, round(avg(CAST(coalesce(seen = 'i', false) AS INT)), 6) AS playing FROM frames GROUP BY 1, 2 HAVING avg(CAST(x IS NOT NULL AS INT)) >= 0.5 AND avg(CAST(coalesce(seen = 'i', false) AS INT)) >= 0.7""")
def sp05_busy_windows(spark, sf_dir):
    w = sampling.busy_windows(frames(spark, sf_dir), ["match_id"], "t", 24 * HOUR, C("x").isNotNull(), F.coalesce(C("seen") == "i", F.lit(False)), 0.5, 0.7)
    return w.select("match_id", "t0", "n", r6(C("known")).alias("known"), r6(C("playing")).alias("playing"))


@query(""", h AS (SELECT match_id, half, min(t) AS a, max(t) AS b FROM frames GROUP BY 1, 2) SELECT match_id, half, unnest(range(a, b, 86400000)) AS moment FROM h WHERE b > a""")
def sp06_regular_moments(spark, sf_dir):
    h = frames(spark, sf_dir).groupBy("match_id", "half").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    return sampling.regular(h, "a", "b", 24 * HOUR, "moment").select("match_id", "half", "moment")


# ---------------------------------------------------------------- teams


def longest(vectors):
    """Number of elements of the vectors v."""
    return vectors.agg(F.max(F.size("v"))).first()[0] or 0


@query("""WITH e AS (SELECT vec_id, label % 5 AS match_id, vec_id % 2 AS team, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings WHERE embedding IS NOT NULL), u AS (SELECT match_id, team, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e),
c AS (SELECT match_id, team, i, avg(x) AS a FROM u GROUP BY 1, 2, 3), w AS (SELECT match_id, team, list(a ORDER BY i) AS a FROM c GROUP BY 1, 2),
d AS (SELECT e.vec_id, e.match_id, e.team, w.team AS p, sqrt(list_sum([power(e.v[i] - w.a[i], 2) FOR i IN range(1, len(e.v) + 1)])) AS dist FROM e JOIN w USING (match_id))
SELECT vec_id, match_id, team, p AS predicted, round(dist, 6) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, p) = 1""", frames=False)
def st11_nearest_centre(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", (C("label") % 5).alias("match_id"), (C("vec_id") % 2).alias("team"), C("embedding").cast("array<double>").alias("v"))
    return teams.nearest_centre(e, teams.mean_vectors(e, ["match_id", "team"], "v"), ["match_id"], "v", "team").select("vec_id", "match_id", "team", "predicted", r6(C("distance")).alias("distance"))


def kickoff_players(spark, sf_dir):
    """Vectors as players, at kick-offs of four seconds every ten; and the kick-offs."""
    n = C("vec_id")
    place = [(n % 2 + 1).cast("int").alias("half"), (n % 40 * 1000).alias("t"), (n * 7 % 39 + 9).cast("double").alias("x"), (n % 11 == 0).alias("keeper")]
    rows = table(spark, sf_dir, "embeddings").where("embedding is not null").select((C("label") % 3).alias("match_id"), *place, "vec_id", C("embedding").cast("array<double>").alias("colour"))
    event = F.floor(C("t") / 10_000) * 10_000
    return rows, rows.select(*KEYS, event.alias("event")).distinct().select(*KEYS, "event", (C("event") % 20_000 == 0).alias("by_ball"), C("event").alias("t0"), (C("event") + 4000).alias("t1"))


@query("""WITH p AS (SELECT label % 3 AS match_id, CAST(vec_id % 2 + 1 AS INT) AS half, vec_id % 40 * 1000 AS t, (vec_id * 7 % 39 + 9)::DOUBLE AS x, vec_id % 11 = 0 AS keeper, [v::DOUBLE FOR v IN embedding] AS c FROM embeddings WHERE embedding IS NOT NULL),
k AS (SELECT DISTINCT match_id, half, t // 10000 * 10000 AS event FROM p),
s AS (SELECT match_id, half, event, CASE WHEN x < 28 THEN 0 ELSE 1 END AS side, c FROM p JOIN k USING (match_id, half) WHERE t BETWEEN event AND event + 4000 AND NOT keeper AND abs(x - 28) >= 1.5 AND x BETWEEN 8 AND 48),
n AS (SELECT match_id, half, event FROM s GROUP BY 1, 2, 3 HAVING count(*) FILTER (side = 0) >= 3 AND count(*) FILTER (side = 1) >= 3),
u AS (SELECT match_id, half, event, side, unnest(c) AS v, generate_subscripts(c, 1) AS i FROM s),
m AS (SELECT match_id, half, event, side, list(v ORDER BY i) AS m FROM (SELECT match_id, half, event, side, i, median(v) AS v FROM u GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2, 3, 4),
b AS (SELECT match_id, half, event, any_value(m) FILTER (side = 0) AS a, any_value(m) FILTER (side = 1) AS b FROM m GROUP BY 1, 2, 3),
d AS (SELECT match_id, half, event, median(list_distance(s.c, CASE side WHEN 0 THEN b.a ELSE b.b END)) AS spread FROM s JOIN b USING (match_id, half, event) GROUP BY 1, 2, 3),
r AS (SELECT *, event % 20000 = 0 AS by_ball, list_distance(a, b) AS apart, list_distance(a, b) < 0.2 * spread AS alike FROM n JOIN b USING (match_id, half, event) JOIN d USING (match_id, half, event)),
f AS (SELECT *, first_value(a) OVER w AS fa, first_value(b) OVER w AS fb FROM r WINDOW w AS (PARTITION BY match_id, half ORDER BY alike, by_ball DESC, event))
SELECT match_id, half, event, by_ball, round(apart, 6) AS apart, round(spread, 6) AS spread, CASE WHEN alike THEN 'alike' WHEN list_distance(fa, b) + list_distance(fb, a) < list_distance(fa, a) + list_distance(fb, b) THEN 'swapped' ELSE 'kept' END AS decision FROM f""", frames=False)
def st11_judged_kickoffs(spark, sf_dir):
    rows, kicked = kickoff_players(spark, sf_dir)
    kits = kickoff_teams.Kits(apart=0.2)
    found = kickoff_teams.judged_kickoffs(kickoff_teams.examples(rows, kicked, kits, PITCH), kits)
    return found.select(*KEYS, "event", "by_ball", r6(C("apart")).alias("apart"), r6(C("spread")).alias("spread"), "decision")


@query()
def st11_teams_by_kits(spark, sf_dir):
    rows, kicked = kickoff_players(spark, sf_dir)
    return kickoff_teams.teams_by_kits(rows, kicked, kickoff_teams.Kits(apart=0.2, least_limit=0.5, fade_s=20.0, step_s=5.0))["teams"]


@query()
def st12_self_trained_teams(spark, sf_dir):
    rows, kicked = kickoff_players(spark, sf_dir)
    rows = rows.withColumn("descriptor", C("colour"))
    size = rows.agg(F.max(F.size("descriptor"))).first()[0] or 0
    return kickoff_teams.teams_by_descriptors(rows, kicked, size, ["match_id", "vec_id"], kickoff_teams.Kits(least_pseudo=10, margin=0.5), turns=2)["teams"]


@query()
def st12_linear_discriminant(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", (C("label") % 2).alias("team"), C("embedding").cast("array<double>").alias("v"))
    w, bias = teams.train_discriminant(e, "team", "v", longest(e))
    return e.select("vec_id", "team", teams.score_column(C("v"), w, bias).alias("score"))


@query()
def st08_teams_by_colour(spark, sf_dir):
    n = C("vec_id")
    place = [(n % 2 + 1).alias("half"), (n % 97 * 250).alias("t"), (n * 7 % 57).cast("double").alias("x"), (n % 19 == 0).alias("referee")]
    e = table(spark, sf_dir, "embeddings").select((C("label") % 5).alias("match_id"), n.alias("id"), C("embedding").cast("array<double>").alias("colour"), *place).where("colour is not null")
    return colours.teams_by_colour(e, ["match_id"], colours.Colours(least_limit=0.5, kit_radius=0.9, referee_limit=0.9, kit_distance=0.2, least_frames=2))


@query(""" SELECT match_id, frame, CASE WHEN x < 28 THEN CAST(match_id % 2 AS INT) ELSE 1 - CAST(match_id % 2 AS INT) END AS keeper_team FROM frames WHERE kind = 'purchase'""")
def st13_keeper_by_side(spark, sf_dir):
    return frames(spark, sf_dir).where("kind = 'purchase'").select("match_id", "frame", teams.keeper_side(C("x"), (C("match_id") % 2).cast("int"), LENGTH).alias("keeper_team"))


@query(""", d AS (SELECT match_id, t // 86400000 AS d, x, value FROM frames WHERE x IS NOT NULL), e AS (SELECT match_id, min((x, value)) AS a, max((x, value)) AS b FROM d GROUP BY match_id, d),
s AS (SELECT match_id, 'left' AS side, a[1] AS x, a[2] AS v FROM e UNION ALL SELECT match_id, 'right', b[1], b[2] FROM e) SELECT match_id, side, count(*) AS n, round(median(v), 6) AS median FROM s WHERE (side = 'left' AND x < 15) OR (side = 'right' AND x > 41) GROUP BY 1, 2 HAVING count(*) >= 5""")
def st09_keeper_kits(spark, sf_dir):
    d = frames(spark, sf_dir).where("x is not null").withColumn("d", F.floor(C("t") / (24 * HOUR)))
    return teams.keeper_samples(d, ["match_id"], "d", "x", "value", LENGTH, 15.0, 5).withColumn("median", r6(C("median")))


@query(""", k AS (SELECT match_id, t // 259200000 AS d, frame, team, value, count(*) FILTER (team = 0) OVER w AS n0, count(*) FILTER (team = 1) OVER w AS n1 FROM frames WHERE team IS NOT NULL WINDOW w AS (PARTITION BY match_id, t // 259200000)),
r AS (SELECT *, row_number() OVER (PARTITION BY match_id, d, team ORDER BY value) AS r, least(greatest(n0, n1) - 2, 2 - least(n0, n1)) AS k, CASE WHEN n1 > n0 THEN 1 ELSE 0 END AS big FROM k)
SELECT match_id, frame, CASE WHEN team = big AND r <= k THEN 1 - team ELSE team END AS balanced FROM r""")
def st14_balanced_teams(spark, sf_dir):
    d = frames(spark, sf_dir).where("team is not null").withColumn("d", F.floor(C("t") / (72 * HOUR)))
    return teams.balanced(d, ["match_id", "d"], "team", "value", 2, ["frame"]).select("match_id", "frame", "balanced")


@query("""WITH e AS (SELECT vec_id, label, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings WHERE embedding IS NOT NULL), u AS (SELECT vec_id, label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e),
s AS (SELECT label AS l, i, sum(x) AS s, count(*) AS n FROM u GROUP BY 1, 2),
d AS (SELECT vec_id, label, l, sum(power(x - (s - CASE WHEN l = label THEN x ELSE 0 END) / (n - CAST(l = label AS INT)), 2)) AS d FROM u JOIN s USING (i) WHERE n > CAST(l = label AS INT) GROUP BY 1, 2, 3)
SELECT vec_id, label, l AS predicted FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, l) = 1""", frames=False)
def st29_leave_one_out(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", "label", C("embedding").cast("array<double>").alias("v"))
    return separation.leave_one_out_centroids(e, "label", "vec_id", "v", longest(e))


def two_classes(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", (C("label") % 2).cast("int").alias("label"), C("embedding").cast("array<double>").alias("v"))


@query("""WITH e AS (SELECT vec_id, CAST(label % 2 AS INT) AS y, [v::DOUBLE FOR v IN embedding] AS v FROM embeddings WHERE embedding IS NOT NULL), u AS (SELECT vec_id, y, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e),
t AS (SELECT i, count(*) AS n, sum(x) AS s, sum(x * x) AS q, count(*) FILTER (y = 0) AS n0, count(*) FILTER (y = 1) AS n1, sum(x) FILTER (y = 0) AS s0, sum(x) FILTER (y = 1) AS s1 FROM u GROUP BY i),
p AS (SELECT vec_id, y, x, (s0 - CASE y WHEN 0 THEN x ELSE 0 END) / (n0 - 1 + y) AS m0, (s1 - CASE y WHEN 1 THEN x ELSE 0 END) / (n1 - y) AS m1, sqrt(greatest((q - x * x) / (n - 1) - power((s - x) / (n - 1), 2), 0)) + 1e-6 AS sd FROM u JOIN t USING (i))
SELECT vec_id, y AS label, CAST(sum(power((x - m1) / sd, 2)) < sum(power((x - m0) / sd, 2)) AS INT) AS by_centroid,
  CAST(sum(x * m1) / (sqrt(sum(x * x)) * sqrt(sum(m1 * m1)) + 1e-9) > sum(x * m0) / (sqrt(sum(x * x)) * sqrt(sum(m0 * m0)) + 1e-9) AS INT) AS by_cosine FROM p GROUP BY vec_id, y""", frames=False)
def st29_centroid_and_cosine(spark, sf_dir):
    e = two_classes(spark, sf_dir)
    return separation.leave_one_out(e, "vec_id", "label", "v", longest(e)).drop("by_discriminant")


@query()
def st29_accuracies(spark, sf_dir):
    e = two_classes(spark, sf_dir)
    return separation.accuracies(e, "vec_id", "label", "v", longest(e))


# ---------------------------------------------------------------- actions

PLAY = Actions(pass_distance=4.0, pass_speed=0.002, shot_speed=0.001)


def segments(spark, sf_dir):
    return islands.control_segments(frames(spark, sf_dir), KEYS, "frame", "t", "team", 10 * HOUR, 0)


SEGMENTS_SQL = """, sa AS (SELECT *, lag(t) OVER (PARTITION BY match_id, half ORDER BY frame) AS pt FROM frames),
sb AS (SELECT *, CASE WHEN lag(team) OVER w IS DISTINCT FROM team OR pt - lag(t) OVER w > 36000000 THEN 1 ELSE 0 END AS nw FROM sa WHERE team IN (0, 1) WINDOW w AS (PARTITION BY match_id, half ORDER BY frame)),
sc AS (SELECT *, sum(nw) OVER (PARTITION BY match_id, half ORDER BY frame) AS g FROM sb),
seg AS (SELECT match_id, half, any_value(team) AS team, min(t) AS t0, max(t) AS t1, min(frame) AS i0, max(frame) AS i1 FROM sc GROUP BY match_id, half, g),
nx AS (SELECT *, lead(team) OVER w AS n_team, lead(t0) OVER w AS n_t0, lead(i0) OVER w AS n_i0 FROM seg WINDOW w AS (PARTITION BY match_id, half ORDER BY i0)),
fl AS (SELECT nx.*, a.x, a.y, b.x AS x2, b.y AS y2, n_t0 - t1 AS gap FROM nx JOIN frames a ON a.frame = nx.i1 LEFT JOIN frames b ON b.frame = nx.n_i0)"""


@query(SEGMENTS_SQL + """, ps AS (SELECT *, n_team = team AS completed, sqrt(power(x2 - x, 2) + power(y2 - y, 2)) AS d FROM fl WHERE gap > 0 AND gap <= 43200000)
SELECT match_id, half, team, t1 AS t, round(d, 6) AS distance, completed, (CASE WHEN half = 1 THEN x2 - x ELSE x - x2 END) >= 3 AS forward, (CASE WHEN half = 1 THEN x ELSE 56 - x END) >= 28 AS far_half FROM ps WHERE d >= 4 AND d / greatest(gap / 1000.0::DOUBLE, 60) >= 0.002""")
def st19_flight_passes(spark, sf_dir):
    f = frames(spark, sf_dir)
    flown = act.flights(segments(spark, sf_dir), f.select(*KEYS, "frame", "x", "y"), KEYS, 12 * HOUR)
    outs = f.where("seen = 'o' and x > 1000")
    p = act.passes(flown, outs.select(*KEYS, "t", "x", "y"), KEYS, PLAY, PITCH, C("half") == 1, 60.0, 12 * HOUR)
    return p.select(*KEYS, "team", "t", r6(C("distance")).alias("distance"), "completed", "forward", "far_half")


@query()
def st19_passes_with_outs(spark, sf_dir):
    f = frames(spark, sf_dir)
    flown = act.flights(segments(spark, sf_dir), f.select(*KEYS, "frame", "x", "y"), KEYS, 6 * HOUR)
    return act.passes(flown, f.where("seen = 'o'").select(*KEYS, "t", "x", "y"), KEYS, PLAY, PITCH, C("half") == 1, 60.0, 6 * HOUR)


@query(SEGMENTS_SQL + """, s1 AS (SELECT *, CASE WHEN half = 1 THEN x ELSE 56 - x END AS xn, CASE WHEN half = 1 THEN y ELSE 32.36::DOUBLE - y END AS yn, CASE WHEN half = 1 THEN x2 ELSE 56 - x2 END AS xe, CASE WHEN half = 1 THEN y2 ELSE 32.36::DOUBLE - y2 END AS ye FROM fl),
s2 AS (SELECT *, sqrt(power(xe - xn, 2) + power(ye - yn, 2)) AS d FROM s1), s3 AS (SELECT *, d / (gap / 1000.0::DOUBLE) AS speed, (xe - xn) / d AS ux, (ye - yn) / d AS uy FROM s2 WHERE d >= 2.5 AND gap > 0),
s4 AS (SELECT *, (56 - xn) / ux AS run, yn + (56 - xn) / ux * uy AS meets FROM s3)
SELECT match_id, half, team, t1 AS t, round(speed, 8) AS speed FROM s4 WHERE 56 - xn BETWEEN 0 AND 32 AND ux >= 0.3 AND speed >= 0.001 AND run / speed <= 3000000 AND abs(meets - 16.18) <= 6.5 AND run / speed <= 3.0""")
def st17_shots(spark, sf_dir):
    f = frames(spark, sf_dir)
    flown = act.flights(segments(spark, sf_dir), f.select(*KEYS, "frame", "x", "y"), KEYS, 12 * HOUR)
    return act.shots(flown, KEYS, PLAY, PITCH, C("half") == 1).select(*KEYS, "team", "t", F.round("speed", 8).alias("speed"))


@query()
def st17_st18_all_shots(spark, sf_dir):
    """Shots seen, lost in the air and told by goals only; an hour of the events passes for 200 ms."""
    f = frames(spark, sf_dir).withColumn("t", F.floor(C("t") / 18_000)).withColumn("ball_state", F.when(C("seen") == "o", "out").when(C("seen").isNotNull(), "play")).withColumn("controlled_by", C("team"))
    seg = islands.control_segments(f, KEYS, "frame", "t", "team", 400, 0)
    goals = f.where("kind = 'purchase' and frame % 5 = 0").select(*KEYS, "t", F.when(C("frame") % 3 > 0, (C("frame") % 2).cast("int")).alias("scorer"))
    right = f.select(*KEYS).distinct().select(*KEYS, F.explode(F.array(F.lit(0), F.lit(1))).alias("team")).withColumn("right", (C("team") == 0) == (C("half") == 1))
    return shots.all_shots(seg, f, goals, right, KEYS, Actions(shot_speed=2.0), PITCH, 200)


@query()
def st17_shot_outcomes(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("t", F.floor(C("t") / 20000))
    seg = islands.control_segments(f, KEYS, "frame", "t", "team", 2000, 0)
    flown = act.flights(seg, f.select(*KEYS, "frame", "x", "y"), KEYS, 3000)
    found = act.shots(flown, KEYS, Actions(shot_speed=2.0), PITCH, C("half") == 1)
    goals = f.where("kind = 'purchase'").select(*KEYS, "t", F.lit(None).cast("int").alias("scorer"))
    return act.with_goals(found, goals, KEYS)


@query(""", g AS (SELECT match_id, half, t AS goal_t, CAST(frame % 2 AS INT) AS scorer FROM frames WHERE kind = 'purchase'),
c AS (SELECT g.match_id, g.half, g.goal_t, g.scorer, f.t, CAST(coalesce(f.team = g.scorer, false) AS INT) AS held, f.x, CASE WHEN (g.scorer = 0) = (g.half = 1) THEN f.x ELSE 56 - f.x END AS xn FROM g JOIN frames f USING (match_id, half) WHERE f.x IS NOT NULL AND f.t BETWEEN g.goal_t - 86400000 AND g.goal_t - 300)
SELECT match_id, half, goal_t, scorer AS team, t, CASE held WHEN 1 THEN 'control' ELSE 'ball' END AS origin FROM c WHERE xn >= 28 AND (held = 1 OR 56 - xn >= 3) QUALIFY row_number() OVER (PARTITION BY match_id, half, goal_t, scorer ORDER BY held DESC, t DESC) = 1""")
def st18_inferred_shots(spark, sf_dir):
    f = frames(spark, sf_dir)
    goals = f.where("kind = 'purchase'").select(*KEYS, "t", (C("frame") % 2).cast("int").alias("scorer"))
    right = (C("scorer") == 0) == (C("half") == 1)
    return act.inferred_shots(goals, f, KEYS, PITCH, right, 24 * HOUR).select(*KEYS, "goal_t", "team", "t", "origin")


@query(""", tb AS (SELECT *, sum(nw) OVER (PARTITION BY match_id, half ORDER BY frame) AS g FROM (SELECT *, CASE WHEN coalesce(lag(kind) OVER w IS DISTINCT FROM kind OR t - lag(t) OVER w >= 43200000, true) THEN 1 ELSE 0 END AS nw FROM frames WHERE x IS NOT NULL WINDOW w AS (PARTITION BY match_id, half ORDER BY frame))),
tt AS (SELECT match_id, half, any_value(kind) AS player, min(t) AS t0, max(t) AS t1, min(frame) AS i0, max(frame) AS i1 FROM tb GROUP BY match_id, half, g),
n AS (SELECT *, lead(player) OVER w AS n_player, lead(t0) OVER w AS n_t0, lead(i0) OVER w AS n_i0 FROM tt WINDOW w AS (PARTITION BY match_id, half ORDER BY i0))
SELECT n.match_id, n.half, n.player, n.t1 AS t, n_player = 'click' AS completed FROM n JOIN frames a ON a.frame = n.i1 JOIN frames b ON b.frame = n.n_i0 WHERE n_player <> player AND n_t0 - t1 BETWEEN 0 AND 43200000 AND sqrt(power(b.x - a.x, 2) + power(b.y - a.y, 2)) >= 4 AND sqrt(power(b.x - a.x, 2) + power(b.y - a.y, 2)) / greatest((n_t0 - t1) / 1000.0::DOUBLE, 60) >= 0.002""")
def st20_touch_passes(spark, sf_dir):
    f = frames(spark, sf_dir).where("x is not null")
    w = islands.ordered(KEYS, "frame")
    new = islands.changed(C("kind"), w) | F.coalesce(C("t") - F.lag("t").over(w) >= 12 * HOUR, F.lit(True))
    runs = islands.numbered(f.withColumn("_new", new), KEYS, ["frame"], C("_new"))
    touched = runs.groupBy(*KEYS, "run").agg(F.first("kind").alias("player"), F.min("t").alias("t0"), F.max("t").alias("t1"), F.min("frame").alias("i0"), F.max("frame").alias("i1")).withColumn("team", (C("player") == "click").cast("int"))
    found = act.touch_passes(touched.withColumn("team", F.when(C("player") == "click", 1).otherwise(0)), f.select(*KEYS, "frame", "x", "y"), KEYS, PLAY, 60.0, 12 * HOUR)
    return found.select(*KEYS, "player", "t", _next_is_click(found).alias("completed"))


def _next_is_click(found):
    return F.when(C("player") == "click", False).otherwise(~C("completed"))


@query(""", b AS (SELECT match_id, frame, t, x FROM frames WHERE seen = 'i') SELECT match_id, frame, CASE WHEN x < 20 THEN 'start of the half' WHEN x < 25 THEN 'goal' WHEN x < 45 AND frame % 2 = 0 THEN 'goal' WHEN x < 45 AND frame % 30 >= 10 THEN 'check' ELSE 'no' END AS category, coalesce(CASE frame % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END, 1 - CAST(frame % 2 AS INT)) AS scorer FROM b""")
def st15_goal_decision(spark, sf_dir):
    f, k = frames(spark, sf_dir).where("seen = 'i'"), C("frame")
    category = act.goal_categories(F.when(C("x") < 25, "ball").otherwise("formation"), C("x") < 20, C("x") < 45, k % 2 == 0, k % 30, 10)
    side = F.when(k % 3 == 0, "right").when(k % 3 == 1, "left")
    return f.select("match_id", "frame", category.alias("category"), act.scorer(side, F.lit(1), (k % 2).cast("int")).alias("scorer"))


@query()
def isl11_same_restart(spark, sf_dir):
    f = frames(spark, sf_dir).where("kind in ('signup', 'purchase')")
    rows = f.select(*KEYS, "t", F.when(C("kind") == "signup", "ball").otherwise("formation").alias("how"), F.when(C("value") < 20, "no").otherwise("goal").alias("category"), (C("value") > 60).alias("evidence"))
    return act.same_restarts(rows, KEYS, 24 * HOUR)


@query(""", r AS (SELECT match_id, t % 5400000 AS t, min(half) AS half FROM frames GROUP BY 1, 2), l AS (SELECT match_id, max_by(half, t) AS half FROM r GROUP BY 1),
g AS (SELECT match_id, t % 5400000 // 1000 * 1000 AS goal_t, CAST(frame % 2 AS INT) AS scorer FROM frames WHERE kind = 'purchase')
SELECT g.match_id, coalesce(r.half, l.half) AS half, goal_t, scorer FROM g ASOF LEFT JOIN r ON g.match_id = r.match_id AND g.goal_t <= r.t JOIN l ON l.match_id = g.match_id""")
def st16_manual_goals(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("t", C("t") % 5_400_000)
    s = F.floor(C("t") / 1000)
    said = F.format_string("%d:%02d=%d", F.floor(s / 60), s % 60, C("frame") % 2)
    notes = f.where("kind = 'purchase'").groupBy("match_id").agg(F.concat_ws(",", F.collect_list(said)).alias("text"))
    return goal_operators.manual_goals(notes, f)


@query(""", e AS (SELECT match_id, half, t, frame FROM frames WHERE kind = 'signup'), s AS (SELECT *, row_number() OVER (PARTITION BY match_id, half ORDER BY t) AS r, min(t) OVER (PARTITION BY match_id, half) AS f FROM e)
SELECT match_id, half, t, CASE WHEN r = 1 THEN 'half_start' ELSE 'goal' END AS type, t - lag(t) OVER (PARTITION BY match_id, half ORDER BY t) AS gap FROM s""")
def st27_st31_kickoffs_to_events(spark, sf_dir):
    e, w = frames(spark, sf_dir).where("kind = 'signup'"), islands.ordered(KEYS, "t")
    return e.select(*KEYS, "t", F.when(F.row_number().over(w) == 1, "half_start").otherwise("goal").alias("type"), (C("t") - F.lag("t").over(w)).alias("gap"))


@query(""", g AS (SELECT frame AS goal, match_id, t + 1 AS t FROM frames WHERE kind = 'purchase'), f AS (SELECT match_id, t, min(half) AS half FROM frames GROUP BY 1, 2), l AS (SELECT match_id, max_by(half, t) AS half FROM f GROUP BY 1)
SELECT g.goal, g.match_id, coalesce(f.half, l.half) AS half FROM g ASOF LEFT JOIN f ON g.match_id = f.match_id AND g.t <= f.t JOIN l ON l.match_id = g.match_id""")
def st28_half_at_goal(spark, sf_dir):
    from trackforge.operators.nearest import asof

    goals = frames(spark, sf_dir).where("kind = 'purchase'").select("match_id", (C("t") + 1).alias("t"), C("frame").alias("goal"))
    rows = frames(spark, sf_dir).groupBy("match_id", "t").agg(F.min("half").alias("half"))
    return asof(goals, rows, ["match_id"], "t", ["half"], forward=True, clamp=True).select("goal", "match_id", "half")


@query(""", p AS (SELECT match_id, half, frame, t, x, y, team, min(t) OVER (PARTITION BY match_id, half) AS begun FROM frames WHERE x IS NOT NULL),
c AS (SELECT match_id, half, team, t // 86400000 AS chain, min(t) AS t0, max(t) AS t1, min_by(y, (t, x, y)) AS y, any_value(begun) AS begun FROM p WHERE team IS NOT NULL GROUP BY 1, 2, 3, 4)
SELECT match_id, half, team, count(*) FILTER (t1 - t0 >= 1000 AND t0 - begun > 172800000 AND 32.36::DOUBLE - y < 1.5) AS substitutes FROM c GROUP BY 1, 2, 3""")
def st07_substitutes(spark, sf_dir):
    f = frames(spark, sf_dir).where("x is not null").select(*KEYS, "t", F.floor(C("t") / (24 * HOUR)).alias("chain"), C("team").alias("chain_team"), "x", "y")
    return players.substitutes(f, KEYS, settle_s=48 * 3600.0)


@query(""", c AS (SELECT match_id, half, team, count(*) AS c, min(frame) AS o FROM frames WHERE team IS NOT NULL GROUP BY 1, 2, 3), m AS (SELECT match_id, half, team, c AS votes FROM c QUALIFY row_number() OVER (PARTITION BY match_id, half ORDER BY c DESC, o) = 1),
i AS (SELECT match_id, half, count(*) AS n, avg(CAST(seen = 'o' AS INT)) > 0.5 AND (median(x) < 8 OR median(x) > 48) AS keeper FROM frames WHERE x IS NOT NULL GROUP BY 1, 2) SELECT i.match_id, i.half, n, keeper, team FROM i LEFT JOIN m USING (match_id, half)""")
def st05_chain_info(spark, sf_dir):
    from trackforge.operators.measures import majority

    f = frames(spark, sf_dir)
    info = f.where("x is not null").groupBy(*KEYS).agg(F.count("*").alias("n"), ((F.avg((C("seen") == "o").cast("int")) > 0.5) & ((F.median("x") < 8) | (F.median("x") > 48))).alias("keeper"))
    return info.join(majority(f, KEYS, "team", "frame"), KEYS, "left").select(*KEYS, "n", "keeper", "team")


# ---------------------------------------------------------------- stateful

#: Possession with a switch after 4 hours and a reset after 20, as in real time after 0.3 and 2 seconds.
SLOW = Possession(switch_s=14400, reset_s=72000)


@query(""", o AS (SELECT match_id, half, frame, t, coalesce(seen = 'o', false) AS dead, seen IS NOT NULL AS ball, team AS c, row_number() OVER (PARTITION BY match_id, half ORDER BY frame) AS r FROM frames),
st AS (SELECT match_id, half, 0::BIGINT AS r, NULL::INT AS cur, NULL::INT AS cand, 0::BIGINT AS since, NULL::BIGINT AS seen_t, NULL::BIGINT AS frame, NULL::INT AS ctl FROM o GROUP BY 1, 2
UNION ALL SELECT z.match_id, z.half, z.r,
 CASE WHEN z.dead OR (NOT z.ball AND z.t - z.seen_t > 72000000) THEN NULL WHEN NOT z.ball THEN z.cur WHEN z.c IS NOT NULL AND z.c IS DISTINCT FROM z.cur AND (z.cur IS NULL OR z.t - (CASE WHEN z.c IS DISTINCT FROM z.cand THEN z.t ELSE z.since END) >= 14400000) THEN z.c ELSE z.cur END,
 CASE WHEN z.dead OR (NOT z.ball AND z.t - z.seen_t > 72000000) THEN NULL WHEN NOT z.ball THEN z.cand WHEN z.c IS NOT DISTINCT FROM z.cur THEN NULL WHEN z.c IS NULL THEN z.cand WHEN z.cur IS NULL OR z.t - (CASE WHEN z.c IS DISTINCT FROM z.cand THEN z.t ELSE z.since END) >= 14400000 THEN NULL ELSE z.c END,
 CASE WHEN z.ball AND NOT z.dead AND z.c IS NOT NULL AND z.c IS DISTINCT FROM z.cur AND z.c IS DISTINCT FROM z.cand THEN z.t ELSE z.since END, CASE WHEN z.ball THEN z.t ELSE z.seen_t END, z.frame, CASE WHEN z.dead OR NOT z.ball THEN NULL ELSE z.c END
 FROM (SELECT o.*, st.cur, st.cand, st.since, st.seen_t FROM st JOIN o ON o.match_id = st.match_id AND o.half = st.half AND o.r = st.r + 1) z)
SELECT match_id, half, frame, ctl AS controlled_by, cur AS possession FROM st WHERE r > 0""")
def st01_possession(spark, sf_dir):
    f = frames(spark, sf_dir).select(*KEYS, "frame", "t", F.coalesce(C("seen") == "o", F.lit(False)).alias("dead"), C("seen").isNotNull().alias("ball"), C("team").alias("controller"))
    return stateful.possession(f, KEYS, SLOW).select(*KEYS, "frame", "controlled_by", "possession")


@query()
def isl02_still_ball(spark, sf_dir):
    f = frames(spark, sf_dir).select("match_id", "half", "frame", "t", "x", "y")
    return stateful.still_ball(f, ["match_id"], 6 * HOUR, 12.0, 20 * HOUR)


@query()
def st02_ball_tracker(spark, sf_dir):
    f = frames(spark, sf_dir).where("x is not null")
    c = f.select((C("match_id") % 32).alias("match_id"), "half", (F.floor(C("t") / HOUR)).alias("frame"), (F.floor(C("t") / HOUR) * 500).alias("t"), "x", "y", (C("value") % 1).alias("confidence"), (C("value") % 7).alias("person"))
    return ball.track_ball(c, KEYS, Ball())


@query()
def st03_st04_st06_player_tracks(spark, sf_dir):
    f = frames(spark, sf_dir).where("x is not null")
    d = f.select((C("match_id") % 16).alias("match_id"), "half", (F.floor(C("t") / (2 * HOUR)) * 100).alias("t"), "x", "y", "team", (C("value") > 200).alias("keeper"))
    return players.track_players(d, KEYS, Tracks())


@query()
def wn09_smoothed_tracks(spark, sf_dir):
    f = frames(spark, sf_dir).where("x is not null").select("match_id", (F.floor(C("t") / 36000)).alias("t"), "x", "y")
    return smoothing.smooth_tracks(f, ["match_id"], 60.0, Tracks(smooth_s=600.0, interpolate_s=3000.0, top_speed=0.5))


@query()
def wn08_steady_tracks(spark, sf_dir):
    how = smoothing.Steady(base_s=2.0, dead=1.5, brisk=8.0, fast=20.0)
    return smoothing.steady_tracks(frames(spark, sf_dir).select("match_id", "t", "x", "y"), ["match_id"], 1.0, how)


@query()
def fill03_cheapest_path(spark, sf_dir):
    f = frames(spark, sf_dir).where("x is not null")
    rows = f.select((C("match_id") % 64).alias("match_id"), "frame", (C("t") / 1000).cast("long").alias("t"), F.when(C("kind") == "purchase", "anchor").otherwise("candidate").alias("kind"), "x", "y", (C("value") % 1).alias("confidence"))
    return ball.fill_gaps(rows, ["match_id"])


@query()
def st30_averaged_ball(spark, sf_dir):
    return stateful.averaged_ball(frames(spark, sf_dir).select("match_id", "t", "x", "y"), ["match_id"], hide_ms=12 * HOUR)


@query()
def jn20_chained_detections(spark, sf_dir):
    f = frames(spark, sf_dir).where("x is not null").select((C("match_id") % 8).alias("match_id"), F.floor(C("t") / (6 * HOUR)).alias("frame"), C("frame").alias("id"), "x", "y")
    return stateful.chained(f, ["match_id"], 6.0)


@query()
def jn17_st22_clock_alignment(spark, sf_dir):
    f = frames(spark, sf_dir).where("kind in ('signup', 'purchase')")
    s = (C("t") % 86400000) / 16000
    return evaluate.align_clocks(f.select("match_id", F.when(C("kind") == "signup", s).alias("t_s"), F.when(C("kind") == "purchase", (s / 60).cast("int")).alias("minute")), ["match_id"])


@query()
def st23_explained_goals(spark, sf_dir):
    f = frames(spark, sf_dir).where("kind in ('signup', 'click', 'purchase')")
    s = (C("t") % 86400000) / 16000
    how = F.when(C("kind") == "signup", "ball").when(C("kind") == "click", "formation")
    return evaluate.explain_goals(f.select("match_id", how.alias("how"), F.when(how.isNotNull(), s).alias("t_s"), F.when(C("kind") == "purchase", (s / 60).cast("int")).alias("minute")), ["match_id"])


@query(SEQUENCES + " SELECT team, count(*) AS possessions, CAST(sum(t1 - t0) AS BIGINT) AS held_ms FROM seqs GROUP BY 1")
def possession_flagship(spark, sf_dir):
    """From frames to possessions to figures for each team, in one plan."""
    s = sequences(spark, sf_dir)
    return s.groupBy("team").agg(F.count("*").alias("possessions"), F.sum(C("t1") - C("t0")).alias("held_ms"))
