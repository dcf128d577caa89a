"""Queries on row-wise functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackforge.functions import scalar as fn
from trackforge.plans.catalog import query, r6
from trackforge.recast import LENGTH, WIDTH, frames, table

C = F.col
#: Boxes from lineitem, as in detections: about 80 wide and high, near each other within an order.
BOXES_SQL = """SELECT l_orderkey AS frame, l_linenumber AS id, CASE l_returnflag WHEN 'A' THEN 'ball' ELSE 'player' END AS kind, l_quantity * 4 AS x1, l_tax * 1000 AS y1, l_quantity * 4 + 60 + l_discount * 400 AS x2, l_tax * 1000 + 90.0::DOUBLE AS y2 FROM lineitem"""


def boxes(spark, sf_dir):
    q, tax = C("l_quantity"), C("l_tax")
    return table(spark, sf_dir, "lineitem").select(C("l_orderkey").alias("frame"), C("l_linenumber").alias("id"), F.when(C("l_returnflag") == "A", "ball").otherwise("player").alias("kind"), (q * 4).alias("x1"), (tax * 1000).alias("y1"), (q * 4 + 60 + C("l_discount") * 400).alias("x2"), (tax * 1000 + 90).alias("y2"))


@query(f"WITH b AS ({BOXES_SQL}) SELECT frame, id, round((x1 + x2) / 2, 6) AS u, round(CASE kind WHEN 'ball' THEN (y1 + y2) / 2 ELSE y2 END, 6) AS v FROM b", frames=False)
def fn01_foot_point(spark, sf_dir):
    u, v = fn.foot_point(C("kind"), C("x1"), C("y1"), C("x2"), C("y2"))
    return boxes(spark, sf_dir).select("frame", "id", r6(u).alias("u"), r6(v).alias("v"))


H = [0.21, 0.013, -3.5, -0.007, 0.25, 1.25, 0.00011, -0.00023, 1.0]


@query(f"WITH b AS ({BOXES_SQL}), p AS (SELECT frame, id, x1 AS u, y2 AS v FROM b) SELECT frame, id, round((0.21::DOUBLE * u + 0.013::DOUBLE * v - 3.5) / (0.00011::DOUBLE * u - 0.00023::DOUBLE * v + 1), 6) AS x, round((-0.007::DOUBLE * u + 0.25::DOUBLE * v + 1.25) / (0.00011::DOUBLE * u - 0.00023::DOUBLE * v + 1), 6) AS y, round(sqrt(power(u - 100, 2) + power(v - 60, 2)) / 80, 6) AS quality FROM p", frames=False)
def fn06_fn09_homography_and_quality(spark, sf_dir):
    x, y = fn.homography(H, C("x1"), C("y2"))
    return boxes(spark, sf_dir).select("frame", "id", r6(x).alias("x"), r6(y).alias("y"), r6(fn.lens_distance(C("x1"), C("y2"), F.lit(100.0), F.lit(60.0), F.lit(80.0))).alias("quality"))


@query(""" SELECT match_id, frame, coalesce(x > 1 AND x < 55 AND y > 1 AND y < 31.36::DOUBLE, false) AS inside, coalesce(x BETWEEN -0.3 AND 56.3 AND y BETWEEN -0.3 AND 32.66, false) AS inside_closed,
coalesce((x - 2 BETWEEN -0.5 AND 52.5 AND y - 2 BETWEEN -0.5 AND 28.86::DOUBLE) OR (x - 2 BETWEEN -2 AND 54 AND abs(y - 2 - 28.36::DOUBLE / 2) <= 3.5), false) AS plausible, coalesce(y > 30.86::DOUBLE, false) AS near_line, coalesce(least(x, 56 - x, y, 32.36::DOUBLE - y) < 1.5, false) AS any_line FROM frames""")
def fn10_fn11_fn30_pitch_zones(spark, sf_dir):
    x, y, no = C("x"), C("y"), F.lit(False)
    return frames(spark, sf_dir).select("match_id", "frame", fn.inside(x, y, LENGTH, WIDTH, -1.0).alias("inside"), fn.inside_closed(x, y, LENGTH, WIDTH, 0.3).alias("inside_closed"), fn.plausible_ball(x - 2, y - 2, 52.0, 28.36).alias("plausible"), F.coalesce(fn.at_line(x, y, LENGTH, WIDTH), no).alias("near_line"), F.coalesce(fn.at_line(x, y, LENGTH, WIDTH, any_line=True), no).alias("any_line"))


@query(f"""WITH b AS ({BOXES_SQL}), p AS (SELECT a.frame, a.id AS a, c.id AS c, greatest(0.0, least(a.x2, c.x2) - greatest(a.x1, c.x1)) * greatest(0.0, least(a.y2, c.y2) - greatest(a.y1, c.y1)) AS i, (a.x2 - a.x1) * (a.y2 - a.y1) + (c.x2 - c.x1) * (c.y2 - c.y1) AS s,
((a.x1 + a.x2) / 2 >= c.x1 + (c.x2 - c.x1) * 0.3::DOUBLE / 2 AND (a.x1 + a.x2) / 2 <= c.x2 - (c.x2 - c.x1) * 0.3::DOUBLE / 2 AND (a.y1 + a.y2) / 2 >= c.y1 AND (a.y1 + a.y2) / 2 <= c.y1 + 0.6::DOUBLE * (c.y2 - c.y1)) AS on_body FROM b a JOIN b c ON a.frame = c.frame AND a.id < c.id)
SELECT frame, a, c, round(CASE WHEN s - i > 0 THEN i / (s - i) ELSE 0 END, 6) AS iou, on_body FROM p""", frames=False)
def fn12_fn13_box_overlap(spark, sf_dir):
    b = boxes(spark, sf_dir)
    a, c = b.select("frame", C("id").alias("a"), *(C(k).alias(f"a_{k}") for k in ("x1", "y1", "x2", "y2"))), b.select("frame", C("id").alias("c"), *(C(k).alias(f"c_{k}") for k in ("x1", "y1", "x2", "y2")))
    box = lambda s: [C(f"{s}_{k}") for k in ("x1", "y1", "x2", "y2")]
    u, v = (C("a_x1") + C("a_x2")) / 2, (C("a_y1") + C("a_y2")) / 2
    return a.join(c, "frame").where(C("a") < C("c")).select("frame", "a", "c", r6(fn.box_iou(box("a"), box("c"))).alias("iou"), fn.on_upper_body(u, v, box("c")).alias("on_body"))


@query(" SELECT match_id, frame, CAST(floor(x / 0.5::DOUBLE) AS BIGINT) AS cx, CAST(floor(y / 0.5::DOUBLE) AS BIGINT) AS cy, least(greatest(CAST(trunc((x - 3) / 50.0::DOUBLE * 28) AS INT), 0), 27) AS bin FROM frames WHERE x IS NOT NULL")
def fn14_fn15_cells_and_bins(spark, sf_dir):
    return frames(spark, sf_dir).where("x is not null").select("match_id", "frame", fn.cell(C("x"), 0.5).alias("cx"), fn.cell(C("y"), 0.5).alias("cy"), fn.clipped_bin(C("x") - 3, 50.0, 28).alias("bin"))


@query("SELECT vec_id, round(sqrt(power(embedding[1]::DOUBLE - embedding[4]::DOUBLE, 2) / 2 + power(embedding[2]::DOUBLE - embedding[5]::DOUBLE, 2) + power(embedding[3]::DOUBLE - embedding[6]::DOUBLE, 2)), 6) AS distance FROM embeddings WHERE embedding IS NOT NULL", frames=False)
def fn16_colour_distance(spark, sf_dir):
    v = C("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", r6(fn.colour_distance(F.slice(v, 1, 3), F.slice(v, 4, 3))).alias("distance"))


KITS_SQL = """WITH c AS (SELECT p_partkey, (p_partkey * 37) % 180 AS h, (p_partkey * 11) % 256 AS s, (p_partkey * 7) % 256 AS v FROM part),
k AS (SELECT p_partkey, h, CASE WHEN v < 60 THEN 'black' WHEN s < 35 AND v > 190 THEN 'white' WHEN s < 130 OR v < 90 THEN NULL WHEN h < 8 THEN 'red' WHEN h < 22 THEN 'orange' WHEN h < 35 THEN 'yellow' WHEN h < 85 THEN 'green' WHEN h < 105 THEN 'cyan' WHEN h < 130 THEN 'blue' WHEN h < 165 THEN 'purple' ELSE 'red' END AS kit FROM c)"""


@query(KITS_SQL + " SELECT a.p_partkey, a.kit, CASE WHEN a.kit IS NOT NULL AND b.kit IS NOT NULL AND a.kit <> b.kit THEN a.kit || ',' || b.kit ELSE 'dark,light' END AS pair FROM k a JOIN k b ON b.p_partkey = a.p_partkey + 1", frames=False)
def fn17_fn18_kit_names(spark, sf_dir):
    k = C("p_partkey")
    named = table(spark, sf_dir, "part").select("p_partkey", fn.kit_name(k * 37 % 180, k * 11 % 256, k * 7 % 256).alias("kit"))
    after = named.select((k - 1).alias("p_partkey"), C("kit").alias("other"))
    return named.join(after, "p_partkey").select("p_partkey", "kit", fn.kit_pair(C("kit"), C("other")).alias("pair"))


@query("""WITH s AS (SELECT o_orderkey, o_orderkey % 7300 AS sec, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderkey % 3600 // 60 AS VARCHAR) || ':' || CAST(o_orderkey % 60 AS VARCHAR) || ',5' WHEN 1 THEN '1:' || CAST(o_orderkey % 60 AS VARCHAR) || ':07' WHEN 2 THEN CAST(o_orderkey % 99 AS VARCHAR) ELSE '1:2:3:4' END AS txt FROM orders)
SELECT o_orderkey, txt, CASE o_orderkey % 4 WHEN 0 THEN (o_orderkey % 3600 // 60) * 60 + o_orderkey % 60 + 0.5::DOUBLE WHEN 1 THEN 3600 + (o_orderkey % 60) * 60 + 7.0::DOUBLE WHEN 2 THEN (o_orderkey % 99)::DOUBLE END AS seconds,
printf('%02d:%02d', sec // 60, sec % 60) AS mmss, printf('%d:%02d:%02d', sec // 3600, sec // 60 % 60, sec % 60) AS hms FROM s""", frames=False)
def fn22_fn23_time_text(spark, sf_dir):
    k = C("o_orderkey")
    text = F.when(k % 4 == 0, F.concat((F.floor(k % 3600 / 60)).cast("string"), F.lit(":"), (k % 60).cast("string"), F.lit(",5"))).when(k % 4 == 1, F.concat(F.lit("1:"), (k % 60).cast("string"), F.lit(":07"))).when(k % 4 == 2, (k % 99).cast("string")).otherwise("1:2:3:4")
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("txt"), fn.seconds_of(text).alias("seconds"), fn.minutes_text(k % 7300).alias("mmss"), fn.hours_text(k % 7300).alias("hms"))


@query(""", h AS (SELECT match_id, half, min(t) AS t0, max(t) AS t1 FROM frames GROUP BY 1, 2), a AS (SELECT *, coalesce(sum(t1 - t0) OVER (PARTITION BY match_id ORDER BY half ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM h)
SELECT f.match_id, f.frame, CAST((f.t - a.t0 + a.before) // 60000 + 1 AS BIGINT) AS minute, CAST(floor(((f.t - a.t0) / 1000.0 + 30 + (f.half - 1) * 2700) / 60) AS BIGINT) + 1 AS clock FROM frames f JOIN a USING (match_id, half)""")
def fn24_fn25_minute_of_play(spark, sf_dir):
    from pyspark.sql import Window

    f = frames(spark, sf_dir)
    halves = f.groupBy("match_id", "half").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    before = Window.partitionBy("match_id").orderBy("half").rowsBetween(Window.unboundedPreceding, -1)
    halves = halves.withColumn("before", F.coalesce(F.sum(C("t1") - C("t0")).over(before), F.lit(0)))
    minute = F.floor((C("t") - C("t0") + C("before")) / 60000) + 1
    return f.join(halves, ["match_id", "half"]).select("match_id", "frame", minute.alias("minute"), fn.clock_minute((C("t") - C("t0")) / 1000, F.lit(0), F.lit(30), C("half"), 45.0).alias("clock"))


@query(""" SELECT match_id, frame, round(1 / (1 + exp(-(-1.87::DOUBLE - 0.0975::DOUBLE * sqrt(power(56 - x, 2) + power(y - 16.18::DOUBLE, 2)) + 2.565::DOUBLE * abs(atan2(y - 13.68::DOUBLE, greatest(56 - x, 0.3::DOUBLE)) - atan2(y - 18.68::DOUBLE, greatest(56 - x, 0.3::DOUBLE)))))), 6) AS xg FROM frames WHERE x IS NOT NULL""")
def fn26_expected_goals(spark, sf_dir):
    return frames(spark, sf_dir).where("x is not null").select("match_id", "frame", r6(fn.expected_goal(C("x"), C("y"), LENGTH, WIDTH, 5.0)).alias("xg"))


@query("""WITH j AS (SELECT d.source, count(*) AS n, count(*) FILTER (l.quality = 1) AS k FROM labels l JOIN documents d USING (doc_id) GROUP BY 1), p AS (SELECT *, k::DOUBLE / n AS p FROM j)
SELECT source, n, k, round(greatest(0, (p + 3.8416::DOUBLE / (2 * n) - 1.96::DOUBLE * sqrt(p * (1 - p) / n + 3.8416::DOUBLE / (4 * n * n))) / (1 + 3.8416::DOUBLE / n)), 6) AS low, round(least(1, (p + 3.8416::DOUBLE / (2 * n) + 1.96::DOUBLE * sqrt(p * (1 - p) / n + 3.8416::DOUBLE / (4 * n * n))) / (1 + 3.8416::DOUBLE / n)), 6) AS high FROM p""", frames=False)
def fn27_wilson_interval(spark, sf_dir):
    judged = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.count_if(C("quality") == 1).alias("k"))
    low, high = fn.wilson(C("k"), C("n"))
    return judged.select("source", "n", "k", r6(low).alias("low"), r6(high).alias("high"))


@query("SELECT doc_id, CASE WHEN quality = 1 THEN true WHEN quality = 0 THEN false END AS good FROM labels", frames=False)
def fn28_yes_no(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", fn.yes_no(F.when(C("quality") == 1, " Y ").when(C("quality") == 0, "No")).alias("good"))


@query(""" SELECT match_id, frame, round(sqrt(power(x - (9 + greatest(0, least(1, ((x - 9) * 0 + (y - 6) * 20) / 400))) * 1 + greatest(0, least(1, ((x - 9) * 0 + (y - 6) * 20) / 400)), 2) + power(y - (6 + greatest(0, least(1, (y - 6) * 20 / 400)) * 20), 2)), 6) AS to_line, round(abs(sqrt(power(x - 28, 2) + power(y - 16.18::DOUBLE, 2)) - 4.75), 6) AS to_circle FROM frames WHERE x IS NOT NULL""")
def fn29_line_distance(spark, sf_dir):
    return frames(spark, sf_dir).where("x is not null").select("match_id", "frame", r6(fn.segment_distance(C("x"), C("y"), 9.0, 6.0, 9.0, 26.0)).alias("to_line"), r6(fn.circle_distance(C("x"), C("y"), 28.0, 16.18, 4.75)).alias("to_circle"))


@query(""" SELECT match_id, frame, CAST(i AS INT) AS i, round(x + 4.75 * cos(2 * pi() * i / 40), 6) AS px, round(y + 4.75 * sin(2 * pi() * i / 40), 6) AS py FROM frames, (SELECT unnest(generate_series(0, 40)) AS i) WHERE kind = 'purchase'""")
def fn29_sampled_circle(spark, sf_dir):
    rows = frames(spark, sf_dir).where("kind = 'purchase'")
    points = rows.select("match_id", "frame", F.explode(fn.sampled_circle(C("x"), C("y"), 4.75, 40)).alias("p"))
    return points.select("match_id", "frame", "p.i", r6(C("p.x")).alias("px"), r6(C("p.y")).alias("py"))


@query(""", s AS (SELECT match_id, frame, (t - lag(t) OVER w) / 1000.0 AS gap, lag(y) OVER w > 30.86::DOUBLE AS e, y > 30.86::DOUBLE AS b FROM frames WHERE x IS NOT NULL WINDOW w AS (PARTITION BY match_id ORDER BY frame)) SELECT match_id, frame, coalesce(gap > 3600 AND e AND b, false) AS change FROM s""")
def fn31_player_change(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("match_id").orderBy("frame")
    gap = (C("t") - F.lag("t").over(w)) / 1000
    return frames(spark, sf_dir).where("x is not null").select("match_id", "frame", F.coalesce(fn.player_change(gap, F.lag("y").over(w) > 30.86, C("y") > 30.86, 3600), F.lit(False)).alias("change"))


@query("""WITH g AS (SELECT o_orderstatus AS k, count(*) AS n, avg(o_totalprice) / 10000 AS m FROM orders GROUP BY 1), p AS (SELECT 1)
SELECT k, printf('%.0f%%', n / 1000.0) AS pct, printf('%d', CAST(n AS BIGINT)) AS whole, printf('%.1f', m) AS dec, printf('%.2f', m) AS dec2, '-' AS missing FROM g""", frames=False)
def fn33_report_values(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy(C("o_orderstatus").alias("k")).agg(F.count("*").alias("n"), (F.avg("o_totalprice") / 10000).alias("m"))
    return g.select("k", fn.report_value(C("n") / 1000, "pct").alias("pct"), fn.report_value(C("n"), "int").alias("whole"), fn.report_value(C("m"), "dec").alias("dec"), fn.report_value(C("m"), "dec2").alias("dec2"), fn.report_value(F.lit(None).cast("double"), "dec").alias("missing"))


@query(""", c AS (SELECT match_id, count(*) FILTER (team = 0) AS a, count(*) FILTER (team = 1) AS b FROM frames GROUP BY 1) SELECT match_id, round(CASE WHEN a + b > 0 THEN a::DOUBLE / (a + b) END, 6) AS share, CASE WHEN a > b THEN 0 WHEN b > a THEN 1 END AS leader, printf('%d : %d', a, b) AS label FROM c""")
def fn34_fn40_share_bars(spark, sf_dir):
    c = frames(spark, sf_dir).groupBy("match_id").agg(F.count_if(C("team") == 0).alias("a"), F.count_if(C("team") == 1).alias("b"))
    share, leader = fn.share_bar(C("a"), C("b"))
    return c.select("match_id", r6(share).alias("share"), leader.alias("leader"), F.format_string("%d : %d", "a", "b").alias("label"))


@query("SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) AS safe, md5(replace(html, '</', '<\\/')) AS script FROM pages", frames=False)
def fn35_escaping(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(fn.html_safe(C("html"))).alias("safe"), F.md5(fn.script_safe(C("html"))).alias("script"))


@query(""", m AS (SELECT match_id, half, avg(x) FILTER (team = 0) < avg(x) FILTER (team = 1) AS right0, median(x) FILTER (seen = 'o') AS gk, count(*) FILTER (seen = 'o') AS n FROM frames GROUP BY 1, 2)
SELECT match_id, half, CASE WHEN match_id % 3 = 0 THEN match_id % 2 = 0 WHEN n >= 10 THEN gk < 28 ELSE coalesce(right0, false) END AS team0_defends_left FROM m""")
def fn36_defended_goal(spark, sf_dir):
    m = frames(spark, sf_dir).groupBy("match_id", "half").agg(F.avg(F.when(C("team") == 0, C("x"))).alias("m0"), F.avg(F.when(C("team") == 1, C("x"))).alias("m1"), F.median(F.when(C("seen") == "o", C("x"))).alias("gk"), F.count_if(C("seen") == "o").alias("n"))
    stated = F.when(C("match_id") % 3 == 0, C("match_id") % 2 == 0)
    return m.select("match_id", "half", F.coalesce(stated, F.when(C("n") >= 10, C("gk") < LENGTH / 2), C("m0") < C("m1"), F.lit(False)).alias("team0_defends_left"))


@query(""", h AS (SELECT match_id, half, min(t) AS a, max(t) AS b FROM frames GROUP BY 1, 2) SELECT match_id, half, (b > a AND coalesce(a > lag(b) OVER (PARTITION BY match_id ORDER BY half), true) AND b < 1706745600000) AS valid FROM h""")
def fn37_half_validation(spark, sf_dir):
    from pyspark.sql import Window

    h = frames(spark, sf_dir).groupBy("match_id", "half").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    before = F.lag("b").over(Window.partitionBy("match_id").orderBy("half"))
    return h.select("match_id", "half", ((C("b") > C("a")) & F.coalesce(C("a") > before, F.lit(True)) & (C("b") < 1706745600000)).alias("valid"))


@query(""" SELECT match_id, frame, round(CASE WHEN (team = 0) = (half = 1) THEN x ELSE 56 - x END, 6) AS xn, round(CASE WHEN (team = 0) = (half = 1) THEN y ELSE 32.36::DOUBLE - y END, 6) AS yn FROM frames WHERE x IS NOT NULL AND team IS NOT NULL""")
def fn38_attack_right(spark, sf_dir):
    right = (C("team") == 0) == (C("half") == 1)
    return frames(spark, sf_dir).where("x is not null and team is not null").select("match_id", "frame", r6(fn.mirrored(C("x"), right, LENGTH)).alias("xn"), r6(fn.mirrored(C("y"), right, WIDTH)).alias("yn"))


@query("""WITH e AS (SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings WHERE embedding IS NOT NULL) SELECT vec_id, round(list_sum([(v[i] - 0.01::DOUBLE * i) / (1 + 0.1::DOUBLE * i) * (0.5::DOUBLE * i - 2) FOR i IN range(1, len(v) + 1)]) + 0.25, 6) AS score FROM e""", frames=False)
def fn39_linear_score(spark, sf_dir):
    v = C("embedding").cast("array<double>")
    fixed = lambda f: F.transform(F.sequence(F.lit(1), F.size(v)), f)
    score = fn.linear_score(v, fixed(lambda i: 0.01 * i), fixed(lambda i: 1 + 0.1 * i), fixed(lambda i: 0.5 * i - 2), F.lit(0.25))
    return table(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", r6(score).alias("score"))
