"""Queries on sources, sinks and lens functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackforge.functions import lens
from trackforge.operators import measures as ag
from trackforge.operators import windows as wn
from trackforge.plans.catalog import query, r6
from trackforge.recast import frames, table
from trackforge.sources import sinks, tables

C = F.col


@query("""WITH p AS (SELECT page_id, url, html || '<script id="match-data" type="application/json">{"page": ' || page_id || ', "at": "' || url || '"}</script>' AS html FROM pages),
d AS (SELECT page_id, html, regexp_extract(html, '(?s)id="match-data"[^>]*>(.*?)</script>', 1) AS data FROM p)
SELECT page_id, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, CAST(json_extract(data, '$.page') AS BIGINT) AS page, json_extract_string(data, '$.at') AS at, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM d""", frames=False)
def src20_embedded_json(spark, sf_dir):
    """Reports: every page with a data element of its own, which is read back."""
    data = F.concat(F.lit('<script id="match-data" type="application/json">{"page": '), C("page_id").cast("string"), F.lit(', "at": "'), C("url"), F.lit('"}</script>'))
    p = table(spark, sf_dir, "pages").withColumn("html", F.concat("html", data)).withColumn("data", tables.embedded_json(C("html"), "match-data"))
    return p.select("page_id", F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"), F.get_json_object("data", "$.page").cast("long").alias("page"), F.get_json_object("data", "$.at").alias("at"), F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events", frames=False)
def src15_src16_json_documents(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("SELECT p_partkey, CAST(p_size AS INT) AS class, round((0.5 - p_size / 200.0::DOUBLE) * 1920, 6) AS x1, round((p_size / 100.0::DOUBLE - 0.1) * 1080, 6) AS y1 FROM part WHERE p_size % 7 <> 0", frames=False)
def src19_label_boxes(spark, sf_dir):
    size = C("p_size")
    line = F.when(size % 7 == 0, F.format_string("%d 0.5 broken", size)).otherwise(F.format_string("%d 0.5 %.4f %.4f 0.2", size, size / 100, size / 100))
    lines = table(spark, sf_dir, "part").select("p_partkey", line.alias("value"))
    b = tables.boxes_of_lines(lines, 1920, 1080)
    return b.select("p_partkey", "class", r6(C("x1")).alias("x1"), r6(C("y1")).alias("y1"))


@query("SELECT o_orderkey, 'priority' AS analysis, o_orderpriority AS label FROM orders UNION ALL SELECT o_orderkey, 'status', o_orderstatus FROM orders", frames=False)
def src24_tidy_labels(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", C("o_orderpriority").alias("priority"), C("o_orderstatus").alias("status"))
    return tables.tidy_labels(o, ["o_orderkey"], ["priority", "status"])


@query(""" SELECT match_id, frame FROM frames WHERE half = 1 AND t BETWEEN 1704200000000 AND 1704900000000 AND x BETWEEN 0.3 AND 55.7""")
def src11_players_in_window(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("time_s", C("t") / 1000)
    return tables.in_window(f, 1, 1704200000.0, 1704900000.0).where("x between 0.3 and 55.7").select("match_id", "frame")


@query(""" SELECT match_id, kind, count(*) AS n, min(frame) AS first FROM frames WHERE kind IN ('click', 'signup') GROUP BY 1, 2 UNION ALL SELECT match_id, 'all', count(DISTINCT frame), min(frame) FROM frames GROUP BY 1""")
def src04_src12_frames_of_tables(spark, sf_dir):
    f = frames(spark, sf_dir)
    kinds = f.where("kind in ('click', 'signup')").groupBy("match_id", "kind").agg(F.count("*").alias("n"), F.min("frame").alias("first"))
    all_frames = tables.frames_of(f.where("frame % 2 = 0"), f)
    return kinds.unionByName(all_frames.groupBy("match_id").agg(F.count("*").alias("n"), F.min("frame").alias("first")).withColumn("kind", F.lit("all")))


@query(""" SELECT match_id, '{' || string_agg('"' || kind || '":' || n, ',' ORDER BY kind) || '}' AS json FROM (SELECT match_id, kind, count(*) AS n FROM frames GROUP BY 1, 2) GROUP BY 1""")
def snk04_nested_stats(spark, sf_dir):
    return sinks.nested(frames(spark, sf_dir).groupBy("match_id", "kind").agg(F.count("*").alias("n")), ["match_id"], "kind", "n")


@query(""" SELECT match_id, frame, kind AS type, CASE WHEN kind = 'view' THEN round(x, 2) END AS x_from, CASE WHEN kind = 'signup' THEN round(value / 500, 3) END AS xg FROM frames WHERE kind IN ('view', 'signup', 'purchase', 'click')""")
def snk05_all_actions(spark, sf_dir):
    f = frames(spark, sf_dir)
    part = lambda k, *cols: f.where(C("kind") == k).select("match_id", "frame", C("kind").alias("k"), *cols)
    out = sinks.all_actions(part("view", C("x").alias("x_from")), part("signup", (C("value") / 500).alias("xg")), part("purchase"), part("click"))
    return sinks.rounded(out, {"x_from": 2, "xg": 3}).select("match_id", "frame", C("k").alias("type"), "x_from", "xg")


@query(""" SELECT match_id, '{"match_id":' || match_id || ',"n":' || count(*) || ',"note":"<\\/script>"}' AS data FROM frames GROUP BY 1""")
def snk09_report_payload(spark, sf_dir):
    d = frames(spark, sf_dir).groupBy("match_id").agg(F.count("*").alias("n")).withColumn("note", F.lit("</script>"))
    return d.select("match_id", sinks.payload(d).alias("data"))


@query(""" SELECT match_id, half, CAST(floor(x / 2) AS BIGINT) AS bin, count(*) AS n FROM frames WHERE x IS NOT NULL GROUP BY 1, 2, 3""")
def snk11_plot_series(spark, sf_dir):
    return frames(spark, sf_dir).where("x is not null").groupBy("match_id", "half", F.floor(C("x") / 2).alias("bin")).agg(F.count("*").alias("n"))


#: A lens eight metres above the middle of the near line.
FISHEYE = {"model": "fisheye", "f": 620.0, "cx": 960.0, "cy": 540.0, "k": [0.02, -0.004, 0.0003], "rvec": [2.1, 0.0, 0.0], "tvec": [-28.0, 12.0, 20.0]}
DISTORTED = {"model": "distorted", "K": [[1000.0, 0, 960.0], [0, 1000.0, 540.0], [0, 0, 1.0]], "dist": [-0.12, 0.03, 0, 0, 0.0], "H": [[0.03, 0.002, -5.0], [0.001, 0.05, -10.0], [0.00001, 0.0002, 1.0]]}


@query(""" SELECT match_id, frame, round(x, 4) AS x, round(y, 4) AS y FROM frames WHERE x IS NOT NULL""")
def fn02_fn03_fn04_lens_round_trip(spark, sf_dir):
    """Pixels of every position, and back: both lens models return where they came from."""
    models = {"top": FISHEYE, "bottom": DISTORTED}
    cam = F.when(C("frame") % 2 == 0, "top").otherwise("bottom")
    there, back = lens.lens_function(models, back=True), lens.lens_function(models)
    p = frames(spark, sf_dir).where("x is not null").withColumn("cam", cam).withColumn("p", there("cam", "x", "y"))
    return p.withColumn("q", back("cam", C("p.x"), C("p.y"))).select("match_id", "frame", F.round("q.x", 4).alias("x"), F.round("q.y", 4).alias("y"))


@query()
def report_timeline(spark, sf_dir):
    """The report's series: shares over time, heat and scores in one tidy table."""
    f = frames(spark, sf_dir)
    line = wn.cumulative_timeline(f, ["match_id", "half"], "t", C("team") == 0, C("team").isNotNull(), 172_800_000, 43_200_000)
    heat = ag.heat_grid(f.where("x is not null"), ["match_id"], F.floor(C("x") / 2).cast("int"), F.floor(C("y") / 2).cast("int"))
    return line.select("match_id", F.lit("share").alias("series"), C("g").alias("at"), "share").unionByName(heat.select("match_id", F.lit("heat").alias("series"), (C("ix") * 100 + C("iy")).cast("long").alias("at"), "share"))
