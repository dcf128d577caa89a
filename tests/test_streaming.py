"""Streams in several micro-batches against the batch operators, and what happens to late rows."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from trackforge.operators import ball
from trackforge.params import Ball
from trackforge.streaming import online

START = dt.datetime(2024, 5, 1, 12)


def stream(spark, folder, parts, schema):
    """A stream that reads one part in each micro-batch."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/part={i}")
        for f in (folder / "in" / f"part={i}").glob("*.parquet"):
            f.rename(folder / "in" / f"{i:03d}.parquet")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*.parquet")


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def test_windows_overlap(spark, tmp_path):
    rows = [("m", at(s), s % 3 == 0) for s in range(0, 300, 5)]
    shares = online.hopping_share(stream(spark, tmp_path, [rows[:30], rows[30:]], "k string, ts timestamp, flag boolean"), ["k"], "ts", F.col("flag"), "60 seconds", "20 seconds", "10 seconds")
    found = {(r.g - START).total_seconds(): (r.n, round(r.share, 6)) for r in online.drained(shares, str(tmp_path / "out"), "complete").collect()}
    for g in range(20, 360, 20):
        inside = [f for _, t, f in rows if g - 60 <= (t - START).total_seconds() < g]
        assert found[g] == (len(inside), round(np.mean(inside), 6))


def test_late_rows_are_dropped(spark, tmp_path):
    parts = [[("m", at(0)), ("m", at(2))], [("m", at(500))], [("m", at(501))], [("m", at(4)), ("m", at(502))], [("m", at(1000))], [("m", at(1001))]]
    found = online.drained(online.sessions(stream(spark, tmp_path, parts, "k string, ts timestamp"), ["k"], "ts", "10 seconds", "60 seconds"), str(tmp_path / "out"))
    assert [((r.t0 - START).total_seconds(), (r.t1 - START).total_seconds(), r.n) for r in found.orderBy("t0").collect()] == [(0, 2, 2), (500, 502, 3)]


def test_repeats_within_the_watermark(spark, tmp_path):
    parts = [[("m", 1, at(0)), ("m", 1, at(0)), ("m", 2, at(1))], [("m", 1, at(3)), ("m", 3, at(4))]]
    found = online.drained(online.without_repeats(stream(spark, tmp_path, parts, "k string, frame long, ts timestamp"), ["k", "frame"], "ts", "60 seconds"), str(tmp_path / "out"))
    assert sorted((r.frame, r.ts) for r in found.collect()) == [(1, at(0)), (2, at(1)), (3, at(4))]


def test_repeated_micro_batches_replace_their_rows(spark, tmp_path):
    schema = "k string, ts timestamp"
    source = stream(spark, tmp_path, [[("a", at(0))], [("b", at(1))]], schema)
    assert online.drained(source, str(tmp_path / "out")).count() == 2
    assert online.drained(source.where("k = 'none'"), str(tmp_path / "other")).count() == 0


def test_ball_online_as_in_batch(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = []
    for key in ("a", "b"):
        for i in range(120):
            seen = [(10 + i * 0.05, 5.0, 0.4, 9.0 if i else 1.0), *([(40.0, 8.0, 0.9, 1.0)] if 30 <= i < 33 or 60 <= i < 80 else [])]
            rows += [(key, at(i / 10), i, i * 100, float(x), y, c, d + rng.random() * 0.1) for x, y, c, d in seen]
    schema = "k string, ts timestamp, frame long, t long, x double, y double, confidence double, person double"
    whole = spark.createDataFrame(rows, schema)
    wanted = sorted((r.k, r.frame, r.x) for r in ball.track_ball(whole, ["k"], Ball()).collect())
    parts = [[r for r in rows if a <= r[2] < a + 31] for a in range(0, 120, 31)] + [[("z", at(900), 0, 0, 1.0, 1.0, 0.9, 0.1)], [("z", at(2000), 1, 1, 1.0, 1.0, 0.9, 0.1)]]
    found = online.drained(online.online_ball(stream(spark, tmp_path, parts, schema), "k", "ts", "1 second"), str(tmp_path / "out"))
    assert sorted((r.k, r.frame, r.x) for r in found.where("k <> 'z'").collect()) == wanted and any(x == 40.0 for _, _, x in wanted)
