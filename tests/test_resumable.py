"""Plans that go on where they stopped."""

import json
import shutil

import pytest
from pyspark.sql import functions as F

from trackforge.plans.resumable import MANIFEST, Step, match_steps, run_steps


def plan(factor=2, calls=None):
    def counted(name, run):
        def inner(t):
            if calls is not None:
                calls.append(name)
            return run(t)

        return inner

    return [
        Step("doubled", ("numbers",), counted("doubled", lambda t: t["numbers"].withColumn("n", F.col("n") * factor)), f"factor {factor}"),
        Step("even", ("doubled",), counted("even", lambda t: t["doubled"].where("n % 4 = 0"))),
        Step("other", ("numbers",), counted("other", lambda t: t["numbers"].where("n > 5"))),
        Step("total", ("even", "other"), counted("total", lambda t: t["even"].union(t["other"]).agg(F.sum("n").alias("n")))),
    ]


@pytest.fixture()
def numbers(spark, tmp_path):
    spark.range(10).select(F.col("id").alias("n")).write.parquet(f"{tmp_path}/in")
    return str(tmp_path / "in")


def test_only_what_is_lost_and_what_follows_is_written_again(spark, tmp_path, numbers):
    out = f"file://{tmp_path}/out"
    run = lambda steps: run_steps(spark, out, {"numbers": numbers}, steps)
    tables, written = run(plan())
    assert written == ["doubled", "even", "other", "total"] and tables["total"].first().n == 40 + 30
    assert run(plan())[1] == []
    lost = json.loads((tmp_path / "out" / MANIFEST).read_text())["even"]["folder"]
    shutil.rmtree(tmp_path / "out" / lost)
    assert run(plan())[1] == ["even", "total"]
    assert run(plan(3))[1] == ["doubled", "even", "total"]
    spark.range(10, 12).select(F.col("id").alias("n")).write.mode("append").parquet(numbers)
    tables, written = run(plan(3))
    assert written == ["doubled", "even", "other", "total"] and tables["other"].count() == 6
    folders = {p.name for p in (tmp_path / "out").iterdir() if p.is_dir()}
    assert folders == {x["folder"] for x in json.loads((tmp_path / "out" / MANIFEST).read_text()).values()}


def test_a_run_that_breaks_off_keeps_what_is_done(spark, tmp_path, numbers):
    out, calls = str(tmp_path / "out"), []
    steps = plan(calls=calls)
    broken = [*steps[:2], Step("other", ("numbers",), lambda t: 1 / 0), steps[3]]
    with pytest.raises(ZeroDivisionError):
        run_steps(spark, out, {"numbers": numbers}, broken)
    assert run_steps(spark, out, {"numbers": numbers}, steps)[1] == ["other", "total"] and calls == ["doubled", "even", "other", "total"]


def test_the_chain_for_matches_as_steps(spark, tmp_path):
    from tests.test_goals import made_up
    from trackforge import schema

    people, ball, _ = made_up(scored=((1, 100, 0),))
    at = lambda r: (r[2], r[3] / 1000, r[1], "top")
    detections = [(*at(r), "player", 0.9, 0.0, 0.0, 1.0, 1.0, r[5], r[6]) for r in people] + [(*at(r), "ball", 0.9, 90.0, 90.0, 91.0, 91.0, r[4], r[5]) for r in ball]
    teams = [(*at(r), "player", 0.9, 0.0, 0.0, 1.0, 1.0, r[5], r[6], r[7], r[8]) for r in people]
    for name, rows, kind in (("detections", detections, schema.DETECTIONS), ("players", teams, schema.TEAMS)):
        schema.with_ms(spark.createDataFrame(rows, kind)).selectExpr("*", "'m' as match_id").write.parquet(f"{tmp_path}/{name}")
    inputs = {name: f"{tmp_path}/{name}" for name in ("detections", "players")}
    tables, written = run_steps(spark, f"{tmp_path}/out", inputs, match_steps())
    assert written == [s.name for s in match_steps()] and run_steps(spark, f"{tmp_path}/out", inputs, match_steps())[1] == []
    assert tables["goals"].where("category = 'goal'").count() == 1 and tables["ball"].count() > 1000
    assert tables["passes"].columns and tables["sequences"].count() > 0
