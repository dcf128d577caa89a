"""A made-up match through the whole chain: two teams, a ball that changes hands, goes out, and lies still."""

import numpy as np
import pytest

from trackforge import schema
from trackforge.operators import report
from trackforge.plans import match


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(7)
    rows, teams = [], []
    for half in (1, 2):
        for i in range(300):
            frame, t = half * 10_000 + 2 * i, half * 2000 + i / 15
            holder = 0 if (i // 75) % 2 == 0 else 1
            spots = []
            for k in range(12):
                team = k % 2
                side = 1 if (team == 0) == (half == 1) else -1
                x = 28 - side * (4 + 2 * (k // 2)) + 2.5 * np.sin(i / 6 + k)
                y = 4 + 4.5 * (k // 2) + 0.3 * np.cos(i / 15 + k)
                spots.append((x, y, team))
                row = (frame, t, half, "top", "player", 0.9, 0.0, 0.0, 1.0, 1.0, float(x), float(y))
                rows.append(row)
                teams.append((*row, team, 0))
            bx, by, _ = next(s for s in spots[4:] if s[2] == holder)
            if i % 10:
                rows.append((frame, t, half, "top", "ball", 0.8, 90.0, 90.0, 91.0, 91.0, float(bx + rng.normal(0, 0.1)), float(by)))
    d = spark.createDataFrame(rows, schema.DETECTIONS)
    p = spark.createDataFrame(teams, schema.TEAMS)
    add = lambda df: schema.with_ms(df).selectExpr("*", "'m' as match_id")
    return {k: v.cache() for k, v in match.analyse(add(d), add(p)).items()}


def test_ball_is_known_in_almost_all_frames(tables):
    assert tables["ball"].where("x is not null").count() >= 590
    assert tables["ball"].where("source = 'interpolated'").count() >= 50


def test_possession_follows_the_holder(tables):
    found = tables["possession"].collect()
    right = [r.possession == (0 if ((r.frame % 10_000) // 2 // 75) % 2 == 0 else 1) for r in found]
    assert len(found) == 600 and np.mean(right) > 0.85
    share = {r.half: r.team_0_percent for r in tables["share"].collect()}
    assert set(share) == {1, 2, None} and all(40 < s < 60 for s in share.values())


def test_sides_sequences_and_passes(tables):
    assert {(r.half, r.team): r.right for r in tables["directions"].collect()} == {(1, 0): True, (1, 1): False, (2, 0): False, (2, 1): True}
    assert tables["sequences"].count() == 8 and tables["recoveries"].count() == 6
    assert tables["passes"].where("completed").count() == 0
    for name in ("zones", "shots", "kickoffs", "goals"):
        tables[name].count()


def test_players_are_tracked_through_the_halves(tables):
    slots = tables["tracks"].where("slot is not null").groupBy("half", "slot_team", "slot").count().collect()
    assert len(slots) == 24 and sum(r["count"] for r in slots) >= 0.95 * 7200
    assert {(r.half, r.team): r.substitutes for r in tables["substitutes"].collect()} == {(h, t): 0 for h in (1, 2) for t in (0, 1)}


def test_report_of_the_match(tables):
    rows = {(r.scope, r.team, r.measure): r.value for r in tables["report"].collect()}
    scopes = ("match", "half_1", "half_2")
    assert len(rows) == len(scopes) * 2 * len(report.MEASURES)
    for scope in scopes:
        assert abs(sum(rows[scope, k, "possession"] for k in (0, 1)) - 100) < 1e-9
        assert all(abs(sum(rows[scope, k, f"{x}_third"] for x in ("own", "middle", "final")) - 100) < 1e-9 for k in (0, 1))
        assert rows[scope, 0, "ball_losses"] == rows[scope, 1, "recoveries"] and rows[scope, 0, "passes_completed"] <= rows[scope, 0, "passes_attempted"]
    for name in ("possessions", "passes_attempted", "shots", "recoveries"):
        assert all(rows["match", k, name] == rows["half_1", k, name] + rows["half_2", k, name] for k in (0, 1))
    sequences = tables["sequences"].collect()
    for k in (0, 1):
        lasted = [(r.t1 - r.t0) / 1000 for r in sequences if r.team == k]
        assert rows["match", k, "possessions"] == len(lasted) and abs(rows["match", k, "average_possession_s"] - np.mean(lasted)) < 1e-9
        assert rows["match", k, "possessions_over_10_s"] == sum(x >= 10 for x in lasted)
        assert 10 < rows["match", k, "team_length_m"] < 20 and rows["match", k, "average_position_m"] < 28 and rows["match", k, "distance_km"] > 0


def test_candidates_on_bodies_and_spare_balls_are_left_out(spark):
    rows = []
    for i in range(60):
        row = lambda kind, conf, box, x, y: (2 * i, i / 15, 1, "top", kind, conf, *box, float(x), float(y))  # noqa: E731, B023
        rows.append(row("player", 0.9, (100.0, 100.0, 120.0, 160.0), 20 + i / 10, 10))
        rows.append(row("ball", 0.9, (109.0, 110.0, 111.0, 112.0), 20.2 + i / 10, 10))  # a head
        rows.append(row("ball", 0.5, (300.0, 150.0, 302.0, 152.0), 20.5 + i / 10, 10))
        rows.append(row("ball", 0.8, (500.0, 500.0, 502.0, 502.0), 50, 30))  # lies beside the pitch
    detections = schema.with_ms(spark.createDataFrame(rows, schema.DETECTIONS)).selectExpr("*", "'m' as match_id")
    found = match.ball_track(detections, match.Settings()).collect()
    assert len(found) == 60 and all(abs(r.x - 20.5 - r.frame / 20) < 1e-6 for r in found)


def test_teams_are_learnt_from_kickoffs(spark):
    """Players have colours and no teams: the kick-offs tell which are whose, and that the teams change ends."""
    from tests.test_goals import made_up

    rng = np.random.default_rng(1)
    people, ball, _ = made_up()
    shirt = {0: (40.0, 120.0, 128.0), 1: (90.0, 130.0, 120.0)}
    rows = [(m, h, f, t, c, x, y, g, (np.array(shirt[k]) + rng.normal(0, 2, 3)).tolist(), k) for m, h, f, t, c, x, y, k, g in people]
    players = spark.createDataFrame(rows, "match_id string, half int, frame int, t long, class string, x_m double, y_m double, gk int, colour array<double>, truth int")
    seen = spark.createDataFrame(ball, "match_id string, half int, frame int, t long, x double, y double")
    found = match.learnt_teams(seen, players, match.Settings())
    assert {r.decision for r in found["decisions"].collect()} == {"kept"}
    sides = {r.half: (r.left_team, r.swapped) for r in found["sides"].collect()}
    assert sides[1][0] != sides[2][0] and [sides[h][1] for h in (1, 2)] == [False, True]
    teams = found["teams"].select("team", "truth").collect()
    assert len(teams) == len(rows) and np.mean([r.team == r.truth for r in teams]) > 0.97
