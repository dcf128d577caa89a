"""Goals of a made-up match, from kick-offs, the ball's way and players' places."""

import numpy as np
import pytest

from trackforge.operators import goals, kickoffs
from trackforge.params import Pitch
from trackforge.plans import match

PITCH = Pitch()
L, W = PITCH.length, PITCH.width
STEP = 200  # ms from frame to frame
LASTS, KICKOFF, STAND = 400_000, 15_000, 4_000  # of a half; from a goal to the kick-off; how long the teams stand
STARTS = {1: 20_000, 2: 620_000}
GOALS = ((1, 100, 0), (1, 250, 1), (2, 150, 0))  # half, second, team


def right(half, team):
    return (team == 0) == (half == 1)


def made_up(scored=GOALS, waits=(), hidden=(), untracked=(), late=()):
    """Rows of players and of the ball. waits: (half, second, ball on the spot) formations; hidden: (half, second) of goals
    whose kick-off has no tracked ball; untracked: the same, with detections that weren't tracked; late: half, x: the ball in the net at the end."""
    players, ball, raw = [], [], []
    for half, begin in STARTS.items():
        stands = [(0, right(half, 1) * 1, True), *((1000 * s + KICKOFF, 1 - team, True) for h, s, team in scored if h == half), *((1000 * s, None, on) for h, s, on in waits if h == half)]
        for now in range(0, LASTS, STEP):
            t, frame = begin + now, (begin + now) // STEP
            stand = next((x for x in stands if x[0] <= now < x[0] + STAND), None)
            places = []
            for i in range(12):
                team, row = i % 2, i // 2
                side = -1 if right(half, team) else 1
                if stand:
                    x, y = L / 2 + side * (8 + 3 * (row % 3)), 4 + 5 * row
                    if stand[1] == team and row == 0:
                        x, y = L / 2 + side * 0.6, W / 2
                else:  # all in one part of the pitch, on the move
                    x, y = 41 + 9 * np.sin(now / 4000 + i), 16 + 12 * np.cos(now / 5000 + 2 * i)
                places.append((float(x), float(y), team))
                players.append(("m", half, frame, t, "player", float(x), float(y), team, 0))
            goal = next(((s, team) for h, s, team in scored if h == half and 1000 * s <= now < 1000 * s + KICKOFF), None)
            if stand and stand[2] and (half, (stand[0] - KICKOFF) // 1000) not in (*hidden, *untracked):
                spot = (L / 2, W / 2)
            elif stand:
                spot = None
                if (half, (stand[0] - KICKOFF) // 1000) in untracked and len([r for r in raw if r[1] == half and r[3] >= begin + stand[0]]) < 12:
                    raw.append(("m", half, frame, t, L / 2 + 0.2, W / 2))
            elif goal and now < 1000 * goal[0] + 5000:
                spot = (L + 1.0 if right(half, goal[1]) else -1.0, W / 2)
            elif any(h == half for h, _ in late) and now >= LASTS - 8000 and (now // STEP) % 2:
                spot = (next(x for h, x in late if h == half), W / 2)
            else:
                spot = (places[3][0] + 0.4, places[3][1])
            if spot:
                ball.append(("m", half, frame, t, float(spot[0]), float(spot[1])))
    return players, ball, raw


def found(spark, **options):
    players, ball, raw = made_up(**options)
    p = spark.createDataFrame(players, "match_id string, half int, frame long, t long, class string, x_m double, y_m double, team int, gk int")
    b = spark.createDataFrame(ball, "match_id string, half int, frame long, t long, x double, y double")
    r = spark.createDataFrame(raw, "match_id string, half int, frame long, t long, x double, y double").unionByName(b)
    directions = spark.createDataFrame([("m", h, t, right(h, t)) for h in (1, 2) for t in (0, 1)], "match_id string, half int, team int, right boolean")
    halves = spark.createDataFrame([("m", h, x, x + LASTS) for h, x in STARTS.items()], "match_id string, half int, start long, end long")
    s = match.Settings()
    events = match.kickoff_events(b, p, s)
    outfield = p.selectExpr("match_id", "half", "t", "x_m x", "y_m y", "team")
    all_ = goals.goals(events, b, r, outfield, directions, s.pitch, s.actions, s.goals, halves).cache()
    late = goals.late_goals(all_, b, halves, directions, s.pitch, s.actions, s.goals)
    out = sorted(all_.collect(), key=lambda r: r.kickoff_t), late.collect()
    spark.catalog.clearCache()
    return out


def scored(rows):
    return [(r.half, round((r.goal_t - STARTS[r.half]) / 1000), r.scorer) for r in rows if r.category == "goal"]


def test_goals_are_found_with_time_and_scorer(spark):
    rows, late = found(spark)
    assert scored(rows) == list(GOALS) and not late
    assert [r.half for r in rows if r.category == "start of the half"] == [1, 2]
    assert all(r.scored_by_side == r.scored_by_kicker and not r.goal_time_is_rough and r.how == "ball" for r in rows if r.category == "goal")


def test_waiting_and_repeated_formations_are_no_goals(spark):
    assert scored(found(spark, waits=((1, 330, False),))[0]) == list(GOALS)
    assert scored(found(spark, waits=((1, 145, True),))[0]) == list(GOALS)


def test_goals_close_to_each_other(spark):
    assert scored(found(spark, scored=((1, 100, 0), (1, 130, 1)))[0]) == [(1, 100, 0), (1, 130, 1)]


def test_an_untracked_ball_on_the_spot_is_evidence(spark):
    rest = [g for g in GOALS if g != (1, 250, 1)]
    rows = found(spark, hidden=((1, 250),))[0]
    assert scored(rows) == rest and any(r.category == "check" and r.how == "formation" for r in rows)
    rows = found(spark, untracked=((1, 250),))[0]
    assert scored(rows) == list(GOALS) and [r.how for r in rows if r.category == "goal"] == ["ball", "ball (raw)", "ball"]


def test_a_goal_at_the_end_of_a_half_is_possible(spark):
    rows, late = found(spark, late=((1, -1.3),))
    assert scored(rows) == list(GOALS)
    assert [(r.half, r.side, r.scorer, r.n) for r in late] == [(1, "left", 1, 20)]


def test_starts_and_groups_of_kickoffs(spark):
    events = spark.createDataFrame([("m", 1 if t < 1000 else 2, 1000 * t, 1000 * t, 1000 * t + 1000, True) for t in (20, 55, 280, 1700, 1740, 1900)], "match_id string, half int, at long, t0 long, t1 long, by_ball boolean")
    s = match.Settings().goals
    merged = goals.merged_kickoffs(events, s)
    assert [r.start for r in sorted(goals.with_starts(merged, None, s).collect(), key=lambda r: r.event)] == [True, True, False, True, True, False]
    late = spark.createDataFrame([("m", 1, -100_000), ("m", 2, 1_690_000)], "match_id string, half int, start long")
    assert [r.start for r in sorted(goals.with_starts(merged, late, s).collect(), key=lambda r: r.event)] == [False, False, False, True, True, False]
    near = spark.createDataFrame([("m", 1, 1000 * t, 1000 * t - 500, 1000 * t + 500, t == 31) for t in (20, 31, 34, 36)], "match_id string, half int, at long, t0 long, t1 long, by_ball boolean")
    assert sorted((r.event, r.t0, r.t1, r.how, r.previous) for r in goals.merged_kickoffs(near, s).collect()) == [(20_000, 19_500, 34_500, "ball", None), (36_000, 35_500, 36_500, "formation", 20_000)]


def test_formations_must_be_calm(spark):
    rows = []
    for i in range(20):
        for k in range(10):
            x = (10 if k % 2 else 46) + (k // 2)
            rows.append(("m", 100 * i, float(x + (0.3 * i if i >= 10 else 0)), 3.0 + 2.5 * k))
    players = spark.createDataFrame(rows, "match_id string, t long, x double, y double")
    formed = players.select("match_id", "t").distinct()
    assert sorted(r.t for r in kickoffs.calm(formed, players, ["match_id"], "t").collect()) == [*range(100, 1000, 100)]


@pytest.mark.parametrize("inside_again", [True, False])
def test_runs_outside_hold_their_last_row(spark, inside_again):
    n = 12
    x = [28.0] * 3 + [-3.0] * (5 if inside_again else n - 3) + [28.0] * (n - 8 if inside_again else 0)
    ball = spark.createDataFrame([("m", 1, i, 400 * i, x[i], 16.0) for i in range(n)], "match_id string, half int, frame long, t long, x double, y double")
    players = spark.createDataFrame([("m", 1, i, 1.0, 1.0, 0) for i in range(n)], "match_id string, half int, frame long, x_m double, y_m double, team int")
    states = {r.frame: r.ball_state for r in match.possession(ball, players, match.Settings()).collect()}
    assert [f for f, s in sorted(states.items()) if s == "out"] == list(range(3, 8 if inside_again else n))


def test_goals_from_notes(spark):
    notes = spark.createDataFrame([("m", "0:10=1, 1:40=0,2:00,x=1,3:00=7,"), ("n", "1:00:00=1"), ("o", None)], "match_id string, text string")
    rows = spark.createDataFrame([("m", 1, 0), ("m", 1, 60_000), ("m", 2, 110_000), ("m", 2, 115_000), ("n", 1, 5)], "match_id string, half int, t long")
    found = goals.manual_goals(notes, rows)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([("m", 1, 10_000, 1), ("m", 2, 100_000, 0), ("m", 2, 120_000, None), ("n", 1, 3_600_000, 1)], key=repr)
    others = spark.createDataFrame([("m", 1, 5, "ball", "goal", 4, "left")], "match_id string, half int, kickoff_t long, how string, category string, goal_t long, side string")
    both = goals.with_manual(others.selectExpr("*", "false as goal_time_is_rough", "0 as scorer"), found)
    assert both.count() == 5 and {(r.how, r.side) for r in both.collect()} == {("ball", "left"), ("manual", None)}
