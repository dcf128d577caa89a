"""Shots against a plain version of their rules, on made-up matches, and the cases by themselves."""

import math
import random

import pytest

from trackforge.operators import shots
from trackforge.params import Actions, Pitch

A, PITCH, KEYS = Actions(), Pitch(), ["match_id", "half"]
L, W, G = PITCH.length, PITCH.width, A.goal_width
HELD = "match_id string, half int, frame long, t long, x double, y double, ball_state string, controlled_by int"
SEGMENTS = "match_id string, half int, team int, t0 long, t1 long, i0 long, i1 long"
STEP = 100


def made_up(match, seed):
    """Frames of two halves, segments of control in them, and goals."""
    rng = random.Random(seed)
    held, segments, goals, frame = [], [], [], 0
    for half in (1, 2):
        t, caught = 1_000_000 * (half - 1), None
        for _ in range(60):
            team = rng.randint(0, 1) if caught is None else 1 - caught
            right = (team == 0) == (half == 1)
            x, y = rng.uniform(26, 52) if right else rng.uniform(4, 30), rng.uniform(8, 24)
            if caught is not None:  # a goalkeeper has the ball
                x, y = (2.0 if right else L - 2.0), W / 2
            caught = team if rng.random() < 0.3 else None
            first = frame, t
            for _ in range(rng.randint(3, 8)):
                held.append((match, half, frame, t, x + rng.uniform(-0.3, 0.3), y, "play", team))
                frame, t = frame + 1, t + STEP
            segments.append((match, half, team, first[1], t - STEP, first[0], frame - 1))
            goal_x = L if right else 0.0
            aim = W / 2 + rng.choice([0, 1, 2, 4, 6, 9]) * rng.choice([-1, 1])
            speed, seen = rng.uniform(3, 25), rng.random() < 0.5
            d = math.hypot(goal_x - x, aim - y)
            for k in range(1, rng.randint(4, 60) if caught is None else 20):
                far = speed * k * STEP / 1000
                bx, by = x + (goal_x - x) * far / d, y + (aim - y) * far / d
                out = bx < -1 or bx > L + 1
                if out and rng.random() < 0.7:
                    held.append((match, half, frame, t, bx, by, "out", None))
                else:
                    held.append((match, half, frame, t, *((bx, by, "play") if seen and not out else (None, None, None)), None))
                frame, t = frame + 1, t + STEP
            if rng.random() < 0.35:
                goals.append((match, half, t - rng.randint(-1500, 8000), rng.choice([0, 1, team, None])))
    return held, segments, sorted(set(goals), key=lambda g: g[2])


def plain_shots(held, segments, goals, exclusive=False):
    by_frame = {r[2]: r for r in held}
    right = lambda team, half: (team == 0) == (half == 1)
    ahead = lambda team, half, x, y: (x, y) if right(team, half) else (L - x, W - y)
    found = []
    for n, (_, half, team, _, t1, _, i1) in enumerate(segments):
        px, py = by_frame[i1][4:6]
        x0, y0 = ahead(team, half, px, py)
        if not 0 <= L - x0 <= A.shot_range:
            continue
        later = segments[n + 1] if n + 1 < len(segments) and segments[n + 1][1] == half else None
        rows = [r for r in held if r[1] == half and r[3] > t1 and r[4] is not None]
        end = next((r for r in rows if t1 + 100 <= r[3] <= t1 + 1000 + STEP and math.hypot(r[4] - px, r[5] - py) >= 2.5), None)
        least = A.shot_speed
        if end is None:
            at_goal = False
            if later and later[3] - t1 <= 5000:
                end = by_frame[later[5]]
                at_goal = later[2] != team and L - ahead(team, half, *end[4:6])[0] <= 3.5
            out = next((r for r in rows if r[6] == "out" and r[3] <= t1 + 5000), None)
            if not at_goal and out and (later is None or later[3] > out[3]):
                if ahead(team, half, *out[4:6])[0] > L - 1:
                    end, at_goal = out, True
                elif end is None and out[3] - t1 <= 3500:
                    end = out
            if end is None:
                continue
            least = 0.0 if at_goal else 0.8 * A.shot_speed
        d = math.hypot(end[4] - px, end[5] - py)
        if d < 2.5:
            continue
        speed = d / (max(end[3] - t1, STEP) / 1000)
        x1, y1 = ahead(team, half, *end[4:6])
        ux, uy = (x1 - x0) / d, (y1 - y0) / d
        if ux < 0.3 or speed < least or (least and (L - x0) / ux / speed > 3):
            continue
        off = abs(y0 + (L - x0) / ux * uy - W / 2)
        if off > G / 2 + 4 or (later and later[2] == team and later[3] - t1 <= 2500):
            continue
        outcome = "on_target" if off <= G / 2 else "off_target"
        if later and later[2] != team and later[3] - t1 <= 3000:
            outcome = "saved" if off <= G / 2 and L - ahead(team, half, *by_frame[later[5]][4:6])[0] <= 3.5 else "blocked"
        if off <= G / 2 and any(-2000 <= g[2] - t1 <= 9000 for g in goals):
            outcome = "goal"
        found.append({"half": half, "team": team, "t": t1, "outcome": outcome, "origin": None})
    attempts, taken = list(found), []
    for _, half, g, scorer in goals:
        near = [s for s in attempts if -2000 <= g - s["t"] <= 9000 and scorer in (None, s["team"]) and not (exclusive and s in taken)]
        if near:
            best = max(near, key=lambda s: s["t"])
            best["outcome"] = "goal"
            taken.append(best)
            continue
        where = None
        if scorer is not None:
            rows = [r for r in held if r[1] == half and r[4] is not None and ahead(scorer, half, r[4], r[5])[0] >= L / 2]
            control = [r for r in rows if g - 15_000 <= r[3] <= g - 300 and r[7] == scorer]
            ball = [r for r in rows if g - 8000 <= r[3] <= g - 1500 and L - ahead(scorer, half, r[4], r[5])[0] >= 3]
            if control or ball:
                where = (control or ball)[-1][3], scorer, "control" if control else "ball"
        else:
            ends = [(s, by_frame[s[6]]) for s in segments if s[1] == half and 0 < g - s[4] <= 10_000]
            ends = [(s, r) for s, r in ends if ahead(s[2], s[1], r[4], r[5])[0] >= L / 2]
            if ends:
                where = ends[-1][0][4], ends[-1][0][2], "control"
        if where:
            found.append({"half": half, "team": where[1], "t": where[0], "outcome": "goal", "origin": where[2]})
    kept = []
    for s in sorted(found, key=lambda s: (s["t"], s["origin"] is not None)):
        if not any(o["team"] == s["team"] and s["t"] - o["t"] < 1500 for o in kept):
            kept.append(s)
    return kept


@pytest.fixture(scope="module")
def matches(spark):
    made = {m: made_up(m, seed) for m, seed in (("a", 1), ("b", 2), ("c", 3))}
    table = lambda i, schema: spark.createDataFrame([r for parts in made.values() for r in parts[i]], schema).repartition(3)
    directions = spark.createDataFrame([(m, h, k, (k == 0) == (h == 1)) for m in made for h in (1, 2) for k in (0, 1)], "match_id string, half int, team int, right boolean")
    return made, table(0, HELD), table(1, SEGMENTS), table(2, "match_id string, half int, t long, scorer int"), directions


@pytest.mark.parametrize("exclusive", [False, True])
def test_all_shots_against_the_plain_rule(matches, exclusive):
    made, held, segments, goals, directions = matches
    found = shots.all_shots(segments, held, goals, directions, KEYS, A, PITCH, STEP, exclusive).collect()
    seen = set()
    for m, parts in made.items():
        wanted = sorted((s["half"], s["team"], s["t"], s["outcome"], s["origin"]) for s in [x | {"origin": x["origin"] or ""} for x in plain_shots(*parts, exclusive)])
        assert sorted((r.half, r.team, r.t, r.outcome, r.origin or "") for r in found if r.match_id == m) == wanted
        seen |= {(w[3], w[4]) for w in wanted}
    assert {o for o, _ in seen} == {"goal", "saved", "blocked", "on_target", "off_target"} and {o for _, o in seen} == {"", "control", "ball"}
    assert all((r.speed is None) == r.inferred for r in found)


def test_two_goals_that_share_a_shot(spark):
    found = spark.createDataFrame([("m", 1, 10_000, 0), ("m", 1, 13_000, 0), ("m", 1, 12_000, 1)], "match_id string, half int, t long, team int")
    goals = spark.createDataFrame([("m", 14_000, 0), ("m", 16_000, 0), ("m", 17_000, 0)], "match_id string, t long, scorer int")
    rows = lambda exclusive: sorted((r.goal_t, r.t) for r in shots.claims(found, goals, ["match_id"], exclusive).collect())
    assert rows(False) == [(14_000, 13_000), (16_000, 13_000), (17_000, 13_000)]
    assert rows(True) == [(14_000, 13_000), (16_000, 10_000)]


def test_no_goals_and_no_segments(spark, matches):
    _, held, segments, goals, directions = matches
    assert {r.outcome for r in shots.all_shots(segments, held, goals.limit(0), directions, KEYS, A, PITCH, STEP).collect()} <= {"saved", "blocked", "on_target", "off_target"}
    assert shots.all_shots(segments.limit(0), held, goals.limit(0), directions, KEYS, A, PITCH, STEP).count() == 0
