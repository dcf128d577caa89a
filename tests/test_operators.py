"""Cases with known answers, and rules held against sequential versions of them."""

import datetime
import itertools
import math
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackforge import plans
from trackforge.functions import lens
from trackforge.operators import actions, assignment, ball, colours, evaluate, islands, measures, nearest, players, stateful, teams
from trackforge.params import Actions, Ball, Pitch, Possession, Tracks
from trackforge.sources import sinks, tables


def frames(spark, labels, step=200, half=1):
    rows = [(1, half, i, i * step, x) for i, x in enumerate(labels)]
    return spark.createDataFrame(rows, "match_id int, half int, frame int, t long, team int")


def spans(df):
    return sorted((r.team, r.t0, r.t1) for r in df.collect())


def test_sequences_of_possession(spark):
    f = frames(spark, [0] * 26 + [1] * 20 + [None] * 5 + [0] * 60)
    found = islands.possession_sequences(f, ["match_id", "half"], "frame", "t", "team", 1000, 300)
    assert [(r.team, (r.t1 - r.t0) / 1000) for r in found.orderBy("t0").collect()] == [(0, 5.0), (1, 3.8), (0, 11.8)]


@pytest.mark.parametrize("labels, runs", [([0] * 26 + [1] * 2 + [None] * 5 + [0] * 26, 2), ([0] * 26 + [1] * 2 + [0] * 26, 1)])
def test_short_runs_bridge_only_without_pause(spark, labels, runs):
    found = islands.possession_sequences(frames(spark, labels), ["match_id", "half"], "frame", "t", "team", 1000, 300)
    assert found.count() == runs


def sequential_segments(t, team, bridge, least):
    out, i = [], 0
    while i < len(t):
        if team[i] is None:
            i += 1
            continue
        last, k = i, i + 1
        while k < len(t) and (team[k] == team[i] or (team[k] is None and t[k] - t[last] <= bridge)):
            last = k if team[k] == team[i] else last
            k += 1
        if t[last] - t[i] >= least:
            out.append((team[i], t[i], t[last]))
        i = last + 1
    return sorted(out)


def test_control_segments_match_the_sequential_rule(spark):
    rng = random.Random(5)
    for _ in range(6):
        team = [rng.choice([0, 1, None, None]) for _ in range(40)]
        t = list(itertools.accumulate(rng.choice([1, 2, 5]) for _ in team))
        rows = [(1, 1, i, t[i], team[i]) for i in range(len(t))]
        df = spark.createDataFrame(rows, "match_id int, half int, frame int, t long, team int")
        found = islands.control_segments(df, ["match_id", "half"], "frame", "t", "team", 4, 2)
        assert spans(found) == sequential_segments(t, team, 4, 2)


def test_anchored_merge_keeps_its_anchor(spark):
    df = spark.createDataFrame([(1, x) for x in (0, 5, 14, 16, 20, 33)], "k int, t long")
    assert sorted((r.t, r.n) for r in islands.anchored_merge(df, ["k"], "t", 15).collect()) == [(0, 3), (16, 2), (33, 1)]


def test_possession_needs_time_to_change(spark):
    p = Possession(switch_s=0.3)
    machine = stateful.PossessionState(p)
    seen = [machine.step(t, False, True, c)[1] for t, c in ((0, 0), (100, 1), (200, None), (300, 1), (400, 1), (500, 1))]
    assert seen == [0, 0, 0, 0, 1, 1]
    assert machine.step(600, True, True, 1) == (None, None)
    assert machine.step(700, False, False, None) == (None, None)


def test_ball_tracker_takes_back_the_wrong_path():
    tracker, path, delays = ball.BallFollower(Ball()), {}, []
    for i in range(20):
        t = i * 100
        seen = np.array([(10.0, 10.0, 0.35, 9.0 if i else 1.0), *([(40.0 + i * 0.1, 20.0, 0.9, 1.0)] if i >= 8 else [])])
        final = tracker.step(i, t, seen[:, :2], seen[:, 2], seen[:, 3])
        path |= {f: x for f, _, x, _, _ in final}
        delays += [t - at for _, at, *_ in final]
    path |= {f: x for f, _, x, _, _ in tracker.finish()}
    assert all(path[f] == 10.0 for f in range(8)) and all(path[f] >= 40.0 for f in path if f >= 12)
    assert 9 not in path and 12 in path and max(delays) <= 400


def ball_path(*parts):
    """x of each frame that is followed. parts: first and last time (ms), then a function of the time to (x, confidence, distance to a person)."""
    follower, got = ball.BallFollower(Ball()), {}
    for t in sorted({t for a, b, _ in parts for t in range(a, b, 100)}):
        c = np.array(sorted((x, 5.0, conf, d) for a, b, f in parts if a <= t < b for x, conf, d in [f(t)]))
        got |= {f: x for f, _, x, *_ in follower.step(t, t, c[:, :2], c[:, 2], c[:, 3])}
    return got | {f: x for f, _, x, *_ in follower.finish()}


def test_ball_is_lost_and_found_again():
    near, far = (lambda x: lambda t: (x, 0.6, 1.0)), (lambda x: lambda t: (x, 0.6, 9.0))
    assert set(ball_path((0, 500, near(10.0)), (2500, 3000, near(60.0)))) == {*range(0, 500, 100), *range(2500, 3000, 100)}
    # away from people nothing is taken up, but what is followed may go there
    assert set(ball_path((0, 500, near(10.0)), (2500, 3000, far(60.0)))) == set(range(0, 500, 100))
    assert set(ball_path((0, 500, near(10.0)), (500, 900, far(10.5)))) == set(range(0, 900, 100))


def test_challengers_must_be_better_and_last():
    held = lambda t: (10.0, 0.4, 9.0)
    start = lambda t: (10.0, 0.9, 1.0)
    wide = [(0, 100, start), (100, 2000, held)]
    assert set(ball_path(*wide, (500, 2000, lambda t: (50.0, 0.31, 1.0))).values()) == {10.0}  # not better by the margin
    assert set(ball_path(*wide, (500, 800, lambda t: (50.0, 0.9, 1.0))).values()) == {10.0}  # gone too soon
    assert set(ball_path(*wide, (500, 2000, lambda t: (50.0, 0.9, 9.0))).values()) == {10.0}  # no one near it
    found = ball_path(*wide, (500, 2000, lambda t: (50.0, 0.9, 1.0)))
    assert [f for f, x in sorted(found.items()) if x == 10.0] == [0, 100, 200, 300, 400] and min(f for f, x in found.items() if x == 50.0) == 900
    # one that jumps by more than three metres starts its time anew
    found = ball_path(*wide, (500, 2000, lambda t: (50.0 if t < 700 else 55.0, 0.9, 1.0)))
    assert [f for f, x in sorted(found.items()) if x == 10.0] == list(range(0, 700, 100)) and min(f for f, x in found.items() if x == 55.0) == 1100


def test_assignment_against_all_permutations():
    rng = np.random.default_rng(0)
    for n, m in ((3, 3), (3, 5), (5, 3), (1, 4), (4, 4)):
        c = rng.integers(0, 9, (n, m)).astype(float)
        pairs = assignment.cheapest_assignment(c)
        small, big = min(n, m), max(n, m)
        view = c if n <= m else c.T
        best = min(sum(view[i, p[i]] for i in range(small)) for p in itertools.permutations(range(big), small))
        assert len(pairs) == small and sum(c[i, j] for i, j in pairs) == best


def test_matching_beats_greedy():
    assert len(assignment.largest_matching([[0, 1], [0]], 2)) == 2
    assert assignment.largest_matching([], 3) == {}


def test_clock_shift_is_found():
    official = [5, 12, 20, 31, 40]
    found = [m * 60 - 30 - 170 for m in official]
    shift, n = evaluate.best_shift(found, official, tolerance=0)
    assert n == 5 and 140 <= shift <= 200


def test_gap_filling_needs_reachable_candidates():
    times = np.array([0.0, 0.1, 0.2, 0.3])
    good = [[(1.0, 0.0, 0.9)], [(2.0, 0.0, 0.9), (50.0, 0.0, 1.0)]]
    assert ball.cheapest_fill(times, (0, 0), (3, 0), good) == [(1.0, 0.0), (2.0, 0.0)]
    assert ball.cheapest_fill(times, (0, 0), (3, 0), [[(60.0, 0.0, 1.0)], []]) == [None, None]


def test_cheapest_fill_against_all_paths():
    rng = np.random.default_rng(3)
    for _ in range(40):
        times = np.cumsum(rng.uniform(0.03, 0.2, 5))
        spots = [[tuple(x) for x in np.column_stack([rng.uniform(0, 8, (k, 2)), rng.random(k)]).tolist()] for k in rng.integers(0, 4, 3)]
        best = {}
        for path in itertools.product(*([None, *s] for s in spots)):
            nodes = [(0, 0.0, 0.0), *((k, *c[:2]) for k, c in enumerate(path, 1) if c), (4, 4.0, 4.0)]
            speeds = [math.dist(a[1:], b[1:]) / (times[b[0]] - times[a[0]]) for a, b in itertools.pairwise(nodes)]
            if max(speeds) <= 35:
                best[path] = sum(1 - c[2] for c in path if c) + sum(c is None for c in path) + 0.005 * sum(speeds)
        found = ball.cheapest_fill(times, (0.0, 0.0), (4.0, 4.0), spots)
        if not best:
            assert found == [None] * 3
        else:
            least = min(best, key=best.get)
            assert found == [c and c[:2] for c in least]


def tracked(rows, **options):
    """rows: t in seconds, x, y, team, keeper."""
    p = Tracks(**options)
    frame = pd.DataFrame([(round(1000 * t), x, y, m, k) for t, x, y, m, k in rows], columns=["t", "x", "y", "team", "keeper"]).sort_values(["t", "x", "y"])
    seen = players.Seen.of(frame, Pitch(), p)
    piece = players.followed(seen, p)
    return seen, piece, players.chained_pieces(seen, piece, p), p


def test_two_players_keep_their_tracks():
    rows = [r for i in range(40) for r in ((i * 0.1, 10 + i * 0.3, 5.0, 0, False), (i * 0.1, 20 - i * 0.2, 15.0, 1, False))]
    seen, piece, chains, p = tracked(rows)
    assert sorted(len(c) for c in chains) == [40, 40]
    whole = players.Stretches.of(seen, chains)
    assert sorted(players.places_in_team(seen, whole, np.zeros(2, bool), p)) == [(0, 0), (1, 0)]


def test_false_and_double_detections_start_no_track():
    rows = [(i * 0.1, 10 + i * 0.3, 5.0, 0, False) for i in range(30)] + [(1.0, 40.0, 20.0, 1, False)] + [(i * 0.1, 10.9 + i * 0.3, 5.0, None, False) for i in range(5, 25)]
    _, piece, chains, _ = tracked(rows)
    assert [len(c) for c in chains] == [30]


def test_hidden_players_are_joined_and_changed_ones_are_not():
    y = Pitch().width - 0.5
    walk = lambda t0, x0, y: [(t0 + i * 0.1, x0 + i * 0.1, y, 0, False) for i in range(20)]
    assert len(tracked(walk(0, 10, 15.0) + walk(5.0, 13, 15.0))[2]) == 1
    assert len(tracked(walk(0, 10, y) + walk(5.0, 13, y))[2]) == 2  # one went off at the bench, one came on
    assert len(tracked(walk(0, 10, 0.5) + walk(5.0, 13, 0.5))[2]) == 1
    assert len(tracked(walk(0, 10, 0.5) + walk(5.0, 13, 0.5), change_at_any_line=True)[2]) == 2
    assert len(tracked(walk(0, 10, 15.0) + walk(7.0, 13, 15.0))[2]) == 2


def test_successors_are_the_cheapest_overall():
    rng = np.random.default_rng(7)
    for _ in range(20):
        rows, spots = [], rng.uniform(5, 15, (4, 2))
        for k, (x, y) in enumerate(spots):
            rows += [(i * 0.1 + 0.001 * k, x, y, None, False) for i in range(4)]
        for k, (x, y) in enumerate(rng.uniform(5, 15, (4, 2))):
            rows += [(3.0 + i * 0.1 + 0.001 * k, x, y, None, False) for i in range(4)]
        frame = pd.DataFrame([(round(1000 * t), x, y, m, k) for t, x, y, m, k in rows], columns=["t", "x", "y", "team", "keeper"])
        at = [np.arange(4 * k, 4 * k + 4) for k in range(8)]
        p = Tracks()
        seen = players.Seen(frame.t.to_numpy(float) / 1000, np.zeros(1, int), frame.x.to_numpy(), frame.y.to_numpy(), np.full(32, -1), np.zeros(32, bool), np.zeros(32, bool))
        found = players.successors(seen, players.Stretches.of(seen, at), p)
        price = lambda a, b: math.dist((seen.x[4 * a], seen.y[4 * a]), (seen.x[4 * b], seen.y[4 * b])) + 0.4 * (seen.t[4 * b] - seen.t[4 * a + 3])
        reach = lambda a, b: math.dist((seen.x[4 * a], seen.y[4 * a]), (seen.x[4 * b], seen.y[4 * b])) <= min(1.6 + 6 * (seen.t[4 * b] - seen.t[4 * a + 3]), 14)
        best = max(((sum(c is not None for c in q), -sum(price(a, b) for a, b in enumerate(q) if b is not None)) for q in itertools.product([None, 4, 5, 6, 7], repeat=4) if len({c for c in q if c}) == sum(c is not None for c in q) and all(b is None or reach(a, b) for a, b in enumerate(q))))
        assert len(found) == best[0] and math.isclose(-sum(price(a, b) for a, b in found.items()), best[1])


def test_places_keepers_and_substitutes(spark):
    y = Pitch().width - 0.5
    stay = lambda t0, t1, x, y, m, k=False: [(t, x + 0.01 * i, y, m, k) for i, t in enumerate(np.arange(t0, t1, 0.1))]
    rows = stay(0, 60, 3, 16, 0, True) + stay(0, 60, 30, 10, 0) + stay(0, 20, 30, 25, 1) + stay(40, 60, 25, y, 1) + stay(0, 60, 28, 5, 1, True)
    df = spark.createDataFrame([("m", round(1000 * float(t)), float(x), float(z), m, k) for t, x, z, m, k in rows], "match_id string, t long, x double, y double, team int, keeper boolean")
    found = players.track_players(df, ["match_id"])
    chains = {(r.chain_team, r.chain_keeper, r.slot) for r in found.select("chain_team", "chain_keeper", "slot").distinct().collect()}
    # the second goalkeeper's detections lie far from any goal; the substitute takes the place that is free again
    assert chains == {(0, True, 0), (0, False, 1), (1, False, 0), (1, False, 1)}
    assert {(r.team, r.substitutes) for r in players.substitutes(found, ["match_id"]).collect()} == {(0, 0), (1, 1)}


def test_still_rows_against_a_plain_scan():
    rng = np.random.default_rng(5)
    for _ in range(30):
        n = 300
        t = np.cumsum(rng.choice([100, 200, 1500], n, p=[0.7, 0.29, 0.01]))
        half = np.sort(rng.integers(1, 3, n))
        x, y = np.cumsum(rng.choice([0, 0, 0, 0.4, -0.4, 3], n)), rng.random(n) * 0.4
        wanted, k = np.zeros(n, bool), 0
        while k < n:
            a, b, e = np.median(x[k : k + 5]), np.median(y[k : k + 5]), k
            while e + 1 < n and half[e + 1] == half[k] and t[e + 1] - t[e] <= 1000 and math.hypot(x[e + 1] - a, y[e + 1] - b) <= 1:
                e += 1
            if t[e] - t[k] >= 2000:
                wanted[k : e + 1] = True
                k = e
            k += 1
        assert (stateful.still_rows(t, half, x, y, 2000, 1.0) == wanted).all()


def test_passes_between_touches(spark):
    """Player 0 carries the ball, passes 10 m to 1, who loses it to 2 of the other team, who plays it out; 2 m passes are none."""
    step, spots = 66, {"a": (0, 0, 10.0), "b": (0, 1, 20.0), "c": (1, 0, 32.0), "d": (1, 1, 34.0)}
    script = ["a"] * 10 + [None] * 12 + ["b"] * 8 + [None] * 14 + ["c"] * 6 + [None] * 3 + ["d"] * 6 + ["out"] * 8
    ball, people = [], []
    for i, who in enumerate(script):
        x = spots[who][2] + 0.5 if who in spots else 60.0 if who else None
        ball.append(("m", i, i * step, x, 10.0 if who else None, "out" if who == "out" else "play" if who else None, None))
        people += [("m", i * step, team, slot, px, 10.0) for team, slot, px in spots.values()]
    held = spark.createDataFrame(ball, "m string, frame long, t long, x double, y double, ball_state string, speed double")
    tracked = spark.createDataFrame(people, "m string, t long, slot_team int, slot int, x double, y double")
    touches = actions.player_touches(actions.player_control(held, tracked, ["m"], Actions()), ["m"], 400)
    assert [(r.player, r.i0, r.i1) for r in touches.orderBy("i0").collect()] == [("T0-0", 0, 9), ("T0-1", 22, 29), ("T1-0", 44, 49), ("T1-1", 53, 58)]
    outs = held.where("ball_state = 'out'").select("m", "t", "x", "y")
    found = actions.touch_passes(touches, held.select("m", "frame", "x", "y"), ["m"], Actions(), 0.05, 3000, outs).orderBy("t").collect()
    assert [(r.player, r.x2, r.completed) for r in found] == [("T0-0", 20.5, True), ("T0-1", 32.5, False), ("T1-1", 60.0, False)]
    assert actions.touch_passes(touches, held.select("m", "frame", "x", "y"), ["m"], Actions(), 0.05, 3000).count() == 2


def made_up_colours(seed, keeper=(90.0, 200.0, 60.0), referee=(20.0, 60.0, 210.0)):
    """id, half, t, x, colour, referee, real team of two teams with goalkeepers and a referee; sides change at half-time."""
    rng = np.random.default_rng(seed)
    rows = []
    for half in (1, 2):
        for i in range(60):
            for k in range(14):
                team = k % 2
                left = (team == 0) == (half == 1)
                kind = "keeper" if k < 2 else "referee" if k == 13 else "player"
                x = (3 if left else 53) if kind == "keeper" else rng.uniform(12, 26) + (0 if left or i > 40 else 18)
                base = np.array({"keeper": keeper, "referee": referee}.get(kind) or ((40.0, 120.0, 120.0) if team == 0 else (150.0, 130.0, 125.0)))
                rows.append((len(rows), half, half * 1_000_000 + 400 * i, float(x), (base + rng.normal(0, 4, 3)).tolist(), kind == "referee" and i % 4 > 0, None if kind == "referee" else team))
    return rows


def test_goalkeepers_and_referees_do_not_pull_teams(spark):
    schema = "m string, id long, half int, t long, x double, colour array<double>, referee boolean"
    rows = made_up_colours(3)
    df = spark.createDataFrame([("m", *r[:6]) for r in rows], schema)
    found = {r.id: r.team for r in colours.teams_by_colour(df, ["m"]).collect()}
    right = lambda found, chosen: np.mean([found[r[0]] == (-1 if r[6] is None else r[6]) for r in chosen])
    keepers, others = [r for r in rows if r[3] in (3, 53)], [r for r in rows if r[3] not in (3, 53)]
    assert right(found, keepers) == 1 and right(found, others) > 0.98  # the farthest of a team's colours are nobody's
    # without places nobody is known as a goalkeeper; a kit like a team's tells nothing
    plain = {r.id: r.team for r in colours.teams_by_colour(df.select("m", "id", "colour", "referee"), ["m"]).collect()}
    assert right(plain, others) > 0.98
    same = made_up_colours(4, keeper=(40.0, 120.0, 120.0))
    found = {r.id: r.team for r in colours.teams_by_colour(spark.createDataFrame([("m", *r[:6]) for r in same], schema), ["m"]).collect()}
    assert right(found, [r for r in same if r[3] not in (3, 53)]) > 0.98


def made_up_kits(seed, apart):
    """Goalkeepers who stand in the other half now and then; apart: distance of the two kits."""
    rng, rows = np.random.default_rng(seed), []
    shirt = {0: (40.0, 120.0, 120.0), 1: (150.0, 130.0, 125.0)}
    for i in range(40):
        for team in (0, 1):
            for k in range(4):
                x = rng.uniform(10, 26) + 28 * team
                rows.append((1, 400 * i, float(x), (np.array(shirt[team]) + rng.normal(0, 3, 3)).tolist(), team))
            x = (3.0, 53.0)[team if i < 36 else 1 - team]  # at the end they stand at the other goal
            kit = np.array([90.0, 60.0 + apart * team, 180.0])
            rows.append((1, 400 * i + 20_000 * (i >= 36), x, (kit + rng.normal(0, 1, 3)).tolist(), team))
    return [("m", n, *r) for n, r in enumerate(rows)]


@pytest.mark.parametrize("apart", [60.0, 6.0])
def test_two_kits_that_differ_tell_goalkeepers_apart(spark, apart):
    rows = made_up_kits(1, apart)
    df = spark.createDataFrame([r[:6] for r in rows], "m string, id long, half int, t long, x double, colour array<double>")
    found = {r.id: r.team for r in colours.teams_by_colour(df, ["m"]).collect()}
    moved = [r for r in rows if r[3] >= 30_000 and r[4] in (3.0, 53.0)]
    assert len(moved) == 8
    by_side = lambda x: 0 if x < 28 else 1
    assert [found[r[1]] for r in moved] == [r[6] if apart > 15 else by_side(r[4]) for r in moved]


def test_one_span_of_two_halves_is_split_at_its_dip(spark):
    counts = [12] * 300 + [9, 8, 9, 9, 10, 9, 9] + [12] * 300
    rows = [("one", 2000 * i, n) for i, n in enumerate(counts)]
    rows += [("two", 2000 * i, 12 if i < 200 or i > 260 else 1) for i in range(600)] + [("short", 2000 * i, 12) for i in range(100)]
    df = spark.createDataFrame(rows, "m string, t long, n int")
    found = sorted((r.m, r.half, r.t0, r.t1) for r in islands.playing_spans(df, ["m"], "t", "n", 8, 5, 30_000, 100_000, 2000, 2, split_near_ms=240_000).collect())
    assert found == [("one", 1, 0, 602_000), ("one", 2, 610_000, 1_214_000), ("short", 1, 0, 200_000), ("two", 1, 0, 400_000), ("two", 2, 520_000, 1_200_000)]


def test_nearest_centre_keeps_equal_rows(spark):
    rows = [(1, 7, [0.0, 0.0]), (1, 7, [9.0, 9.0]), (1, 7, [9.0, 9.0]), (1, 8, None), (2, 9, [1.0, 1.0]), (1, 3, [5.0, None])]
    centres = [(1, 0, [0.0, 1.0]), (1, 1, [8.0, 9.0]), (1, 2, [8.0, 9.0])]
    df = spark.createDataFrame(rows, "k int, id int, v array<double>")
    found = teams.nearest_centre(df, spark.createDataFrame(centres, "k int, team int, v array<double>"), ["k"], "v", "team").collect()
    assert sorted(map(tuple, found), key=repr) == sorted([(1, 7, 0, 1.0), (1, 7, 1, 1.0), (1, 7, 1, 1.0), (1, 8, None, None), (2, 9, None, None), (1, 3, None, None)], key=repr)


def test_many_keys_are_walked_in_order(spark):
    """5,000 keys, some of them over several batches, in any order of rows."""
    rng = random.Random(6)
    events = {k: sorted(rng.sample(range(10_000), 60_000 // 10 if k == 77 else rng.randint(1, 4))) for k in range(5000)}
    rows = [(k, t) for k, ts in events.items() for t in ts]
    rng.shuffle(rows)
    wanted = []
    for k, ts in events.items():
        first, n = None, 0
        for t in ts:
            if first is None or t - first >= 500:
                wanted += [(k, first, n)] if n else []
                first, n = t, 0
            n += 1
        wanted.append((k, first, n))
    df = spark.createDataFrame(rows, "k int, t long").repartition(5)
    assert sorted(map(tuple, islands.anchored_merge(df, ["k"], "t", 500).collect())) == sorted(wanted)


def test_lenses_return_where_they_came_from():
    x, y = np.array([5.0, 28.0, 50.0]), np.array([4.0, 16.0, 30.0])
    from trackforge.plans.tables import DISTORTED, FISHEYE

    for c in (FISHEYE, DISTORTED):
        u, v = lens.to_pixels(c, x, y)
        back = lens.to_pitch(c, u, v)
        assert np.allclose(back[0], x, atol=1e-6) and np.allclose(back[1], y, atol=1e-6)


def test_lens_range_ends_at_the_rim():
    assert lens.widest_angle([0, 0, 0]) == 1.55 and lens.widest_angle([0.1, 0, 0]) == 1.55
    # the slope 1 - 0.6 x^2 is 0.05 at 1.2583
    assert math.isclose(lens.widest_angle([-0.2, 0, 0]), 1.26) and lens.widest_angle([0, 0, -0.05]) < 1.3
    c = {"model": "fisheye", "f": 400.0, "cx": 1000.0, "cy": 800.0, "k": [-0.2, 0, 0], "rvec": [np.pi, 0.0, 0.0], "tvec": [0.0, 0.0, 10.0]}
    rim = lens.Radial(c["k"])(np.array([1.25, 1.26, 1.27]))
    x, y = lens.to_pitch(c, 1000 + 400 * (rim[[0, 1, 1]] + [0, -1e-9, 1e-4]), np.full(3, 800.0))
    assert np.isfinite(x[:2]).all() and np.isnan(x[2]) and math.isclose(np.hypot(x[0], y[0]), 10 * np.tan(1.25), rel_tol=1e-6)
    assert np.isnan(lens.to_pixels(c, np.array([10 * np.tan(1.3)]), np.zeros(1))[0]).all()


def test_curves_are_inverted_up_to_where_they_turn():
    for k in ([0.05, -0.02, 0.003], [-0.2, 0, 0], [0, 0, -0.05], [0.3, 0.1, 0.2]):
        curve = lens.Radial(k)
        most = curve.falls_to(0.0, 1.5)
        x = np.linspace(0, 0.999 * most, 50)
        assert np.allclose(curve.back(curve(x), most), x, atol=1e-9)


def test_discriminant_separates(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i % 2), [float(v) for v in rng.normal(3 * (i % 2), 1, 4)]) for i in range(400)]
    df = spark.createDataFrame(rows, "team int, v array<double>")
    w, b = teams.train_discriminant(df, "team", "v", 4)
    assert np.mean([(np.dot(w, v) + b > 0) == bool(t) for t, v in rows]) > 0.95


def test_class_moments_in_parts(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(5, 2, (90, 3))
    rows = [(int(i % 3), v.tolist()) for i, v in enumerate(x)] + [(None, [1.0, 1.0, 1.0]), (1, None), (1, [1.0, None, 2.0])]
    found = teams.class_moments(spark.createDataFrame(rows, "team int, v array<double>").repartition(4), "team", "v", 3)
    for k in range(3):
        n, mean, cov = found[k]
        assert n == 30 and np.allclose(mean, x[k::3].mean(0)) and np.allclose(cov, np.cov(x[k::3].T))


def test_tables_come_back_from_disk(spark, tmp_path):
    ball = [(1, 0.1, 1, 2.0, None, 0.5, "detected"), (2, 0.2, 1, None, None, None, "interpolated")]
    df = spark.createDataFrame(ball, tables.FILES["ball"])
    sinks.write_csv(df, str(tmp_path / "m1" / "ball.csv"), df.columns)
    again = tables.read_table(spark, str(tmp_path), "ball")
    assert again.where("x_m is null").count() == 1 and again.agg({"t": "max"}).first()[0] == 200
    sinks.write_table(again, str(tmp_path / "parquet"), ["half"], ["t"])
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 2


def test_missing_json_gives_no_rows(spark, tmp_path):
    from trackforge import schema

    assert tables.read_json(spark, str(tmp_path / "none.json"), schema.MATCH).count() == 0
    (tmp_path / "m.json").write_text('{"name": "m", "halves": [{"start": "0:10", "end": "20:00", "start_s": 10, "end_s": 1200}]}')
    match = tables.read_json(spark, str(tmp_path / "m.json"), schema.MATCH)
    assert [(r.half, r.start_s) for r in tables.half_rows(match).collect()] == [(1, 10.0)]


def test_empty_tables_give_empty_results(spark):
    none = spark.createDataFrame([], "match_id int, half int, frame int, t long, team int")
    keys = ["match_id", "half"]
    assert islands.possession_sequences(none, keys, "frame", "t", "team", 1, 1).count() == 0
    assert islands.anchored_merge(none, keys, "t", 5).count() == 0


def test_queries_read_whole_vectors(spark, tmp_path):
    rng = np.random.default_rng(4)
    x, label = rng.normal(size=(60, 20)).astype(np.float32), np.arange(60) % 4
    x[:, 12:] += 2 * rng.normal(size=(4, 8))[label]
    spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    x = x.astype(float)
    means = lambda i: [x[(label == k) & (np.arange(60) != i)].mean(0) for k in range(4)]
    nearest = {i: int(np.argmin([np.linalg.norm(x[i] - m) for m in means(i)])) for i in range(60)}
    assert {r.vec_id: r.predicted for r in plans.QUERIES["st29_leave_one_out"](spark, str(tmp_path)).collect()} == nearest
    sides = [x[label % 2 == i] for i in (0, 1)]
    w, b = teams.discriminant([s.mean(0) for s in sides], [np.cov(s.T) for s in sides], [len(s) for s in sides])
    found = {r.vec_id: r.score for r in plans.QUERIES["st12_linear_discriminant"](spark, str(tmp_path)).collect()}
    assert np.allclose([found[i] for i in range(60)], x @ w + b)


def test_equal_means_give_no_direction(spark):
    """Both teams' means are equal; in doubles the order of the rows decides which sum is smaller."""
    df = spark.createDataFrame([(1, 0, x) for x in (0.1, 0.2, 0.3)] + [(1, 1, x) for x in (0.3, 0.2, 0.1)], "k int, team int, x double").coalesce(1)
    assert 0.3 + 0.2 + 0.1 < 0.1 + 0.2 + 0.3
    for first in (df, df.withColumn("team", 1 - df.team)):
        assert {r.team: r.right for r in measures.attack_directions(first, ["k"], "team", "x").collect()} == {0: False, 1: True}


def test_equal_means_give_the_direction_of_the_sql(spark, tmp_path):
    """Equal means whose sums differ in doubles: the SQL, run by one thread, sums in the order of frames."""
    kinds = {"click": (0.3, 0.2, 0.1), "view": (0.1, 0.2, 0.3)}
    rows = []
    for user, step in ((1, 1), (2, -1)):
        for kind, values in kinds.items():
            for v in values[::step]:
                rows.append((len(rows), datetime.datetime(2024, 1, 3), user, kind, v, "{}"))
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    df.orderBy("event_id").coalesce(1).write.parquet(f"{tmp_path}/in")
    df.orderBy(df.event_id.desc()).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    duck = duckdb.connect(config={"threads": 1})
    duck.sql(f"create view events as select * from '{tmp_path}/in/*.parquet'")
    for name in ("ag04_attack_direction", "ag03_thirds", "ag08_action_totals"):
        sql = duck.sql(plans.ORACLES[name])
        found = plans.QUERIES[name](spark, str(tmp_path)).select(*sql.columns).collect()
        assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, sql.fetchall()))
    rights = plans.QUERIES["ag04_attack_direction"](spark, str(tmp_path)).where("right").collect()
    assert {(r.match_id, r.team) for r in rights} == {(1, 0), (2, 1)}


def test_equal_scores_change_team_in_order(spark):
    rows = [(1, f, 1, 5.0) for f in (4, 2, 3)] + [(1, 9, 0, 1.0)]
    df = spark.createDataFrame(rows, "k int, frame int, team int, score double")
    found = teams.balanced(df, ["k"], "team", "score", 2, ["frame"]).collect()
    assert {r.frame: r.balanced for r in found} == {2: 0, 3: 1, 4: 1, 9: 0}


def test_distances_are_rounded_as_in_sql(spark):
    """hypot may differ from the root of squares in the last bit, which matters at a limit."""
    points = [(i, 0.01 * i, 0.013 * i + 0.37) for i in range(1, 400)]
    df = spark.createDataFrame([(i, 0.0, 0.0) for i, *_ in points], "k int, x double, y double").withColumn("b", F.col("k"))
    right = spark.createDataFrame(points, "k int, x double, y double").withColumn("p", F.col("k"))
    found = {r.k: r.distance for r in nearest.nearest_in_key(df, right, ["k"], "b", "p").collect()}
    assert found == {i: math.sqrt(x * x + y * y) for i, x, y in points}


def test_rivals_meet_once(spark):
    spans = [(i % 2, i, 7 * i % 50, 7 * i % 50 + 3 * i) for i in range(40)]
    df = spark.createDataFrame([*spans, spans[3]], "k int, id int, t0 long, t1 long")
    found = nearest.overlaps_in_time(df, ["k"], "id", "t0", "t1", 5, 10)
    wanted = sorted((k, a, b, min(t1, u1) - max(t0, u0)) for k, a, t0, t1 in spans for m, b, u0, u1 in spans if k == m and a < b and min(t1, u1) - max(t0, u0) >= 5)
    assert sorted(map(tuple, found.collect())) == wanted
    assert "Aggregate" not in found.where("a is null or a > 0")._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]


def test_nearest_of_many_looks_at_few(spark):
    """Against all pairs: crowds, copies, lines and groups without points; the nearest of crowds are found without their pairs."""
    from trackforge.operators import proximity

    rng = np.random.default_rng(3)
    for n, spot in ((300, lambda k: rng.uniform(0, 50, (k, 2))), (300, lambda k: np.round(rng.normal(0, 2, (k, 2)))), (200, lambda k: np.stack([np.full(k, 7.0), rng.uniform(0, 9, k)], 1)), (40, lambda k: np.exp(9 * rng.normal(0, 1, (k, 2))))):
        p, q = spot(n), spot(n)
        group, to_group = rng.integers(0, 4, n), rng.integers(1, 6, n)
        d, found = proximity.nearest_points(group, *p.T, to_group, *q.T, 6)
        away = np.sqrt((p[:, None, 0] - q[:, 0]) ** 2 + (p[:, None, 1] - q[:, 1]) ** 2)
        away[group[:, None] != to_group] = np.inf
        wanted = np.where(group == 0, -1, away.argmin(1))
        assert (found == wanted).all() and (d[group > 0] == away.min(1)[group > 0]).all()
    d, found = proximity.nearest_points(np.zeros(3, int), np.array([np.nan, np.inf, 1]), np.zeros(3), np.zeros(2, int), np.array([np.nan, 4]), np.zeros(2), 1)
    assert found.tolist() == [0, 1, 1] and np.isnan(d[0]) and d[1:].tolist() == [np.inf, 3]
    spots = rng.uniform(0, 50, (2, 30_000, 2))
    looked = []
    away = proximity.Strips._away
    proximity.Strips._away = lambda self, x, y, i: looked.append(len(i)) or away(self, x, y, i)
    try:
        proximity.nearest_points(np.zeros(30_000, int), *spots[0].T, np.zeros(30_000, int), *spots[1].T, 1)
    finally:
        proximity.Strips._away = away
    assert sum(looked) < 100 * 30_000
    rows = [(1, 10, 0.0, 0.0), (1, 11, None, 0.0), (2, 12, 0.0, 0.0), (None, 13, 0.0, 0.0)]
    left, right = spark.createDataFrame(rows, "k int, b int, x double, y double"), spark.createDataFrame([(1, 7, 3.0, 4.0, "b"), (1, 5, -3.0, 4.0, "a"), (1, 4, None, 0.0, "c"), (None, 3, 0.0, 0.0, "d")], "k int, p int, x double, y double, who string")
    near = nearest.nearest_in_key(left, right, ["k"], "b", "p", carry=["who"])
    assert near.columns == ["k", "b", "x", "y", "distance", "nearest", "nearest_who"]
    assert {r.b: (r.distance, r.nearest, r.nearest_who) for r in near.collect()} == {10: (5.0, 5, "a"), 11: (None,) * 3, 12: (None,) * 3, 13: (None,) * 3}
    assert "Join" not in near._jdf.queryExecution().optimizedPlan().toString()


def test_nearest_in_time_makes_no_pairs(spark):
    rng = random.Random(5)
    left = [(1, i, rng.randrange(300)) for i in range(60)] + [(2, 99, 5)]
    right = [(1, rng.choice("ab"), rng.randrange(300), i) for i in range(40)] + [(1, "c", 290, 70), (1, "c", 290, 60)]
    l, r = spark.createDataFrame(left, "k int, i int, t long"), spark.createDataFrame(right, "k int, who string, t long, f int")  # noqa: E741
    found = nearest.nearest_in_time(l, r, ["k"], "who", "t", 7, "i")
    wanted = []
    for (k, i, t), who in itertools.product(left, "abc"):
        near = [(abs(u - t), u, f) for m, w, u, f in right if (m, w) == (k, who) and t - 7 <= u < t + 7]
        wanted += [(k, i, who, *min(near)[1:])] if near else []
    assert sorted(map(tuple, found.collect())) == sorted(wanted)
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in line]
    assert len(joins) == 1 and ">=" not in joins[0]


def test_close_links_are_greedy_links_without_a_matrix(spark, monkeypatch):
    rng = np.random.default_rng(8)
    for n, m, spot in ((0, 4, 9.0), (40, 60, 9.0), (70, 30, 4.0), (90, 90, 2.0)):
        for grid in (1.0, 1e-3):
            a, b = (np.round(rng.uniform(0, spot, (k, 2)) / grid) * grid for k in (n, m))
            b[:2] = np.nan
            wanted = np.full(m, -1)
            for i, j in assignment.greedy_links(np.hypot(*(a[:, None] - b[None]).transpose(2, 0, 1)), 2.5):
                wanted[j] = i
            assert assignment.close_links(a, b, 2.5).tolist() == wanted.tolist()
    pairs = []
    within = assignment.pairs_within
    monkeypatch.setattr(assignment, "pairs_within", lambda *args: pairs.append(within(*args)) or pairs[-1])
    a, b = rng.uniform(0, 50, (2, 20_000, 2))
    b[1000:4000], a[:3000] = a[0], a[0]  # a crowd in one place
    assert sorted(assignment.close_links(a, b, 6.0)[1000:4000]) == list(range(3000))
    assert sum(len(p[0]) for p in pairs) < 50 * 20_000


def test_chains_of_frames_with_gaps(spark):
    rows = [(1, 5, 1, 0.0, 0.0), (1, 5, 2, 9.0, 0.0), (1, 8, 3, 0.5, 0.0), (1, 8, 4, 0.2, 0.0), (1, 9, 5, 9.0, 0.0), (1, 9, 6, 0.3, 0.0), (None, 9, 7, 0.3, 0.0)]
    found = stateful.chained(spark.createDataFrame(rows, "k int, frame long, id long, x double, y double"), ["k"], 2.0)
    assert sorted((r.id, r.frame, r.chain) for r in found.collect()) == [(1, 5, 0), (2, 5, 1), (3, 8, 2), (4, 8, 0), (5, 9, 3), (6, 9, 0), (7, 9, 0)]


def test_gaps_of_a_match_need_no_frame_for_each(spark, monkeypatch):
    """Two anchors in a frame, several candidates, empty gaps; a frame of data is made for no frame of the match."""
    rows = [(1, 1, 0, "anchor", 0.0, 0.0, 0.5), (1, 2, 100, "candidate", 40.0, 0.0, 1.0), (1, 2, 100, "candidate", 1.0, 0.0, 0.9), (1, 3, 200, "candidate", 2.0, 0.0, 0.8)]
    rows += [(1, 4, 300, "anchor", 9.0, 9.0, 0.1), (1, 4, 300, "anchor", 3.0, 0.0, 0.1), (1, 4, 300, "candidate", 1.0, 0.0, 0.1), (1, 5, 400, "anchor", 3.0, 0.0, 1.0), (1, 6, 500, "candidate", 3.0, 0.0, 1.0), (2, 6, 500, "candidate", 3.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "k int, frame long, t long, kind string, x double, y double, confidence double")
    monkeypatch.setattr(ball, "grouped", None)
    assert sorted(map(tuple, ball.fill_gaps(df, ["k"]).collect())) == [(1, 2, 1.0, 0.0), (1, 3, 2.0, 0.0)]


def test_keeping_apart_follows_the_number_of_rows(spark, monkeypatch):
    """As the greedy rule says; and of many rows that nearly all stay no pairs are made."""
    from trackforge.operators import clean, proximity

    rng = np.random.default_rng(4)
    rows = [(int(k), i, float(q), int(c), float(x), float(y)) for i, (k, q, c, x, y) in enumerate(zip(rng.integers(0, 4, 900), rng.integers(0, 90, 900), rng.integers(0, 3, 900), *rng.integers(0, 40, (2, 900)), strict=True))]
    rows += [(0, 900, 0.0, None, 1.0, 1.0), (0, 901, 0.0, 1, None, 1.0), (9, 902, 0.0, 1, math.nan, 1.0)]
    df = spark.createDataFrame(rows, "k int, id int, quality double, cam int, x double, y double")
    d = lambda a, b: F.sqrt(F.pow(a["x"] - b["x"], F.lit(2)) + F.pow(a["y"] - b["y"], F.lit(2)))
    for other, clash in ((None, lambda a, b: d(a, b) < 5), ("cam", lambda a, b: (a["cam"] != b["cam"]) & (d(a, b) < 5))):
        found, wanted = clean.keep_apart(df, ["k"], ["quality", "id"], "id", 5.0, other), clean.greedy_keep(df, ["k"], ["quality", "id"], "id", clash)
        assert found.columns == wanted.columns and sorted(r.id for r in found.collect()) == sorted(r.id for r in wanted.collect())
        assert 0 < found.count() < len(rows)
    looked = []
    away = proximity.Strips._away
    monkeypatch.setattr(proximity.Strips, "_away", lambda self, x, y, i: looked.append(len(i)) or away(self, x, y, i))
    x, y = rng.uniform(0, 40, (2, 20_000))
    stays = proximity.greedy_apart(np.zeros(20_000, int), (x > 20).astype(int), x, y, 1.0, False)
    assert stays.sum() > 15_000 and sum(looked) < 1_000 * 20_000


def test_links_cost_as_little_as_assignments_and_few_are_asked_for():
    rng = np.random.default_rng(0)
    for k in range(300):
        n = int(rng.integers(1, 14))
        m = int(rng.integers(n, 18))
        a, b = (np.round(rng.uniform(0, 10, (s, 2)) * (1, k % 3)) / (1 + k % 2) for s in (n, m))  # on a line, on a grid: ties
        c = np.hypot(*(a[:, None] - b[None]).transpose(2, 0, 1)) - 0.3 * rng.integers(0, 2, n)[:, None] + 2.0 * rng.integers(0, 2, (n, m))
        c[c > rng.choice([3, 6, 20])] = 1e3

        def cheaper(row, limit, c=c):
            j = np.flatnonzero(c[row] < min(limit, 1e3))
            j = j[np.argsort(c[row][j], kind="stable")]
            return j.tolist(), c[row][j].tolist()

        def more(row, limit, cheaper=cheaper):
            limit = 2 * limit if limit < 20 else np.inf
            return *cheaper(row, limit), limit

        wanted = sum(c[i, j] for i, j in assignment.cheapest_assignment(c))
        for known in (0.5, 2.0, np.inf):
            i, j = assignment.cheapest_links([cheaper(row, known) for row in range(n)], m, 1e3, known, more)
            assert len(set(i.tolist())) == len(set(j.tolist())) == len(i)
            assert abs(c[i, j].sum() + 1e3 * (n - len(i)) - wanted) < 1e-6


def test_prices_of_crowded_frames_need_no_matrix(monkeypatch):
    """Pairs that are too far apart aren't priced: of 7.6 million pairs of pieces and detections a tenth at most."""
    priced = []
    prices = players.Pieces.prices

    def counted(self, *args):
        found = prices(self, *args)
        priced.append(found.size)
        return found

    monkeypatch.setattr(players.Pieces, "prices", counted)
    rng = np.random.default_rng(1)
    t = np.repeat([0, 100, 200], [2_000, 1_800, 2_000])
    rows = pd.DataFrame({"t": t, "x": rng.uniform(0, 56, len(t)), "y": rng.uniform(0, 32, len(t)), "team": 0, "keeper": False}).sort_values(["t", "x", "y"])
    piece = players.followed(players.Seen.of(rows, Pitch(), Tracks()), Tracks())
    assert (piece >= 0).mean() > 0.5 and sum(priced) < 760_000


def test_detections_without_a_place_begin_pieces_of_their_own():
    rows = pd.DataFrame({"t": [0, 0, 100, 100, 200, 200], "x": [5.0, np.nan, 5.0, np.nan, 5.0, np.nan], "y": 5.0, "team": 0, "keeper": False})
    assert players.followed(players.Seen.of(rows, Pitch(), Tracks()), Tracks()).tolist() == [0, -1, 0, -1, 0, -1]
