"""Stateful operators on streams cut into micro-batches, rows shuffled, against the batch operators."""

import datetime as dt
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tests.test_streaming import START, at, stream
from trackforge.operators import clean, players, stateful
from trackforge.params import Pitch, Possession, Tracks
from trackforge.streaming import online, possession, tracks

P, PITCH = Tracks(), Pitch()


def shuffled_batches(rows, time, parts, late, seed):
    """rows in parts micro-batches by time, each row up to late seconds too late, in no order."""
    rng = random.Random(seed)
    arrival = sorted(rows, key=lambda r: time(r) + rng.uniform(0, late))
    size = -(-len(arrival) // parts)
    batches = [arrival[i : i + size] for i in range(0, len(arrival), size)]
    for b in batches:
        rng.shuffle(b)
    return batches


def walks(seed):
    """Players who walk, are hidden for a while, stand close to each other; false detections and doubles in between."""
    rng, rows = np.random.default_rng(seed), []
    for half in (1, 2):
        for n in range(6):
            x, y, team = rng.uniform(5, 50), rng.uniform(3, 29), n % 2
            speed = rng.uniform(-1.5, 1.5, 2)
            hidden = rng.uniform(2, 18)
            for i in range(200):
                t = 100 * i
                x, y = x + 0.1 * speed[0], y + 0.1 * speed[1]
                if hidden < t / 1000 < hidden + rng.choice([0.5, 3.0]) or rng.random() < 0.05:
                    continue
                rows.append((half, t, float(x + rng.normal(0, 0.1)), float(y + rng.normal(0, 0.1)), None if rng.random() < 0.2 else team, n == 0))
        for _ in range(30):
            rows.append((half, 100 * int(rng.integers(200)), float(rng.uniform(0, 56)), float(rng.uniform(0, 32)), None, False))
    return rows


def test_pieces_online_as_in_batch(spark, tmp_path):
    rows = walks(8)
    late_rows = [(1, 500, 20.0, 20.0, 0, False), (1, 600, 20.0, 20.0, 0, False)]
    stamped = [("m", half, at(t / 1000 + 3600 * (half - 1)), t, x, y, team, k) for half, t, x, y, team, k in rows]
    batches = shuffled_batches(stamped, lambda r: (r[2] - START).total_seconds(), 9, 1.5, 3)
    end = [("end", 1, at(36_000), 0, 0.0, 0.0, None, False)]
    # the last rows push the watermark on; rows that come long after it has passed them are dropped
    batches += [[("m", 2, at(3600 + 30), 30_000, 5.0, 5.0, None, False)], [("m", h, at(t / 1000), t, x, y, m, k) for h, t, x, y, m, k in late_rows], end, [("end", 2, at(36_001), 0, 0.0, 0.0, None, False)]]
    schema = "match_id string, half int, ts timestamp, t long, x double, y double, team int, keeper boolean"
    found = online.drained(tracks.online_pieces(stream(spark, tmp_path, batches, schema), ["match_id", "half"], "ts", "2 seconds"), str(tmp_path / "out")).where("match_id = 'm'").collect()
    assert len(found) > 500
    for half in (1, 2):
        frame = pd.DataFrame([r[1:] for r in rows if r[0] == half] + ([(30_000, 5.0, 5.0, None, False)] if half == 2 else []), columns=["t", "x", "y", "team", "keeper"]).sort_values(["t", "x", "y"], ignore_index=True)
        seen = players.Seen.of(frame, PITCH, P)
        piece = players.followed(seen, P)
        wanted = sorted((int(n), int(t), x, y) for n, t, x, y in zip(piece, frame.t, frame.x, frame.y, strict=True) if n >= 0)
        mine = [r for r in found if r.half == half]
        assert sorted((r.piece, r.t, r.x, r.y) for r in mine if r.what == "detection") == wanted
        pieces = players.Stretches.of(seen, players.grouped_by(piece))
        summary = sorted((int(piece[x[0]]), int(frame.t[x[0]]), int(frame.t[x[-1]]), len(x), None if m < 0 else m, round(k, 9)) for x, m, k in zip(pieces.at, pieces.team.tolist(), pieces.keeper_share, strict=True))
        assert sorted((r.piece, r.t0, r.t, r.n, r.team, round(r.keeper_share, 9)) for r in mine if r.what == "piece") == summary


def played(seed):
    """Frames of a match: the ball moves, lies still, goes out for short and for long, isn't seen; halves end in the middle."""
    rng = random.Random(seed)
    rows, t, x, y, mode, until = [], 0, 28.0, 16.0, "move", 0
    for i in range(1500):
        half = 1 if i < 700 else 2
        t += rng.choice([66, 67, 67, 67, 133, 1200]) if rng.random() < 0.1 else 67
        if i == 700:
            t += 900_000
        if t >= until:
            mode, until = rng.choice(["move", "move", "still", "out", "hidden"]), t + rng.choice([300, 900, 1500, 4000])
            if mode == "out":
                x = -2.5 if rng.random() < 0.5 else 60.0
            elif x < 0 or x > 56:
                x, y = 28.0, 16.0
        if mode == "move":
            x, y = min(max(x + rng.uniform(-0.5, 0.5), 0), 56), min(max(y + rng.uniform(-0.5, 0.5), 0), 32)
        jitter = rng.uniform(-0.45, 0.45)
        hidden = mode == "hidden" or rng.random() < 0.03
        rows.append((half, i, t, None if hidden else x + jitter, None if hidden else y, rng.choice([0, 1, None, 0 if (t // 3000) % 2 else 1])))
    return rows


def batch_states(rows, p, pitch):
    """out and still of each frame by the batch operators' rules, in plain form."""
    out = [False] * len(rows)
    for half in (1, 2):
        at = [i for i, r in enumerate(rows) if r[0] == half]
        run = None
        for n, i in enumerate(at):
            _, _, t, x, y, _ = rows[i]
            beyond = None if x is None else x < -p.out_margin or x > pitch.length + p.out_margin or y < -p.out_margin or y > pitch.width + p.out_margin
            if run is None and beyond:
                run = i
            if run is not None and (beyond is False or n == len(at) - 1):
                inside = beyond is False
                if t - rows[run][2] >= 1000 * p.out_min_s:
                    for k in range(run, i if inside else i + 1):
                        out[k] = True
                run = None
    known = [i for i, r in enumerate(rows) if r[3] is not None]
    t, half, x, y = (np.array([rows[i][c] for i in known], float) for c in (2, 0, 3, 4))
    still = np.zeros(len(rows), bool)
    still[known] = stateful.still_rows(t, half, x, y, 1000 * p.still_s, p.still_radius, 1000)
    return out, still.tolist()


def test_states_of_the_ball_as_in_batch():
    p = Possession()
    counts = np.zeros(2, int)
    for seed in range(12):
        rows = played(seed)
        states, got = possession.BallStates(p, PITCH), []
        for n, r in enumerate(rows):
            if n % 97 == 0:
                states = possession.BallStates.loaded(states.saved(), p, PITCH)
            states.add(possession.Frame(*r))
            got += states.decided()
            assert len(states.waiting) < 120
        states.end()
        got += states.decided()
        out, still = batch_states(rows, p, PITCH)
        assert [r.frame for r in got] == [r[1] for r in rows]
        assert [r.out for r in got] == out and [r.still for r in got] == still
        counts += [sum(out), sum(still)]
    assert counts.min() > 300


def test_possession_online_as_in_batch(spark, tmp_path):
    p, rows = Possession(), {m: played(seed) for m, seed in (("a", 31), ("b", 32))}
    stamped = [(m, at(r[2] / 1000), *r) for m, frames in rows.items() for r in frames]
    batches = shuffled_batches(stamped, lambda r: (r[1] - START).total_seconds(), 7, 1.5, 5)
    batches += [[("end", at(90_000), 1, 0, 0, 0.0, 0.0, None)], [("end", at(90_001), 1, 1, 1, 0.0, 0.0, None)]]
    schema = "match_id string, ts timestamp, half int, frame long, t long, x double, y double, controller int"
    found = online.drained(possession.ordered_possession(stream(spark, tmp_path, batches, schema), "match_id", "ts", "2 seconds", p), str(tmp_path / "out")).where("match_id <> 'end'")
    wanted = []
    for m, frames in rows.items():
        out, still = batch_states(frames, p, PITCH)
        machines = {1: stateful.PossessionState(p), 2: stateful.PossessionState(p)}
        for r, o, s in zip(frames, out, still, strict=True):
            wanted.append((m, r[0], r[1], o, s, *machines[r[0]].step(r[2], o or s, r[3] is not None, r[5])))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(wanted, key=repr)
    assert {r[6] for r in wanted} == {None, 0, 1}


def test_duplicates_online_as_in_batch(spark, tmp_path):
    rng = random.Random(1)
    rows = [("m", at(s), n, rng.choice(["top", "low"]), rng.uniform(0, 9), rng.uniform(0, 9), rng.random()) for s in range(40) for n in range(12)]
    schema = "match_id string, ts timestamp, id int, cam string, x double, y double, quality double"
    batches = shuffled_batches(rows, lambda r: (r[1] - START).total_seconds(), 6, 3, 2) + [[("m", at(900), 0, "top", 0.0, 0.0, 0.5)], [("m", at(901), 0, "top", 0.0, 0.0, 0.5)]]
    clash = lambda a, b: (a["cam"] != b["cam"]) & clean.near(a, b, 2.5)
    found = online.drained(online.without_clashes(stream(spark, tmp_path, batches, schema), ["match_id"], "ts", "4 seconds", ["quality"], "id", clash), str(tmp_path / "out"))
    wanted = clean.greedy_keep(spark.createDataFrame(rows, schema), ["match_id", "ts"], ["quality"], "id", clash)
    assert sorted((r.ts, r.id) for r in found.collect() if r.ts < at(900)) == sorted((r.ts, r.id) for r in wanted.collect())
    assert wanted.count() < len(rows)


def test_pieces_of_the_query_equal_the_batch(spark):
    from trackforge import plans

    folder = "/root/testdata/sf0.01"
    one = plans.QUERIES["streaming_pieces"](spark, folder).groupBy("match_id", "half", "piece").count()
    other = plans.QUERIES["st03_st04_st06_player_tracks"](spark, folder).groupBy("match_id", "half", F.col("track").alias("piece")).count()
    assert one.exceptAll(other).count() == 0 and other.exceptAll(one).count() == 0 and one.count() > 0


class Held:
    """A value or list of state that counts the calls."""

    def __init__(self, calls):
        self.calls, self.value = calls, None

    def __getattr__(self, name):
        def call(*args):
            self.calls.append(name)
            if name in ("update", "put"):
                self.value = args[0]
            elif name == "appendValue":
                self.value = [*(self.value or []), args[0]]
            elif name == "clear":
                self.value = None
            return {"exists": self.value is not None, "get": self.value or ()}.get(name)

        return call


class Handle:
    def __init__(self):
        self.calls = []

    def __getattr__(self, name):
        return lambda *args: self.calls.append(name) if name == "registerTimer" else Held(self.calls)


class Watermark:
    def getCurrentWatermarkInMs(self):
        return 10**9


def test_a_match_that_is_over_needs_few_calls_of_state():
    """It comes out whole, and what is known of its ball isn't written in between."""
    frames = [r for r in played(3) if r[0] == 1]
    rows = pd.DataFrame(frames, columns=possession.FRAME).astype({"controller": "Int32"})
    rows["event_ms"] = rows.t
    machine, handle = possession.OrderedFrames(Possession(), PITCH, "m", 0), Handle()
    machine.init(handle)
    list(machine.handleInputRows(("a",), iter([rows]), Watermark()))
    handle.calls.clear()
    found = pd.concat(list(machine.handleExpiredTimer(("a",), Watermark(), None)))
    out, still = batch_states(frames, Possession(), PITCH)
    assert found.frame.tolist() == [r[1] for r in frames] and found.out.tolist() == out and found.still.tolist() == still
    assert "update" not in handle.calls and len(handle.calls) <= 7
