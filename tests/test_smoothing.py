"""Smoothing against plain versions of its rules, row by row."""

import math
import random

import numpy as np
import pytest

from trackforge.operators import smoothing
from trackforge.params import Tracks


def parabola(values, at):
    """Value and slope at row at of the least-squares parabola through (row, value) pairs."""
    u = np.array([r - at for r, _ in values], float)
    c = np.polyfit(u, [v for _, v in values], 2)
    return c[2], c[1]


def plain_grid(points, step, p):
    """points: (t, x, y) by time. The rule of the smoothed grid, one row after the other."""
    rows, k = [], 0
    while (g := points[0][0] + k * step) < points[-1][0] + step / 2:
        after = next((i for i, q in enumerate(points) if q[0] >= g), None)
        if after in (None, 0):
            x, y = (points[-1] if after is None else points[0])[1:]
            gap = 0.0
        else:
            (t0, *a), (t1, *b) = points[after - 1], points[after]
            x, y = (u + (v - u) * (g - t0) / (t1 - t0) for u, v in zip(a, b, strict=True))
            gap = t1 - t0
        rows.append([g, x, y, 0.0, gap <= p.interpolate_s])
        k += 1
    out, a = [list(r) for r in rows], 0
    while a < len(rows):
        b = a
        while b < len(rows) and rows[b][4] == rows[a][4]:
            b += 1
        if rows[a][4]:
            w = min(int(round(p.smooth_s / step)) | 1, b - a)
            w -= 1 - w % 2
            for i in range(a, b):
                if w < 5:
                    out[i][4] = False
                    continue
                first = min(max(i - w // 2, a), b - w)
                (x, vx), (y, vy) = (parabola([(j, rows[j][c]) for j in range(first, first + w)], i) for c in (1, 2))
                out[i][1:4] = x, y, math.hypot(vx, vy) / step
        a = b
    fast = [i for i, r in enumerate(out) if r[3] > p.top_speed]
    for i, r in enumerate(out):
        if any(abs(i - j) <= 3 for j in fast):
            r[4] = False
        if not r[4]:
            r[3] = 0.0
    return out


@pytest.mark.parametrize("seed", range(6))
def test_grid_against_the_plain_rule(seed):
    rng = random.Random(seed)
    t, points, x, y = 0.0, [], 20.0, 10.0
    for _ in range(rng.choice([1, 2, 6, 80, 200])):
        points.append((round(t, 3), x, y))
        t += rng.choice([0.07, 0.07, 0.07, 0.2, 0.4, 2.5]) if rng.random() < 0.3 else 0.0667
        x, y = x + rng.uniform(-0.4, 0.4), y + rng.uniform(-0.4, 0.4)
        if rng.random() < 0.02:
            x += 12
    found = smoothing.on_grid(*(np.array(c) for c in zip(*points, strict=True)), 0.1, Tracks())
    wanted = plain_grid(points, 0.1, Tracks())
    assert len(found["t"]) == len(wanted)
    assert found["valid"].tolist() == [r[4] for r in wanted]
    for name, i in (("t", 0), ("x", 1), ("y", 2), ("speed", 3)):
        np.testing.assert_allclose(found[name], [r[i] for r in wanted], atol=1e-6)


def plain_blur(values, sigma):
    reach = int(4 * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    n = len(values)
    return [sum(w[k + reach] * values[min(max(i + k, 0), n - 1)] for k in range(-reach, reach + 1)) / sum(w) for i in range(n)]


def plain_drag(points, radius):
    out, (ax, ay) = [], points[0]
    for x, y in points:
        d = math.hypot(x - ax, y - ay)
        if d > radius:
            ax, ay = x - (x - ax) / d * radius, y - (y - ay) / d * radius
        out.append((ax, ay))
    return out


def plain_steady(points, dt, p):
    both = lambda pts, s: list(zip(plain_blur([a for a, _ in pts], s), plain_blur([b for _, b in pts], s), strict=True))
    light, medium, heavy = (both(points, p.base_s * k / dt) for k in (p.light, 1, p.heavy))
    gx, gy = np.gradient([a for a, _ in medium], dt), np.gradient([b for _, b in medium], dt)
    pace = plain_blur([math.hypot(a, b) for a, b in zip(gx, gy, strict=True)], p.pace_s / dt)
    ahead, back = plain_drag(medium, p.dead), plain_drag(medium[::-1], p.dead)[::-1]
    held = both([((a + c) / 2, (b + d) / 2) for (a, b), (c, d) in zip(ahead, back, strict=True)], p.settle_s / dt)
    out = []
    for i, v in enumerate(pace):
        q = min(max((v - p.brisk) / (p.fast - p.brisk), 0), 1)
        if p.dead > 0:
            parts = [(1 - q, held[i]), (q, light[i])]
        else:
            s = min(max((p.easy - v) / (p.easy - p.slow), 0), 1)
            parts = [(s, heavy[i]), (1 - s - q, medium[i]), (q, light[i])]
        out.append(tuple(sum(w * z[c] for w, z in parts) for c in (0, 1)))
    return out


@pytest.mark.parametrize("dead", [0.0, 0.5])
def test_steady_tracks_against_the_plain_rule(spark, dead):
    rng, p, dt = random.Random(4), smoothing.Steady(dead=dead), 1 / 15
    rows, wanted = [], []
    for player in range(4):
        x, y, run = 10.0 * player, 5.0, []
        for i in range(120):
            unknown = i in (40, 41, 43, 80) or (player == 3 and i % 7 == 0)
            pace = 0.6 if (i // 30) % 2 else 0.05
            x, y = x + pace * rng.uniform(0, 1), y + pace * rng.uniform(-1, 1)
            rows.append((player, i * 67, None if unknown else x, None if unknown else y))
            if unknown:
                wanted += run if len(run) < 3 else plain_steady(run, dt, p)
                wanted.append((None, None))
                run = []
            else:
                run.append((x, y))
        wanted += run if len(run) < 3 else plain_steady(run, dt, p)
    df = spark.createDataFrame(rows, "player long, t long, x double, y double").repartition(3)
    found = sorted(smoothing.steady_tracks(df, ["player"], dt, p).collect(), key=lambda r: (r.player, r.t))
    assert [(r.player, r.t) for r in found] == [(a, b) for a, b, *_ in rows]
    for r, (x, y) in zip(found, wanted, strict=True):
        assert (r.x is None) == (x is None)
        if x is not None:
            assert math.hypot(r.x - x, r.y - y) < 1e-9


def test_a_shaking_player_stands_still():
    z = np.array([30 + 0.2 * (-1) ** i + 8j for i in range(200)])
    assert np.ptp(smoothing.dragged(z, 0.5).real) == 0


def test_smooth_tracks_of_rows_in_any_order(spark):
    rows = [(k, 100 * i, 0.3 * i * k, 2.0) for k in (1, 2) for i in range(30)]
    rows += [(1, 500, 99.0, 99.0), (2, None, 1.0, 1.0), (2, 900, None, 1.0)]
    df = spark.createDataFrame(rows, "player long, t long, x double, y double").repartition(4)
    found = smoothing.smooth_tracks(df, ["player"], 0.1).collect()
    assert len(found) == 60 and all(r.valid for r in found)
    assert {(r.player, round(r.speed, 6)) for r in found} == {(1, 3.0), (2, 6.0)}
