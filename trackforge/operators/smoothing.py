"""Smoothed tracks: positions and speeds of players on a regular grid, and positions to draw.

A key's rows come as arrays in time order; a row's window, its fit and its weights are computed for all rows at once.
Places are complex numbers where both coordinates are treated alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackforge.operators.grouping import walked
from trackforge.params import Tracks

LEAST_WINDOW = 5  # rows of a fit; shorter pieces tell no speed
AROUND_JUMP = 3  # rows before and after an impossible speed that count as part of the jump


def stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the first row of its run of equal flags, and the row behind it."""
    at = np.arange(len(flags))
    new = np.ones(len(flags), bool)
    new[1:] = flags[1:] != flags[:-1]
    begin = np.maximum.accumulate(np.where(new, at, 0))
    ends = np.append(np.flatnonzero(new)[1:], len(flags))
    return begin, ends[np.cumsum(new) - 1]


def local_parabolas(z: np.ndarray, at: np.ndarray, first: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Value and slope for a row, at each of the rows at, of the parabola that fits the width rows from first on best.

    Offsets are counted from the row itself, so that the first two coefficients are what is asked for, at the ends of a
    piece as well.
    """
    reach = np.arange(int(width.max(initial=0)))
    rows = first[:, None] + reach
    counts = reach < width[:, None]
    u = np.where(counts, rows - at[:, None], 0).astype(float)
    powers = np.stack([counts.astype(float), u, u * u], axis=2)
    values = np.where(counts, z[np.minimum(rows, len(z) - 1)], 0)
    fit = np.linalg.solve(powers.transpose(0, 2, 1) @ powers, powers.transpose(0, 2, 1) @ values[:, :, None])
    return fit[:, 0, 0], fit[:, 1, 0]


def on_grid(t: np.ndarray, x: np.ndarray, y: np.ndarray, step: float, p: Tracks) -> dict[str, np.ndarray]:
    """Smoothed positions and speeds every step seconds, and which of them are valid.

    Not valid, and without speed: what lies in a gap of the track of more than interpolate_s, pieces too short for a
    fit, and what surrounds speeds above top_speed.
    """
    grid = np.arange(t[0], t[-1] + step / 2, step)
    z = np.interp(grid, t, x) + 1j * np.interp(grid, t, y)
    gap = np.concatenate([[0.0], np.diff(t), [0.0]])[np.searchsorted(t, grid)]
    bridged = gap <= p.interpolate_s
    begin, end = stretches(bridged)
    wanted = int(round(p.smooth_s / step)) | 1
    width = np.minimum(wanted, end - begin)
    width -= (width + 1) % 2  # odd
    valid = bridged & (width >= LEAST_WINDOW)
    speed = np.zeros(len(grid))
    at = np.flatnonzero(valid)
    first = np.clip(at - width[at] // 2, begin[at], end[at] - width[at])
    z[at], slope = local_parabolas(z, at, first, width[at])
    speed[at] = np.abs(slope) / step
    jumps = np.concatenate([[0], np.cumsum(speed > p.top_speed)])
    row = np.arange(len(grid))
    near = jumps[np.minimum(row + AROUND_JUMP + 1, len(grid))] > jumps[np.maximum(row - AROUND_JUMP, 0)]
    valid &= ~near
    return {"t": grid, "x": z.real, "y": z.imag, "speed": np.where(valid, speed, 0.0), "valid": valid}


def smooth_tracks(df: DataFrame, keys: list[str], step_s: float, p: Tracks = Tracks()) -> DataFrame:
    """Smoothed grid of each player's track: t (ms), x, y, speed, valid. Rows: t, x, y; the first of rows with equal t counts."""

    def run(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        new = np.append(True, rows["t"][1:] != rows["t"][:-1])
        out = on_grid(rows["t"][new] / 1000, rows["x"][new], rows["y"][new], step_s, p)
        return out | {"t": (out["t"] * 1000).round().astype("int64")}

    known = df.where(F.col("t").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull()).select(*keys, "t", "x", "y")
    return walked(known, keys, ["t", "x", "y"], run, [("t", T.LongType()), ("x", T.DoubleType()), ("y", T.DoubleType()), ("speed", T.DoubleType()), ("valid", T.BooleanType())])


# ---------------------------------------------------------------- positions to draw


@dataclass(frozen=True)
class Steady:
    """How positions to draw are calmed. Times in seconds, metres, metres a second."""

    base_s: float = 0.5  # width of the medium smoothing
    dead: float = 0.5  # radius within which a player may shake without moving; 0: heavy smoothing for slow players instead
    brisk: float = 3.0  # from here on the light smoothing takes over ...
    fast: float = 5.0  # ... wholly from here on
    slow: float = 0.6  # without a dead radius: heavy smoothing up to here ...
    easy: float = 1.6  # ... fading until here
    light: float = 0.5  # of base_s
    heavy: float = 2.4
    pace_s: float = 0.3  # smoothing of the speed
    settle_s: float = 0.2  # smoothing of what the dead radius leaves


def blurred(z: np.ndarray, sigma: float) -> np.ndarray:
    """Weighted means with a Gaussian of sigma rows, cut off at four sigma; beyond the ends the end values go on."""
    reach = int(4 * sigma + 0.5)
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / max(sigma, 1e-9)) ** 2)
    return np.convolve(np.pad(z, reach, mode="edge"), weights / weights.sum(), "valid")


def dragged(z: np.ndarray, radius: float) -> np.ndarray:
    """A point that stays until the path leaves the circle of radius around it, and is then pulled along at its rim."""
    out, point = np.empty(len(z), complex), complex(z[0])
    for i, q in enumerate(z.tolist()):
        away = abs(q - point)
        if away > radius:
            point += (q - point) * (1 - radius / away)
        out[i] = point
    return out


def steadied(z: np.ndarray, dt: float, p: Steady) -> np.ndarray:
    """One run of known places, dt seconds apart: calm where slow, light where fast, without lag. Two places or one stay."""
    if len(z) < 3:
        return z
    light, medium = (blurred(z, p.base_s * k / dt) for k in (p.light, 1.0))
    pace = blurred(np.abs(np.gradient(medium, dt)), p.pace_s / dt)
    quick = np.clip((pace - p.brisk) / (p.fast - p.brisk), 0, 1)
    if p.dead > 0:
        both_ways = (dragged(medium, p.dead) + dragged(medium[::-1], p.dead)[::-1]) / 2
        return (1 - quick) * blurred(both_ways, p.settle_s / dt) + quick * light
    still = np.clip((p.easy - pace) / (p.easy - p.slow), 0, 1)
    return still * blurred(z, p.base_s * p.heavy / dt) + (1 - still - quick) * medium + quick * light


def steady_tracks(df: DataFrame, keys: list[str], dt_s: float, p: Steady = Steady()) -> DataFrame:
    """Positions for drawing: t, x, y of each row. Rows: t, x, y, one every dt_s; unknown positions (null) part runs and stay null."""

    def run(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        z = rows["x"].astype(float) + 1j * rows["y"].astype(float)
        known = ~np.isnan(z)
        begin, end = stretches(known)
        for a in np.unique(begin[known]).tolist():
            z[a : end[a]] = steadied(z[a : end[a]], dt_s, p)
        return {"t": rows["t"], "x": np.where(known, z.real, np.nan), "y": np.where(known, z.imag, np.nan)}

    return walked(df.select(*keys, "t", "x", "y"), keys, ["t", "x", "y"], run, [("t", T.LongType()), ("x", T.DoubleType()), ("y", T.DoubleType())])
