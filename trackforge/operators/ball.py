"""The ball's way through its candidates, and the cheapest way through gaps. Times are milliseconds, positions metres."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackforge.operators.grouping import grouped, walked
from trackforge.params import Ball

PERSON_BONUS = 0.3  # fixed values: what a person nearby is worth, how far away a challenger still is the same, and what a metre a second costs
SAME_RIVAL = 3.0
SPEED_COST = 0.005
COLUMNS = [("frame", T.LongType()), ("x", T.DoubleType()), ("y", T.DoubleType()), ("confidence", T.DoubleType())]


def best_of(values: np.ndarray, allowed: np.ndarray) -> int | None:
    """Number of the first largest value among those allowed."""
    return int(np.where(allowed, values, -np.inf).argmax()) if allowed.any() else None


@dataclass
class BallFollower:
    """Follows one candidate within reach; a clearly better one near a person takes over once it has lasted.

    A takeover takes back what was followed since the challenger appeared. So positions stay pending while there is a
    challenger that could still take them back, and are handed out, final, as soon as there is none: the same code
    serves whole halves and streams.
    """

    p: Ball
    place: np.ndarray | None = None
    seen: int = 0
    rival: np.ndarray | None = None
    rival_since: int = 0
    pending: list[tuple] = field(default_factory=list)

    def step(self, frame: int, t: int, at: np.ndarray, confidence: np.ndarray, person: np.ndarray) -> list[tuple]:
        """The candidates of a frame: places (rows), confidences, distances to the nearest person. Returns final positions."""
        p = self.p
        worth = confidence + PERSON_BONUS * (person < p.near)
        strong = (confidence >= p.acquire_confidence) & (person < p.near)
        if self.place is not None and t - self.seen > 1000 * p.lost_s:
            self.place = None
        if self.place is None:
            pick = best_of(worth, strong)
        else:
            reach = p.gate + p.max_speed * (t - self.seen) / 1000
            away = np.hypot(*(at - self.place).T)
            pick = best_of(worth - 0.5 * away / reach, away <= reach)
            challenger = best_of(worth, strong & (away > reach))
            if challenger is not None and worth[challenger] > (0.0 if pick is None else worth[pick]) + p.switch_margin:
                pick = self._challenged(t, at[challenger], challenger, pick)
            else:
                self.rival = None
        if pick is not None:
            self.place, self.seen = at[pick], t
            self.pending.append((frame, t, float(at[pick, 0]), float(at[pick, 1]), float(confidence[pick])))
        return self._final()

    def _challenged(self, t: int, where: np.ndarray, challenger: int, pick: int | None) -> int | None:
        """The challenger, if it has lasted long enough, else what was picked."""
        if self.rival is None or np.hypot(*(where - self.rival)) > SAME_RIVAL:
            self.rival_since = t
        self.rival = where
        if t - self.rival_since < 1000 * self.p.switch_s:
            return pick
        self.pending = [x for x in self.pending if x[1] < self.rival_since]
        self.rival = None
        return challenger

    def _final(self) -> list[tuple]:
        safe = len(self.pending) if self.rival is None else sum(x[1] < self.rival_since for x in self.pending)
        out, self.pending = self.pending[:safe], self.pending[safe:]
        return out

    def finish(self) -> list[tuple]:
        """What was still pending at the end."""
        out, self.pending = self.pending, []
        return out


def followed(rows: pd.DataFrame, follower: BallFollower) -> list[tuple]:
    """Final positions (frame, t, x, y, confidence) of the frames of some rows (frame, t, x, y, confidence, person)."""
    rows = rows.sort_values(["t", "frame", "x", "y"])
    frame, t = rows.frame.to_numpy(), rows.t.to_numpy()
    at, confidence, person = rows[["x", "y"]].to_numpy(float), rows.confidence.to_numpy(float), rows.person.fillna(np.inf).to_numpy(float)
    edges = np.flatnonzero(np.concatenate([[True], (frame[1:] != frame[:-1]) | (t[1:] != t[:-1]), [True]])) if len(rows) else [0]
    out = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        out += follower.step(int(frame[a]), int(t[a]), at[a:b], confidence[a:b], person[a:b])
    return out


def track_ball(candidates: DataFrame, keys: list[str], p: Ball = Ball()) -> DataFrame:
    """The ball's position at frames, from candidates (frame, t, x, y, confidence, person: distance to the nearest)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        follower = BallFollower(p)
        found = sorted(followed(rows, follower) + follower.finish())
        return pd.DataFrame(found, columns=["frame", "t", "x", "y", "confidence"])

    return grouped(candidates, keys, run, COLUMNS)


def cheapest_way(times: np.ndarray, nodes: np.ndarray, first: list[int], top_speed: float, miss: float, doubt: float) -> list[int]:
    """The nodes on the path of least cost from the first to the last node, without these two.

    nodes: x, y, confidence, layer by layer; first: where each layer begins (one more at the end); times: of the layers, in
    seconds. A layer is reached from all layers before at once.
    """
    layer = np.repeat(np.arange(len(times)), np.diff(first))
    x, y, at, doubts = nodes[:, 0], nodes[:, 1], times[layer], doubt * (1 - nodes[:, 2])
    cost, came = np.full(len(nodes), np.inf), np.full(len(nodes), -1)
    cost[0] = 0
    for k in range(1, len(times)):
        a, b = first[k], first[k + 1]
        if a == b:
            continue
        taken = np.maximum(times[k] - at[:a], 1e-9)
        speed = np.hypot(x[a:b, None] - x[:a], y[a:b, None] - y[:a]) / taken
        total = np.where(speed <= top_speed, cost[:a] + miss * (k - layer[:a] - 1) + SPEED_COST * speed, np.inf)
        best = total.argmin(axis=1)
        cost[a:b] = total[np.arange(b - a), best] + doubts[a:b]
        came[a:b] = np.where(cost[a:b] < np.inf, best, -1)
    way, node = [], int(came[-1])
    while node > 0:
        way.append(node)
        node = int(came[node])
    return way[::-1]


def cheapest_fill(times: np.ndarray, start: tuple[float, float], end: tuple[float, float], candidates: list[list[tuple[float, float, float]]], top_speed: float = 35.0, miss: float = 1.0, doubt: float = 1.0) -> list[tuple[float, float] | None]:
    """Positions between two anchors: the path through candidates (x, y, confidence) of least cost.

    A skipped time costs miss, a step SPEED_COST for each metre a second, a candidate doubt * (1 - confidence); steps
    faster than top_speed can't be taken. times: of start, of the frames between, and of end, in seconds. The candidates
    of a time are a layer.
    """
    layers = [np.array([[*start, 1.0]]), *(np.array(c, float).reshape(-1, 3) for c in candidates), np.array([[*end, 1.0]])]
    first = np.cumsum([0, *(len(x) for x in layers)])
    nodes = np.concatenate(layers)
    out: list[tuple[float, float] | None] = [None] * len(candidates)
    for node in cheapest_way(times, nodes, first.tolist(), top_speed, miss, doubt):
        out[int(np.searchsorted(first, node, "right")) - 2] = tuple(nodes[node, :2].tolist())
    return out


def fill_gaps(df: DataFrame, keys: list[str], top_speed: float = 35.0) -> DataFrame:
    """Filled positions of gaps. Rows: frame, t, kind ("anchor" or "candidate"), x, y, confidence."""

    def run(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        nodes = np.stack([rows[c].astype(float) for c in ("x", "y", "confidence")], 1)
        first = np.flatnonzero(np.append(True, np.diff(rows["frame"]) != 0))
        anchors = np.flatnonzero(rows["anchor"].astype(bool))
        frame = np.searchsorted(first, anchors, "right") - 1
        new = np.append(True, np.diff(frame) != 0)[: len(frame)]
        anchors, frame, first, times = anchors[new], frame[new].tolist(), np.append(first, len(nodes)), rows["t"][first] / 1000
        found = [np.zeros(0, int)]
        for a, b, i, j in zip(anchors[:-1].tolist(), anchors[1:].tolist(), frame[:-1], frame[1:], strict=True):
            if j > i + 1:
                low, high = int(first[i + 1]), int(first[j])
                ends = np.concatenate([nodes[a : a + 1], nodes[low:high], nodes[b : b + 1]])
                ends[[0, -1], 2] = 1.0
                steps = [0, *(first[i + 1 : j + 1] - low + 1).tolist(), high - low + 2]
                found.append(np.array(cheapest_way(times[i : j + 1], ends, steps, top_speed, 1.0, 1.0), int) + low - 1)
        at = np.concatenate(found)
        return {"frame": rows["frame"][at], "x": nodes[at, 0], "y": nodes[at, 1]}

    rows = df.where(F.col("frame").isNotNull()).select(*keys, "frame", "t", "x", "y", "confidence", F.coalesce(F.col("kind") == "anchor", F.lit(False)).alias("anchor"))
    order = [F.col(c).asc_nulls_last() for c in ("frame", "x", "y")]
    return walked(rows, keys, order, run, [("frame", T.LongType()), ("x", T.DoubleType()), ("y", T.DoubleType())])
