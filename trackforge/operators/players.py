"""Players' tracks: pieces from frame to frame, chains of pieces, and places in the team.

A half of a match is one group. All live pieces are rows of one table of arrays; a frame is priced, filtered and
written to as a whole, and what a piece has seen is kept as the piece number of each detection. Times are seconds in
here, positions metres.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackforge.operators.assignment import cheapest_links, sorted_links
from trackforge.operators.grouping import grouped
from trackforge.operators.proximity import pairs_within, spread
from trackforge.params import Pitch, Tracks

UNKNOWN = -1
FORBIDDEN = 1e3  # the price of a pair that can't be; any number of pairs that can costs less
SETTLED = 0.3  # how much less a pair with a settled piece costs; no pair costs less than its distance by more
NEAR = 64  # detections or pieces that are priced with each of the others at first, about


def at_bench(x: np.ndarray, y: np.ndarray, pitch: Pitch, p: Tracks) -> np.ndarray:
    """Where players go off and come on: near the bench's touchline, or near any line."""
    depth = pitch.width - y
    if p.change_at_any_line:
        depth = np.minimum(np.minimum(depth, y), np.minimum(x, pitch.length - x))
    return depth < p.change_depth


def opposed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Both teams are known and differ."""
    return (a >= 0) & (b >= 0) & (a != b)


@dataclass
class Seen:
    """Detections in the order of time, and where each frame's begin (one more at the end)."""

    t: np.ndarray
    frames: np.ndarray
    x: np.ndarray
    y: np.ndarray
    team: np.ndarray
    keeper: np.ndarray
    bench: np.ndarray

    @classmethod
    def of(cls, rows: pd.DataFrame, pitch: Pitch, p: Tracks) -> "Seen":
        """Rows in order: t (ms), x, y, team, keeper."""
        t, x, y = rows.t.to_numpy(float) / 1000, rows.x.to_numpy(float), rows.y.to_numpy(float)
        frames = np.append(np.flatnonzero(np.append(True, t[1:] != t[:-1])), len(t)) if len(t) else np.zeros(1, int)
        team = pd.array(rows.team, "Int32").fillna(UNKNOWN).to_numpy(int)
        return cls(t, frames, x, y, np.where(team > 1, UNKNOWN, team), rows.keeper.fillna(False).to_numpy(bool), at_bench(x, y, pitch, p))


class Pieces:
    """The live pieces, each a row of the arrays.

    Both coordinates are filtered alike, with the same noise, so a piece has one variance of place, one of speed and one
    covariance; mean holds x, y and their speeds.
    """

    def __init__(self, p: Tracks) -> None:
        self.p, self.made = p, 0
        self.number, self.count, self.bench = np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool)  # bench: of the latest detection
        self.t, self.place_var, self.speed_var, self.cov = (np.zeros(0) for _ in range(4))
        self.mean, self.votes, self.keeper = np.zeros((0, 4)), np.zeros((0, 2), int), np.zeros(0, int)
        self.first_vote, self.began = np.zeros(0, int), np.zeros(0)

    FIELDS = ("number", "bench", "count", "t", "place_var", "speed_var", "cov", "mean", "votes", "keeper", "first_vote", "began")

    def keep(self, chosen: np.ndarray) -> None:
        for f in self.FIELDS:
            setattr(self, f, getattr(self, f)[chosen])

    @property
    def team(self) -> np.ndarray:
        """By majority; a tie goes to the team that was seen first."""
        lead = self.votes[:, 1] - self.votes[:, 0]
        return np.where(lead == 0, self.first_vote, (lead > 0).astype(int))

    @property
    def settled(self) -> np.ndarray:
        return self.count >= self.p.hits

    def begin(self, seen: Seen, at: np.ndarray) -> np.ndarray:
        """New pieces from detections; their numbers."""
        n, known = len(at), seen.team[at] >= 0
        number = self.made + np.arange(n)
        self.made += n
        still = np.zeros(n)
        new = {
            "number": number, "bench": seen.bench[at], "count": np.ones(n, int), "t": seen.t[at], "place_var": np.full(n, self.p.noise**2), "speed_var": np.full(n, 25.0), "cov": still,
            "mean": np.stack([seen.x[at], seen.y[at], still, still], 1), "votes": ((seen.team[at, None] == [0, 1]) & known[:, None]).astype(int), "keeper": seen.keeper[at].astype(int), "first_vote": seen.team[at], "began": seen.t[at],
        }
        for f in self.FIELDS:
            setattr(self, f, np.concatenate([getattr(self, f), new[f]]))
        return number

    def expected(self, t: float) -> np.ndarray:
        """Places of all pieces at t."""
        return self.mean[:, :2] + self.mean[:, 2:] * np.maximum(t - self.t, 1e-3)[:, None]

    def write(self, rows: np.ndarray, seen: Seen, at: np.ndarray) -> None:
        """Detection at[i] belongs to piece rows[i]."""
        p, dt = self.p, np.maximum(seen.t[at] - self.t[rows], 1e-3)
        push = p.acceleration**2
        speed_var = self.speed_var[rows] + push * dt**2
        cov = self.cov[rows] + dt * self.speed_var[rows] + push * dt**3 / 2
        place_var = self.place_var[rows] + dt * (2 * self.cov[rows] + dt * self.speed_var[rows]) + push * dt**4 / 4
        trust, pull = place_var / (place_var + p.noise**2), cov / (place_var + p.noise**2)
        ahead = self.mean[rows, :2] + self.mean[rows, 2:] * dt[:, None]
        off = np.stack([seen.x[at], seen.y[at]], 1) - ahead
        speed = self.mean[rows, 2:] + pull[:, None] * off
        pace = np.hypot(*speed.T)
        speed *= (p.top_speed / np.maximum(pace, p.top_speed))[:, None]
        self.mean[rows] = np.concatenate([ahead + trust[:, None] * off, speed], 1)
        self.place_var[rows], self.cov[rows], self.speed_var[rows] = (1 - trust) * place_var, (1 - trust) * cov, speed_var - pull * cov
        self.t[rows], self.bench[rows] = seen.t[at], seen.bench[at]
        self.count[rows] += 1
        self.keeper[rows] += seen.keeper[at]
        known = seen.team[at] >= 0
        self.votes[rows[known], seen.team[at[known]]] += 1
        self.first_vote[rows] = np.where(self.first_vote[rows] < 0, seen.team[at], self.first_vote[rows])

    def prices(self, seen: Seen, at: np.ndarray, t: float, rows: np.ndarray, away: np.ndarray) -> np.ndarray:
        """What it costs that piece rows[i], expected at a distance of away[i] at t, goes on with detection at[i]; FORBIDDEN if it can't."""
        p, age, count = self.p, (t - self.t)[rows], self.count[rows]
        share, keeper = self.keeper[rows] / np.maximum(count, 1), seen.keeper[at]
        price = away + (0.3 * age - SETTLED * self.settled[rows]) + 2.0 * opposed(self.team[rows], seen.team[at])
        price += np.where(keeper, 2.0 * (share < 0.3), 1.0 * ((share > 0.7) & (count > 15)))
        changed = (age > p.change_s) & self.bench[rows] & seen.bench[at]
        return np.where(changed | (away > np.minimum(p.gate + p.gate_speed * age, p.gate_most)), FORBIDDEN, price)

    def cheapest(self, seen: Seen, at: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
        """Which pieces go on with which detections (numbers of at): cheapest overall. Each is priced with those near it first."""
        there, here = self.expected(t), np.stack([seen.x[at], seen.y[at]], 1)
        pieces, columns = np.flatnonzero(np.isfinite(there).all(1)), np.flatnonzero(np.isfinite(here).all(1))
        if not len(pieces) or not len(columns):
            return np.zeros(0, int), np.zeros(0, int)
        there, here = there[pieces], here[columns]
        flip = len(pieces) > len(columns)
        one, other = (here, there) if flip else (there, here)
        most = float(np.minimum(self.p.gate + self.p.gate_speed * (t - self.t), self.p.gate_most).max())

        def priced(i: np.ndarray, j: np.ndarray, away: np.ndarray) -> np.ndarray:
            i, j = (j, i) if flip else (i, j)
            return self.prices(seen, at[columns[j]], t, pieces[i], away)

        def known(radius: float) -> float:
            """All pairs within radius cost less than this, or others do too; the rest costs at least as much."""
            return radius - SETTLED if radius < most else FORBIDDEN

        def more(row: int, limit: float) -> tuple[list[int], list[float], float]:
            radius = 2 * (limit + SETTLED)
            j = by_x[np.searchsorted(x, one[row, 0] - radius, "left") : np.searchsorted(x, one[row, 0] + radius, "right")]
            away = np.hypot(one[row, 0] - other[j, 0], one[row, 1] - other[j, 1])
            j, away = j[away <= radius], away[away <= radius]
            price, limit = priced(np.full(len(j), row), j, away), known(radius)
            j, price = j[price < limit], price[price < limit]
            order = np.lexsort((j, price))
            return j[order].tolist(), price[order].tolist(), limit if limit < FORBIDDEN else np.inf

        by_x = np.argsort(other[:, 0], kind="stable")
        x = other[by_x, 0]
        radius = max(float(np.sqrt(NEAR * np.prod(np.ptp(other, 0)) / np.pi / len(other))), 2 * SETTLED)
        i, j, away = pairs_within(one, other, min(radius, most))
        price, limit = priced(i, j, away), known(radius)
        cheap = price < limit
        a, b = cheapest_links(sorted_links(i[cheap], j[cheap], price[cheap], len(one)), len(other), FORBIDDEN, limit if limit < FORBIDDEN else np.inf, more)
        rows, taken = (b, a) if flip else (a, b)
        order = np.argsort(rows)
        return pieces[rows[order]], columns[taken[order]]

    def overdue(self, t: float) -> np.ndarray:
        """Which pieces haven't been seen for too long at t."""
        return t - self.t > np.where(self.settled, self.p.lost_s, self.p.tentative_s)

    def take(self, seen: Seen, a: int, b: int) -> np.ndarray:
        """The piece of each detection of a frame, seen[a:b]; UNKNOWN for doubles of players just seen."""
        p, at, t = self.p, np.arange(a, b), seen.t[a]
        piece = np.full(b - a, UNKNOWN)
        rows, columns = self.cheapest(seen, at, t)
        self.write(rows, seen, at[columns])
        piece[columns] = self.number[rows]
        rest = np.delete(at, columns)
        # what lies next to a player who has just been seen is that player again
        placed = rest[np.isfinite(seen.x[rest]) & np.isfinite(seen.y[rest])]
        i, j, away = pairs_within(np.stack([seen.x[placed], seen.y[placed]], 1), np.stack([seen.x[at[columns]], seen.y[at[columns]]], 1), p.double_distance)
        double = i[(away < p.double_distance) & ~opposed(seen.team[placed[i]], self.team[rows[j]])]
        rest = np.setdiff1d(rest, placed[double])
        piece[rest - a] = self.begin(seen, rest)
        return piece


def followed(seen: Seen, p: Tracks) -> np.ndarray:
    """The piece of each detection, UNKNOWN for those of none that has enough."""
    piece, live = np.full(len(seen.t), UNKNOWN), Pieces(p)
    for a, b in zip(seen.frames[:-1].tolist(), seen.frames[1:].tolist(), strict=True):
        live.keep(~live.overdue(seen.t[a]))
        piece[a:b] = live.take(seen, a, b)
    enough = np.bincount(piece[piece >= 0], minlength=live.made + 1) >= p.hits
    return np.where(enough[piece], piece, UNKNOWN)


@dataclass
class Stretches:
    """Pieces or chains: their detections in order, and a row for each."""

    at: list[np.ndarray]
    first: np.ndarray
    last: np.ndarray
    team: np.ndarray
    keeper_share: np.ndarray
    count: np.ndarray

    @classmethod
    def of(cls, seen: Seen, at: list[np.ndarray]) -> "Stretches":
        team = []
        for x in at:
            known = seen.team[x][seen.team[x] >= 0]
            votes = np.bincount(known, minlength=2)
            team.append(UNKNOWN if not len(known) else int(known[0]) if votes[0] == votes[1] else int(votes.argmax()))
        one = lambda pick: np.array([pick(x) for x in at])
        return cls(at, one(lambda x: x[0]).astype(int), one(lambda x: x[-1]).astype(int), np.array(team, int), one(lambda x: seen.keeper[x].mean()).astype(float), one(len).astype(int))


def grouped_by(numbers: np.ndarray) -> list[np.ndarray]:
    """Places of each number that isn't UNKNOWN, by first place."""
    order = np.argsort(numbers, kind="stable")
    order = order[numbers[order] >= 0]
    parts = np.split(order, np.flatnonzero(np.diff(numbers[order])) + 1) if len(order) else []
    return sorted(parts, key=lambda x: x[0])


def successors(seen: Seen, s: Stretches, p: Tracks) -> dict[int, int]:
    """Which piece goes on as which: cheapest overall, among pairs close in time and place.

    Only starts within the time that can be bridged are looked at for each end; pieces that such pairs connect are
    settled by themselves.
    """
    n = len(s.at)
    start, end = seen.t[s.first], seen.t[s.last]
    low, high = np.searchsorted(start, end - 0.05, "left"), np.searchsorted(start, end + p.stitch_s, "right")
    b, a = spread(low, np.maximum(low, high))
    gap = start[b] - end[a]
    wait = np.maximum(gap, 0)
    away = np.hypot(seen.x[s.first[b]] - seen.x[s.last[a]], seen.y[s.first[b]] - seen.y[s.last[a]])
    other_role = ((s.keeper_share[a] > 0.5) != (s.keeper_share[b] > 0.5)) & (np.minimum(s.count[a], s.count[b]) > 15)
    changed = (gap > p.change_s) & seen.bench[s.last[a]] & seen.bench[s.first[b]]
    fits = (a != b) & (away <= np.minimum(p.stitch_base + p.gate_speed * wait, p.stitch_most)) & ~opposed(s.team[a], s.team[b]) & ~other_role & ~changed
    a, b, price = a[fits], b[fits], (away + 0.4 * wait)[fits]
    starts, number = np.unique(b, return_inverse=True)  # no more of them than ends, or the other way round
    ends, of = np.unique(a, return_inverse=True)
    if len(starts) < len(ends):
        j, i = cheapest_links(sorted_links(number, of, price, len(starts)), len(ends), FORBIDDEN)
    else:
        i, j = cheapest_links(sorted_links(of, number, price, len(ends)), len(starts), FORBIDDEN)
    return dict(zip(ends[i].tolist(), starts[j].tolist(), strict=True))


def chained_pieces(seen: Seen, piece: np.ndarray, p: Tracks) -> list[np.ndarray]:
    """Detections of each chain of pieces."""
    pieces = Stretches.of(seen, grouped_by(piece))
    after = successors(seen, pieces, p)
    chains = []
    for i in sorted(set(range(len(pieces.at))) - set(after.values())):
        chain = [i]
        while chain[-1] in after:
            chain.append(after[chain[-1]])
        chains.append(np.sort(np.concatenate([pieces.at[k] for k in chain])))
    return chains


def places_in_team(seen: Seen, chains: Stretches, keeper: np.ndarray, p: Tracks) -> list[tuple[int, int] | None]:
    """Team and place of each chain, None without one; a sweep over the starts of chains.

    A place that is free again goes to the nearest chain of the same role, else a new place is opened while fewer than
    team_size are busy and no second goalkeeper appears. Chains of unknown team may take either team's.
    """
    start, end = seen.t[chains.first], seen.t[chains.last]
    team, place, chain = (np.zeros(0, int) for _ in range(3))  # of every place: whose it is, its number, who had it last
    out: list[tuple[int, int] | None] = [None] * len(chains.at)
    for c in np.lexsort((np.arange(len(start)), start)).tolist():
        if end[c] - start[c] < p.least_s:
            continue
        ours = np.ones(len(team), bool) if chains.team[c] < 0 else team == chains.team[c]
        idle = start[c] - end[chain]
        changed = (idle > p.change_s) & seen.bench[chains.last[chain]] & seen.bench[chains.first[c]]
        free = np.flatnonzero(ours & (idle >= -0.05) & (keeper[chain] == keeper[c]) & ~changed)
        if len(free):
            away = np.hypot(seen.x[chains.last[chain[free]]] - seen.x[chains.first[c]], seen.y[chains.last[chain[free]]] - seen.y[chains.first[c]])
            k = int(free[np.lexsort((place[free], team[free], away + 0.3 * idle[free]))[0]])
            chain[k] = c
        else:
            busy = end[chain] > start[c] + p.overlap_s
            for side in (0, 1) if chains.team[c] < 0 else (int(chains.team[c]),):
                own = busy & (team == side)
                if own.sum() < p.team_size and not (keeper[c] and keeper[chain[own]].any()):
                    team, place, chain = np.append(team, side), np.append(place, (team == side).sum()), np.append(chain, c)
                    k = len(team) - 1
                    break
            else:
                continue
        out[c] = int(team[k]), int(place[k])
    return out


def track_players(detections: DataFrame, keys: list[str], p: Tracks = Tracks(), pitch: Pitch = Pitch()) -> DataFrame:
    """t, track, chain, chain_team, chain_keeper, slot_team, slot, x, y for every kept detection.

    detections: t (ms), x, y, team, keeper. chain_team: by the votes of its detections. chain_keeper: most of them are a
    goalkeeper's and half of them lie near a goal line. Chains that get no place have no slot.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["t", "x", "y"])
        seen = Seen.of(rows, pitch, p)
        piece = followed(seen, p)
        chains = Stretches.of(seen, chained_pieces(seen, piece, p))
        middle = np.array([np.median(seen.x[x]) for x in chains.at])
        keeper = (chains.keeper_share > 0.5) & ((middle < p.keeper_zone) | (middle > pitch.length - p.keeper_zone)) if len(middle) else np.zeros(0, bool)
        slots = places_in_team(seen, chains, keeper, p)
        at = np.concatenate([*chains.at, np.zeros(0, int)]).astype(int)
        of = np.repeat(np.arange(len(chains.at)), chains.count)
        given = lambda i: pd.array([None if s is None else s[i] for s in slots], "Int32")[of]
        teams = pd.array([None if m < 0 else m for m in chains.team.tolist()], "Int32")[of]
        return pd.DataFrame({"t": rows.t.to_numpy()[at], "track": piece[at], "chain": of, "chain_team": teams, "chain_keeper": keeper[of], "slot_team": given(0), "slot": given(1), "x": seen.x[at], "y": seen.y[at]})

    return grouped(detections, keys, run, [("t", T.LongType()), ("track", T.IntegerType()), ("chain", T.IntegerType()), ("chain_team", T.IntegerType()), ("chain_keeper", T.BooleanType()), ("slot_team", T.IntegerType()), ("slot", T.IntegerType()), ("x", T.DoubleType()), ("y", T.DoubleType())])


def bench_line(x: Column, y: Column, pitch: Pitch, p: Tracks) -> Column:
    depth = pitch.width - y
    return (F.least(depth, y, x, pitch.length - x) if p.change_at_any_line else depth) < p.change_depth


def substitutes(tracked: DataFrame, keys: list[str], p: Tracks = Tracks(), pitch: Pitch = Pitch(), settle_s: float = 30.0) -> DataFrame:
    """For each key and team the players who came on: chains of at least least_s that begin at the bench line once the
    first settle_s seconds of the group are over. tracked: t, chain, chain_team, x, y."""
    first = F.min_by(F.struct("x", "y"), F.struct("t", "x", "y"))
    chains = tracked.groupBy(*keys, "chain", "chain_team").agg(F.min("t").alias("t0"), F.max("t").alias("t1"), first.alias("at"))
    begun = tracked.groupBy(*keys).agg(F.min("t").alias("begun"))
    came = (F.col("t1") - F.col("t0") >= 1000 * p.least_s) & (F.col("t0") - F.col("begun") > 1000 * settle_s) & bench_line(F.col("at.x"), F.col("at.y"), pitch, p)
    return chains.where("chain_team is not null").join(begun, keys).groupBy(*keys, F.col("chain_team").alias("team")).agg(F.count_if(came).alias("substitutes"))
