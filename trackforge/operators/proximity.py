"""Points near others in the plane, for many groups of points at once, with work that follows the number of points."""

from __future__ import annotations

import numpy as np

STRIP = 4  # points of a strip are about so many times the number of strips
PAIRS = 1 << 21  # pairs that are held at once


def spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges [low, high), one range after the other, and the range of each."""
    n = high - low
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + low[of], of


def bounds(values: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: np.ndarray, right: bool = False) -> np.ndarray:
    """searchsorted of each wanted value in its own sorted part [low, high) of values."""
    low, high = low.copy(), high.copy()
    while len(values) and (low < high).any():
        middle = (low + high) // 2
        at = values[np.minimum(middle, len(values) - 1)]
        after = (low < high) & ((at <= wanted) if right else (at < wanted))
        low, high = np.where(after, middle + 1, low), np.where(after, high, np.where(low < high, middle, high))
    return low


def pieces(cost: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of rows whose costs add up to about PAIRS."""
    part = np.cumsum(cost) // PAIRS
    edges = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(cost)) if len(cost) else np.zeros(1, int)
    return list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))


class Strips:
    """The points of each group in strips of equal numbers by x, ordered by y within; crowded places get narrow strips."""

    def __init__(self, group: np.ndarray, x: np.ndarray, y: np.ndarray, groups: int) -> None:
        order = np.lexsort((y, x, group))
        same = np.append(False, (np.diff(group[order]) == 0) & (np.diff(x[order]) == 0) & (np.diff(y[order]) == 0)) if len(order) else np.zeros(0, bool)
        first = order[~same]  # of points in one place that of smallest number
        n = np.bincount(group[first], minlength=groups)
        strips = np.ceil(np.sqrt(n / STRIP)).astype(int)
        self.start = np.append(0, np.cumsum(strips))  # of the strips of each group
        g = group[first]
        strip = self.start[g] + (np.arange(len(first)) - (np.cumsum(n) - n)[g]) * strips[g] // np.maximum(n, 1)[g]
        self.low, self.high = (np.searchsorted(strip, np.arange(self.start[-1]), side) for side in ("left", "right"))
        self.left, self.right = x[first][self.low], x[first][self.high - 1]
        self.at = first[np.lexsort((y[first], strip))]
        self.x, self.y = x[self.at], y[self.at]

    def nearest(self, group: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distance to the nearest point of the group and its number, the smallest if several are as near; -1 in groups without points."""
        best, found = np.full(len(x), np.inf), np.full(len(x), -1)
        begin, end = self.start[group], self.start[group + 1]
        own = np.minimum(bounds(self.right, begin, end, x), end - 1)
        live = np.flatnonzero(begin < end)
        # the neighbours in the own strip bound what has to be looked at
        k = bounds(self.y, self.low[own[live]], self.high[own[live]], y[live])
        for i in (k - 1, k):
            i = np.clip(i, self.low[own[live]], self.high[own[live]] - 1)
            best[live] = np.minimum(best[live], self._away(x[live], y[live], i))
        for side in (-1, 1):
            rows, strip = live, own[live] + (side > 0)
            while len(rows):
                there = (strip >= begin[rows]) & (strip < end[rows])
                rows, strip = rows[there], strip[there]
                gap = (x[rows] - self.right[strip]) if side < 0 else (self.left[strip] - x[rows])
                close = gap <= self._reach(best[rows])
                rows, strip = rows[close], strip[close]
                self._look(rows, strip, x, y, best, found)
                strip = strip + side
        return best, found

    def _away(self, x: np.ndarray, y: np.ndarray, i: np.ndarray) -> np.ndarray:
        return np.sqrt((x - self.x[i]) ** 2 + (y - self.y[i]) ** 2)

    @staticmethod
    def _reach(best: np.ndarray) -> np.ndarray:
        """A little more than best, as distances are rounded."""
        return best * (1 + 1e-9) + 1e-300

    def _look(self, rows: np.ndarray, strip: np.ndarray, x: np.ndarray, y: np.ndarray, best: np.ndarray, found: np.ndarray) -> None:
        """Takes the points of one strip for each row into account."""
        reach = self._reach(best[rows])
        low = bounds(self.y, self.low[strip], self.high[strip], y[rows] - reach)
        high = bounds(self.y, low, self.high[strip], y[rows] + reach, right=True)
        some = high > low
        rows, low, high = rows[some], low[some], high[some]
        for a, b in pieces(high - low):
            i, of = spread(low[a:b], high[a:b])
            mine = rows[a:b]
            d, first = self._away(x[mine][of], y[mine][of], i), np.cumsum(high[a:b] - low[a:b]) - (high[a:b] - low[a:b])
            least = np.minimum.reduceat(d, first)
            number = np.minimum.reduceat(np.where(d == least[of], self.at[i], np.iinfo(np.int64).max), first)
            better = (least < best[mine]) | ((least == best[mine]) & ((found[mine] < 0) | (number < found[mine])))
            best[mine[better]], found[mine[better]] = least[better], number[better]


def nearest_points(group: np.ndarray, x: np.ndarray, y: np.ndarray, to_group: np.ndarray, to_x: np.ndarray, to_y: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """For each point the distance of the nearest of the others of its group, and its number: the smallest if several are as near.

    -1 without any. Positions that aren't finite are compared with all of their group, as distances of NaN are largest.
    """
    best, found = np.full(len(x), np.nan), np.full(len(x), -1)
    sound, to_sound = np.isfinite(x) & np.isfinite(y), np.isfinite(to_x) & np.isfinite(to_y)
    whole = np.flatnonzero(to_sound)
    strips = Strips(to_group[whole], to_x[whole], to_y[whole], groups)
    asked = np.flatnonzero(sound)
    order = asked[np.lexsort((y[asked], x[asked], group[asked]))]
    new = np.append(True, (np.diff(group[order]) != 0) | (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0))[: len(order)]
    each = order[new]
    d, i = strips.nearest(group[each], x[each], y[each])
    of = np.cumsum(new) - 1
    best[order] = d[of]
    found[order] = np.where(i[of] >= 0, whole[i[of]], -1) if len(whole) else -1
    for k in np.flatnonzero(found < 0).tolist() if not (sound.all() and to_sound.all()) else ():
        others = np.flatnonzero(to_group == group[k])
        if len(others):
            with np.errstate(invalid="ignore"):
                away = np.sqrt((x[k] - to_x[others]) ** 2 + (y[k] - to_y[others]) ** 2)
            j = int(np.lexsort((others, away))[0])  # NaN comes last
            best[k], found[k] = away[j], others[j]
    return best, found


def pairs_within(a: np.ndarray, b: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of a and b (positions) at most most apart, and their distances. Rows meet by squares of that width."""
    none = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    if not len(a) or not len(b):
        return none
    width = most * (1 + 1e-9)
    corner = np.minimum(a.min(0), b.min(0))
    square_a, square_b = (np.floor((p - corner) / width).astype(np.int64) + 1 for p in (a, b))
    rows = max(square_a[:, 1].max(), square_b[:, 1].max()) + 2
    number = square_b[:, 0] * rows + square_b[:, 1]
    order = np.argsort(number, kind="stable")
    number = number[order]
    found = [none]
    for column in (-1, 0, 1):
        middle = (square_a[:, 0] + column) * rows + square_a[:, 1]
        low, high = np.searchsorted(number, middle - 1, "left"), np.searchsorted(number, middle + 1, "right")
        for begin, end in pieces(high - low):
            at, of = spread(low[begin:end], high[begin:end])
            i, j = of + begin, order[at]
            d = np.hypot(a[i, 0] - b[j, 0], a[i, 1] - b[j, 1])
            near = d <= most
            found.append((i[near], j[near], d[near]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


BLOCK = 32  # rows of a group that are decided one by one


def greedy_apart(group: np.ndarray, kind: np.ndarray, x: np.ndarray, y: np.ndarray, distance: float, alike: bool) -> np.ndarray:
    """Which rows stay if, in order within their group, each goes that lies nearer than distance to one that stays before it.

    Only rows of the same kind count (alike), or only those of other kinds. kind: small numbers. Groups come one after the
    other. Half of the rows are settled first, then those near what stays of them go, then the other half is settled; all
    groups at once.
    """
    begin = np.flatnonzero(np.append(True, np.diff(group) != 0)) if len(group) else np.zeros(0, int)
    sizes = np.diff(np.append(begin, len(group)))
    place = np.arange(len(group)) - np.repeat(begin, sizes)
    number = np.repeat(np.arange(len(begin)), sizes)
    kinds = int(kind.max(initial=0)) + 1
    stays = np.ones(len(group), bool)

    def between(low: int, high: int) -> np.ndarray:
        return spread(begin + np.minimum(low, sizes), begin + np.minimum(high, sizes))[0]

    def near(rows: np.ndarray, kept: np.ndarray) -> np.ndarray:
        others = [kind[kept] == k if alike else kind[kept] != k for k in range(kinds)]
        to, of = np.concatenate([kept[o] for o in others]), np.repeat(np.arange(kinds), [o.sum() for o in others])
        return nearest_points(number[rows] * kinds + kind[rows], x[rows], y[rows], number[to] * kinds + of, x[to], y[to], len(begin) * kinds)[0] < distance

    def settle(low: int, high: int) -> None:
        rows = between(low, high)
        rows = rows[stays[rows]]
        if high - low > BLOCK:
            middle = (low + high) // 2
            settle(low, middle)
            first, second = between(low, middle), between(middle, high)
            first, second = first[stays[first]], second[stays[second]]
            if len(first) and len(second):
                stays[second[near(second, first)]] = False
            if len(second):
                settle(middle, high)
            return
        own = np.unique(number[rows])
        for a in range(0, len(own), 512):
            some = own[a : a + 512]
            table = np.full((len(some), high - low), -1)
            mine = rows[np.searchsorted(number[rows], some[0], "left") : np.searchsorted(number[rows], some[-1], "right")]
            table[np.searchsorted(some, number[mine]), place[mine] - low] = mine
            there = table >= 0
            u, v, c = x[table], y[table], kind[table]
            clash = np.sqrt((u[:, :, None] - u[:, None]) ** 2 + (v[:, :, None] - v[:, None]) ** 2) < distance
            clash &= (c[:, :, None] == c[:, None]) if alike else (c[:, :, None] != c[:, None])
            for k in range(1, high - low):
                there[:, k] &= ~(there[:, :k] & clash[:, k, :k]).any(1)
            stays[mine] = there[np.searchsorted(some, number[mine]), place[mine] - low]

    if len(group):
        settle(0, int(sizes.max()))
    return stays
