"""Matching problems on small matrices: optimal assignment, largest matching, greedy chaining."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np

from trackforge.operators.proximity import pairs_within


def cheapest_assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of least total cost, one for each row or column, whichever are fewer.

    Shortest augmenting paths with dual prices; rows are taken in order, so ties are settled the same way every time.
    """
    cost = np.asarray(cost, float)
    if not cost.size:
        return []
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    n, m = c.shape
    row_price, column_price = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for row in range(n):
        slack, via, open_ = c[row] - row_price[row] - column_price, np.full(m, -1), np.ones(m, bool)
        reached: list[tuple[int, float]] = []
        while True:
            j = int(np.argmin(np.where(open_, slack, np.inf)))
            dist = slack[j]
            open_[j] = False
            if owner[j] < 0:
                break
            i = owner[j]
            reached.append((j, dist))
            through = dist + c[i] - row_price[i] - column_price
            better = open_ & (through < slack)
            slack[better], via[better] = through[better], j
        row_price[row] += dist
        for k, d in reached:
            row_price[owner[k]] += dist - d
            column_price[k] -= dist - d
        while via[j] >= 0:
            owner[j] = owner[via[j]]
            j = via[j]
        owner[j] = row
    return sorted((j, int(i)) if flip else (int(i), j) for j, i in enumerate(owner) if i >= 0)


def sorted_links(i: np.ndarray, j: np.ndarray, price: np.ndarray, rows: int) -> list[tuple[list[int], list[float]]]:
    """For each row the columns j and their prices, the cheapest first."""
    order = np.lexsort((j, price, i))
    edges, column, price = np.searchsorted(i[order], np.arange(rows + 1)).tolist(), j[order].tolist(), price[order].tolist()
    return [(column[a:b], price[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def cheapest_links(links: list[tuple[list[int], list[float]]], columns: int, alone: float, known: float = np.inf, more: Callable[[int, float], tuple[list[int], list[float], float]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """cheapest_assignment of no more rows than columns where only linked pairs can be; a row without a partner costs alone.

    links: as of sorted_links, for each row those that cost less than known; more(row, known) gives those that cost less
    than a higher limit, and the limit. Rows begin with their cheapest column, the first that wants it; each of the others then
    searches only as far as a cheaper way to a free column, or to a row that stays alone, may lie, and only there are more
    links asked for.
    """
    rows = len(links)
    links, limit = list(links), [known] * rows
    row_price, column_price = [0.0] * rows, [0.0] * columns
    owner, partner = [-1] * columns, [-1] * rows
    for row, (column, cost) in enumerate(links):
        if column and owner[column[0]] < 0 and cost[0] <= alone:
            owner[column[0]], partner[row], row_price[row] = row, column[0], cost[0]
    for row in [r for r in range(rows) if partner[r] < 0]:
        slack: dict[int, float] = {}
        via: dict[int, int] = {}
        reached: list[tuple[int, float]] = []
        heap: list[tuple[float, int]] = []  # columns, and -1 - rows with links that aren't known
        base = {row: 0.0}  # distance of a row, less its price
        here, least, end = row, np.inf, -1  # end: the free column, or -1 - the row that stays alone
        while True:
            start = base[here]
            if start + alone < least:
                least, end = start + alone, -1 - here
            column, cost = links[here]
            for c, price in zip(column, cost, strict=True):
                d = start + price
                if d >= least:  # prices of columns are never above zero
                    break
                d -= column_price[c]
                if d < least and d < slack.get(c, np.inf):
                    slack[c], via[c] = d, here
                    if owner[c] < 0:
                        least, end = d, c
                    else:
                        heapq.heappush(heap, (d, c))
            if start + limit[here] < least:
                heapq.heappush(heap, (start + limit[here], -1 - here))
            while heap and heap[0][1] >= 0 and heap[0][0] > slack[heap[0][1]]:
                heapq.heappop(heap)
            if not heap or heap[0][0] >= least:
                break
            d, c = heapq.heappop(heap)
            if c < 0:
                here = -1 - c
                *links[here], limit[here] = more(here, limit[here])
            else:
                reached.append((c, d))
                slack[c] = -np.inf  # settled, whatever rounding says
                here = owner[c]
                base[here] = d - row_price[here]
        row_price[row] += least
        for c, d in reached:
            if d < least:
                row_price[owner[c]] += least - d
                column_price[c] -= least - d
        if end < 0:
            here = -1 - end
            end, partner[here] = partner[here], -1
        while end >= 0:
            here = via[end]
            owner[end] = here
            end, partner[here] = partner[here], end
            if here == row:
                break
    out = np.array(partner, int)
    mine = np.flatnonzero(out >= 0)
    return mine, out[mine]


def largest_matching(links: list[list[int]], right: int) -> dict[int, int]:
    """left -> right for a matching with the most pairs. links: for each left node the right nodes it may take.

    Breadth-first augmenting paths from each left node in turn.
    """
    taken, given = [-1] * right, {}
    for start in range(len(links)):
        came: dict[int, int] = {}
        queue, end = [start], -1
        for left in queue:
            for r in links[left]:
                if r not in came:
                    came[r] = left
                    if taken[r] < 0:
                        end = r
                        break
                    queue.append(taken[r])
            if end >= 0:
                break
        while end >= 0:
            left = came[end]
            before = given.get(left, -1)
            taken[end], given[left] = left, end
            end = before
    return given


def greedy_links(distance: np.ndarray, most: float) -> list[tuple[int, int]]:
    """One-to-one pairs by ascending distance, none farther than most."""
    i, j = np.nonzero(distance <= most)
    out, rows, columns = [], set(), set()
    for k in np.lexsort((j, i, distance[i, j])):
        if i[k] not in rows and j[k] not in columns:
            rows.add(i[k])
            columns.add(j[k])
            out.append((int(i[k]), int(j[k])))
    return out


class Places:
    """The different positions of some points, with the points at each, in order, and how many of them are taken."""

    def __init__(self, points: np.ndarray) -> None:
        sound = np.flatnonzero(np.isfinite(points).all(1))
        self.at, of = np.unique(points[sound], axis=0, return_inverse=True)
        self.points = sound[np.argsort(of.ravel(), kind="stable")].tolist()
        self.end = np.cumsum(np.bincount(of.ravel(), minlength=len(self.at))).tolist()
        self.next = [0, *self.end[:-1]] if self.end else []

    def free(self) -> np.ndarray:
        return np.flatnonzero(np.array(self.next, int) < np.array(self.end, int))


def close_links(a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """greedy_links of the points a and b without the matrix of their distances: for each of b its partner in a, -1 if none.

    Points in one place are looked at together. Near pairs come first: what is linked at a small radius takes no part at
    the next, so the pairs looked at grow like the points, not like their square.
    """
    link = np.full(len(b), -1)
    one, other = Places(a), Places(b)
    if not len(one.at) or not len(other.at):
        return link

    def join(p: int, q: int, n: int = 1) -> None:
        i, j = one.next[p], other.next[q]
        link[other.points[j : j + n]] = one.points[i : i + n]
        one.next[p], other.next[q] = i + n, j + n

    def join_tied(pairs: list[tuple[int, int]]) -> None:
        """Pairs of places that are equally far apart: the points in order, each with the first that is free."""
        partners: dict[int, list[int]] = {}
        for p, q in pairs:
            partners.setdefault(p, []).append(q)
        heads = [(one.points[one.next[p]], p) for p in partners if one.next[p] < one.end[p]]
        heapq.heapify(heads)
        while heads:
            p = heapq.heappop(heads)[1]
            free = [(other.points[other.next[q]], q) for q in partners[p] if other.next[q] < other.end[q]]
            if free:
                join(p, min(free)[1])
                if one.next[p] < one.end[p]:
                    heapq.heappush(heads, (one.points[one.next[p]], p))

    low, high = np.minimum(one.at.min(0), other.at.min(0)), np.maximum(one.at.max(0), other.at.max(0))
    radius = float(min(most, np.sqrt(np.prod(high - low) / max(len(one.at), len(other.at))))) or most
    while True:
        left, right = one.free(), other.free()
        i, j, d = pairs_within(one.at[left], other.at[right], radius)
        order = np.argsort(d, kind="stable")
        edges = np.flatnonzero(np.append(np.append(True, np.diff(d[order]) != 0), True)).tolist() if len(d) else [0]
        p, q = left[i[order]].tolist(), right[j[order]].tolist()
        for x, y in zip(edges[:-1], edges[1:], strict=True):
            if y == x + 1 or len(set(p[x:y])) == y - x == len(set(q[x:y])):
                for k in range(x, y):
                    n = min(one.end[p[k]] - one.next[p[k]], other.end[q[k]] - other.next[q[k]])
                    if n:
                        join(p[k], q[k], n)
            else:
                join_tied(list(zip(p[x:y], q[x:y], strict=True)))
        if radius >= most:
            return link
        radius = min(2 * radius, most)
