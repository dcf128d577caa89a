"""Pieces of players' tracks online."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from trackforge.operators.players import Pieces, Seen
from trackforge.params import Pitch, Tracks
from trackforge.streaming.reordered import MS, Reordered, processed

FIELDS = "count long, bench boolean, t double, place_var double, speed_var double, cov double, x double, y double, vx double, vy double, team_0 long, team_1 long, keeper long, first_vote long, began double"
OUTPUT = ["what", "piece", "t", "x", "y", "t0", "n", "team", "keeper_share"]


def stored(live: Pieces) -> list[tuple]:
    """A row of FIELDS for each live piece."""
    columns = [live.count, live.bench, live.t, live.place_var, live.speed_var, live.cov, *live.mean.T, *live.votes.T, live.keeper, live.first_vote, live.began]
    return list(zip(*(c.tolist() for c in columns), strict=True))


def restored(rows: list[tuple[int, tuple]], made: int, p: Tracks) -> Pieces:
    """rows: numbers with what stored() gave for them."""
    live = Pieces(p)
    live.made = made
    if rows:
        rows = sorted(rows)
        c = [np.array(x) for x in zip(*(values for _, values in rows), strict=True)]
        live.number = np.array([number for number, _ in rows])
        live.count, live.bench, live.t, live.place_var, live.speed_var, live.cov = c[:6]
        live.mean, live.votes, live.keeper, live.first_vote, live.began = np.stack(c[6:10], 1), np.stack(c[10:12], 1), c[12], c[13], c[14]
    return live


class OnlinePieces(Reordered):
    """A detection comes out as soon as its piece has enough of them; a piece when it is over.

    Live pieces are a map from their numbers; detections of pieces that may be chance are another. Match time and event
    time run alike within a key.
    """

    def __init__(self, p: Tracks, pitch: Pitch, keys: list[str], idle_ms: int) -> None:
        super().__init__(["t", "x", "y"], idle_ms)
        self.p, self.pitch, self.keys = p, pitch, keys

    def open(self) -> None:
        self.pieces = self.handle.getMapState("pieces", "number long", FIELDS)
        self.unsure = self.handle.getMapState("unsure", "number long", "seen array<struct<t:long,x:double,y:double>>")
        self.clock = self.handle.getValueState("clock", "made long, offset long")

    def _live(self) -> tuple[Pieces, int]:
        made, offset = self.clock.get() if self.clock.exists() else (0, 0)
        return restored([(k[0], tuple(v)) for k, v in self.pieces.iterator()], made, self.p), offset

    def _over(self, live: Pieces, gone: np.ndarray) -> list[tuple]:
        """Lets go of pieces; a row for each that had enough detections."""
        out = []
        for i in np.flatnonzero(gone).tolist():
            number, n = int(live.number[i]), int(live.count[i])
            if n >= self.p.hits:
                team = int(live.team[i])
                out.append(("piece", number, round(1000 * float(live.t[i])), None, None, round(1000 * float(live.began[i])), n, None if team < 0 else team, float(live.keeper[i] / n)))
            if self.pieces.containsKey((number,)):
                self.pieces.removeKey((number,))
            if self.unsure.containsKey((number,)):
                self.unsure.removeKey((number,))
        live.keep(~gone)
        return out

    def _table(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=OUTPUT).astype({"x": float, "y": float, "t0": "Int64", "n": "Int64", "team": "Int32", "keeper_share": float})
        for i, (name, value) in enumerate(zip(self.keys, key, strict=True)):
            out.insert(i, name, value)
        return out

    def passed(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        live, _ = self._live()
        seen = Seen.of(rows, self.pitch, self.p)
        t, waiting, out = rows.t.tolist(), {k[0]: [tuple(x) for x in v[0]] for k, v in self.unsure.iterator()}, []
        for a, b in zip(seen.frames[:-1].tolist(), seen.frames[1:].tolist(), strict=True):
            gone = live.overdue(seen.t[a])
            for number in live.number[gone].tolist():
                waiting.pop(number, None)
            out += self._over(live, gone)
            numbers = live.take(seen, a, b)
            settled = dict(zip(live.number.tolist(), live.settled.tolist(), strict=True))
            for i, number in zip(range(a, b), numbers.tolist(), strict=True):
                if number >= 0:
                    waiting.setdefault(number, []).append((t[i], float(seen.x[i]), float(seen.y[i])))
                    if settled[number]:
                        out += [("detection", number, *d, None, None, None, None) for d in waiting.pop(number)]
        for number, values in zip(live.number.tolist(), stored(live), strict=True):
            self.pieces.updateValue((number,), values)
        for number in [k[0] for k in self.unsure.keys()]:
            if number not in waiting:
                self.unsure.removeKey((number,))
        for number, held in waiting.items():
            self.unsure.updateValue((number,), (held,))
        offset = int(rows[MS].iloc[-1] - rows.t.iloc[-1])
        self.clock.update((live.made, offset))
        if len(live.t):
            self.wake_at(round(1000 * float(live.t.min()) + offset + 1000 * self.p.lost_s) + 1)
        return self._table(key, out)

    def lapsed(self, key: tuple, watermark: int) -> pd.DataFrame | None:
        live, offset = self._live()
        if not len(live.t):
            return None
        gone = live.overdue((watermark - offset) / 1000)
        out = self._over(live, gone)
        if gone.any() and len(live.t):
            self.wake_at(round(1000 * float(live.t.min()) + offset + 1000 * self.p.lost_s) + 1)
        return self._table(key, out)

    def ended(self, key: tuple) -> pd.DataFrame | None:
        live, _ = self._live()
        out = self._over(live, np.ones(len(live.t), bool))
        self.clock.clear()
        return self._table(key, out)


def online_pieces(stream: DataFrame, keys: list[str], ts: str, late: str, p: Tracks = Tracks(), pitch: Pitch = Pitch(), idle_s: float = 600.0) -> DataFrame:
    """Players' pieces on a stream of detections: keys (match and half), ts (event time), t (ms), x, y, team, keeper.

    Rows may come in any order within late. Rows that come out: a detection (what = "detection": piece, t, x, y) once its
    piece has enough of them, and a piece (what = "piece": t its last, t0 its first time, n, team, keeper_share) once it
    can't go on; both as the batch operator numbers them. A key that has been quiet for idle_s is forgotten.
    """
    kinds = dict(stream.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", what string, piece int, t long, x double, y double, t0 long, n long, team int, keeper_share double"
    return processed(stream, keys, ts, late, ["t", "x", "y", "team", "keeper"], OnlinePieces(p, pitch, keys, int(1000 * idle_s)), schema)
