"""Possession online: from frames that come in any order to who has the ball.

Two stateful operators. The first puts the frames of a match in order and decides which of them are dead, because the
ball is outside or lies still; both need what comes after. The second is the possession machine.
"""

from __future__ import annotations

import json
import math
import statistics
from collections import deque
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from trackforge.operators.stateful import PossessionState
from trackforge.params import Pitch, Possession
from trackforge.streaming.reordered import Reordered, processed

ANCHOR = 5  # rows whose median is where a stay is
FRAME = ["half", "frame", "t", "x", "y", "controller"]


@dataclass
class Frame:
    half: int
    frame: int
    t: int
    x: float | None
    y: float | None
    controller: int | None
    out: bool | None = None  # None: not decided yet
    still: bool | None = None


@dataclass
class OutsideRun:
    """A run outside lasts over unseen frames up to one inside, or to the end of the half, and counts if it is long enough."""

    least_ms: int
    since: int | None = None
    half: int | None = None

    def step(self, row: Frame, beyond: bool | None) -> bool | None:
        """What row tells of the run's open frames: True and False decide them, None leaves them open. Sets row.out."""
        verdict = None
        if self.since is not None and row.half != self.half:
            verdict, self.since = False, None  # it was too short at the half's last frame, or it had been decided
        self.half = row.half
        if self.since is None:
            if beyond:
                self.since, row.out = row.t, True if self.least_ms <= 0 else None
            else:
                row.out = False
            return verdict
        lasted = row.t - self.since >= self.least_ms
        if beyond is False:
            self.since, row.out = None, False
            return lasted
        row.out = True if lasted else None
        return True if lasted else None


@dataclass
class Stay:
    """Positions around the median of the first few; where one doesn't belong, a new stay may begin."""

    least_ms: int
    radius: float
    gap_ms: int
    anchor: tuple[float, float] | None = None  # of a stay that lasts long enough already
    last: tuple[int, int] = (0, 0)  # time and half of its latest frame
    tail: list[Frame] = field(default_factory=list)  # frames that aren't decided

    def _apart(self, t: int, half: int, row: Frame) -> bool:
        return row.t - t > self.gap_ms or row.half != half

    def add(self, row: Frame, ended: bool = False) -> None:
        """row: of known position, the next in order. Sets still of the frames that can be decided now."""
        if self.anchor and not self._apart(*self.last, row) and math.dist(self.anchor, (row.x, row.y)) <= self.radius:
            row.still, self.last = True, (row.t, row.half)
            return
        self.anchor = None
        self.tail.append(row)
        self.decide(ended)

    def decide(self, ended: bool = False) -> None:
        while self.tail and (ended or len(self.tail) >= ANCHOR):
            first = self.tail[:ANCHOR]
            place = statistics.median(r.x for r in first), statistics.median(r.y for r in first)
            end = next((k for k in range(1, len(self.tail)) if self._apart(self.tail[k - 1].t, self.tail[k - 1].half, self.tail[k]) or math.dist(place, (self.tail[k].x, self.tail[k].y)) > self.radius), None)
            own = self.tail[:end]
            if own[-1].t - own[0].t >= self.least_ms:
                for r in own:
                    r.still = True
                del self.tail[: len(own)]
                if end is None:
                    self.anchor, self.last = place, (own[-1].t, own[-1].half)
            elif end is None and not ended:
                return
            else:
                self.tail.pop(0).still = False


class BallStates:
    """Frames in order, with out and still once they are decided; undecided ones wait, and those behind them."""

    def __init__(self, p: Possession, pitch: Pitch, outside: OutsideRun | None = None, stay: Stay | None = None, waiting: list[Frame] | None = None) -> None:
        self.p, self.pitch = p, pitch
        self.outside = outside or OutsideRun(int(1000 * p.out_min_s))
        self.stay = stay or Stay(int(1000 * p.still_s), p.still_radius, 1000)
        self.waiting = deque(waiting or [])

    def _beyond(self, row: Frame) -> bool | None:
        if row.x is None:
            return None
        m = self.p.out_margin
        return row.x < -m or row.x > self.pitch.length + m or row.y < -m or row.y > self.pitch.width + m

    def add(self, row: Frame) -> None:
        verdict = self.outside.step(row, self._beyond(row))
        if verdict is not None:
            for r in self.waiting:
                if r.out is None:
                    r.out = verdict
        self.waiting.append(row)
        if row.x is None:
            row.still = False
        else:
            self.stay.add(row)

    def end(self) -> None:
        """Nothing more comes: what is open is too short."""
        self.stay.decide(ended=True)
        for r in self.waiting:
            r.out = bool(r.out)
        self.outside.since = None

    def decided(self) -> list[Frame]:
        out = []
        while self.waiting and self.waiting[0].out is not None and self.waiting[0].still is not None:
            out.append(self.waiting.popleft())
        return out

    def saved(self) -> str:
        undecided = {id(r) for r in self.stay.tail}
        frames = [asdict(r) | {"tail": id(r) in undecided} for r in self.waiting]
        stay = {"anchor": self.stay.anchor, "last": self.stay.last}
        return json.dumps({"frames": frames, "outside": asdict(self.outside), "stay": stay})

    @classmethod
    def loaded(cls, text: str, p: Possession, pitch: Pitch) -> "BallStates":
        held = json.loads(text)
        tails = [f.pop("tail") for f in held["frames"]]
        frames = [Frame(**f) for f in held["frames"]]
        new = cls(p, pitch, OutsideRun(**held["outside"]), waiting=frames)
        anchor = held["stay"]["anchor"]
        new.stay.anchor, new.stay.last = anchor and tuple(anchor), tuple(held["stay"]["last"])
        new.stay.tail = [f for f, tail in zip(frames, tails, strict=True) if tail]
        return new


class OrderedFrames(Reordered):
    def __init__(self, p: Possession, pitch: Pitch, key: str, idle_ms: int) -> None:
        super().__init__(["t", "frame"], idle_ms)
        self.p, self.pitch, self.key = p, pitch, key
        self.kept: BallStates | None = None

    def open(self) -> None:
        self.states = self.handle.getValueState("states", "text string")

    def _load(self) -> BallStates:
        return BallStates.loaded(self.states.get()[0], self.p, self.pitch) if self.states.exists() else BallStates(self.p, self.pitch)

    def _table(self, key: tuple, rows: list[Frame]) -> pd.DataFrame:
        columns = {self.key: [key[0]] * len(rows)} | {c: [getattr(r, c) for r in rows] for c in ("half", "frame", "t", "out", "still")}
        return pd.DataFrame(columns | {"ball": [r.x is not None for r in rows], "controller": pd.array([r.controller for r in rows], "Int32")})

    def passed(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        states = self._load()
        columns = [rows[c].tolist() for c in FRAME]
        for half, frame, t, x, y, controller in zip(*columns, strict=True):
            states.add(Frame(int(half), int(frame), int(t), _known(x), _known(y), None if _known(controller) is None else int(controller)))
        out = states.decided()
        if self.ending:
            self.kept = states
        else:
            self.states.update((states.saved(),))
        return self._table(key, out)

    def ended(self, key: tuple) -> pd.DataFrame | None:
        states, self.kept = self.kept or self._load(), None
        states.end()
        self.states.clear()
        return self._table(key, states.decided())


def _known(value: float | None) -> float | None:
    """None for nulls, which come as NaN from columns of numbers."""
    return None if value is None or value is pd.NA or value != value else value


class Machine(StatefulProcessor):
    """The possession machine over frames that come in order."""

    def __init__(self, p: Possession, key: str) -> None:
        self.p, self.key = p, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "half int, holder int, rival int, since long, seen long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        half, machine = None, PossessionState(self.p)
        if self.held.exists():
            half, holder, rival, since, seen = self.held.get()
            machine = PossessionState(self.p, holder, rival, since, seen)
        out = []
        parts = list(rows)
        frames = (pd.concat(parts) if len(parts) > 1 else parts[0]).sort_values(["t", "frame"])
        columns = [frames[c].tolist() for c in ("half", "frame", "t", "out", "still", "ball", "controller")]
        for own, frame, t, outside, still, ball, controller in zip(*columns, strict=True):
            if own != half:
                half, machine = int(own), PossessionState(self.p)
            near = None if _known(controller) is None else int(controller)
            out.append((int(frame), bool(outside), bool(still), half, *machine.step(int(t), bool(outside or still), bool(ball), near)))
        self.held.update((half, machine.holder, machine.rival, machine.rival_since, machine.ball_seen))
        frame, outside, still, halves, controller, holder = zip(*out, strict=True)
        yield pd.DataFrame({self.key: [key[0]] * len(out), "half": halves, "frame": frame, "out": outside, "still": still, "controlled_by": pd.array(controller, "Int32"), "possession": pd.array(holder, "Int32")})

    def close(self) -> None:
        pass


def ordered_possession(stream: DataFrame, key: str, ts: str, late: str, p: Possession = Possession(), pitch: Pitch = Pitch(), idle_s: float = 600.0) -> DataFrame:
    """out, still, controlled_by and possession of each frame: key (match), ts (event time), half, frame, t (ms), x, y, controller.

    Frames may come in any order within late; x and y are null where the ball isn't seen. A frame comes out once it is
    known whether the ball is out or lies still, so a few seconds after the watermark; what is left when a match has been
    quiet for idle_s comes out then, and the match's frames are forgotten; a machine's few numbers stay.
    """
    kind = dict(stream.dtypes)[key]
    frames = stream.select(key, ts, "half", "frame", "t", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "controller")
    states = processed(frames, [key], ts, late, FRAME, OrderedFrames(p, pitch, key, int(1000 * idle_s)), f"{key} {kind}, half int, frame long, t long, out boolean, still boolean, ball boolean, controller int")
    schema = f"{key} {kind}, half int, frame long, out boolean, still boolean, controlled_by int, possession int"
    return states.groupBy(key).transformWithStateInPandas(Machine(p, key), schema, "Append", "None")
