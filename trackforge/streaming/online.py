"""Structured Streaming forms of the operators that can run online. Every one needs a watermark on ts.

Late rows beyond the watermark are dropped; windows align to the epoch, not to a match's start.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trackforge.operators.ball import BallFollower, followed
from trackforge.operators.clean import greedy_keep, keep_apart
from trackforge.operators.stateful import PossessionState
from trackforge.params import Ball, Possession


def sessions(stream: DataFrame, keys: list[str], ts: str, gap: str, late: str) -> DataFrame:
    """Sessions of rows no more than gap apart; each is emitted when the watermark has passed its end."""
    w = F.session_window(ts, gap)
    out = stream.withWatermark(ts, late).groupBy(*keys, w).agg(F.min(ts).alias("t0"), F.max(ts).alias("t1"), F.count("*").alias("n"))
    return out.drop("session_window")


def hopping_share(stream: DataFrame, keys: list[str], ts: str, flag: Column, width: str, step: str, late: str) -> DataFrame:
    """Share of flag in windows of width every step."""
    w = F.window(ts, width, step)
    out = stream.withWatermark(ts, late).groupBy(*keys, w).agg(F.avg(flag.cast("int")).alias("share"), F.count("*").alias("n"))
    return out.select(*keys, F.col("window.end").alias("g"), "share", "n")


def without_repeats(stream: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """The first of rows with equal keys that come within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def without_clashes(stream: DataFrame, keys: list[str], ts: str, late: str, rank: list[str], item: str, clash: Callable) -> DataFrame:
    """clean.greedy_keep on a stream: a frame's rows, those of equal keys and ts, are held until the watermark has passed ts."""
    return greedy_keep(stream.withWatermark(ts, late), [*keys, ts], rank, item, clash)


def without_doubles(stream: DataFrame, keys: list[str], ts: str, late: str, rank: list[str], item: str, distance: float, other: str | None = None) -> DataFrame:
    """clean.keep_apart on a stream, for frames of many rows; otherwise as without_clashes."""
    return keep_apart(stream.withWatermark(ts, late), [*keys, ts], rank, item, distance, other)


def online_possession(stream: DataFrame, key: str, p: Possession = Possession()) -> DataFrame:
    """The possession machine on a stream of frames: key, frame, t, half, dead, ball, controller.

    Rows of a key must come in order of time within a micro-batch and from batch to batch; state is a few numbers.
    """

    def run(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        half, machine = None, PossessionState(p)
        if state.exists:
            half, holder, rival, since, seen = state.get
            machine = PossessionState(p, holder, rival, since or 0, seen)
        rows = pd.concat(list(batches)).sort_values(["t", "frame"])
        out = []
        for r in rows.itertuples():
            if r.half != half:
                machine.drop()
                half = int(r.half)
            c, holder = machine.step(int(r.t), bool(r.dead), bool(r.ball), None if pd.isna(r.controller) else int(r.controller))
            out.append((name[0], r.frame, c, holder))
        state.update((half, machine.holder, machine.rival, machine.rival_since, machine.ball_seen))
        yield pd.DataFrame(out, columns=[key, "frame", "controlled_by", "possession"]).astype({"controlled_by": "Int32", "possession": "Int32"})

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, frame long, controlled_by int, possession int", "half int, holder int, rival int, since long, seen long", "append", GroupStateTimeout.NoTimeout)


def online_ball(stream: DataFrame, key: str, ts: str, late: str, p: Ball = Ball()) -> DataFrame:
    """The ball tracker on a stream of candidates: key, frame, t, x, y, confidence, person, with ts as event time.

    A position comes out once no challenger can take it back, so late by at most the time that a challenger needs, and
    when the watermark has passed that time and nothing followed. All candidates of a frame must come in one micro-batch,
    frames of a key in order; state is one follower, as text.
    """

    def run(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        follower = BallFollower(p)
        if state.exists:
            held = json.loads(state.get[0])
            place = lambda x: None if x is None else np.array(x)
            follower = BallFollower(p, place(held["place"]), held["seen"], place(held["rival"]), held["since"], [tuple(x) for x in held["pending"]])
        if state.hasTimedOut:
            out = follower.finish()
            state.remove()
        else:
            rows = pd.concat(list(batches))
            out = followed(rows, follower)
            listed = lambda x: None if x is None else x.tolist()
            state.update((json.dumps({"place": listed(follower.place), "seen": follower.seen, "rival": listed(follower.rival), "since": follower.rival_since, "pending": follower.pending}),))
            state.setTimeoutTimestamp(max(int(rows[ts].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + int(1000 * p.switch_s) + 1)
        frame = pd.DataFrame(out, columns=["frame", "t", "x", "y", "confidence"])[["frame", "x", "y", "confidence"]]
        frame.insert(0, key, name[0])
        yield frame

    kind = dict(stream.dtypes)[key]
    rows = stream.withWatermark(ts, late).select(key, ts, "frame", "t", "x", "y", "confidence", "person")
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, frame long, x double, y double, confidence double", "follower string", "append", GroupStateTimeout.EventTimeTimeout)


def drained(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and reads back what it emitted, from Parquet under folder.

    Every micro-batch has a folder of its own, which a repeated one replaces. In complete mode the last one counts.
    """
    spark, path, schema = stream.sparkSession, f"{folder}/rows", stream.schema
    last: list[int] = []

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/{batch:09d}")
        last.append(batch)

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    if not last:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{path}/{max(last):09d}" if mode == "complete" else path)
