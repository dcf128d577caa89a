"""Processors on streams whose rows come in any order within the watermark.

A key's rows are held, as Arrow batches, until the watermark has passed them; then they go on in order. So results equal
those of the batch operators on the rows that weren't late. State lives in RocksDB.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

MS = "event_ms"  # event time of a row, in milliseconds


def packed(rows: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pandas(rows, preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(blob: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(blob).read_pandas()


class Reordered(StatefulProcessor):
    """passed() gets a key's rows in order once the watermark is behind them, lapsed() every call after that, ended() when
    nothing has come for idle_ms; then the key's state goes. A key that ends with the rows that pass has ending set: passed()
    may leave what ended() needs in the processor instead of writing it as state."""

    def __init__(self, order: list[str], idle_ms: int) -> None:
        self.order, self.idle_ms = order, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.ending = handle, False
        self.early = handle.getListState("early", "rows binary")
        self.latest = handle.getValueState("latest", "ms long")
        self.open()

    def open(self) -> None:
        """Opens a processor's own state."""

    def passed(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError

    def lapsed(self, key: tuple, watermark: int) -> pd.DataFrame | None:
        """What the watermark alone settles."""

    def ended(self, key: tuple) -> pd.DataFrame | None:
        """What is left of a key; clears its state."""

    def wake_at(self, ms: int) -> None:
        self.handle.registerTimer(int(ms))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        for part in rows:
            if len(part):
                self.early.appendValue((packed(part.drop(columns=[c for c in part if str(part[c].dtype).startswith("datetime")])),))
                self.wake_at(part[MS].max())
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        held = [unpacked(bytes(blob)) for (blob,) in self.early.get()]
        latest, waits = None, False
        if held:
            rows = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
            due = rows[MS].to_numpy() <= watermark
            waits = not due.all()
            if waits:
                self.early.put([(packed(rows[~due]),)])
                rows = rows[due]
            else:
                self.early.clear()
            if len(rows):
                latest = int(rows[MS].max())
                self.ending = not waits and latest + self.idle_ms <= watermark  # so what passed() finds needn't be kept
                yield self.passed(key, rows.sort_values(self.order, ignore_index=True))
                if not self.ending:
                    self.latest.update((latest,))
                    self.wake_at(latest + self.idle_ms)
        if not self.ending:
            found = self.lapsed(key, watermark)
            if found is not None and len(found):
                yield found
        if latest is None and not waits and self.latest.exists():
            self.ending = self.latest.get()[0] + self.idle_ms <= watermark
        if self.ending:
            found = self.ended(key)
            self.ending = False
            self.latest.clear()
            if found is not None and len(found):
                yield found

    def close(self) -> None:
        pass


def with_rocksdb(spark: SparkSession) -> None:
    """Streams of this session that start from now on keep their state in RocksDB, which transformWithState needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def processed(stream: DataFrame, keys: list[str], ts: str, late: str, columns: list[str], processor: Reordered, schema: str) -> DataFrame:
    with_rocksdb(stream.sparkSession)
    rows = stream.withWatermark(ts, late).select(*keys, ts, F.unix_millis(ts).alias(MS), *columns)
    return rows.groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", "EventTime")
