"""Memory of Python workers, which serve many tasks and operators one after the other."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

BATCH_BYTES = "8m"
LARGE = 4 << 20  # bytes of a group after which memory is given back
_KEPT: dict[str, Callable[[], None]] = {}


def kept(owner: str, forget: Callable[[], None]) -> None:
    """Registers what an operator keeps from task to task; it is forgotten when a worker turns to another operator."""
    _KEPT[owner] = forget


def give_back() -> None:
    """Returns freed memory to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _turn_to(owner: str | None) -> None:
    for name, forget in _KEPT.items():
        if name != owner:
            forget()


def lean(run: Callable, owner: str | None = None) -> Callable:
    """run, a function of an iterator of batches, with its freed memory given back at the end of the task."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _turn_to(owner)
        yield from run(batches)
        give_back()

    return wrapped


def lean_group(run: Callable) -> Callable:
    """run, a function of one group's table or of two tables, with its freed memory given back after large groups."""

    def whole(*tables: pa.Table) -> pa.Table:
        _turn_to(None)
        out = run(*tables)
        if sum(t.nbytes for t in tables) > LARGE:
            give_back()
        return out

    return (lambda a: whole(a)) if run.__code__.co_argcount == 1 else (lambda a, b: whole(a, b))


def bound_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes as well, as rows hold whole texts; a session that sets its own bound keeps it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, BATCH_BYTES)
