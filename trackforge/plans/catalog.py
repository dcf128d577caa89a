"""Registry of queries: a name, what it runs, and the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackforge.recast import FRAMES_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, frames: bool = True) -> Callable[[Query], Query]:
    """Registers a function under its name. sql: its oracle; with frames it may begin with a list of CTEs after frames."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH RECURSIVE {FRAMES_SQL}{sql}" if frames else sql
        return f

    return register


def r6(c: Column) -> Column:
    return F.round(c, 6)
