"""Functions of one key's rows, run over all keys of a partition one after the other.

A window numbers the rows of each key, so that rows arrive by key and in order, with the partitioning that windows and
aggregations of the same keys have: no shuffle of its own. One Python call per partition then walks the keys; a key
costs a slice of arrays instead of an Arrow stream and a frame.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from trackforge.operators.proximity import nearest_points

ROW = "_row"
BATCH = 10_000  # rows of a batch of results
Columns = list[tuple[str, T.DataType]]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, and the first row of each group (one more number at the end)."""
    held: list[pa.RecordBatch] = []

    def table() -> tuple[pa.Table, np.ndarray]:
        whole = pa.Table.from_batches(held).combine_chunks()
        return whole, np.append(np.flatnonzero(whole.column(ROW).to_numpy() == 1), whole.num_rows)

    for batch in batches:
        begins = np.flatnonzero(batch.column(ROW).to_numpy(zero_copy_only=False) == 1)
        if len(begins):
            last = int(begins[-1])
            held.append(batch.slice(0, last))
            if sum(b.num_rows for b in held):
                yield table()
            held, batch = [], batch.slice(last)
        held.append(batch)
    if held:
        yield table()


def _mapped(df: DataFrame, keys: list[str], order: list, columns: Columns, run: Callable[[pa.Table, np.ndarray], tuple[list, np.ndarray]]) -> DataFrame:
    """run returns the columns of all results one after the other, and the number of rows of each group's result."""
    schema = T.StructType([*(df.schema[k] for k in keys), *(T.StructField(n, k) for n, k in columns)])
    kinds = [to_arrow_type(k) for _, k in columns]
    names = [f.name for f in schema]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in _groups(batches):
            found, sizes = run(table, bounds)
            of = pa.array(np.repeat(bounds[:-1], sizes))
            own = [table.column(k).take(of).combine_chunks() for k in keys]
            out = pa.Table.from_arrays([*own, *(pa.array(c, kind, from_pandas=True) for c, kind in zip(found, kinds, strict=True))], names=names)
            yield from out.to_batches()

    numbered = df.withColumn(ROW, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return numbered.mapInArrow(walk, schema)


def walked(df: DataFrame, keys: list[str], order: list, run: Callable[[dict[str, np.ndarray]], dict], columns: Columns) -> DataFrame:
    """run on the arrays of each key's rows, in order; its arrays or lists by name, with the keys before them.

    Numbers with nulls come as floats with NaN, other values with nulls as objects with None; NaN and None mean null in
    results.
    """

    def of_groups(table: pa.Table, bounds: np.ndarray) -> tuple[list, np.ndarray]:
        values = {c: table.column(c).to_numpy() for c in table.column_names if c != ROW and c not in keys}
        results = [run({c: v[a:b] for c, v in values.items()}) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        sizes = np.array([len(r[columns[0][0]]) for r in results])
        joined = [np.concatenate([r[n] for r in results]) if isinstance(results[0][n], np.ndarray) else [x for r in results for x in r[n]] for n, _ in columns]
        return joined, sizes

    return _mapped(df, keys, order, columns, of_groups)


def grouped(df: DataFrame, keys: list[str], run: Callable[[pd.DataFrame], pd.DataFrame], columns: Columns) -> DataFrame:
    """run on a pandas frame of each key's rows; its result, with the keys before it."""

    def of_groups(table: pa.Table, bounds: np.ndarray) -> tuple[list, np.ndarray]:
        rows = table.drop_columns(ROW).to_pandas()
        results = [run(rows.iloc[a:b].reset_index(drop=True)) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        joined = pd.concat([r[[n for n, _ in columns]] for r in results])
        return [joined[n] for n, _ in columns], np.array([len(r) for r in results])

    return _mapped(df, keys, [F.lit(0)], columns, of_groups)


def with_nearest(df: DataFrame, keys: list[str], order: list, row: str, x: str, y: str, answer: str) -> DataFrame:
    """Of the rows where row isn't null: keys, row, the answer of the nearest row without it in the same key, and _d, the distance.

    order: first the rows without row, in the order in which ties are settled.
    """
    schema = T.StructType([*(df.schema[k] for k in keys), df.schema[row], T.StructField("_d", T.DoubleType()), T.StructField(answer, df.schema[answer].dataType)])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begins in _groups(batches):
            asks = table.column(row).is_valid().to_numpy()
            at, to = np.flatnonzero(asks), np.flatnonzero(~asks)
            if not len(at):
                continue
            group = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
            px, py = (table.column(c).to_numpy() for c in (x, y))  # null becomes NaN
            known = table.column(x).is_valid().to_numpy()[at] & table.column(y).is_valid().to_numpy()[at]
            d, found = np.full(len(at), np.nan), np.full(len(at), -1)
            here = at[known]
            d[known], found[known] = nearest_points(group[here], px[here], py[here], group[to], px[to], py[to], len(begins) - 1)
            none = found < 0
            which = pa.array(to[np.maximum(found, 0)] if len(to) else np.zeros(len(at), int), mask=none)
            mine = table.take(pa.array(at))
            answers = table.column(answer).take(which)
            out = pa.Table.from_arrays([*(mine.column(c) for c in (*keys, row)), pa.array(d, pa.float64(), mask=none), answers], names=schema.names)
            yield from out.combine_chunks().to_batches(max_chunksize=BATCH)

    numbered = df.withColumn(ROW, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return numbered.mapInArrow(walk, schema)
