"""Cleaning of detections: margins, de-duplication within a frame, spots that never move, judged rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackforge.operators.proximity import greedy_apart

BATCH = 10_000  # rows of a batch of results


def greedy_keep(df: DataFrame, keys: list[str], rank: list[str], item: str, clash: "callable", most: int | None = None) -> DataFrame:
    """Within each key, rows in order of rank; a row is dropped if it clashes with a row that was kept before it.

    clash(kept, row) compares two structs of all columns. A row near a dropped one stays, so this isn't an anti join.
    A key's rows are those of one frame, a few dozen; they are held as one array. For many, see keep_apart.
    """
    step = lambda acc, x: F.when(F.exists(acc, lambda y: clash(y, x)), acc).otherwise(F.concat(acc, F.array(x)))
    grouped = ranked(df, keys, rank, item)
    kept = F.aggregate("_items", F.slice("_items", 1, 0), step)
    kept = F.slice(kept, 1, most) if most else kept
    return grouped.select(*keys, F.inline(kept))


def ranked(df: DataFrame, keys: list[str], rank: list[str], item: str) -> DataFrame:
    """keys and _items: their rows in order of rank, as one array."""
    columns = [c for c in df.columns if c not in keys and c not in rank]
    row = F.struct(*rank, *([item] if item not in rank else []), *(c for c in columns if c != item))
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("_items"))


def keep_apart(df: DataFrame, keys: list[str], rank: list[str], item: str, distance: float, other: str | None = None) -> DataFrame:
    """greedy_keep for rows (x, y) that clash if they are nearer than distance, and with other: if they differ in it as well.

    Rows without a position, or without other, clash with none. The work of a key follows the number of its rows, also if
    most of many stay.
    """
    rows = ranked(df, keys, rank, item)
    own = rows.schema["_items"].dataType.elementType
    schema = T.StructType([*(rows.schema[k] for k in keys), *own])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("_items"))
            group, items = pc.list_parent_indices(lists).to_numpy(), lists.flatten()
            x, y = (items.field(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("x", "y"))
            kind = items.field(other).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) if other else np.zeros(len(x), int)
            sound = np.flatnonzero(np.isfinite(x) & np.isfinite(y) & (kind >= 0))
            stays = np.ones(len(x), bool)
            stays[sound] = greedy_apart(group[sound], kind[sound].astype(int), x[sound], y[sound], distance, other is None)
            at = np.flatnonzero(stays)
            for a in range(0, len(at), BATCH):
                part = at[a : a + BATCH]
                mine, of = items.take(pa.array(part)), pa.array(group[part])
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(k)).take(of) for k in keys), *mine.flatten()], names=schema.names)

    return rows.mapInArrow(keep, schema)


def near(a: Column, b: Column, distance: float, strict: bool = True) -> Column:
    d = F.hypot(a["x"] - b["x"], a["y"] - b["y"])
    return d < distance if strict else d <= distance


def top_by_key(df: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def standing_cells(df: DataFrame, frame: str, frames: Column | int, cell: float, share: float, far: Column) -> DataFrame:
    """Cells, with their eight neighbours, in which far candidates are seen in at least share of all frames: cx, cy."""
    cells = df.where(far).select(frame, F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy"))
    spots = cells.groupBy("cx", "cy").agg(F.countDistinct(frame).alias("k")).where(F.col("k") >= share * frames)
    around = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    return spots.select("cx", "cy", around.alias("dx")).select("cx", "cy", "dx", around.alias("dy")).select((F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy")).distinct()


def without_standing(df: DataFrame, cells: DataFrame, cell: float, played: Column) -> DataFrame:
    """Rows outside the cells, and those that played says are in play."""
    keyed = df.withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell))
    marked = keyed.join(cells.withColumn("_spot", F.lit(True)), ["cx", "cy"], "left")
    return marked.where(F.col("_spot").isNull() | F.coalesce(played, F.lit(False))).drop("_spot", "cx", "cy")
