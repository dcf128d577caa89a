"""Sums over vectors, for models that need no more of the data: number, sums and sums of products of each key's vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


def unfolded(sums: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, sums and sums of products from a key's moments as one array."""
    side = int(round(len(sums) ** 0.5))
    m = sums.reshape(side, side)
    return int(round(m[0, 0])), m[0, 1:], m[1:, 1:]


def added(sums: DataFrame, keys: list[str]) -> DataFrame:
    """The moments of each key, added up. sums: keys, sums (binary)."""

    def run(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b.as_buffer()) for b in rows.column("sums"))
        return rows.slice(0, 1).select(keys).append_column("sums", pa.array([total.tobytes()], pa.binary()))

    return sums.groupBy(*keys).applyInArrow(run, sums.select(*keys, "sums").schema)


def moments(df: DataFrame, keys: list[str], vector: str, size: int) -> DataFrame:
    """keys, sums: each task sums up its own rows, so that a key is shuffled once for each task. Vectors that aren't whole are left out."""
    whole = df.where((F.size(vector) == size) & F.forall(vector, lambda x: x.isNotNull())).select(*keys, F.col(vector).cast("array<double>").alias("v"))
    fields = [(k, to_arrow_type(whole.schema[k].dataType)) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            names = list(zip(*(batch.column(i).to_pylist() for i in range(len(keys))), strict=True))
            x = batch.column(len(keys)).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            number = {name: i for i, name in enumerate(dict.fromkeys(names))}
            of = np.array([number[name] for name in names])
            for name, i in number.items():
                own = np.concatenate([np.ones((int((of == i).sum()), 1)), x[of == i]], axis=1)
                total[name] = total.get(name, 0) + own.T @ own
        columns = [pa.array([name[i] for name in total], kind) for i, (_, kind) in enumerate(fields)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([m.tobytes() for m in total.values()], pa.binary())], names=[*keys, "sums"])

    schema = ", ".join(f"`{k}` {whole.schema[k].dataType.simpleString()}" for k in keys) + ", sums binary"
    return added(whole.mapInArrow(run, schema), keys)
