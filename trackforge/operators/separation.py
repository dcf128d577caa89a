"""How well descriptors separate classes: leave-one-out predictions, and clusters that know no labels.

Models come from moments of all rows, so one pass learns them; the row that is left out is taken off the sums again,
for many rows at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from trackforge.operators.moments import moments, unfolded

MOST_LABELS = 1_000
CELLS = 1 << 21  # numbers that are held at once
EPSILON, TINY = 1e-6, 1e-9  # fixed values: added to deviations and to lengths


def whole(df: DataFrame, vector: str, size: int) -> DataFrame:
    return df.where((F.size(vector) == size) & F.forall(vector, lambda x: x.isNotNull()))


def judged(df: DataFrame, columns: list[str], vector: str, size: int, predict: Callable, fields: list[tuple[str, pa.DataType, str]], width: int) -> DataFrame:
    """columns of the rows with whole vectors, and what predict(vectors, last of the columns) returns, some rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(len(columns)).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            labels = batch.column(len(columns) - 1).to_numpy(zero_copy_only=False)
            step = max(1, CELLS // max(1, width))
            for at in range(0, len(x), step):
                part = batch.slice(at, step)
                found = predict(x[at : at + step], labels[at : at + step])
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(columns))), *(pa.array(f, kind, from_pandas=True) for f, (_, kind, _) in zip(found, fields, strict=True))], names=[*columns, *(n for n, *_ in fields)])

    rows = whole(df, vector, size).select(*columns, F.col(vector).cast("array<double>").alias("_v"))
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns), *(f"{n} {sql}" for n, _, sql in fields)])
    return rows.mapInArrow(run, schema)


def class_sums(df: DataFrame, label: str, vector: str, size: int) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Number, sums and sums of products of each label's vectors; few labels, so it fits the driver."""
    rows = moments(df.where(F.col(label).isNotNull()).select(label, vector), [label], vector, size).collect()
    return {r[label]: unfolded(np.frombuffer(bytes(r.sums))) for r in rows}


def left_out(x: np.ndarray, label: np.ndarray, sums: dict[int, tuple[int, np.ndarray, np.ndarray]], shrink: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels 0 or 1 that the others' models give each row: by centroid, by discriminant, by cosine; NaN where a class is empty without the row."""
    (n0, s0, q0), (n1, s1, q1) = sums[0], sums[1]
    own = np.stack([label == 0, label == 1]).astype(float)
    counts = np.stack([n0 - own[0], n1 - own[1]])
    possible = (counts > 0).all(0)
    with np.errstate(invalid="ignore", divide="ignore"):
        means = np.stack([(s - o[:, None] * x) / c[:, None] for s, o, c in zip((s0, s1), own, counts, strict=True)])
        n = n0 + n1 - 1
        mean = (s0 + s1 - x) / n
        variance = np.maximum((np.diag(q0 + q1) - x * x) / n - mean * mean, 0)
        scale = np.sqrt(variance) + EPSILON
        z, (c0, c1) = (x - mean) / scale, (means - mean) / scale
        by_centroid = np.linalg.norm(z - c1, axis=1) < np.linalg.norm(z - c0, axis=1)
        size = x.shape[1]
        if size > 1:
            spread = (q0 + q1 - x[:, :, None] * x[:, None, :] - n * mean[:, :, None] * mean[:, None, :]) / max(1, n - 1) / (scale[:, :, None] * scale[:, None, :])
        else:
            spread = (variance / scale**2)[:, :, None]
        trace = np.trace(spread, axis1=1, axis2=2)
        spread = (1 - shrink) * spread + shrink * np.eye(size) * (trace / size)[:, None, None]
        w = np.linalg.solve(np.where(possible[:, None, None], spread, np.eye(size)), np.where(possible[:, None], c1 - c0, 0.0)[:, :, None])[:, :, 0]
        by_discriminant = ((z - (c0 + c1) / 2) * w).sum(1) > 0
        cosine = [(x * m).sum(1) / (np.linalg.norm(x, axis=1) * np.linalg.norm(m, axis=1) + TINY) for m in means]
    return tuple(np.where(possible, p, np.nan) for p in (by_centroid, by_discriminant, cosine[1] > cosine[0]))


def leave_one_out(df: DataFrame, item: str, label: str, vector: str, size: int, shrink: float = 0.3) -> DataFrame:
    """item, label, by_centroid, by_discriminant and by_cosine: the label (0 or 1) that all other rows' models give each row.

    Centroids and the discriminant are of standardised descriptors. Rows of other labels and vectors that aren't whole
    are left out; a row that is its class's only one gets null.
    """
    rows = df.where(F.col(label).isin(0, 1)).select(item, F.col(label).cast("int").alias(label), vector)
    sums = class_sums(rows, label, vector, size)
    none = 0, np.zeros(size), np.zeros((size, size))
    sums = {k: sums.get(k, none) for k in (0, 1)}
    fields = [(name, pa.int32(), "int") for name in ("by_centroid", "by_discriminant", "by_cosine")]
    return judged(rows, [item, label], vector, size, lambda x, y: left_out(x, y, sums, shrink), fields, 4 * size * size)


def leave_one_out_centroids(df: DataFrame, label: str, item: str, vector: str, size: int) -> DataFrame:
    """item, label, predicted: the label of the nearest class mean, each row's own left out of its class; ties to the smaller.

    Of at most MOST_LABELS labels; more are refused.
    """
    at = F.col(vector)
    sums = whole(df.where(F.col(label).isNotNull()), vector, size).groupBy(label).agg(F.count("*").alias("n"), F.array(*(F.sum(at[i]) for i in range(size))).alias("s")).orderBy(label).limit(MOST_LABELS + 1).collect()
    if len(sums) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    labels, n, s = np.array([r[label] for r in sums]), np.array([r.n for r in sums], float), np.array([r.s for r in sums], float).reshape(-1, size)

    def nearest(x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray]:
        mine = (own[:, None] == labels).astype(float)
        left = n - mine
        with np.errstate(invalid="ignore", divide="ignore"):
            away = (((x[:, None] - (s - mine[:, :, None] * x[:, None]) / left[:, :, None])) ** 2).sum(2)
        away = np.where(left > 0, away, np.inf)
        best = labels[away.argmin(1)]
        return (np.where(np.isfinite(away.min(1)), best, None),)

    kind = df.schema[label].dataType
    return judged(df.where(F.col(label).isNotNull()), [item, label], vector, size, nearest, [("predicted", to_arrow_type(kind), kind.simpleString())], len(labels) * size)


def two_means(df: DataFrame, vector: str, size: int, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two centres of standardised vectors, their means and deviations. Starts from the two sides of the longest axis; only sums of each side reach the driver."""
    rows = whole(df, vector, size).select(F.lit(0).alias("_all"), F.col(vector).alias("_v"))
    n, s, q = class_sums(rows, "_all", "_v", size).get(0, (0, np.zeros(size), np.zeros((size, size))))
    mean = s / max(1, n)
    scale = np.sqrt(np.maximum(np.diag(q) / max(1, n) - mean**2, 0)) + EPSILON
    spread = (q - n * np.outer(mean, mean)) / np.outer(scale, scale)
    axis = np.linalg.eigh(spread)[1][:, -1]
    axis = axis * (1 if axis[np.abs(axis).argmax()] > 0 else -1)
    centres = np.stack([-axis, axis])
    for _ in range(rounds):
        found = side_sums(rows, size, mean, scale, centres)
        new = np.stack([found[k][1] / found[k][0] if found[k][0] else centres[k] for k in (0, 1)])
        if np.allclose(new, centres, atol=1e-12):
            break
        centres = new
    return centres, mean, scale


def nearer(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, centres: np.ndarray) -> np.ndarray:
    z = (x - mean) / scale
    return (np.linalg.norm(z - centres[1], axis=1) < np.linalg.norm(z - centres[0], axis=1)).astype(np.int32)


def side_sums(rows: DataFrame, size: int, mean: np.ndarray, scale: np.ndarray, centres: np.ndarray) -> dict[int, tuple[int, np.ndarray]]:
    """Number and sum of the standardised vectors next to either centre; a task sends one row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(2, np.int64), np.zeros((2, size))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            side, z = nearer(x, mean, scale, centres), (x - mean) / scale
            for k in (0, 1):
                n[k] += int((side == k).sum())
                total[k] += z[side == k].sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(n), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["side", "n", "s"])

    parts = rows.select(F.col("_v").cast("array<double>").alias("v")).mapInArrow(run, "side int, n long, s array<double>")
    summed = parts.groupBy("side").agg(F.sum("n").alias("n"), *(F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(size))).collect()
    out = {0: (0, np.zeros(size)), 1: (0, np.zeros(size))}
    return out | {r.side: (r.n, np.array([r[f"s{i}"] for i in range(size)])) for r in summed}


def accuracies(df: DataFrame, item: str, label: str, vector: str, size: int) -> DataFrame:
    """One row: n, and the share of rows with the right label by centroid, discriminant, cosine and by two clusters, whichever way they are named."""
    rows = df.where(F.col(label).isin(0, 1))
    found = leave_one_out(rows, item, label, vector, size)
    share = lambda c: F.avg((F.col(c) == F.col(label)).cast("int")).alias(c)
    left = found.agg(F.count("*").alias("n"), share("by_centroid"), share("by_discriminant"), share("by_cosine"))
    centres, mean, scale = two_means(rows, vector, size)
    sides = judged(rows.select(item, F.col(label).cast("int").alias(label), vector), [item, label], vector, size, lambda x, _: (nearer(x, mean, scale, centres),), [("side", pa.int32(), "int")], 4 * size)
    agree = sides.agg(F.avg((F.col("side") == F.col(label)).cast("int")).alias("a"))
    named = agree.first().a
    return left.withColumn("by_two_means", F.lit(None if named is None else max(named, 1 - named)).cast("double"))
