"""Which team a player belongs to: centres, discriminants, sides, numbers in a frame. By colours alone: colours.py."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type



def by_element(df: DataFrame, keys: list[str], vector: str, summary: Callable[[str], Column]) -> DataFrame:
    """A summary of each key's vectors, element by element, as one vector."""
    parts = df.select(*keys, F.posexplode(vector).alias("_pos", "_x")).groupBy(*keys, "_pos").agg(summary("_x").alias("_x"))
    placed = F.array_sort(F.collect_list(F.struct("_pos", "_x")))
    return parts.groupBy(*keys).agg(F.transform(placed, lambda p: p["_x"]).alias(vector))


def mean_vectors(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    return by_element(df, keys, vector, F.avg)


def median_vectors(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    return by_element(df, keys, vector, F.median)


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays; null if one is null or holds nulls."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def nearest_centre(df: DataFrame, centres: DataFrame, keys: list[str], vector: str, label: str) -> DataFrame:
    """Each row of df, without its vector, with the label of the nearest of its key's centres (arrays); ties to the smaller label.

    A key has few centres, so they are one array that rows are joined with once. Rows without a vector, or without a
    centre, get null.
    """
    listed = centres.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("l"), F.col(vector).alias("c")))).alias("_c"))
    measured = F.transform("_c", lambda c: F.struct(distance(F.col(vector), c["c"]).alias("d"), c["l"].alias("l")))
    near = df.join(listed, keys, "left").withColumn("_b", F.array_min(F.filter(measured, lambda x: x["d"].isNotNull())))
    return near.select(*(c for c in df.columns if c != vector), F.col("_b.l").alias("predicted"), F.col("_b.d").alias("distance"))


def discriminant(means: list[np.ndarray], covariances: list[np.ndarray], counts: list[int], shrink: float = 0.3) -> tuple[np.ndarray, float]:
    """Weights and bias that separate two classes, from moments; covariances shrink towards their diagonal."""
    pooled = sum((n - 1) * c for n, c in zip(counts, covariances, strict=True)) / max(1, sum(counts) - 2)
    pooled = (1 - shrink) * pooled + shrink * np.diag(np.diag(pooled)) + 1e-9 * np.eye(len(pooled))
    w = np.linalg.solve(pooled, means[1] - means[0])
    return w, float(-w @ (means[0] + means[1]) / 2)


def class_moments(df: DataFrame, label: str, vector: str, size: int) -> dict:
    """For each label the number of vectors, their mean and covariance (of a sample): one pass, sums of a few kilobytes."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for batch in batches:
            labels, x = np.array(batch.column(0).to_pylist(), object), batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            for k in set(labels.tolist()):
                own = np.concatenate([np.ones((int((labels == k).sum()), 1)), x[labels == k]], axis=1)
                total[k] = total.get(k, 0) + own.T @ own
        yield pa.RecordBatch.from_arrays([pa.array(list(total), kind), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["label", "sums"])

    def added(rows: pa.Table) -> pa.Table:
        return pa.table({"label": rows.column("label")[:1], "sums": pa.array([sum(np.frombuffer(b.as_buffer()) for b in rows.column("sums")).tobytes()], pa.binary())})

    whole = df.where(F.col(label).isNotNull() & (F.size(vector) == size) & F.forall(vector, lambda x: x.isNotNull())).select(F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    kind, ddl = to_arrow_type(whole.schema["label"].dataType), f"label {whole.schema['label'].dataType.simpleString()}, sums binary"
    out = {}
    for r in whole.mapInArrow(sums, ddl).groupBy("label").applyInArrow(added, ddl).collect():
        m = np.frombuffer(bytes(r.sums)).reshape(size + 1, size + 1)
        n, mean = int(m[0, 0]), m[0, 1:] / m[0, 0]
        out[r.label] = n, mean, (m[1:, 1:] - n * np.outer(mean, mean)) / max(1, n - 1)
    return out


def covariances(df: DataFrame, label: str, vector: str, size: int) -> DataFrame:
    """Covariances of a sample for all pairs of elements: label, i, j (at least i), n, cov."""
    spark, kind = df.sparkSession, df.schema[label].dataType.simpleString()
    rows = [(k, i, j, n, float(cov[i, j])) for k, (n, _, cov) in class_moments(df, label, vector, size).items() for i in range(size) for j in range(i, size)] if size else []
    return spark.createDataFrame(rows, f"{label} {kind}, i int, j int, n long, cov double")


def train_discriminant(df: DataFrame, label: str, vector: str, size: int, shrink: float = 0.3) -> tuple[np.ndarray, float]:
    """Of the two smallest labels; only moments reach the driver."""
    found = class_moments(df, label, vector, size)
    chosen = [found[k] for k in sorted(found)[:2]]
    return discriminant([mean for _, mean, _ in chosen], [cov for _, _, cov in chosen], [n for n, _, _ in chosen], shrink)


def score_column(vector: Column, weights: np.ndarray, bias: float) -> Column:
    w = F.array(*(F.lit(float(v)) for v in weights))
    return F.aggregate(F.zip_with(vector, w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) + bias


def keeper_side(x: Column, left_team: Column, length: float) -> Column:
    """The goalkeeper's team: who defends the left goal if in the left half, else the other."""
    return F.when(x < length / 2, left_team).otherwise(1 - left_team)


def keeper_samples(df: DataFrame, keys: list[str], frame: str, x: str, value: str, length: float, zone: float, least: int) -> DataFrame:
    """Median value of the outermost players near each goal: keys, side, median; from at least so many frames."""
    ends = df.groupBy(*keys, frame).agg(F.min(F.struct(x, value)).alias("a"), F.max(F.struct(x, value)).alias("b"))
    both = ends.select(*keys, F.inline(F.array(F.struct(F.lit("left").alias("side"), F.col(f"a.{x}").alias("x"), F.col(f"a.{value}").alias("v")), F.struct(F.lit("right").alias("side"), F.col(f"b.{x}").alias("x"), F.col(f"b.{value}").alias("v")))))
    near = both.where(((F.col("side") == "left") & (F.col("x") < zone)) | ((F.col("side") == "right") & (F.col("x") > length - zone)))
    return near.groupBy(*keys, "side").agg(F.count("*").alias("n"), F.median("v").alias("median")).where(F.col("n") >= least)


def balanced(df: DataFrame, frame_keys: list[str], team: str, score: str, size: int, ties: list[str] | None = None) -> DataFrame:
    """Players changed to the other team where one has more than size and the other less, those that fit least first.

    ties: columns that decide among equal scores; without them any of these may change.
    """
    counts = Window.partitionBy(*frame_keys)
    n = [F.sum((F.col(team) == i).cast("int")).over(counts) for i in (0, 1)]
    rows = df.withColumn("_n0", n[0]).withColumn("_n1", n[1])
    big = F.when(F.col("_n1") > F.col("_n0"), 1).otherwise(0)
    k = F.least(F.greatest("_n0", "_n1") - size, size - F.least("_n0", "_n1"))
    rows = rows.withColumn("_big", big).withColumn("_k", k)
    rank = F.row_number().over(Window.partitionBy(*frame_keys, team).orderBy(score, *(ties or [])))
    moved = (F.col(team) == F.col("_big")) & (rank <= F.col("_k"))
    return rows.withColumn("balanced", F.when(moved, 1 - F.col(team)).otherwise(F.col(team))).drop("_n0", "_n1", "_big", "_k")
