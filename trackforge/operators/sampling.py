"""Reproducible choices of rows: by a hash of their id and a seed, spaced, stratified, or regular."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackforge.operators import islands, nearest


def draw(item: str, seed: int) -> Column:
    """A number for each id and seed; ordering by it is a permutation."""
    return F.crc32(F.concat(F.col(item).cast("string"), F.lit(f":{seed}")).cast("binary"))


def spaced_sample(df: DataFrame, keys: list[str], item: str, t: str, apart: int, most: int, seed: int) -> DataFrame:
    """At most so many rows of each key in random order, no two nearer than apart in time."""
    return islands.spaced_by_rank(df, keys, t, [draw(item, seed), F.col(item)], apart, most)


def one_per_stratum(df: DataFrame, keys: list[str], stratum: str, item: str, most: int, seed: int) -> DataFrame:
    """Rows taken from the strata in turn: the first of each, then the second, until there are most."""
    r = draw(item, seed)
    turn = df.withColumn("turn", F.row_number().over(Window.partitionBy(*keys, stratum).orderBy(r, item)))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("turn", draw(stratum, seed), stratum))
    return turn.withColumn("place", place).where(F.col("place") <= most)


def evenly(df: DataFrame, keys: list[str], order: str, most: int) -> DataFrame:
    """Rows at evenly spaced places from the first to the last."""
    w = Window.partitionBy(*keys)
    n, i = F.count("*").over(w), F.row_number().over(w.orderBy(order)) - 1
    rows = df.withColumn("_n", n).withColumn("_i", i)
    k = F.explode(F.sequence(F.lit(0), F.lit(most - 1)))
    wanted = rows.groupBy(*keys).agg(F.max("_n").alias("_n")).select(*keys, F.col("_n").alias("_m"), k.alias("_k"))
    wanted = wanted.select(*keys, F.floor(F.col("_k") * (F.col("_m") - 1) / (most - 1)).alias("_i")).distinct()
    return rows.join(wanted, [*keys, "_i"]).drop("_n", "_i")


def regular(spans: DataFrame, start: str, end: str, step: int, name: str) -> DataFrame:
    """A row every step from start, end excluded."""
    return spans.where(F.col(end) > F.col(start)).withColumn(name, F.explode(F.sequence(F.col(start), F.col(end) - 1, F.lit(step))))


def away_from(df: DataFrame, events: DataFrame, keys: list[str], item: str, t: str, apart: int, most: int, seed: int) -> DataFrame:
    """Random rows that are not within apart of any event."""
    free = nearest.near_events(df, events, keys, t, apart)
    w = Window.partitionBy(*keys).orderBy(draw(item, seed), item)
    return free.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def busy_windows(df: DataFrame, keys: list[str], t: str, width: int, known: Column, playing: Column, least_known: float, least_playing: float) -> DataFrame:
    """Windows of fixed width on a regular grid with enough known and enough playing rows."""
    w = df.groupBy(*keys, (F.floor(F.col(t) / width) * width).alias("t0")).agg(F.count("*").alias("n"), F.avg(known.cast("int")).alias("known"), F.avg(playing.cast("int")).alias("playing"))
    return w.where((F.col("known") >= least_known) & (F.col("playing") >= least_playing))
