"""Moving measures over rows and time, and filling of gaps. t is in integer milliseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def over_rows(keys: list[str], order: str, before: int, after: int):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(-before, after)


def over_time(keys: list[str], t: str, before: int, after: int):
    return Window.partitionBy(*keys).orderBy(t).rangeBetween(-before, after)


def moving_share(df: DataFrame, keys: list[str], t: str, flag: Column, counted: Column, width_ms: int, step_ms: int) -> DataFrame:
    """Share of flag among counted rows in (g - width, g] at every g of a grid that starts at each key's first row.

    Every row goes to the few grid points whose window holds it, so a grid costs width / step rows for each row.
    """
    first = df.groupBy(*keys).agg(F.min(t).alias("_first"), F.max(t).alias("_last"))
    rows = df.where(counted).select(*keys, t, flag.cast("int").alias("_f")).join(first, keys)
    low = F.ceil((F.col(t) - F.col("_first")) / step_ms)
    high = F.floor((F.col(t) - F.col("_first") + width_ms - 1) / step_ms)
    points = rows.where(high >= low).withColumn("_g", F.explode(F.sequence(low, high))).withColumn("g", F.col("_first") + F.col("_g") * step_ms)
    return points.where(F.col("g") <= F.col("_last")).groupBy(*keys, "g").agg(F.avg("_f").alias("share"), F.count("*").alias("n"))


def trailing_share(df: DataFrame, keys: list[str], order: str, flag: Column, counted: Column, rows: int, default: float = 0.5) -> DataFrame:
    w = over_rows(keys, order, rows - 1, 0)
    n = F.sum(counted.cast("int")).over(w)
    return df.withColumn("share", F.when(n > 0, F.sum((flag & counted).cast("int")).over(w) / n).otherwise(default))


def rolling_median(df: DataFrame, keys: list[str], order: str, value: str, rows: int) -> DataFrame:
    return df.withColumn("median", F.percentile(value, F.lit(0.5)).over(over_rows(keys, order, rows // 2, rows // 2)))


def fitted_speed(df: DataFrame, keys: list[str], order: str, t: str, x: str, y: str, rows: int = 4, least: int = 5) -> DataFrame:
    """Adds speed: slope of straight lines through the known positions of the rows around, null for too few."""
    w = over_rows(keys, order, rows, rows)
    seconds = F.col(t) / 1000
    known = F.count(x).over(w)
    slope = F.hypot(F.regr_slope(F.col(x), seconds).over(w), F.regr_slope(F.col(y), seconds).over(w))
    return df.withColumn("speed", F.when(known >= least, slope))


def trailing_displacement(df: DataFrame, keys: list[str], t: str, x: str, y: str, before_ms: int) -> DataFrame:
    """Adds moved: the farthest position of the last before_ms from the present one."""
    past = F.collect_list(F.struct(F.col(x).alias("x"), F.col(y).alias("y"))).over(over_time(keys, t, before_ms, 0))
    return df.withColumn("moved", F.array_max(F.transform(past, lambda p: F.hypot(p["x"] - F.col(x), p["y"] - F.col(y)))))


def smoothed_label(df: DataFrame, keys: list[str], t: str, label: str, around_ms: int, least: int) -> DataFrame:
    """Adds smooth: the majority of labels 0 and 1 around, from the labels as given; ties and short chains keep their own."""
    w = over_time(keys, t, around_ms, around_ms)
    ones, n = F.sum(label).over(w), F.count(label).over(w)
    chain = F.count("*").over(Window.partitionBy(*keys))
    return df.withColumn("smooth", F.when(chain < least, F.col(label)).when(2 * ones > n, 1).when(2 * ones < n, 0).otherwise(F.col(label)))


def steps(df: DataFrame, keys: list[str], order: str, t: str, x: str, y: str) -> DataFrame:
    """Adds step (distance from the row before) and pace (per second)."""
    w = Window.partitionBy(*keys).orderBy(order)
    step = F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w))
    dt = (F.col(t) - F.lag(t).over(w)) / 1000
    return df.withColumn("step", step).withColumn("pace", F.when(dt > 0, step / dt))


def shake(df: DataFrame, keys: list[str], order: str, value: str, rows: int) -> DataFrame:
    """Adds peak (largest value around) and residue (distance from the mean around)."""
    w = over_rows(keys, order, rows, rows)
    return df.withColumn("peak", F.max(value).over(w)).withColumn("residue", F.abs(F.col(value) - F.avg(value).over(w)))


def dilated(df: DataFrame, keys: list[str], order: str, bad: Column, rows: int) -> DataFrame:
    """Adds valid: no bad row within rows rows."""
    return df.withColumn("valid", ~F.coalesce(F.max(F.coalesce(bad, F.lit(False))).over(over_rows(keys, order, rows, rows)), F.lit(False)))


def decayed_centres(df: DataFrame, keys: list[str], t: str, values: list[str], step_ms: int, scale_ms: int, reach: int) -> DataFrame:
    """Means weighted by exp(-|dt| / scale) at the middle of every step, over samples at most reach steps away."""
    steps_at = df.groupBy(*keys).agg(F.min(F.floor(F.col(t) / step_ms)).alias("_a"), F.max(F.floor(F.col(t) / step_ms)).alias("_b"))
    rows = df.join(steps_at, keys).withColumn("_s", F.floor(F.col(t) / step_ms))
    rows = rows.withColumn("s", F.explode(F.sequence(F.greatest("_a", F.col("_s") - reach), F.least("_b", F.col("_s") + reach))))
    w = F.exp(-F.abs(F.col(t) - (F.col("s") * step_ms + step_ms / 2)) / scale_ms)
    return rows.withColumn("_w", w).groupBy(*keys, "s").agg(*((F.sum(F.col("_w") * F.col(v)) / F.sum("_w")).alias(v) for v in values))


def filled(df: DataFrame, keys: list[str], order: str, t: str, columns: list[str], most_ms: int | None) -> DataFrame:
    """Positions interpolated between the known rows around, if at most most_ms apart; adds source. No extrapolation."""
    df = df.withColumn("_known", F.col(columns[0]).isNotNull())
    known = F.col("_known")
    w = Window.partitionBy(*keys).orderBy(order)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    point = F.when(known, F.struct(F.col(t).alias("t"), *columns))
    rows = df.withColumn("_a", F.last(point, ignorenulls=True).over(back)).withColumn("_b", F.first(point, ignorenulls=True).over(ahead))
    gap = F.col("_b.t") - F.col("_a.t")
    usable = ~known & (gap > 0) if most_ms is None else ~known & (gap > 0) & (gap <= most_ms)
    part = (F.col(t) - F.col("_a.t")) / gap
    for c in columns:
        rows = rows.withColumn(c, F.when(usable, F.col(f"_a.{c}") + part * (F.col(f"_b.{c}") - F.col(f"_a.{c}"))).otherwise(F.col(c)))
    return rows.withColumn("source", F.when(known, "detected").when(usable, "interpolated")).drop("_a", "_b", "_known")


def regular_grid(df: DataFrame, keys: list[str], t: str, columns: list[str], step_ms: int, most_ms: int) -> DataFrame:
    """Rows every step_ms from each key's first to its last, interpolated; valid where the rows around are near enough.

    Each row fills the grid up to the next one, so no join is needed.
    """
    w = Window.partitionBy(*keys).orderBy(t)
    first = F.min(t).over(Window.partitionBy(*keys))
    rows = df.withColumn("_n", F.lead(t).over(w)).withColumn("_first", first)
    for c in columns:
        rows = rows.withColumn(f"_{c}", F.lead(c).over(w))
    low = F.ceil((F.col(t) - F.col("_first")) / step_ms)
    high = F.ceil((F.coalesce("_n", F.col(t) + 1) - F.col("_first")) / step_ms) - 1
    rows = rows.where(high >= low).withColumn("_k", F.explode(F.sequence(low, high))).withColumn("g", F.col("_first") + F.col("_k") * step_ms)
    part = F.coalesce((F.col("g") - F.col(t)) / (F.col("_n") - F.col(t)), F.lit(0.0))
    values = [(F.col(c) + part * (F.coalesce(f"_{c}", c) - F.col(c))).alias(c) for c in columns]
    near = (F.col("g") == F.col(t)) | F.coalesce(F.col("_n") - F.col(t) <= most_ms, F.lit(True))
    return rows.select(*keys, "g", *values, near.alias("valid"), (F.col("g") == F.col(t)).alias("detected"))


def cumulative_timeline(df: DataFrame, keys: list[str], t: str, flag: Column, counted: Column, width_ms: int, step_ms: int) -> DataFrame:
    """Share of flag in [g - width, g) on a grid from width on, as differences of cumulative counts from each key's start."""
    first = Window.partitionBy(*keys)
    rows = df.where(counted).select(*keys, t, flag.cast("int").alias("_f")).withColumn("_r", F.col(t) - F.min(t).over(first)).withColumn("_l", F.max("_r").over(first))
    low, high = F.greatest(F.floor(F.col("_r") / step_ms) + 1, F.lit(width_ms // step_ms)), F.floor((F.col("_r") + width_ms) / step_ms)
    points = rows.where(high >= low).withColumn("_g", F.explode(F.sequence(low, high))).withColumn("g", F.col("_g") * step_ms)
    return points.where(F.col("g") <= F.col("_l")).groupBy(*keys, "g").agg(F.avg("_f").alias("share"), F.count("*").alias("n"))
