"""Runs of rows in time order: by gaps, by constant labels, with bridging, and greedy choices among them.

keys partition the rows (match and half as a rule), so every operator is one shuffle by keys and one sort; chained
operators with the same keys share it. Times are integer milliseconds.
"""

from __future__ import annotations

import bisect

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackforge.operators.grouping import walked


def ordered(keys: list[str], *order: str):
    return Window.partitionBy(*keys).orderBy(*order)


def numbered(df: DataFrame, keys: list[str], order: list[str], breaks: Column, name: str = "run") -> DataFrame:
    """Adds the number of the run: how often breaks was true from the first row of the keys up to this one."""
    window = ordered(keys, *order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(F.when(breaks, 1).otherwise(0)).over(window))


def changed(column: Column, window) -> Column:
    """The value differs from the row before; true for the first row. Nulls are equal to each other."""
    return (F.row_number().over(window) == 1) | ~column.eqNullSafe(F.lag(column).over(window))


def gap_sessions(df: DataFrame, keys: list[str], t: str, gap_ms: int, *, extra: list[Column] | None = None) -> DataFrame:
    """Sessions of rows no more than gap_ms apart: keys, t0, t1, n and extra aggregates."""
    window = ordered(keys, t)
    parted = F.coalesce(F.col(t) - F.lag(t).over(window) > gap_ms, F.lit(True))
    runs = numbered(df.withColumn("_new", parted), keys, [t], F.col("_new"))
    return runs.groupBy(*keys, "run").agg(F.min(t).alias("t0"), F.max(t).alias("t1"), F.count("*").alias("n"), *(extra or [])).drop("run")


def constant_runs(df: DataFrame, keys: list[str], order: str, t: str, labels: list[str], gap_ms: int | None = None) -> DataFrame:
    """Maximal runs of equal labels (and, with gap_ms, of smaller steps in time): keys, labels, t0, t1, n."""
    window = ordered(keys, order)
    new = F.lit(False)
    for label in labels:
        new = new | changed(F.col(label), window)
    if gap_ms is not None:
        new = new | (F.col(t) - F.lag(t).over(window) >= gap_ms)
    runs = numbered(df.withColumn("_new", F.coalesce(new, F.lit(True))), keys, [order], F.col("_new"))
    return runs.groupBy(*keys, "run", *labels).agg(F.min(t).alias("t0"), F.max(t).alias("t1"), F.count("*").alias("n")).drop("run")


def outside_runs(df: DataFrame, keys: list[str], order: str, t: str, state: Column, least_ms: int, ended: str | None = None) -> DataFrame:
    """Runs outside: from a row whose state is "o" over rows that are outside or unseen (null) to the next one inside.

    A run ends at the time of the first row inside, else at the last row of its keys, and counts if it lasts least_ms.
    ended: adds a column of that name, whether there was a row inside, which isn't part of the run itself.
    """
    window = ordered(keys, order)
    upto = window.rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("_s", F.last(state, ignorenulls=True).over(upto)).withColumn("_next", F.lead(t).over(window))
    rows = rows.withColumn("_new", (F.col("_s") == "o") & ~F.coalesce(F.lag("_s").over(window) == "o", F.lit(False)))
    runs = numbered(rows, keys, [order], F.col("_new")).where(F.col("_s") == "o")
    last = [F.max_by("_next", order).isNotNull().alias(ended)] if ended else []
    runs = runs.groupBy(*keys, "run").agg(F.min(t).alias("t0"), F.coalesce(F.max_by("_next", order), F.max(t)).alias("t1"), F.count("*").alias("n"), *last)
    return runs.where(F.col("t1") - F.col("t0") >= least_ms).drop("run")


def possession_sequences(df: DataFrame, keys: list[str], order: str, t: str, team: str, least_ms: int, bridge_ms: int) -> DataFrame:
    """Possessions of one team: keys, team, t0, t1, start (order of the first row).

    Raw runs end at another team or none. Runs shorter than least_ms are dropped; two kept runs of a team are joined
    only across dropped runs when every pause between neighbouring raw runs is at most bridge_ms.
    """
    rows = df.withColumn("_new", F.col(team).isNotNull() & changed(F.col(team), ordered(keys, order)))
    raw = numbered(rows, keys, [order], F.col("_new")).where(F.col(team).isNotNull())
    raw = raw.groupBy(*keys, "run").agg(F.first(team).alias(team), F.min(t).alias("t0"), F.max(t).alias("t1"), F.min(order).alias("start"))
    by_run = ordered(keys, "run")
    raw = raw.withColumn("_far", F.coalesce(F.col("t0") - F.lag("t1").over(by_run) > bridge_ms, F.lit(True)))
    raw = numbered(raw, keys, ["run"], F.col("_far"), "chain").where(F.col("t1") - F.col("t0") >= least_ms)
    raw = raw.withColumn("_new", changed(F.col("chain"), by_run) | changed(F.col(team), by_run))
    raw = numbered(raw, keys, ["run"], F.col("_new"), "sequence")
    return raw.groupBy(*keys, "sequence").agg(F.first(team).alias(team), F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.min("start").alias("start")).drop("sequence")


def recoveries(sequences: DataFrame, keys: list[str], team: str, within_ms: int) -> DataFrame:
    """Sequences that begin less than within_ms after one of the other team."""
    window = ordered(keys, "t0", "start")
    before = sequences.withColumn("_team", F.lag(team).over(window)).withColumn("_t1", F.lag("t1").over(window))
    return before.where((F.col("_team") != F.col(team)) & (F.col("t0") - F.col("_t1") < within_ms)).drop("_team", "_t1")


def control_segments(df: DataFrame, keys: list[str], order: str, t: str, team: str, bridge_ms: int, least_ms: int) -> DataFrame:
    """Runs of control by a team; rows without control are bridged up to bridge_ms after the last controlled row."""
    window = ordered(keys, order)
    held = df.withColumn("_before", F.lag(t).over(window)).where(F.col(team).isin(0, 1))
    new = changed(F.col(team), window) | F.coalesce(F.col("_before") - F.lag(t).over(window) > bridge_ms, F.lit(False))
    runs = numbered(held.withColumn("_new", new), keys, [order], F.col("_new"))
    runs = runs.groupBy(*keys, "run").agg(F.first(team).alias(team), F.min(t).alias("t0"), F.max(t).alias("t1"), F.min(order).alias("i0"), F.max(order).alias("i1"))
    return runs.where(F.col("t1") - F.col("t0") >= least_ms).drop("run")


def touches(df: DataFrame, keys: list[str], order: str, t: str, player: str, gap_ms: int) -> DataFrame:
    """Runs of neighbouring rows with the same player (not null), steps shorter than gap_ms."""
    return constant_runs(df, keys, order, t, [player], gap_ms).where(F.col(player).isNotNull())


def reappearances(df: DataFrame, keys: list[str], t: str, seen: Column, least_ms: int) -> DataFrame:
    """Rows that are seen again at least least_ms after the seen row before: keys, t, away_ms."""
    rows = df.where(seen).withColumn("away_ms", F.col(t) - F.lag(t).over(ordered(keys, t)))
    return rows.where(F.col("away_ms") >= least_ms).select(*keys, t, "away_ms")


def merged_sessions(sessions: DataFrame, keys: list[str], gap_ms: int) -> DataFrame:
    """Sessions (t0, t1) that begin less than gap_ms after the end of the one before become one."""
    window = ordered(keys, "t0")
    far = F.coalesce(F.col("t0") - F.lag("t1").over(window) >= gap_ms, F.lit(True))
    runs = numbered(sessions.withColumn("_new", far), keys, ["t0"], F.col("_new"))
    return runs.groupBy(*keys, "run").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.sum("n").alias("n"), F.count("*").alias("parts")).drop("run")


def anchored_merge(df: DataFrame, keys: list[str], t: str, within_ms: int) -> DataFrame:
    """Events merged into the first of their group while less than within_ms after that first: keys, t, n."""

    def run(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        times, firsts = rows[t], [0]
        while (after := int(np.searchsorted(times, times[firsts[-1]] + within_ms))) < len(times):
            firsts.append(after)
        return {t: times[firsts], "n": np.diff([*firsts, len(times)])}

    return walked(df.select(*keys, t).where(F.col(t).isNotNull()), keys, [t], run, [(t, df.schema[t].dataType), ("n", T.LongType())])


def spaced(df: DataFrame, keys: list[str], t: str, apart_ms: int) -> DataFrame:
    """Greedy choice in time order: an event is kept if the kept one before is at least apart_ms away."""
    return anchored_merge(df, keys, t, apart_ms).drop("n")


def spaced_by_rank(df: DataFrame, keys: list[str], t: str, rank: list[Column], apart_ms: int, most: int | None = None) -> DataFrame:
    """Greedy choice by rank: an event is kept if no kept one is nearer than apart_ms in time."""
    places = [f"r{i}" for i in range(len(rank))]

    def run(rows: dict[str, np.ndarray]) -> dict[str, list]:
        kept, chosen = [], []
        for x in rows[t].tolist():
            at = bisect.bisect_left(kept, x)
            if all(abs(y - x) >= apart_ms for y in kept[max(0, at - 1) : at + 1]):
                kept.insert(at, x)
                chosen.append(x)
                if len(chosen) == most:
                    break
        return {t: chosen}

    ranked = df.select(*keys, *(c.alias(n) for c, n in zip(rank, places, strict=True)), t)
    return walked(ranked, keys, [*(F.col(n).asc_nulls_last() for n in places), t], run, [(t, df.schema[t].dataType)])


def half_starts(df: DataFrame, keys: list[str], t: str, window_ms: int) -> DataFrame:
    """Adds start: the first event of its keys, or less than window_ms after it."""
    return df.withColumn("start", F.col(t) - F.min(t).over(Window.partitionBy(*keys)) < window_ms)


def last_stay(df: DataFrame, keys: list[str], t: str, gap_ms: int) -> DataFrame:
    """The last session of each key: keys, t0, t1, n."""
    stays = gap_sessions(df, keys, t, gap_ms)
    return stays.groupBy(*keys).agg(F.max_by(F.struct("t0", "t1", "n"), "t1").alias("s")).select(*keys, "s.t0", "s.t1", "s.n")


def steady_episodes(df: DataFrame, keys: list[str], t: str, x: str, y: str, gap_ms: int, least_ms: int, spread: float) -> DataFrame:
    """Sessions of at least least_ms in which every position lies within spread of the median position."""
    window = ordered(keys, t)
    far = F.coalesce(F.col(t) - F.lag(t).over(window) > gap_ms, F.lit(True))
    runs = numbered(df.withColumn("_new", far), keys, [t], F.col("_new"))
    whole = Window.partitionBy(*keys, "run")
    off = F.hypot(F.col(x) - F.median(x).over(whole), F.col(y) - F.median(y).over(whole))
    found = runs.withColumn("_off", off).groupBy(*keys, "run").agg(F.min(t).alias("t0"), F.max(t).alias("t1"), F.count("*").alias("n"), F.max("_off").alias("_off"))
    return found.where((F.col("t1") - F.col("t0") >= least_ms) & (F.col("_off") <= spread)).drop("run", "_off")


def violated_side(df: DataFrame, keys: list[str], order: str, t: str, x: str, y: str, out: Column, length: float, width: float) -> DataFrame:
    """Runs of out rows with the line that is crossed farthest: 0 left, 1 right, 2 at y = 0, 3 at y = width; ties to the first."""
    runs = numbered(df.withColumn("_out", out).withColumn("_new", changed(out, ordered(keys, order))), keys, [order], F.col("_new")).where("_out")
    over = [-F.col(x), F.col(x) - length, -F.col(y), F.col(y) - width]
    runs = runs.groupBy(*keys, "run").agg(F.min(t).alias("t0"), F.max(t).alias("t1"), F.count("*").alias("n"), *(F.max(c).alias(f"_v{i}") for i, c in enumerate(over)))
    most = F.greatest(*(F.col(f"_v{i}") for i in range(4)))
    side = F.when(F.col("_v0") == most, 0).when(F.col("_v1") == most, 1).when(F.col("_v2") == most, 2).when(F.col("_v3") == most, 3)
    return runs.select(*keys, "t0", "t1", "n", side.alias("side"))


def hard_gaps(df: DataFrame, keys: list[str], t: str, x: str, y: str, least_ms: int, most_ms: int) -> DataFrame:
    """Gaps between neighbouring rows with a score of length and speed: keys, t (middle), gap_ms, score."""
    window = ordered(keys, t)
    gap = F.col(t) - F.lag(t).over(window)
    speed = F.hypot(F.col(x) - F.lag(x).over(window), F.col(y) - F.lag(y).over(window)) / (gap / 1000)
    rows = df.select(*keys, F.col(t).alias("_t"), gap.alias("gap_ms"), speed.alias("speed")).where(F.col("gap_ms").between(least_ms, most_ms))
    return rows.select(*keys, F.floor(F.col("_t") - F.col("gap_ms") / 2).alias(t), "gap_ms", (F.col("gap_ms") / 1000 * (1 + F.col("speed") / 5)).alias("score"))


def smoothed_counts(df: DataFrame, keys: list[str], t: str, count: str, smooth: int) -> DataFrame:
    """Adds _m: the median of the count over smooth rows around each."""
    around = ordered(keys, t).rowsBetween(-(smooth // 2), smooth // 2)
    return df.withColumn("_m", F.percentile(count, F.lit(0.5)).over(around))


def split_at_dip(spans: DataFrame, counts: DataFrame, keys: list[str], t: str, over_ms: int, near_ms: int) -> DataFrame:
    """The only span of its keys, if longer than over_ms, becomes two: up to the dip of the count and after it.

    The dip is the lowest smoothed count in the middle two fifths, the first of equal ones; around it goes what lies less
    than near_ms away and is at most one higher. spans: t0, t1; counts: t, _m.
    """
    alone = spans.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).where((F.col("_n") == 1) & (F.col("t1") - F.col("t0") > over_ms)).select(*keys, "t0", "t1")
    rows = counts.join(alone, keys).where(F.col(t).between(F.col("t0"), F.col("t1")))
    length = F.col("t1") - F.col("t0")
    middle = F.col(t).between(F.col("t0") + 0.3 * length, F.col("t0") + 0.7 * length)
    dip = F.min(F.when(middle, F.struct("_m", F.col(t).alias("t")))).over(Window.partitionBy(*keys))
    low = rows.withColumn("_d", dip).where((F.abs(F.col(t) - F.col("_d.t")) < near_ms) & (F.col("_m") <= F.col("_d._m") + 1))
    cuts = low.groupBy(*keys, "t0", "t1").agg(F.min(t).alias("lo"), F.max(t).alias("hi"))
    halves = cuts.select(*keys, F.inline(F.array(F.struct("t0", F.col("lo").alias("t1")), F.struct(F.col("hi").alias("t0"), "t1"))))
    return spans.select(*keys, "t0", "t1").join(cuts.select(*keys), keys, "left_anti").unionByName(halves)


def playing_spans(df: DataFrame, keys: list[str], t: str, count: str, least_count: float, smooth: int, gap_ms: int, least_ms: int, step_ms: int, most: int, split_near_ms: int | None = None) -> DataFrame:
    """The longest spans in which the smoothed count is high: short pauses are bridged, short spans dropped.

    Each span is widened by one step at both ends, from time 0 at the earliest, and numbered in time order as half. With
    split_near_ms, one span of over eight times least_ms that is alone where two are wanted is split at its dip.
    """
    counts = smoothed_counts(df, keys, t, count, smooth)
    spans = gap_sessions(counts.where(F.col("_m") >= least_count), keys, t, gap_ms).where(F.col("t1") - F.col("t0") + step_ms >= least_ms)
    by_length = Window.partitionBy(*keys).orderBy((F.col("t0") - F.col("t1")), "t0")
    longest = spans.withColumn("_r", F.row_number().over(by_length)).where(F.col("_r") <= most).select(*keys, "t0", "t1")
    if split_near_ms is not None and most == 2:
        longest = split_at_dip(longest, counts, keys, t, 8 * least_ms, split_near_ms)
    return longest.select(*keys, F.row_number().over(ordered(keys, "t0")).alias("half"), F.greatest(F.lit(0), F.col("t0") - step_ms).alias("t0"), (F.col("t1") + step_ms).alias("t1"))
