"""Kick-offs: by the ball lying on the centre spot, or by the formation of both teams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackforge.operators import islands
from trackforge.operators.nearest import asof, chamfer
from trackforge.operators.windows import trailing_displacement
from trackforge.params import Pitch


def ball_on_spot(ball: DataFrame, keys: list[str], t: str, pitch: Pitch, radius: float = 1.5, still: float = 0.8, still_ms: int = 800) -> DataFrame:
    """Rows of the ball within radius of the centre spot that has moved at most still in the last still_ms."""
    moved = trailing_displacement(ball.where(F.col("x").isNotNull()), keys, t, "x", "y", still_ms)
    return moved.where((F.hypot(F.col("x") - pitch.length / 2, F.col("y") - pitch.width / 2) <= radius) & (F.col("moved") <= still))


def formation_frames(players: DataFrame, keys: list[str], pitch: Pitch, line: float = 0.5, least_side: int = 3, most_centre: int = 2, most_difference: int = 3, least_players: int = 8) -> DataFrame:
    """Frames (keys) in which both teams stand in their halves with at most most_centre players in the circle."""
    middle = pitch.length / 2
    centre = F.hypot(F.col("x") - middle, F.col("y") - pitch.width / 2) < pitch.centre_radius
    left, right = F.count_if(~centre & (F.col("x") < middle)), F.count_if(~centre & (F.col("x") > middle))
    on_line = F.count_if(~centre & (F.abs(F.col("x") - middle) < line))
    f = players.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(centre).alias("centre"), left.alias("l"), right.alias("r"), on_line.alias("on_line"))
    return f.where((F.col("n") >= least_players) & (F.col("centre") <= most_centre) & (F.col("on_line") == 0) & (F.col("l") >= least_side) & (F.col("r") >= least_side) & (F.abs(F.col("l") - F.col("r")) <= most_difference))


def two_sides(players: DataFrame, keys: list[str], pitch: Pitch, line: float = 0.5, least_side: int = 3, most_difference: int = 3, least_players: int = 8) -> DataFrame:
    """Frames (keys) in which both halves are about equally full, wherever the players stand in them."""
    left, right = F.count_if(F.col("x") < pitch.length / 2 - line), F.count_if(F.col("x") > pitch.length / 2 + line)
    f = players.groupBy(*keys).agg(left.alias("l"), right.alias("r"))
    return f.where((F.col("l") + F.col("r") >= least_players) & (F.least("l", "r") >= least_side) & (F.abs(F.col("l") - F.col("r")) <= most_difference))


def calm(formed: DataFrame, players: DataFrame, keys: list[str], t: str, most: float = 0.8, before_ms: int = 1000) -> DataFrame:
    """Formation frames whose players stand where those of the first frame at most before_ms earlier stand, if that is a formation too.

    formed: t of formation frames; players: t, x, y. The median distance to the nearest of the earlier frame counts.
    """
    times = players.select(*keys, t).distinct()
    earlier = asof(formed.select(*keys, (F.col(t) - before_ms).alias(t), F.col(t).alias("_now")), times.withColumn("_then", F.col(t)), keys, t, ["_then"], forward=True)
    pairs = earlier.select(*keys, F.col("_now").alias(t), "_then").where(F.col("_then") < F.col(t))
    pairs = pairs.join(formed.select(*keys, F.col(t).alias("_then")), [*keys, "_then"], "left_semi")
    here = players.join(pairs, [*keys, t]).select(*keys, F.col(t).alias("_pair"), F.lit(True).alias("_from"), "x", "y")
    there = players.withColumnRenamed(t, "_then").join(pairs, [*keys, "_then"]).select(*keys, F.col(t).alias("_pair"), F.lit(False).alias("_from"), "x", "y")
    moved = chamfer(here.union(there), keys, "x", "y", F.when(F.col("_from"), F.col("_pair")), F.when(~F.col("_from"), F.col("_pair")), t)
    return formed.join(moved.where(F.col("calm") <= most).select(*keys, t), [*keys, t], "left_semi")


def events(marks: DataFrame, keys: list[str], t: str, gap_ms: int = 1000, ball_ms: int = 500, formation_ms: int = 1000) -> DataFrame:
    """Kick-offs from marked frames (t, by_ball): sessions that last long enough; their time is the mean of the frames'."""
    found = islands.gap_sessions(marks, keys, t, gap_ms, extra=[F.avg(t).alias("at"), F.bool_or("by_ball").alias("by_ball")])
    return found.where(F.col("t1") - F.col("t0") >= F.when(F.col("by_ball"), ball_ms).otherwise(formation_ms))


def crowd(episodes_rows: DataFrame, keys: list[str], frame: str, radii: tuple[float, ...]) -> DataFrame:
    """For each episode the median number of people within radii of the ball, and the number of frames.

    Rows: keys name the episode; frame; d: a person's distance to the ball.
    """
    per_frame = episodes_rows.groupBy(*keys, frame).agg(*(F.count_if(F.col("d") <= r).alias(f"w{i}") for i, r in enumerate(radii)))
    return per_frame.groupBy(*keys).agg(F.count("*").alias("frames"), *(F.median(f"w{i}").alias(f"within_{i}") for i in range(len(radii))))


def control_summary(controls: DataFrame, frames_near: Column) -> DataFrame:
    """Shares of random control moments with at least one, three and six raw ball frames, and the most."""
    shares = [F.avg((frames_near >= k).cast("int")).alias(f"at_least_{k}") for k in (1, 3, 6)]
    return controls.agg(F.count("*").alias("controls"), *shares, F.max(frames_near).alias("most"))


def restart_windows(goals: DataFrame, stays: DataFrame, keys: list[str], from_ms: int = 3000, to_ms: int = 90_000, early_ms: int = 2000, late_ms: int = 40_000) -> DataFrame:
    """From each goal to the first stay of the ball at the centre in reach, else a default window: keys, start, end, kickoff_found.

    goals: t; stays: t0.
    """
    from trackforge.operators.nearest import first_in_interval

    g = goals.select(*keys, F.col("t").alias("goal"), (F.col("t") + from_ms).alias("a"), (F.col("t") + to_ms).alias("b"))
    found = first_in_interval(stays.select(*keys, F.col("t0").alias("t")), g, keys, "t", "a", "b", to_ms, "goal")
    seen = F.col("found").isNotNull()
    return found.select(*keys, "goal", (F.col("goal") - early_ms).alias("start"), F.coalesce("found", F.col("goal") + late_ms).alias("end"), seen.alias("kickoff_found"))


def first_of_half(df: DataFrame, keys: list[str], t: str) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(t)) == 1
