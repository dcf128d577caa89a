"""Teams learnt from kick-offs, where each team stands in its own half.

The players on the two sides at a kick-off are labelled examples of both teams. Teams change ends between halves, so
what is learnt are first the sides of each half, then which side of one half is which of the other. Two ways to tell
the others: the nearer of two colours that change with the light in the course of the match, or a discriminant of
descriptors. All matches go through together; a model is a row for each match. Times are milliseconds, positions metres.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackforge.operators.grouping import grouped
from trackforge.operators.moments import added, moments, unfolded
from trackforge.operators.nearest import interval_join
from trackforge.operators.sampling import evenly
from trackforge.operators.teams import distance, mean_vectors, median_vectors, nearest_centre
from trackforge.params import Pitch
from trackforge.stored import written

MATCH, HALF, EVENT = ["match_id"], ["match_id", "half"], ["match_id", "half", "event"]


@dataclass(frozen=True)
class Kits:
    """How teams are learnt from kick-offs."""

    frames: int = 12  # of a kick-off, evenly spaced
    centre: float = 1.5  # nearer to the halfway line it isn't certain whose half it is
    zone: float = 8.0  # nearer to a goal line goalkeepers stand
    least_side: int = 3  # examples of each side that make a kick-off usable
    least_examples: int = 8  # of each side in a half
    apart: float = 1.5  # spreads that the sides' colours must differ by
    outlier: float = 2.5
    least_limit: float = 15.0
    slack: float = 1.3  # limits grow by this for colours of one time
    fade_s: float = 600.0  # after so long a kick-off counts 1/e
    step_s: float = 30.0
    start_s: float = 90.0  # the start of a half is a kick-off however it was recognised
    shrink: float = 0.3
    margin: float = 1.5  # score beyond which a player becomes an example himself
    most_pseudo: int = 3000
    least_pseudo: int = 50


def examples(players: DataFrame, kicked: DataFrame, p: Kits, pitch: Pitch) -> DataFrame:
    """Players at kick-offs with event, by_ball and side (0 left, 1 right).

    players: match_id, half, t, x, keeper and more; kicked: match_id, half, event (its time), by_ball, t0, t1.
    """
    times = interval_join(players.select(*HALF, "t").distinct(), kicked.select(*EVENT, "by_ball", "t0", "t1"), HALF, "t", "t0", "t1", 10_000)
    picked = evenly(times.select(*EVENT, "by_ball", "t"), EVENT, "t", p.frames)
    clear = (F.abs(F.col("x") - pitch.length / 2) >= p.centre) & F.col("x").between(p.zone, pitch.length - p.zone)
    outfield = players.where(~F.coalesce("keeper", F.lit(False)) & clear).withColumn("side", (F.col("x") >= pitch.length / 2).cast("int"))
    return outfield.join(picked, [*HALF, "t"])


def both(df: DataFrame, keys: list[str], label: str, vector: str) -> DataFrame:
    """For each key the vectors of labels 0 and 1 side by side: a, b."""
    of = lambda k: F.first(F.when(F.col(label) == k, F.col(vector)), ignorenulls=True)
    return df.groupBy(*keys).agg(of(0).alias("a"), of(1).alias("b"))


def fit_of_sides(a: Column, b: Column, c: Column, d: Column) -> tuple[Column, Column]:
    """How far colours a, b of two sides are from c, d as they stand, and if they are swapped."""
    return distance(a, c) + distance(b, d), distance(a, d) + distance(b, c)


def judged_kickoffs(found: DataFrame, p: Kits) -> DataFrame:
    """match_id, half, event, by_ball, apart, spread and decision: kept, alike (both sides wear the same) or swapped.

    Swapped: the kits stand on other sides than at the half's first kick-off that isn't alike, ball kick-offs first.
    found: examples with colour.
    """
    sides = found.groupBy(*EVENT, "by_ball").agg(*(F.count_if(F.col("side") == k).alias(f"n{k}") for k in (0, 1))).where((F.col("n0") >= p.least_side) & (F.col("n1") >= p.least_side))
    middle = both(median_vectors(found, [*EVENT, "side"], "colour"), EVENT, "side", "colour")
    off = distance(F.col("colour"), F.when(F.col("side") == 0, F.col("a")).otherwise(F.col("b")))
    spread = found.join(middle, EVENT).groupBy(*EVENT).agg(F.median(off).alias("spread"))
    rows = sides.join(middle, EVENT).join(spread, EVENT).withColumn("apart", distance(F.col("a"), F.col("b")))
    rows = rows.withColumn("_alike", F.col("apart") < p.apart * F.col("spread"))
    first = F.first(F.struct("a", "b")).over(Window.partitionBy(*HALF).orderBy("_alike", F.desc("by_ball"), "event").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("_first", first)
    keep, swap = fit_of_sides(F.col("_first.a"), F.col("_first.b"), F.col("a"), F.col("b"))
    decision = F.when(F.col("_alike"), "alike").when(swap < keep, "swapped").otherwise("kept")
    return rows.select(*EVENT, "by_ball", "apart", "spread", decision.alias("decision"))


def first_half(df: DataFrame) -> Column:
    return F.min("half").over(Window.partitionBy(*MATCH))


def sides_of_teams(kept: DataFrame, p: Kits) -> DataFrame:
    """match_id, half, left_team and swapped (against the match's first half), for matches with examples enough on all sides.

    Team 0 is the darker one: the median of the first element of its examples' colours is smaller.
    """
    centres = both(median_vectors(kept, [*HALF, "side"], "colour"), HALF, "side", "colour")
    counts = kept.groupBy(*HALF).agg(F.least(F.count_if(F.col("side") == 0), F.count_if(F.col("side") == 1)).alias("_n"))
    rows = centres.join(counts, HALF).withColumn("_least", F.min("_n").over(Window.partitionBy(*MATCH))).where(F.col("_least") >= p.least_examples)
    start = F.first(F.struct("a", "b")).over(Window.partitionBy(*MATCH).orderBy("half"))
    keep, swap = fit_of_sides(F.col("_s.a"), F.col("_s.b"), F.col("a"), F.col("b"))
    rows = rows.withColumn("_s", start).select(*HALF, (F.coalesce(keep >= swap, F.lit(False)) & (F.col("half") != first_half(rows))).alias("swapped"))
    labelled = kept.join(rows, HALF).withColumn("team", F.col("side").bitwiseXOR(F.col("swapped").cast("int")))
    shade = labelled.groupBy(*MATCH).agg(*(F.median(F.when(F.col("team") == k, F.col("colour")[0])).alias(f"m{k}") for k in (0, 1)))
    flipped = shade.select(*MATCH, (F.col("m0") > F.col("m1")).alias("_flipped"))
    return rows.join(flipped, MATCH).select(*HALF, F.col("swapped").cast("int").bitwiseXOR(F.col("_flipped").cast("int")).alias("left_team"), "swapped")


def with_team(found: DataFrame, sides: DataFrame) -> DataFrame:
    return found.join(sides, HALF).withColumn("team", F.col("side").bitwiseXOR(F.col("left_team")))


def local_colours(labelled: DataFrame, players: DataFrame, p: Kits) -> DataFrame:
    """The teams' colours in each step of a match: means of the kick-offs' colours, those near in time counting most.

    Returns match_id, step, team, colour. Kick-offs are a few dozen rows for each match by now.
    """
    means = mean_vectors(labelled, [*MATCH, "event", "team"], "colour").join(labelled.groupBy(*MATCH, "event", "team").agg(F.count("*").alias("n")), [*MATCH, "event", "team"])
    span = players.groupBy(*MATCH).agg(F.min("t").alias("_t0"), F.max("t").alias("_t1"))
    width = int(1000 * p.step_s)
    steps = span.select(*MATCH, "_t0", F.explode(F.sequence(F.lit(0), F.floor((F.col("_t1") - F.col("_t0")) / width))).alias("step"))
    weight = F.col("n") * F.exp(-F.abs(F.col("event") - (F.col("_t0") + width * (F.col("step") + 0.5))) / (1000 * p.fade_s))
    rows = steps.join(means, MATCH).withColumn("_w", weight).select(*MATCH, "step", "team", "_w", F.posexplode("colour").alias("_pos", "_x"))
    rows = rows.groupBy(*MATCH, "step", "team", "_pos").agg((F.sum(F.col("_w") * F.col("_x")) / F.sum("_w")).alias("_x"))
    placed = F.array_sort(F.collect_list(F.struct("_pos", "_x")))
    return rows.groupBy(*MATCH, "step", "team").agg(F.transform(placed, lambda x: x["_x"]).alias("colour"))


def teams_by_kits(players: DataFrame, kicked: DataFrame, p: Kits = Kits(), pitch: Pitch = Pitch()) -> dict[str, DataFrame]:
    """decisions on kick-offs, sides of the teams, and teams: the players (without colour) with their team, -1 if it is neither.

    Examples (a few thousand rows for each match), decisions and sides are written in between, as others read them.
    players: match_id, half, t, x, keeper, colour (array) and more; goalkeepers get the team that defends their side.
    Matches whose kick-offs tell too little, and players without a colour, get no team (null).
    """
    found = written(examples(players, kicked, p, pitch))
    decisions = written(judged_kickoffs(found, p))
    kept = found.join(decisions.where("decision = 'kept'").select(*EVENT), EVENT)
    sides = written(sides_of_teams(kept, p))
    labelled = with_team(kept, sides)
    centres = median_vectors(labelled, [*MATCH, "team"], "colour")
    off = labelled.join(centres.withColumnRenamed("colour", "_c"), [*MATCH, "team"]).groupBy(*MATCH, "team").agg(F.median(distance(F.col("colour"), F.col("_c"))).alias("_off"))
    limits = off.select(*MATCH, F.col("team").alias("predicted"), F.greatest(p.outlier * F.col("_off"), F.lit(p.least_limit)).alias("limit"))
    begun = players.groupBy(*MATCH).agg(F.min("t").alias("_t0"))
    stepped = players.join(begun, MATCH).withColumn("step", F.floor((F.col("t") - F.col("_t0")) / int(1000 * p.step_s))).drop("_t0")
    near = nearest_centre(stepped, local_colours(labelled, players, p), [*MATCH, "step"], "colour", "team")
    near = near.join(limits, [*MATCH, "predicted"], "left").join(sides.select(*HALF, "left_team"), HALF, "left")
    by_colour = F.when(F.col("distance") <= p.slack * F.col("limit"), F.col("predicted")).when(F.col("distance").isNotNull(), -1)
    by_side = F.when(F.col("x") < pitch.length / 2, F.col("left_team")).otherwise(1 - F.col("left_team"))
    team = F.when(F.coalesce("keeper", F.lit(False)), by_side).otherwise(by_colour)
    return {"decisions": decisions, "sides": sides, "teams": near.select(*(c for c in players.columns if c != "colour"), team.cast("int").alias("team"))}


# ---------------------------------------------------------------- discriminant of descriptors


def discriminant_of(sums: list[np.ndarray], shrink: float) -> tuple[np.ndarray, float]:
    """Weights and bias of the score that is positive for the second class, from both classes' moments.

    Descriptors are standardised, and the covariance within classes shrinks towards a multiple of the identity.
    """
    (n0, s0, _), (n1, s1, _) = (unfolded(m) for m in sums)
    n, s, q = unfolded(sums[0] + sums[1])
    mean = s / n
    scale = np.sqrt(np.maximum(np.diag(q) / n - mean**2, 0)) + 1e-6
    within = (q - np.outer(s0, s0) / n0 - np.outer(s1, s1) / n1) / np.outer(scale, scale) / max(1, n - 1)
    size = len(s)
    within = (1 - shrink) * within + shrink * np.eye(size) * np.trace(within) / size
    c0, c1 = (s0 / n0 - mean) / scale, (s1 / n1 - mean) / scale
    w = np.linalg.solve(within, c1 - c0)
    return w / scale, float(-w @ (c0 + c1) / 2 - (mean * w / scale).sum())


def models(sums: DataFrame, shrink: float, least: int) -> DataFrame:
    """match_id, weights, bias for each match with at least `least` examples of both labels. sums: match_id, label, sums."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        parts = {k: np.frombuffer(s) for k, s in zip(rows.label, rows.sums, strict=True)}
        if set(parts) != {0, 1} or min(unfolded(m)[0] for m in parts.values()) < least:
            return pd.DataFrame({"weights": [], "bias": []})
        weights, bias = discriminant_of([parts[0], parts[1]], shrink)
        return pd.DataFrame({"weights": [weights.tolist()], "bias": [bias]})

    return grouped(sums.select(*MATCH, "label", "sums"), MATCH, run, [("weights", T.ArrayType(T.DoubleType())), ("bias", T.DoubleType())])


def scored(df: DataFrame, model: DataFrame, name: str = "score") -> DataFrame:
    """df with the score of its descriptor by its match's model; matches without one drop out."""
    dot = F.aggregate(F.zip_with("descriptor", "weights", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return df.join(model, MATCH).withColumn(name, dot + F.col("bias")).drop("weights", "bias")


def swapped_halves(found: DataFrame, size: int, p: Kits) -> DataFrame:
    """match_id, half, swapped, keep: the later halves, with the share of their examples that the first half's model puts on
    the side they stand on; below a half, or without examples enough, the teams have changed ends."""
    first = found.where(F.col("_first") == F.col("half"))
    model = models(moments(first.select(*MATCH, F.col("side").alias("label"), "descriptor"), [*MATCH, "label"], "descriptor", size), p.shrink, p.least_examples)
    later = found.where(F.col("_first") != F.col("half"))
    tested = scored(later, model).groupBy(*HALF).agg(F.avg(((F.col("score") > 0) == (F.col("side") == 1)).cast("int")).alias("keep"), F.least(F.count_if(F.col("side") == 0), F.count_if(F.col("side") == 1)).alias("_n"))
    tested = tested.where(F.col("_n") >= p.least_examples).select(*HALF, "keep")
    return later.select(*HALF).distinct().join(tested, HALF, "left").select(*HALF, (F.coalesce("keep", F.lit(0.0)) < 0.5).alias("swapped"), "keep")


def chosen_pseudo(everybody: DataFrame, model: DataFrame, item: list[str], turn: int, p: Kits) -> DataFrame:
    """Players the model is sure of, as many of one team as of the other, chosen by a hash of their columns item and the turn."""
    sure = scored(everybody, model).where(F.abs("score") >= p.margin).withColumn("label", (F.col("score") > 0).cast("int"))
    sizes = sure.groupBy(*MATCH).agg(F.least(F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1), F.lit(p.most_pseudo)).alias("_m")).where(F.col("_m") >= p.least_pseudo)
    rank = F.row_number().over(Window.partitionBy(*MATCH, "label").orderBy(F.xxhash64(*item, F.lit(turn)), *item))
    return sure.join(sizes, MATCH).withColumn("_r", rank).where(F.col("_r") <= F.col("_m")).select(*MATCH, "label", "descriptor")


def teams_by_descriptors(players: DataFrame, kicked: DataFrame, size: int, item: list[str], p: Kits = Kits(), pitch: Pitch = Pitch(), turns: int = 0) -> dict[str, DataFrame]:
    """sides of the teams in each half, and teams: players (without descriptor and colour) with score and team.

    Examples (a few thousand rows for each match), sides and models are written in between, as others read them.
    players: match_id, half, t, x, keeper, descriptor (size numbers), colour and more; item: columns that name a player's
    row. Kick-offs by the ball and those at the start of a half count, or all if a match has fewer than two of these. The
    score is positive towards team 1; team 0 wears darker colours. In each of the turns the model is learnt again with
    players it is sure of, from all over the pitch. Matches with too few examples, and players without a whole
    descriptor, get no team (null).
    """
    whole = players.where((F.size("descriptor") == size) & F.forall("descriptor", lambda x: x.isNotNull()))
    begun = players.groupBy(*HALF).agg(F.min("t").alias("_begun"))
    sure = F.col("by_ball") | (F.col("event") - F.col("_begun") < int(1000 * p.start_s))
    kicked = kicked.join(begun, HALF).withColumn("_sure", sure).withColumn("_n", F.count_if("_sure").over(Window.partitionBy(*MATCH)))
    kicked = kicked.where(F.col("_sure") | (F.col("_n") < 2)).drop("_sure", "_n", "_begun")
    found = examples(whole, kicked, p, pitch)
    found = written(found.withColumn("_first", first_half(found)))
    ends = found.select(*HALF).distinct().join(swapped_halves(found, size, p), HALF, "left").select(*HALF, F.coalesce("swapped", F.lit(False)).alias("swapped"), "keep")
    ends = written(ends)
    labelled = found.join(ends, HALF).withColumn("label", F.col("side").bitwiseXOR(F.col("swapped").cast("int")))
    own = written(moments(labelled.select(*MATCH, "label", "descriptor"), [*MATCH, "label"], "descriptor", size))
    model = written(models(own, p.shrink, p.least_examples))
    everybody = whole.where(~F.coalesce("keeper", F.lit(False)))
    for turn in range(turns):
        more = moments(chosen_pseudo(everybody, model, item, turn, p), [*MATCH, "label"], "descriptor", size)
        model = written(models(added(own.unionByName(more), [*MATCH, "label"]), p.shrink, p.least_examples))
    shade = labelled.groupBy(*MATCH).agg(*(F.median(F.when(F.col("label") == k, F.col("colour")[0])).alias(f"m{k}") for k in (0, 1)))
    flipped = model.select(*MATCH).join(shade, MATCH, "left").select(*MATCH, F.coalesce(F.col("m0") > F.col("m1"), F.lit(False)).alias("_flipped"))
    sides = ends.join(flipped, MATCH).select(*HALF, F.col("swapped").cast("int").bitwiseXOR(F.col("_flipped").cast("int")).alias("left_team"), "swapped", "keep")
    given = scored(whole, model).join(flipped, MATCH).withColumn("score", F.when(F.col("_flipped"), -F.col("score")).otherwise(F.col("score"))).select(*item, "score")
    by_side = F.when(F.col("x") < pitch.length / 2, F.col("left_team")).otherwise(1 - F.col("left_team"))
    team = F.when(F.coalesce("keeper", F.lit(False)), by_side).otherwise((F.col("score") > 0).cast("int"))
    rows = players.join(given, item, "left").join(sides.select(*HALF, "left_team"), HALF, "left")
    return {"sides": sides, "teams": rows.select(*(c for c in players.columns if c not in ("descriptor", "colour")), "score", team.alias("team"))}
