"""The figures of a match's report, one row for each scope, team and measure.

Measures are registered with the table they come from. Each table is aggregated once, for halves and whole matches
together by grouping sets, and its columns become rows; so a measure more costs an expression, not a pass.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackforge.functions.scalar import mirrored
from trackforge.operators.measures import by_scope, percent
from trackforge.params import Actions, Pitch

MATCH, HALF, KEYS = "match_id", "half", ["match_id", "half"]


def either_team() -> Column:
    return F.explode(F.array(F.lit(0), F.lit(1))).alias("team")


def seconds() -> Column:
    return (F.col("t1") - F.col("t0")) / 1000


@dataclass(frozen=True)
class Measure:
    """A figure of a team: value is an aggregate over its table; otherwise is what it is without rows there."""

    name: str
    table: str
    value: Callable[[Pitch, Actions], Column]
    otherwise: float | None = None


def count_if(flag: Callable[[Pitch, Actions], Column]) -> Callable[[Pitch, Actions], Column]:
    return lambda p, a: F.count_if(flag(p, a))


MEASURES = [
    Measure("possession", "assigned", lambda p, a: percent(F.col("possession") == F.col("team"))),
    Measure("possession_in_opponent_half", "held", lambda p, a: percent(F.col("xn") >= p.length / 2)),
    Measure("own_third", "held", lambda p, a: percent(F.col("xn") < p.length / 3)),
    Measure("middle_third", "held", lambda p, a: percent((F.col("xn") >= p.length / 3) & (F.col("xn") < 2 * p.length / 3))),
    Measure("final_third", "held", lambda p, a: percent(F.col("xn") >= 2 * p.length / 3)),
    Measure("possessions", "sequences", lambda p, a: F.count("*"), 0),
    Measure("average_possession_s", "sequences", lambda p, a: F.avg(seconds())),
    Measure("longest_possession_s", "sequences", lambda p, a: F.max(seconds())),
    Measure("possessions_over_10_s", "sequences", count_if(lambda p, a: seconds() >= 10), 0),
    Measure("recoveries", "recoveries", lambda p, a: F.count("*"), 0),
    Measure("recoveries_in_opponent_half", "recoveries", count_if(lambda p, a: F.col("xn") >= p.length / 2), 0),
    Measure("ball_losses", "losses", lambda p, a: F.count("*"), 0),
    Measure("average_position_m", "shape", lambda p, a: F.avg("height")),
    Measure("team_length_m", "shape", lambda p, a: F.avg("depth")),
    Measure("team_width_m", "shape", lambda p, a: F.avg("breadth")),
    Measure("passes_attempted", "passes", lambda p, a: F.count("*"), 0),
    Measure("passes_completed", "passes", count_if(lambda p, a: F.col("completed")), 0),
    Measure("pass_accuracy", "passes", lambda p, a: percent(F.col("completed"))),
    Measure("shots", "shots", lambda p, a: F.count("*"), 0),
    Measure("shots_on_target", "shots", count_if(lambda p, a: F.col("outcome").isin("goal", "saved", "on_target")), 0),
    Measure("big_chances", "shots", count_if(lambda p, a: F.col("xg") >= a.big_chance), 0),
    Measure("xg", "shots", lambda p, a: F.sum("xg"), 0.0),
    Measure("distance_km", "moved", lambda p, a: F.sum("metres") / 1000),
]


def facts(tables: dict[str, DataFrame], pitch: Pitch) -> dict[str, DataFrame]:
    """What measures are taken of, each with match_id, half and team, from the tables of the chain that are there.

    tables: possession (frame, t, x, y, possession), directions (team, right), sequences (team, t0, t1, start), recoveries
    (as sequences), players (frame, x, y, team, keeper), passes, shots, moved (team, metres).
    """
    out = {name: tables[name] for name in ("sequences", "passes", "shots", "moved") if name in tables}
    directions = tables["directions"].select(*KEYS, "team", "right")
    normal = lambda df: df.join(directions, [*KEYS, "team"]).withColumn("xn", mirrored(F.col("x"), F.col("right"), pitch.length))
    if "possession" in tables:
        frames = tables["possession"].where("possession in (0, 1)")
        out["assigned"] = frames.select(*KEYS, "possession", either_team())
        out["held"] = normal(frames.where("x is not null").select(*KEYS, F.col("possession").alias("team"), "x"))
        if "recoveries" in tables:
            at = tables["possession"].where("x is not null").select(*KEYS, F.col("frame").alias("start"), "x")
            out["recoveries"] = normal(tables["recoveries"].select(*KEYS, "team", "start").join(at, [*KEYS, "start"]))
            out["losses"] = out["recoveries"].withColumn("team", 1 - F.col("team"))
    if "players" in tables:
        people = tables["players"].where("team in (0, 1)").where(~F.coalesce("keeper", F.lit(False)))
        placed = normal(people.select(*KEYS, "frame", "team", "x", "y")).groupBy(*KEYS, "frame", "team")
        shape = placed.agg(F.count("*").alias("n"), F.avg("xn").alias("height"), (F.max("xn") - F.min("xn")).alias("depth"), (F.max("y") - F.min("y")).alias("breadth"))
        out["shape"] = shape.where("n >= 4")
    return out


def report(tables: dict[str, DataFrame], pitch: Pitch = Pitch(), a: Actions = Actions(), measures: list[Measure] | None = None) -> DataFrame:
    """match_id, scope ("match", "half_1", ...), team, measure, value. Measures whose table isn't there are left out."""
    known = facts(tables, pitch)
    chosen = [m for m in (measures or MEASURES) if m.table in known]
    rows = []
    for name in dict.fromkeys(m.table for m in chosen):
        own = [m for m in chosen if m.table == name]
        wide = by_scope(known[name].where("team in (0, 1)"), MATCH, HALF, ["team"], [m.value(pitch, a).cast("double").alias(m.name) for m in own])
        rows.append(wide.unpivot([MATCH, HALF, "team"], [m.name for m in own], "measure", "value"))
    found = functools.reduce(lambda x, y: x.unionByName(y), rows).withColumn("half", F.coalesce("half", F.lit(0)))
    halves = tables["directions"].select(*KEYS).distinct()
    scopes = halves.unionByName(halves.select(MATCH, F.lit(0).alias(HALF)).distinct())
    defaults = F.explode(F.array(*(F.struct(F.lit(m.name).alias("measure"), F.lit(m.otherwise).cast("double").alias("otherwise")) for m in chosen)))
    whole = scopes.select(*KEYS, either_team()).select(*KEYS, "team", defaults.alias("m")).select(*KEYS, "team", "m.measure", "m.otherwise")
    out = whole.join(found, [*KEYS, "team", "measure"], "left")
    scope = F.when(F.col(HALF) == 0, "match").otherwise(F.concat(F.lit("half_"), F.col(HALF).cast("string")))
    return out.select(MATCH, scope.alias("scope"), "team", "measure", F.coalesce("value", "otherwise").alias("value"))
