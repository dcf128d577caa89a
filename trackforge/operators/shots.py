"""Shots from control segments: seen in flight, lost in the air, and those that only a goal tells of.

Everything that looks ahead from a segment is an interval join in time buckets with the first row that satisfies a
condition; the rest are conditions on a row for each segment. Times are milliseconds, positions metres.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackforge.functions.scalar import expected_goal
from trackforge.operators.islands import spaced
from trackforge.operators.nearest import interval_join
from trackforge.params import Actions, Pitch
from trackforge.stored import written

FLIGHT_FROM, FLIGHT_TO = 100, 1000  # fixed values of the rules: when a flight that is seen has gone FLIGHT metres
FLIGHT = 2.5
LOST, LOST_OUT = 5000, 3500  # how long after a segment the end of a flight that isn't seen counts; of one that just goes out
AT_GOAL = 3.5
RECEIVED, REACHED = 2500, 3000  # a team mate's reception makes a pass; an opponent's a blocked or saved shot
EARLY, LATE = 2000, 9000  # a shot may be this much after or before its goal
CONTROL_FROM, CONTROL_TO, BALL_FROM, BALL_TO, ANY_FROM = 15_000, 300, 8000, 1500, 10_000
APART = 1500
ASIDE, STEEP, SLOW_PART, LATE_S = 4.0, 0.3, 0.8, 3.0


def first_row(rows: DataFrame, spans: DataFrame, keys: list[str], reach: int, wanted: Column, name: str) -> DataFrame:
    """keys, i0, name: the first row (t, x, y) of each span (i0, from_t, to_t, px, py) that is wanted."""
    met = interval_join(rows.select(*keys, "t", "x", "y"), spans, keys, "t", "from_t", "to_t", max(1, reach)).where(wanted)
    return met.groupBy(*keys, "i0").agg(F.min(F.struct("t", "x", "y")).alias(name))


def attempts(segments: DataFrame, held: DataFrame, keys: list[str], a: Actions, pitch: Pitch, step_ms: int = 67) -> DataFrame:
    """Shots among segments (team, right, t0, t1, i0, i1): team, t, x, y, speed, seen, aimed (on target), outcome, xg.

    held: frame, t, x, y, ball_state. right: the segment's team attacks right. A flight that is seen needs shot_speed. One
    that is lost ends with the next segment, or where the ball goes out before it; if that is at the opponents' goal line
    no speed is needed, else SLOW_PART of it. step_ms: time between frames.
    """
    w = Window.partitionBy(*keys).orderBy("i0")
    rows = segments.select("*", *(F.lead(c).over(w).alias(f"n_{c}") for c in ("team", "t0", "i0")))
    at = held.select(*keys, F.col("frame").alias("i1"), F.col("x").alias("px"), F.col("y").alias("py"))
    then = held.select(*keys, F.col("frame").alias("n_i0"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    rows = rows.join(at, [*keys, "i1"]).join(then, [*keys, "n_i0"], "left")
    ahead = lambda c: F.when(F.col("right"), c).otherwise(pitch.length - c)
    across = lambda c: F.when(F.col("right"), c).otherwise(pitch.width - c)
    rows = rows.withColumn("xn", ahead(F.col("px"))).withColumn("yn", across(F.col("py"))).where((pitch.length - F.col("xn")).between(0, a.shot_range))

    known = held.where("x is not null")
    spans = rows.select(*keys, "i0", "px", "py", "t1")
    away = F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py"))
    flown = first_row(known, spans.withColumn("from_t", F.col("t1") + FLIGHT_FROM).withColumn("to_t", F.col("t1") + FLIGHT_TO + step_ms), keys, FLIGHT_TO, away >= FLIGHT, "flown")
    gone = first_row(known.where("ball_state = 'out'"), spans.withColumn("from_t", F.col("t1") + 1).withColumn("to_t", F.col("t1") + LOST), keys, LOST, F.lit(True), "gone")
    rows = rows.join(flown, [*keys, "i0"], "left").join(gone, [*keys, "i0"], "left")

    after = F.col("n_t0") - F.col("t1")
    taken = F.coalesce((after > 0) & (after <= LOST), F.lit(False))
    kept_at_goal = F.coalesce(taken & (F.col("n_team") != F.col("team")) & (pitch.length - ahead(F.col("nx")) <= AT_GOAL), F.lit(False))
    out_first = F.coalesce(F.col("gone").isNotNull() & (F.col("n_t0").isNull() | (F.col("n_t0") > F.col("gone.t"))), F.lit(False))
    behind = out_first & (ahead(F.col("gone.x")) > pitch.length - 1.0)
    next_end = F.struct(F.col("n_t0").alias("t"), F.col("nx").alias("x"), F.col("ny").alias("y"))
    lost = F.when(kept_at_goal, next_end).when(behind, F.col("gone")).when(taken, next_end).when(out_first & (F.col("gone.t") - F.col("t1") <= LOST_OUT), F.col("gone"))
    seen = F.col("flown").isNotNull()
    rows = rows.withColumn("seen", seen).withColumn("end", F.coalesce(F.col("flown"), lost)).withColumn("_free", ~seen & (kept_at_goal | behind)).where(F.col("end.x").isNotNull())
    rows = written(rows.select(*keys, "team", "right", "t1", "px", "py", "xn", "yn", "n_team", "n_t0", "nx", "seen", "end", "_free"))  # some rows for each minute of play
    took = F.greatest(F.col("end.t") - F.col("t1"), F.lit(step_ms)) / 1000
    d = F.hypot(F.col("end.x") - F.col("px"), F.col("end.y") - F.col("py"))
    rows = rows.withColumn("d", d).where(F.col("d") >= FLIGHT).withColumn("speed", F.col("d") / took)
    ux, uy = (ahead(F.col("end.x")) - F.col("xn")) / F.col("d"), (across(F.col("end.y")) - F.col("yn")) / F.col("d")
    rows = rows.withColumn("ux", ux).withColumn("uy", uy).where(F.col("ux") >= STEEP)
    run = (pitch.length - F.col("xn")) / F.col("ux")
    fast = F.col("_free") | ((F.col("speed") >= F.when(F.col("seen"), a.shot_speed).otherwise(SLOW_PART * a.shot_speed)) & (run / F.col("speed") <= LATE_S))
    off = F.abs(F.col("yn") + run * F.col("uy") - pitch.width / 2)
    received = F.coalesce((F.col("n_team") == F.col("team")) & (after <= RECEIVED), F.lit(False))
    rows = rows.where(fast & (off <= a.goal_width / 2 + ASIDE) & ~received).withColumn("aimed", off <= a.goal_width / 2)
    reached = F.coalesce((F.col("n_team") != F.col("team")) & (after <= REACHED), F.lit(False))
    saved = F.coalesce(pitch.length - ahead(F.col("nx")) <= AT_GOAL, F.lit(False)) & F.col("aimed")
    outcome = F.when(reached & saved, "saved").when(reached, "blocked").when(F.col("aimed"), "on_target").otherwise("off_target")
    xg = expected_goal(F.col("xn"), F.col("yn"), pitch.length, pitch.width, a.goal_width)
    return rows.select(*keys, "team", F.col("t1").alias("t"), F.col("px").alias("x"), F.col("py").alias("y"), "speed", "seen", "aimed", outcome.alias("outcome"), xg.alias("xg"))


def claims(found: DataFrame, goals: DataFrame, match: list[str], exclusive: bool = False) -> DataFrame:
    """match, goal_t, t, team: for each goal the latest shot of its scorer in reach. goals: t, scorer (null: any team).

    Goals claim in order of time. exclusive: a shot that an earlier goal has claimed can't be claimed again, so that two
    goals soon after each other have two shots; else they may share one. A match's goals are a few rows, folded as arrays.
    """
    g = goals.select(*match, F.col("t").alias("goal_t"), "scorer", (F.col("t") - LATE).alias("from_t"), (F.col("t") + EARLY).alias("to_t"))
    near = interval_join(found.select(*match, "t", "team"), g, match, "t", "from_t", "to_t", EARLY + LATE).where(F.coalesce(F.col("scorer") == F.col("team"), F.lit(True)))
    offers = near.groupBy(*match, "goal_t", "scorer").agg(F.array_sort(F.collect_set(F.struct((-F.col("t")).alias("back"), F.col("team").alias("team")))).alias("shots"))
    if not exclusive:
        return offers.select(*match, "goal_t", (-F.col("shots")[0]["back"]).alias("t"), F.col("shots")[0]["team"].alias("team"))
    listed = offers.groupBy(*match).agg(F.array_sort(F.collect_list(F.struct("goal_t", F.coalesce("scorer", F.lit(-1)).alias("scorer"), "shots"))).alias("g"))

    def step(acc: Column, x: Column) -> Column:
        free = F.filter(x["shots"], lambda s: ~F.exists(acc, lambda y: (y["t"] == -s["back"]) & (y["team"] == s["team"])))
        claim = F.struct(x["goal_t"].alias("goal_t"), (-free[0]["back"]).alias("t"), free[0]["team"].alias("team"))
        return F.when(F.size(free) > 0, F.concat(acc, F.array(claim))).otherwise(acc)

    empty = F.from_json(F.lit("[]"), "array<struct<goal_t:bigint,t:bigint,team:int>>")
    return listed.select(*match, F.inline(F.aggregate("g", empty, step)))


def unseen(goals: DataFrame, held: DataFrame, segments: DataFrame, directions: DataFrame, keys: list[str], a: Actions, pitch: Pitch) -> DataFrame:
    """Where goals that no shot belongs to were shot from: goal_t, team, t, x, y, origin, xg.

    The last control by the scorer in the attacking half in the last CONTROL_FROM, else the last ball in that half, but
    not at the goal, BALL_TO to BALL_FROM before; if the scorer isn't known, the end of the last segment in ANY_FROM that
    ends in its team's attacking half. goals: t, half, scorer; held: frame, t, x, y, controlled_by; directions: team, right.
    """
    ahead = F.when(F.col("right"), F.col("x")).otherwise(pitch.length - F.col("x"))
    mine = goals.where("scorer is not null").select(*keys, F.col("t").alias("goal_t"), F.col("scorer").alias("team")).join(directions.select(*keys, "team", "right"), [*keys, "team"])
    spans = mine.select("*", (F.col("goal_t") - CONTROL_FROM).alias("from_t"), (F.col("goal_t") - CONTROL_TO).alias("to_t"))
    near = interval_join(held.where("x is not null").select(*keys, "t", "x", "y", "controlled_by"), spans, keys, "t", "from_t", "to_t", CONTROL_FROM).withColumn("xn", ahead)
    control = F.coalesce(F.col("controlled_by") == F.col("team"), F.lit(False))
    passing = F.col("t").between(F.col("goal_t") - BALL_FROM, F.col("goal_t") - BALL_TO) & (pitch.length - F.col("xn") >= 3.0)
    near = near.where((F.col("xn") >= pitch.length / 2) & (control | passing))
    best = near.groupBy(*keys, "goal_t", "team", "right").agg(F.max(F.struct(control.cast("int").alias("c"), "t", "x", "y")).alias("o"))
    known = best.select(*keys, "goal_t", "team", "right", "o.t", "o.x", "o.y", F.when(F.col("o.c") == 1, "control").otherwise("ball").alias("origin"))
    ends = segments.join(held.select(*keys, F.col("frame").alias("i1"), "x", "y"), [*keys, "i1"]).where("x is not null").select(*keys, "team", "right", F.col("t1").alias("t"), "x", "y")
    anyone = goals.where("scorer is null").select(*keys, F.col("t").alias("goal_t"), (F.col("t") - ANY_FROM).alias("from_t"), (F.col("t") - 1).alias("to_t"))
    last = interval_join(ends, anyone, keys, "t", "from_t", "to_t", ANY_FROM).where(ahead >= pitch.length / 2).groupBy(*keys, "goal_t").agg(F.max(F.struct("t", "team", "right", "x", "y")).alias("o"))
    found = known.unionByName(last.select(*keys, "goal_t", "o.team", "o.right", "o.t", "o.x", "o.y", F.lit("control").alias("origin")))
    yn = F.when(F.col("right"), F.col("y")).otherwise(pitch.width - F.col("y"))
    return found.select(*keys, "goal_t", "team", "t", "x", "y", "origin", expected_goal(ahead, yn, pitch.length, pitch.width, a.goal_width).alias("xg"))


def all_shots(segments: DataFrame, held: DataFrame, goals: DataFrame, directions: DataFrame, keys: list[str], a: Actions = Actions(), pitch: Pitch = Pitch(), step_ms: int = 67, exclusive: bool = False) -> DataFrame:
    """keys, team, t, x, y, speed, outcome, inferred, origin, xg: attempts with goals among them, and a shot for every other goal.

    keys: match, then half. goals: keys, t, scorer. An aimed attempt with a goal in reach is a goal, whoever scored it;
    for each goal the latest attempt of its scorer is one too. Of a team's shots within APART of one that counts only
    that one does.
    """
    match = keys[:1]
    found = written(attempts(segments.join(directions.select(*keys, "team", "right"), [*keys, "team"]), held, keys, a, pitch, step_ms))
    times = goals.select(*match, (F.col("t") - LATE).alias("from_t"), (F.col("t") + EARLY).alias("to_t"))
    reached = interval_join(found.where("aimed").select(*match, "t", "team"), times, match, "t", "from_t", "to_t", EARLY + LATE, "left_semi").distinct().withColumn("_near", F.lit(True))
    claimed = claims(found, goals, match, exclusive)
    own = claimed.select(*match, "t", "team").distinct().withColumn("_own", F.lit(True))
    seen = found.join(reached, [*match, "t", "team"], "left").join(own, [*match, "t", "team"], "left")
    goal = F.col("_own").isNotNull() | (F.col("_near").isNotNull() & F.col("aimed"))
    seen = seen.select(*keys, "team", "t", "x", "y", "speed", F.when(goal, "goal").otherwise(F.col("outcome")).alias("outcome"), F.lit(False).alias("inferred"), F.lit(None).cast("string").alias("origin"), "xg")
    missing = goals.join(claimed.select(*match, F.col("goal_t").alias("t")), [*match, "t"], "left_anti")
    more = unseen(missing, held, segments.join(directions.select(*keys, "team", "right"), [*keys, "team"]), directions, keys, a, pitch)
    more = more.select(*keys, "team", "t", "x", "y", F.lit(None).cast("double").alias("speed"), F.lit("goal").alias("outcome"), F.lit(True).alias("inferred"), "origin", "xg")
    both = seen.unionByName(more)
    first = Window.partitionBy(*match, "team", "t").orderBy("inferred", "x")
    once = both.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    return once.join(spaced(both.select(*match, "team", "t"), [*match, "team"], "t", APART), [*match, "team", "t"]).select(*both.columns)
