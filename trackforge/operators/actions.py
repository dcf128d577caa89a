"""Passes, shots, corners and entries from control segments and the ball's positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackforge.functions.scalar import expected_goal
from trackforge.operators.islands import changed, numbered, ordered
from trackforge.operators.nearest import interval_join, nearest_in_key
from trackforge.params import Actions, Pitch


def flights(segments: DataFrame, positions: DataFrame, keys: list[str], pause_ms: int) -> DataFrame:
    """Segments with the ball's position at their last row and, if it comes within pause_ms, the next one's first.

    segments: team, t0, t1, i0, i1; positions: frame, x, y. Adds x, y, x2, y2, gap (ms), next_team.
    """
    w = Window.partitionBy(*keys).orderBy("i0")
    after = segments.select("*", *(F.lead(c).over(w).alias(f"n_{c}") for c in ("team", "t0", "i0")))
    at = positions.select(*keys, F.col("frame").alias("i1"), "x", "y")
    then = positions.select(*keys, F.col("frame").alias("n_i0"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    rows = after.join(at, [*keys, "i1"], "left").join(then, [*keys, "n_i0"], "left")
    gap = F.col("n_t0") - F.col("t1")
    return rows.withColumn("gap", gap).withColumn("followed", F.coalesce((gap > 0) & (gap <= pause_ms), F.lit(False)))


def passes(flown: DataFrame, outs: DataFrame, keys: list[str], a: Actions, pitch: Pitch, right: Column, least_dt: float, pause_ms: int) -> DataFrame:
    """Passes by the ball's flight: to the next segment, or out of play before it comes.

    outs: t, x, y of rows out of play. right: the segment's team attacks right. Adds completed, forward, far_half.
    """
    spans = flown.where(~F.col("followed")).select(*keys, "i0", F.col("t1").alias("from_t"), (F.col("t1") + pause_ms).alias("to_t"))
    out = interval_join(outs.select(*keys, "t", F.col("x").alias("ox"), F.col("y").alias("oy")), spans, keys, "t", "from_t", "to_t", max(1, pause_ms)).where("t > from_t")
    first = out.groupBy(*keys, "i0").agg(F.min(F.struct("t", "ox", "oy")).alias("o"))
    rows = flown.join(first, [*keys, "i0"], "left")
    left = ~F.col("followed") & F.col("o").isNotNull() & F.coalesce(F.col("n_t0") > F.col("o.t"), F.lit(True))
    x2, y2 = F.when(F.col("followed"), F.col("x2")).when(left, F.col("o.ox")), F.when(F.col("followed"), F.col("y2")).when(left, F.col("o.oy"))
    gap = F.when(F.col("followed"), F.col("gap")).when(left, F.col("o.t") - F.col("t1")) / 1000
    rows = rows.select(*keys, "team", F.col("t1").alias("t"), "x", "y", x2.alias("x2"), y2.alias("y2"), gap.alias("gap_s"), (F.col("followed") & (F.col("n_team") == F.col("team"))).alias("completed"), right.alias("right"))
    d = F.hypot(F.col("x2") - F.col("x"), F.col("y2") - F.col("y"))
    ahead = lambda c: F.when(F.col("right"), F.col(c)).otherwise(pitch.length - F.col(c))
    rows = rows.withColumn("distance", d).where((d >= a.pass_distance) & (d / F.greatest("gap_s", F.lit(least_dt)) >= a.pass_speed))
    return rows.withColumn("forward", ahead("x2") - ahead("x") >= 3.0).withColumn("far_half", ahead("x") >= pitch.length / 2)


def player_control(ball: DataFrame, tracked: DataFrame, keys: list[str], a: Actions) -> DataFrame:
    """keys, frame, t, player, team of frames in which the ball, in play and not flying, is within reach of a tracked player.

    ball: frame, t, x, y, ball_state, speed (null: unknown); tracked: t, slot_team, slot, x, y.
    """
    player = F.concat(F.lit("T"), F.col("slot_team").cast("string"), F.lit("-"), F.col("slot").cast("string"))
    people = tracked.where(F.col("slot").isNotNull()).select(*keys, "t", F.col("slot_team").alias("team"), player.alias("player"), "x", "y")
    slow = F.coalesce(F.col("speed") <= a.fly_speed, F.lit(True))
    rows = ball.where((F.col("ball_state") == "play") & F.col("x").isNotNull() & slow).select(*keys, "frame", "t", "x", "y")
    near = nearest_in_key(rows, people, [*keys, "t"], "frame", "player", within=a.player_control, carry=["team"])
    return near.where(F.col("nearest").isNotNull()).select(*keys, "frame", "t", F.col("nearest").alias("player"), F.col("nearest_team").alias("team"))


def player_touches(controlled: DataFrame, keys: list[str], bridge_ms: int) -> DataFrame:
    """Runs of control by one player, over pauses of at most bridge_ms: player, team, t0, t1, i0, i1 (frames)."""
    w = ordered(keys, "frame")
    new = changed(F.col("player"), w) | F.coalesce(F.col("t") - F.lag("t").over(w) > bridge_ms, F.lit(False))
    runs = numbered(controlled.withColumn("_new", new), keys, ["frame"], F.col("_new"))
    return runs.groupBy(*keys, "run", "player", "team").agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.min("frame").alias("i0"), F.max("frame").alias("i1")).drop("run")


def touch_passes(touches: DataFrame, positions: DataFrame, keys: list[str], a: Actions, least_dt: float, pause_ms: int, outs: DataFrame | None = None) -> DataFrame:
    """Passes between touches of different players; a player's own next touch is a dribble.

    touches: player, team, i0, i1, t0, t1; positions: frame, x, y. outs: t, x, y of rows out of play; where one comes
    within pause_ms and before the next touch, the ball was played out, which is a pass that isn't completed.
    """
    w = Window.partitionBy(*keys).orderBy("i0")
    rows = touches.select("*", *(F.lead(c).over(w).alias(f"n_{c}") for c in ("player", "team", "t0", "i0")))
    at = positions.select(*keys, F.col("frame").alias("i1"), "x", "y")
    then = positions.select(*keys, F.col("frame").alias("n_i0"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    rows = rows.join(at, [*keys, "i1"]).join(then, [*keys, "n_i0"], "left")
    to_player = F.col("n_player").isNotNull() & (F.col("n_t0") - F.col("t1")).between(0, pause_ms)
    end = F.when(to_player, F.struct(F.col("n_t0").alias("t"), "x2", "y2"))
    if outs is not None:
        spans = rows.select(*keys, "i0", (F.col("t1") + 1).alias("from_t"), F.least(F.col("t1") + pause_ms, F.coalesce(F.col("n_t0"), F.col("t1") + pause_ms)).alias("to_t")).where("from_t <= to_t")
        gone = interval_join(outs.select(*keys, "t", "x", "y"), spans, keys, "t", "from_t", "to_t", max(1, pause_ms)).groupBy(*keys, "i0").agg(F.min(F.struct("t", F.col("x").alias("x2"), F.col("y").alias("y2"))).alias("out"))
        rows = rows.join(gone, [*keys, "i0"], "left")
        out = F.col("out").isNotNull()
        end, to_player = F.when(out, F.col("out")).otherwise(end), to_player & ~out
    rows = rows.withColumn("end", end).withColumn("to_player", to_player).where(F.col("end").isNotNull() & ~(F.col("to_player") & (F.col("n_player") == F.col("player"))))
    d, gap = F.hypot(F.col("end.x2") - F.col("x"), F.col("end.y2") - F.col("y")), (F.col("end.t") - F.col("t1")) / 1000
    rows = rows.where((d >= a.pass_distance) & (d / F.greatest(gap, F.lit(least_dt)) >= a.pass_speed))
    completed = F.col("to_player") & (F.col("n_team") == F.col("team"))
    return rows.select(*keys, "player", "team", F.col("t1").alias("t"), "x", "y", "end.x2", "end.y2", completed.alias("completed"))


def shots(flown: DataFrame, keys: list[str], a: Actions, pitch: Pitch, right: Column) -> DataFrame:
    """Shots among flights: fast and straight enough towards the goal, not received by the own team.

    The outcome is by where the path meets the goal line and who has the ball next. Adds xg.
    """
    side = lambda c, whole: F.when(right, F.col(c)).otherwise(whole - F.col(c))
    rows = flown.withColumn("xn", side("x", pitch.length)).withColumn("yn", side("y", pitch.width)).withColumn("xe", side("x2", pitch.length)).withColumn("ye", side("y2", pitch.width))
    d = F.hypot(F.col("xe") - F.col("xn"), F.col("ye") - F.col("yn"))
    rows = rows.withColumn("d", d).where((F.col("d") >= 2.5) & (F.col("gap") > 0)).withColumn("speed", F.col("d") / (F.col("gap") / 1000))
    ux, uy = (F.col("xe") - F.col("xn")) / F.col("d"), (F.col("ye") - F.col("yn")) / F.col("d")
    rows = rows.withColumn("run", (pitch.length - F.col("xn")) / ux).withColumn("meets", F.col("yn") + F.col("run") * uy).withColumn("ux", ux)
    near = (pitch.length - F.col("xn")).between(0, a.shot_range)
    straight = (F.col("ux") >= 0.3) & (F.col("speed") >= a.shot_speed) & (F.col("run") / F.col("speed") <= 3.0)
    aimed = F.abs(F.col("meets") - pitch.width / 2)
    own = (F.col("n_team") == F.col("team")) & (F.col("gap") <= 2500)
    rows = rows.where(near & straight & (aimed <= a.goal_width / 2 + 4.0) & ~F.coalesce(own, F.lit(False)))
    on_target = aimed <= a.goal_width / 2
    other = (F.col("n_team") != F.col("team")) & (F.col("gap") <= 3000)
    outcome = F.when(other & on_target & (pitch.length - F.col("xe") <= 3.5), "saved").when(other, "blocked").when(on_target, "on_target").otherwise("off_target")
    return rows.select(*keys, "team", F.col("t1").alias("t"), "x", "y", "speed", outcome.alias("outcome"), expected_goal(F.col("xn"), F.col("yn"), pitch.length, pitch.width, a.goal_width).alias("xg"))


def with_goals(found: DataFrame, goals: DataFrame, keys: list[str], early_ms: int = 2000, late_ms: int = 9000) -> DataFrame:
    """Shots with the outcome goal where one follows: for every goal the latest shot of the scorer in reach.

    goals: t, scorer (null: any). A shot may be taken by several goals.
    """
    g = goals.select(*keys, F.col("t").alias("goal_t"), "scorer", (F.col("t") - late_ms).alias("from_t"), (F.col("t") + early_ms).alias("to_t"))
    near = interval_join(found, g, keys, "t", "from_t", "to_t", early_ms + late_ms).where(F.coalesce(F.col("scorer") == F.col("team"), F.lit(True)))
    latest = near.groupBy(*keys, "goal_t").agg(F.max(F.struct("t", "team")).alias("s")).select(*keys, "s.t", "s.team").distinct().withColumn("_goal", F.lit(True))
    return found.join(latest, [*keys, "t", "team"], "left").withColumn("outcome", F.when(F.col("_goal"), "goal").otherwise(F.col("outcome"))).drop("_goal")


def inferred_shots(goals: DataFrame, rows: DataFrame, keys: list[str], pitch: Pitch, right: Column, reach_ms: int) -> DataFrame:
    """A shot for every goal given: from the last control by the scorer in the attacking half before it, else the ball there.

    goals: t, scorer; rows: t, team, x, y. right: the scorer attacks right.
    """
    g = goals.select(*keys, F.col("t").alias("goal_t"), "scorer", (F.col("t") - reach_ms).alias("from_t"), (F.col("t") - 300).alias("to_t"))
    near = interval_join(rows.where(F.col("x").isNotNull()).select(*keys, "t", "team", "x", "y"), g, keys, "t", "from_t", "to_t", reach_ms)
    xn = F.when(right, F.col("x")).otherwise(pitch.length - F.col("x"))
    near = near.withColumn("xn", xn).where(F.col("xn") >= pitch.length / 2)
    held = F.coalesce(F.col("team") == F.col("scorer"), F.lit(False))
    near = near.where(held | (pitch.length - F.col("xn") >= 3.0))
    origin = F.max(F.struct(held.cast("int").alias("held"), "t", "x", "y"))
    found = near.groupBy(*keys, "goal_t", "scorer").agg(origin.alias("o"))
    return found.select(*keys, "goal_t", F.col("scorer").alias("team"), F.col("o.t").alias("t"), F.col("o.x").alias("x"), F.col("o.y").alias("y"), F.when(F.col("o.held") == 1, "control").otherwise("ball").alias("origin"))


def goal_categories(how: Column, start: Column, evidence: Column, raw: Column, near_frames: Column, check_frames: int) -> Column:
    """What a kick-off says: start of a half, goal, check, or no."""
    return F.when(start, "start of the half").when(how == "ball", "goal").when(evidence & raw, "goal").when(evidence & (near_frames >= check_frames), "check").otherwise("no")


def same_restarts(df: DataFrame, keys: list[str], within_ms: int) -> DataFrame:
    """Ball kick-offs soon after a goal or start, without a ball at a goal before them, become "no", in order of time.

    Rows: t, how, category, evidence (boolean). Whether one counts depends on what the one before became, so the rows
    of a match are folded as an array; they are a few dozen.
    """
    items = F.array_sort(F.collect_list(F.struct("t", "how", "category", "evidence")))
    empty = F.from_json(F.lit("[]"), "array<struct<t:bigint,category:string>>")

    def step(acc: Column, x: Column) -> Column:
        before = F.element_at(acc, -1)
        again = (F.size(acc) > 0) & (x["category"] == "goal") & (x["how"] == "ball") & ~x["evidence"] & before["category"].isin("goal", "start of the half") & (x["t"] - before["t"] < within_ms)
        return F.concat(acc, F.array(F.struct(x["t"].alias("t"), F.when(F.coalesce(again, F.lit(False)), "no").otherwise(x["category"]).alias("category"))))

    folded = df.groupBy(*keys).agg(F.aggregate(items, empty, step).alias("a"))
    return folded.select(*keys, F.inline("a"))


def scorer(side: Column, right_team: Column, kicker: Column) -> Column:
    """By the side of the goal, else the team that doesn't kick off."""
    return F.coalesce(F.when(side == "right", right_team).when(side == "left", 1 - right_team), 1 - kicker)
