"""Goals from kick-offs: what preceded each of them, its category, the goal's time and who scored.

Kick-offs, a few dozen for a match, are one row each; the ball's rows that lie before them are found by interval joins
in time buckets. Times are integer milliseconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackforge.functions.scalar import seconds_of
from trackforge.operators import islands
from trackforge.operators.actions import goal_categories, same_restarts, scorer
from trackforge.operators.nearest import asof, interval_join, nearest_in_key
from trackforge.params import Actions, Goals, Pitch
from trackforge.stored import written

MATCH = ["match_id"]
KEYS = ["match_id", "half"]
EVENT = [*KEYS, "event"]
ms = lambda seconds: int(1000 * seconds)


def merged_kickoffs(events: DataFrame, g: Goals) -> DataFrame:
    """Kick-offs that follow the first of their group by less than merge_s are that one: event (its time), at, t0, t1, how, previous.

    events: at (mean time), t0, t1, by_ball. t0, t1: of all frames of the group; previous: the event before in the half.
    """
    first = islands.spaced(events.select(*KEYS, F.col("at").cast("long").alias("at")), KEYS, "at", ms(g.merge_s))
    rows = events.withColumn("at", F.col("at").cast("long")).join(first.withColumn("_lead", F.lit(True)), [*KEYS, "at"], "left")
    own = F.last(F.when(F.col("_lead"), F.col("at")), ignorenulls=True).over(Window.partitionBy(*KEYS).orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    groups = rows.withColumn("event", own).groupBy(*EVENT).agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.bool_or("by_ball").alias("by_ball"))
    order = Window.partitionBy(*KEYS).orderBy("event")
    return groups.withColumn("how", F.when(F.col("by_ball"), "ball").otherwise("formation")).withColumn("previous", F.lag("event").over(order)).drop("by_ball")


def with_starts(kickoffs: DataFrame, halves: DataFrame | None, g: Goals) -> DataFrame:
    """Adds start: the first kick-off of a half and those within start_window_s of it, unless the half began too long before.

    halves: start (ms); without the half's start the first one always counts.
    """
    first = F.min("event").over(Window.partitionBy(*KEYS))
    rows = kickoffs.withColumn("_first", first)
    begun = F.lit(True)
    if halves is not None:
        rows, begun = rows.join(halves.select(*KEYS, F.col("start").alias("_start")), KEYS, "left"), F.coalesce(F.col("_first") - F.col("_start") < ms(g.start_s), F.lit(True))
    return rows.withColumn("start", begun & ((F.col("event") == F.col("_first")) | (F.col("event") - F.col("_first") < ms(g.start_window_s)))).drop("_first", "_start")


def at_goal(pitch: Pitch, a: Actions, g: Goals) -> tuple[Column, Column]:
    """The ball near a goal; the ball in a net, behind the line."""
    before = F.abs(F.col("y") - pitch.width / 2) <= a.goal_width / 2 + 1.5
    near = before & ((F.col("x") <= g.zone) | (F.col("x") >= pitch.length - g.zone))
    return near, before & ((F.col("x") < -g.net_margin) | (F.col("x") > pitch.length + g.net_margin))


def evidence(kickoffs: DataFrame, ball: DataFrame, pitch: Pitch, a: Actions, g: Goals) -> DataFrame:
    """For each kick-off with one the last stay of the ball at a goal before it: seen_t, side, frames_near.

    The search goes back look_back_s, but not beyond a second after the kick-off before. A stay in the net that begins
    early enough in or shortly before the stay tells the time of the goal. Stays of few frames, or too long before the
    kick-off, are chance and leave frames_near alone.
    """
    span = kickoffs.select(*EVENT, F.greatest(F.col("event") - ms(g.look_back_s), F.coalesce(F.col("previous") + 1000, F.col("event") - ms(g.look_back_s))).alias("from_t"), (F.col("event") - 1).alias("to_t"))
    near, net = at_goal(pitch, a, g)
    rows = ball.where(F.col("x").isNotNull()).select(*KEYS, "t", "x", near.alias("near"), net.alias("net")).where(F.col("near") | F.col("net"))
    rows = interval_join(rows, span, KEYS, "t", "from_t", "to_t", ms(g.look_back_s))
    close = rows.where("near")
    seen = close.groupBy(*EVENT).agg(F.count("*").alias("frames_near"), F.max_by("x", "t").alias("last_x"))
    stay = islands.last_stay(close, EVENT, "t", ms(g.stay_gap_s)).select(*EVENT, F.col("t0").alias("stay_t"))
    in_net = islands.last_stay(rows.where("net"), EVENT, "t", ms(g.net_gap_s)).select(*EVENT, F.col("t0").alias("net_t"))
    found = seen.join(stay, EVENT).join(in_net, EVENT, "left")
    goal_t = F.when(F.col("net_t") >= F.col("stay_t") - ms(g.net_early_s), F.col("net_t")).otherwise(F.col("stay_t"))
    chance = (F.col("frames_near") < g.least_frames) | (F.col("event") - goal_t > ms(g.evidence_gap_s))
    return found.select(*EVENT, "frames_near", F.when(~chance, goal_t).alias("seen_t"), F.when(~chance, F.when(F.col("last_x") < pitch.length / 2, "left").otherwise("right")).alias("side"))


def raw_sightings(kickoffs: DataFrame, candidates: DataFrame, pitch: Pitch, g: Goals) -> DataFrame:
    """For each kick-off whether enough moments have an untracked ball candidate on the spot: raw."""
    spot = candidates.where(F.hypot(F.col("x") - pitch.length / 2, F.col("y") - pitch.width / 2) <= g.raw_radius).select(*KEYS, "t").distinct()
    narrow = kickoffs.select(*EVENT, F.lit("narrow").alias("kind"), (F.col("t0") - 3000).alias("from_t"), (F.col("t1") + 1000).alias("to_t"))
    wide = kickoffs.select(*EVENT, F.lit("wide").alias("kind"), (F.col("event") - 8000).alias("from_t"), (F.col("event") + 2000).alias("to_t"))
    counted = interval_join(spot, narrow.union(wide), KEYS, "t", "from_t", "to_t", 10_000).groupBy(*EVENT).agg(F.count_if(F.col("kind") == "narrow").alias("n"), F.count_if(F.col("kind") == "wide").alias("w"))
    return counted.select(*EVENT, ((F.col("n") >= g.raw_frames) | (F.col("w") >= g.raw_wide_frames)).alias("raw"))


def kickers(kickoffs: DataFrame, players: DataFrame, pitch: Pitch, within: float = 3.0) -> DataFrame:
    """For each kick-off the team that stands nearest to the spot in most of its frames; a tie goes to the team seen first.

    players: t, x, y, team of outfield players.
    """
    spots = interval_join(players.select(*KEYS, "t").distinct(), kickoffs.select(*EVENT, "t0", "t1"), KEYS, "t", "t0", "t1", 10_000)
    spots = spots.select(*EVENT, "t", F.lit(pitch.length / 2).alias("x"), F.lit(pitch.width / 2).alias("y"), F.lit(0).alias("spot"))
    people = players.select(*KEYS, "t", "x", "y", "team").withColumn("pid", F.xxhash64("x", "y", "team"))
    near = nearest_in_key(spots.select(*KEYS, "t", "x", "y", "spot", "event"), people, [*KEYS, "t"], "spot", "pid", within=within, carry=["team"])
    votes = near.where("nearest_team in (0, 1)").groupBy(*EVENT, "nearest_team").agg(F.count("*").alias("votes"), F.min("t").alias("since"))
    return votes.groupBy(*EVENT).agg(F.max_by("nearest_team", F.struct("votes", -F.col("since"))).alias("kicker"))


def goals(events: DataFrame, ball: DataFrame, candidates: DataFrame, players: DataFrame, directions: DataFrame, pitch: Pitch, a: Actions = Actions(), g: Goals = Goals(), halves: DataFrame | None = None) -> DataFrame:
    """Every distinct kick-off with its category; those called goal are goals.

    events: at, t0, t1, by_ball of kick-offs; ball: t, x, y as tracked; candidates: t, x, y of the ball as detected;
    players: t, x, y, team of outfield players; directions: team, right; halves: start of each half (ms), if known.
    Returns half, kickoff_t, gap_ms to the kick-off before, how (ball, ball (raw), formation), category, goal_t with
    goal_time_is_rough, side, frames_near_goal, scored_by_side, scored_by_kicker, scorer.
    """
    k = written(with_starts(merged_kickoffs(events, g), halves, g))  # a few dozen rows for each match, asked four times
    k = k.join(evidence(k, ball, pitch, a, g), EVENT, "left").join(raw_sightings(k, candidates, pitch, g), EVENT, "left").join(kickers(k, players, pitch), EVENT, "left")
    k = k.join(directions.where("team = 0").select(*KEYS, F.col("right").alias("_first_right")), KEYS, "left")
    shown, near, raw = F.col("seen_t").isNotNull(), F.coalesce("frames_near", F.lit(0)), F.coalesce("raw", F.lit(False))
    category = goal_categories(F.col("how"), F.col("start"), shown, raw, near, g.check_frames)
    how = F.when(~F.col("start") & (F.col("how") != "ball") & shown & raw, "ball (raw)").otherwise(F.col("how"))
    k = written(k.select("*", category.alias("_category"), how.alias("_how")))
    again = same_restarts(k.select(*KEYS, F.col("event").alias("t"), F.col("_how").alias("how"), F.col("_category").alias("category"), shown.alias("evidence")), KEYS, ms(g.same_restart_s))
    k = k.join(again.select(*KEYS, F.col("t").alias("event"), "category"), EVENT)
    is_goal, start = F.col("category") == "goal", F.col("start")
    rough = is_goal & ~shown
    by_side = F.when(~start, scorer(F.col("side"), F.when(F.col("_first_right"), 0).otherwise(1), F.lit(None).cast("int")))
    by_side = F.when(F.col("side").isNotNull() & F.col("_first_right").isNotNull(), by_side)
    by_kicker = F.when(~start, 1 - F.col("kicker"))
    return k.select(
        *KEYS,
        F.col("event").alias("kickoff_t"),
        (F.col("event") - F.col("previous")).alias("gap_ms"),
        F.col("_how").alias("how"),
        "category",
        F.when(rough, F.col("event") - ms(g.rough_s)).otherwise(F.col("seen_t")).alias("goal_t"),
        rough.alias("goal_time_is_rough"),
        "side",
        near.alias("frames_near_goal"),
        by_side.alias("scored_by_side"),
        by_kicker.alias("scored_by_kicker"),
        F.coalesce(by_side, by_kicker).alias("scorer"),
    )


def late_goals(found: DataFrame, ball: DataFrame, halves: DataFrame, directions: DataFrame, pitch: Pitch, a: Actions = Actions(), g: Goals = Goals()) -> DataFrame:
    """Possible goals that no kick-off follows: stays of the ball in a net between the last goal or start of a half and its end.

    halves: end (ms). Returns t0, t1, n, side, scorer.
    """
    last = found.where("category in ('goal', 'start of the half')").groupBy(*KEYS).agg(F.max("kickoff_t").alias("last"))
    span = last.join(halves.select(*KEYS, "end"), KEYS).select(*KEYS, (F.col("last") + 5001).alias("from_t"), (F.col("end") + 5000).alias("to_t")).where("from_t <= to_t")
    rows = interval_join(ball.where(F.col("x").isNotNull() & at_goal(pitch, a, g)[1]).select(*KEYS, "t", "x"), span, KEYS, "t", "from_t", "to_t", 60_000)
    stays = islands.gap_sessions(rows, KEYS, "t", ms(g.net_gap_s), extra=[F.min_by("x", "t").alias("x")]).where(F.col("n") >= g.late_frames)
    stays = stays.join(directions.where("team = 0").select(*KEYS, F.when(F.col("right"), 0).otherwise(1).alias("_right")), KEYS, "left")
    side = F.when(F.col("x") < pitch.length / 2, "left").otherwise("right")
    return stays.select(*KEYS, "t0", "t1", "n", side.alias("side"), F.when(side == "right", F.col("_right")).otherwise(1 - F.col("_right")).alias("scorer"))


def manual_goals(notes: DataFrame, rows: DataFrame) -> DataFrame:
    """Goals known from elsewhere: match_id, half, goal_t (ms), scorer. notes: match_id, text such as "33:10=1,41:00=0".

    A time is [[h:]m:]s of the recording; a team is 0 or 1, none if it is left out. Parts that don't read so are left
    out. The half is that of the first of the match's rows (t, half) not before the goal, or of its last.
    """
    part = F.explode(F.split("text", ",")).alias("part")
    said = notes.select("match_id", part).select("match_id", F.trim(F.split("part", "=")[0]).alias("at"), F.get(F.split("part", "="), F.lit(1)).alias("team"))
    team = F.when(F.trim("team").isin("0", "1"), F.trim("team").cast("int"))
    goals = said.select("match_id", F.round(1000 * seconds_of(F.col("at"))).cast("long").alias("t"), team.alias("scorer"), (F.col("team").isNull() | team.isNotNull()).alias("_ok")).where(F.col("_ok") & F.col("t").isNotNull()).drop("_ok")
    moments = rows.groupBy("match_id", "t").agg(F.min("half").alias("half"))
    return asof(goals, moments, MATCH, "t", ["half"], forward=True, clamp=True).select(*KEYS, F.col("t").alias("goal_t"), "scorer")


def with_manual(found: DataFrame, manual: DataFrame) -> DataFrame:
    """The goals found, with manual ones added as goals of the match: all other columns of theirs are null but how."""
    mine = manual.select(*KEYS, F.lit("manual").alias("how"), F.lit("goal").alias("category"), "goal_t", F.lit(False).alias("goal_time_is_rough"), "scorer")
    return found.unionByName(mine, allowMissingColumns=True)
