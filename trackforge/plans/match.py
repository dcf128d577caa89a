"""The chain for matches: from detections with teams and ball candidates to possession, figures and actions.

All matches go through together, partitioned by match and half. Tables that several others read (teams, ball, possession,
directions, kick-offs, goals, tracks) are written in between; the others are lazy.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackforge.functions.scalar import mirrored, on_upper_body
from trackforge.operators import actions, goals, islands, kickoff_teams, kickoffs, measures, nearest, report, shots, smoothing, stateful, windows
from trackforge.operators import ball as ball_operators
from trackforge.operators import players as player_operators
from trackforge.params import Actions, Ball, Goals, Pitch, Possession, Stats, Tracks
from trackforge.stored import written

KEYS = ["match_id", "half"]


@dataclass(frozen=True)
class Settings:
    pitch: Pitch = field(default_factory=Pitch)
    ball: Ball = field(default_factory=Ball)
    possession: Possession = field(default_factory=Possession)
    stats: Stats = field(default_factory=Stats)
    actions: Actions = field(default_factory=Actions)
    goals: Goals = field(default_factory=Goals)
    tracks: Tracks = field(default_factory=Tracks)
    frame_rate: float = 15.0
    kits: kickoff_teams.Kits = field(default_factory=kickoff_teams.Kits)


def without_spares(candidates: DataFrame, rows: DataFrame, s: Settings) -> DataFrame:
    """Candidates without those that lie where, in a large share of a match's frames, one lies far from everybody.

    A candidate at such a spot stays if somebody is within control of it.
    """
    b, moment = s.ball, F.struct("half", "frame")
    around = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    cells = candidates.withColumn("cx", F.floor(F.col("x") / b.cell)).withColumn("cy", F.floor(F.col("y") / b.cell))
    alone = cells.where(F.coalesce(F.col("distance"), F.lit(1e9)) > b.far).groupBy("match_id", "cx", "cy").agg(F.countDistinct(moment).alias("k"))
    total = rows.groupBy("match_id").agg(F.countDistinct(moment).alias("frames"))
    spots = alone.join(total, "match_id").where(F.col("k") >= b.spot_share * F.col("frames"))
    spots = spots.select("match_id", "cx", "cy", around.alias("dx")).select("match_id", "cx", "cy", "dx", around.alias("dy")).select("match_id", (F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy")).distinct()
    marked = cells.join(spots.withColumn("_spot", F.lit(True)), ["match_id", "cx", "cy"], "left")
    return marked.where(F.col("_spot").isNull() | F.coalesce(F.col("distance") < s.possession.control, F.lit(False))).drop("_spot", "cx", "cy")


def ball_track(detections: DataFrame, s: Settings) -> DataFrame:
    """The ball at each frame: candidates not on bodies and not lying spare, tracked, and interpolated over short gaps."""
    rows = detections.select(*KEYS, "frame", "t", "cam", "class", "conf", "x1", "y1", "x2", "y2", F.col("x_m").alias("x"), F.col("y_m").alias("y"))
    candidates = rows.where("class = 'ball'").withColumn("id", F.xxhash64("frame", "x", "y", "conf"))
    people = rows.where("class <> 'ball'").withColumn("person_id", F.xxhash64("frame", "x", "y"))
    on_body = on_upper_body((F.col("l.x1") + F.col("l.x2")) / 2, (F.col("l.y1") + F.col("l.y2")) / 2, [F.col(f"r.{c}") for c in ("x1", "y1", "x2", "y2")])
    candidates = nearest.overlapping(candidates, people, [*KEYS, "frame", "cam"], on_body, "left_anti")
    near = nearest.nearest_in_key(candidates, people, [*KEYS, "frame"], "id", "person_id")
    near = without_spares(near, rows, s)
    path = ball_operators.track_ball(near.select(*KEYS, "frame", "t", "x", "y", F.col("conf").alias("confidence"), F.col("distance").alias("person")), KEYS, s.ball)
    frames = rows.groupBy(*KEYS, "frame").agg(F.min("t").alias("t"))
    known = frames.join(path, [*KEYS, "frame"], "left")
    return windows.filled(known, KEYS, "frame", "t", ["x", "y"], int(1000 * s.ball.interpolate_s))


def possession(ball: DataFrame, players: DataFrame, s: Settings, restarts: DataFrame | None = None) -> DataFrame:
    """ball with controller, possession and state of every frame. players: team; restarts: start, end."""
    p = s.possession
    people = players.select(*KEYS, "frame", "team", F.col("x_m").alias("x"), F.col("y_m").alias("y")).withColumn("pid", F.xxhash64("frame", "x", "y"))
    seen = nearest.nearest_in_key(ball, people, [*KEYS, "frame"], "t", "pid", within=p.control, carry=["team"])
    beyond = (F.col("x") < -p.out_margin) | (F.col("x") > s.pitch.length + p.out_margin) | (F.col("y") < -p.out_margin) | (F.col("y") > s.pitch.width + p.out_margin)
    state = F.when(F.col("x").isNotNull(), F.when(beyond, "o").otherwise("i"))
    outs = islands.outside_runs(ball, KEYS, "frame", "t", state, int(1000 * p.out_min_s), ended="ended")
    still = stateful.still_ball(ball.select(*KEYS, "frame", "t", "x", "y").withColumn("h", F.col("half")), ["match_id"], 1000 * p.still_s, p.still_radius, 1000).withColumn("still", F.lit(True))
    # A run that ends at a row inside doesn't hold it; one that nothing ends holds its last row.
    outs = outs.withColumn("t1", F.col("t1") - F.col("ended").cast("int"))
    out_rows = nearest.interval_join(ball.select(*KEYS, "frame", "t"), outs, KEYS, "t", "t0", "t1", 10_000, "left_semi").select(*KEYS, "frame").withColumn("out", F.lit(True))
    rows = seen.join(out_rows, [*KEYS, "frame"], "left").join(still, ["match_id", "frame"], "left")
    restart = F.lit(False)
    if restarts is not None:
        again = nearest.interval_join(ball.select(*KEYS, "frame", "t"), restarts, KEYS, "t", "start", "end", 30_000, "left_semi").select(*KEYS, "frame").withColumn("restart", F.lit(True))
        rows, restart = rows.join(again, [*KEYS, "frame"], "left"), F.coalesce("restart", F.lit(False))
    out, lying = F.coalesce("out", F.lit(False)), F.coalesce("still", F.lit(False))
    ball_state = F.when(F.col("x").isNotNull(), F.when(out, "out").when(lying, "still").when(restart, "restart").otherwise("play"))
    rows = rows.select(*KEYS, "frame", "t", "x", "y", ball_state.alias("ball_state"), (out | lying | restart).alias("dead"), F.col("x").isNotNull().alias("ball"), F.col("nearest_team").alias("controller"))
    held = stateful.possession(rows, KEYS, p)
    return rows.select(*KEYS, "frame", "t", "x", "y", "ball_state").join(held, [*KEYS, "frame"])


def kickoff_events(ball: DataFrame, players: DataFrame, s: Settings) -> DataFrame:
    """Kick-offs by the ball that lies on the spot between two teams, or by a formation in which nobody moves."""
    on_pitch = F.col("x_m").between(0, s.pitch.length) & F.col("y_m").between(0, s.pitch.width)
    people = players.where((F.col("class") == "player") & on_pitch).select(*KEYS, "t", F.col("x_m").alias("x"), F.col("y_m").alias("y"))
    key = [*KEYS, "t"]
    by_ball = kickoffs.ball_on_spot(ball, KEYS, "t", s.pitch).select(*key).join(kickoffs.two_sides(people, key, s.pitch), key, "left_semi")
    formed = kickoffs.calm(kickoffs.formation_frames(people, key, s.pitch).select(*key), people, KEYS, "t")
    marks = by_ball.withColumn("by_ball", F.lit(True)).union(formed.join(by_ball, key, "left_anti").select(*key, F.lit(False)))
    return kickoffs.events(marks, KEYS, "t")


def learnt_teams(ball: DataFrame, players: DataFrame, s: Settings) -> dict[str, DataFrame]:
    """Teams of players that have a colour each but no team, from the kick-offs; decisions on these and the sides of the teams.

    Referees and players of neither team are none of team 0 and 1.
    """
    kicked = kickoff_events(ball, players, s).select(*KEYS, F.col("at").cast("long").alias("event"), "by_ball", "t0", "t1")
    rows = players.where("class = 'player'").withColumn("x", F.col("x_m")).withColumn("keeper", F.coalesce(F.col("gk").cast("boolean"), F.lit(False)))
    found = kickoff_teams.teams_by_kits(rows, kicked, s.kits, s.pitch)
    return found | {"teams": found["teams"].drop("x", "keeper")}


def goal_events(detections: DataFrame, ball: DataFrame, players: DataFrame, directions: DataFrame, kicked: DataFrame, s: Settings, halves: DataFrame | None = None) -> dict[str, DataFrame]:
    """Goals from the kick-offs found, and with the halves' ends possible goals that none follows."""
    raw = detections.where("class = 'ball'").select(*KEYS, "t", F.col("x_m").alias("x"), F.col("y_m").alias("y"))
    outfield = players.where("class = 'player' and team in (0, 1) and not coalesce(cast(gk as boolean), false)").select(*KEYS, "t", F.col("x_m").alias("x"), F.col("y_m").alias("y"), "team")
    found = written(goals.goals(kicked, ball, raw, outfield, directions, s.pitch, s.actions, s.goals, halves))
    out = {"goals": found}
    if halves is not None:
        out["late_goals"] = goals.late_goals(found, ball, halves, directions, s.pitch, s.actions, s.goals)
    return out


def player_tracks(players: DataFrame, s: Settings) -> DataFrame:
    """Every player's detections with track, chain and place in the team."""
    rows = players.where("class = 'player'").select(*KEYS, "t", F.col("x_m").alias("x"), F.col("y_m").alias("y"), "team", F.col("gk").cast("boolean").alias("keeper"))
    return player_operators.track_players(rows, KEYS, s.tracks, s.pitch)


def figures(held: DataFrame, s: Settings) -> dict[str, DataFrame]:
    """Shares, thirds, sequences and recoveries for each half and for the match."""
    at = held.withColumn("team", F.col("possession"))
    sequences = islands.possession_sequences(at, KEYS, "frame", "t", "team", int(1000 * s.stats.sequence_s), int(1000 * s.stats.bridge_s))
    share = measures.by_scope(held, "match_id", "half", [], [measures.percent(F.col("possession") == 0, F.col("possession").isNotNull()).alias("team_0_percent"), measures.percent(F.col("possession").isNotNull()).alias("assigned_percent")])
    return {"share": share, "sequences": sequences, "recoveries": islands.recoveries(sequences, KEYS, "team", int(1000 * s.stats.recovery_s))}


def zones(held: DataFrame, directions: DataFrame, s: Settings) -> DataFrame:
    """Thirds of possession by team. directions: team, right."""
    at = held.where(F.col("possession").isNotNull() & F.col("x").isNotNull()).withColumn("team", F.col("possession"))
    xn = mirrored(F.col("x"), F.col("right"), s.pitch.length)
    return measures.by_scope(at.join(directions, [*KEYS, "team"]).withColumn("xn", xn), "match_id", "half", ["team"], measures.thirds(F.col("xn"), s.pitch.length))


def played(held: DataFrame, directions: DataFrame, tracks: DataFrame, found: DataFrame, s: Settings) -> dict[str, DataFrame]:
    """Passes and shots from control segments, and passes from touches of tracked players.

    directions: team, right; found: kick-offs with category, goal_t and scorer, whose goals are shots too.
    """
    a = s.actions
    paced = windows.fitted_speed(held, ["match_id"], "frame", "t", "x", "y")
    control = paced.withColumn("team", F.when(F.coalesce(F.col("speed") <= a.fly_speed, F.lit(True)), F.col("controlled_by")))
    segments = islands.control_segments(control, KEYS, "frame", "t", "team", int(1000 * a.bridge_s), int(1000 * a.touch_s))
    flown = actions.flights(segments, held.select(*KEYS, "frame", "x", "y"), KEYS, int(1000 * a.pass_gap))
    flown = flown.join(directions, [*KEYS, "team"])
    outs = held.where("ball_state = 'out' and x is not null").select(*KEYS, "t", "x", "y")
    touches = actions.player_touches(actions.player_control(paced, tracks, KEYS, a), KEYS, int(1000 * a.bridge_s))
    touched = actions.touch_passes(touches, held.select(*KEYS, "frame", "x", "y"), KEYS, a, 0.05, int(1000 * a.pass_gap), outs)
    scored = found.where("category = 'goal' and goal_t is not null").select(*KEYS, F.col("goal_t").alias("t"), "scorer")
    taken = shots.all_shots(segments, held, scored, directions, KEYS, a, s.pitch)
    return {"touch_passes": touched, "passes": actions.passes(flown, outs, KEYS, a, s.pitch, F.col("right"), 0.05, int(1000 * a.pass_gap)), "shots": taken}


def analyse(detections: DataFrame, players: DataFrame, s: Settings = Settings(), restarts: DataFrame | None = None, halves: DataFrame | None = None) -> dict[str, DataFrame]:
    """All tables of the chain. detections as read; players: detections of players with their team; halves: start, end (ms).

    Players with a colour (array) and no team get their teams from the kick-offs; how comes back as kit_decisions and sides.
    """
    ball = written(ball_track(detections, s))
    learnt = {}
    if "team" not in players.columns:
        found = learnt_teams(ball, players, s)
        players = written(found["teams"])
        learnt = {"teams": players, "kit_decisions": found["decisions"], "sides": found["sides"]}
    held = written(possession(ball, players, s, restarts))
    outfield = players.where("class = 'player' and team in (0, 1)").withColumn("x", F.col("x_m"))
    directions = written(measures.attack_directions(outfield, KEYS, "team", "x"))
    kicked = written(kickoff_events(ball, players, s))
    tracks = written(player_tracks(players, s))
    goal_tables = goal_events(detections, ball, players, directions, kicked, s, halves)
    out = {**learnt, "ball": ball, "possession": held, "directions": directions, "kickoffs": kicked, **goal_tables, "tracks": tracks, "substitutes": player_operators.substitutes(tracks, KEYS, s.tracks, s.pitch), "zones": zones(held, directions, s), **figures(held, s), **played(held, directions, tracks, goal_tables["goals"], s)}
    people = players.where("class = 'player'").select(*KEYS, "frame", F.col("x_m").alias("x"), F.col("y_m").alias("y"), "team", F.col("gk").cast("boolean").alias("keeper"))
    step = 1 / s.frame_rate
    paced = smoothing.smooth_tracks(tracks.where("slot is not null").select(*KEYS, F.col("slot_team").alias("team"), "slot", "t", "x", "y"), [*KEYS, "team", "slot"], step, s.tracks)
    moved = paced.where("valid").select(*KEYS, "team", (F.col("speed") * step).alias("metres"))
    return out | {"report": report.report({**out, "players": people, "moved": moved}, s.pitch, s.actions)}
