"""Schemas of the tables of a match. Missing values are null; t is milliseconds as an integer beside time_s."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = {"i": T.IntegerType(), "l": T.LongType(), "d": T.DoubleType(), "s": T.StringType(), "b": T.BooleanType()}


def _schema(text: str) -> T.StructType:
    """ "name:kind name:kind" as a schema."""
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in (x.split(":") for x in text.split())])


DETECTIONS = _schema("frame:i time_s:d half:i cam:s class:s conf:d x1:d y1:d x2:d y2:d x_m:d y_m:d")
BALL = _schema("frame:i time_s:d half:i x_m:d y_m:d conf:d source:s")
TEAMS = _schema("frame:i time_s:d half:i cam:s class:s conf:d x1:d y1:d x2:d y2:d x_m:d y_m:d team:i gk:i")
POSSESSION = _schema("frame:i time_s:d half:i ball_x:d ball_y:d controller_team:i possession_team:i ball_in_play:i ball_state:s")
EVENTS = _schema("time_s:d time:s half:i type:s kicking_team:i scored_by:i")
GOALS = _schema("half:i kickoff_s:d kickoff:s gap_s:d how:s category:s goal_s:d goal:s goal_time_is_rough:i side:s frames_near_goal:i scored_by_side:i scored_by_kicker:i scorer:i")
ACTIONS = _schema("type:s time_s:d time:s half:i team:i x_from:d y_from:d x_to:d y_to:d outcome:s xg:d speed_ms:d")
TRACKS = _schema("half:i time_s:d player:s team:i x_m:d y_m:d speed_ms:d source:s")
PLAYERS = _schema("half:i team:i player:s role:s first_s:d last_s:d on_pitch_min:d coverage_pct:d counted_pct:d distance_m:d distance_est_m:d dist_per_min_m:d avg_speed_ms:d top_speed_ms:d sprints:i hi_run_m:d enters_at_line:i leaves_at_line:i")
TEAM_DISTANCE = _schema("half:i team:i field_stints:i gk_stints:i m_per_player_min:i team_field_km:d per_field_player_m:i")

RESTARTS = T.ArrayType(T.StructType([T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()), T.StructField("type", T.StringType()), T.StructField("kickoff_found", T.BooleanType())]))
_HALF = T.StructType([T.StructField("start", T.StringType()), T.StructField("end", T.StringType()), T.StructField("start_s", T.DoubleType()), T.StructField("end_s", T.DoubleType())])
MATCH = T.StructType([T.StructField("name", T.StringType()), T.StructField("video", T.StringType()), T.StructField("halves", T.ArrayType(_HALF)), T.StructField("calibration", T.MapType(T.StringType(), T.StringType())), T.StructField("provisional", T.BooleanType())])
_KEYPOINT = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
PITCH = T.StructType([*(T.StructField(n, T.DoubleType()) for n in ("length_m", "width_m", "penalty_area_depth_m", "penalty_area_width_m", "centre_circle_radius_m")), T.StructField("keypoints", T.ArrayType(_KEYPOINT)), T.StructField("flip_idx", T.ArrayType(T.IntegerType()))])
_REALS = T.ArrayType(T.DoubleType())
CALIBRATION = T.StructType([T.StructField("model", T.StringType()), *(T.StructField(n, T.DoubleType()) for n in ("f", "cx", "cy")), *(T.StructField(n, _REALS) for n in ("k", "rvec", "tvec", "dist")), *(T.StructField(n, T.ArrayType(_REALS)) for n in ("K", "H"))])
_POINT = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("u", T.DoubleType()), T.StructField("v", T.DoubleType())])
_LINE = T.StructType([T.StructField("line", T.StringType()), T.StructField("u", T.DoubleType()), T.StructField("v", T.DoubleType())])
CLICKED = T.StructType([T.StructField("image", T.StringType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("points", T.ArrayType(_POINT)), T.StructField("lines", T.ArrayType(_LINE))])


def with_ms(df: DataFrame) -> DataFrame:
    """Adds t, the time in integer milliseconds, by which windows and thresholds are exact."""
    return df.withColumn("t", F.round(F.col("time_s") * 1000).cast("long"))
