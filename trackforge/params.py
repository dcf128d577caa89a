"""Thresholds of every step, with the defaults of football recorded at 15 frames a second."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Pitch:
    length: float = 56.0
    width: float = 32.36
    penalty_depth: float = 9.0
    penalty_width: float = 19.64
    centre_radius: float = 4.75
    goal_width: float = 5.0


@dataclass(frozen=True)
class Detect:
    confidence: float = 0.1
    stride: int = 2
    margin: float = 1.0
    ball_margin: float = 2.0
    merge_distance: float = 2.5
    max_balls: int = 3


@dataclass(frozen=True)
class Ball:
    max_speed: float = 30.0
    gate: float = 1.5
    near: float = 3.0
    acquire_confidence: float = 0.3
    switch_margin: float = 0.25
    switch_s: float = 0.4
    lost_s: float = 1.5
    interpolate_s: float = 1.0
    cell: float = 0.5
    spot_share: float = 0.15
    far: float = 3.0


@dataclass(frozen=True)
class Possession:
    control: float = 1.5
    switch_s: float = 0.3
    reset_s: float = 2.0
    out_margin: float = 1.0
    out_min_s: float = 1.0
    still_s: float = 2.0
    still_radius: float = 1.0
    window_s: float = 60.0


@dataclass(frozen=True)
class Actions:
    goal_width: float = 5.0
    shot_speed: float = 6.0
    shot_range: float = 32.0
    pass_distance: float = 4.0
    pass_speed: float = 5.0
    player_control: float = 1.5
    pass_gap: float = 3.0
    fly_speed: float = 7.0
    big_chance: float = 0.25
    bridge_s: float = 0.4
    touch_s: float = 0.2


@dataclass(frozen=True)
class Stats:
    sequence_s: float = 1.0
    bridge_s: float = 0.3
    recovery_s: float = 3.0


@dataclass(frozen=True)
class Tracks:
    team_size: int = 6
    acceleration: float = 6.0
    noise: float = 0.6
    top_speed: float = 9.0
    lost_s: float = 2.0
    gate: float = 2.5
    gate_speed: float = 6.0
    gate_most: float = 9.0
    hits: int = 3
    tentative_s: float = 0.2
    double_distance: float = 2.0
    stitch_s: float = 4.0
    stitch_base: float = 1.6
    stitch_most: float = 14.0
    smooth_s: float = 1.0
    interpolate_s: float = 2.0
    sprint: float = 5.5
    sprint_s: float = 1.0
    intense: float = 4.0
    change_s: float = 0.5
    change_depth: float = 1.5
    change_at_any_line: bool = False
    keeper_zone: float = 8.0
    least_s: float = 1.0
    overlap_s: float = 2.0


@dataclass(frozen=True)
class Halves:
    step: float = 2.0
    players: int = 8
    gap: float = 30.0
    segment: float = 300.0
    smooth: int = 5


@dataclass(frozen=True)
class Goals:
    merge_s: float = 15.0
    same_restart_s: float = 45.0
    start_window_s: float = 60.0
    start_s: float = 90.0
    look_back_s: float = 90.0
    zone: float = 3.0
    stay_gap_s: float = 3.0
    net_margin: float = 0.5
    net_early_s: float = 8.0
    net_gap_s: float = 6.0
    raw_frames: int = 6
    raw_wide_frames: int = 10
    raw_radius: float = 1.5
    check_frames: int = 10
    late_frames: int = 4
    rough_s: float = 15.0
    least_frames: int = 3
    evidence_gap_s: float = 40.0
