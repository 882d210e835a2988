"""Constants of the analysis. Columns built from them are literals that Catalyst folds."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """Fixed values of the rules; a frame count is in frames, a distance in pixels, an angle in degrees."""

    net_y_ratio: float = 0.46
    rally_gap_sec: float = 3.0
    # spike cleaning
    warmup: int = 25
    detour: float = 2.5
    detour_warmup: float = 5.0
    speed_ratio: float = 4.0
    speed_ratio_warmup: float = 6.0
    speed_extreme: float = 12.0
    longest_spike: int = 3
    # impulse scores
    skip_angle: float = 15.0
    apex_up: float = 2.0
    apex_down: float = 2.0
    apex_horizontal: float = 4.0
    downward_turn: float = 10.0
    downward_bonus: float = 1.5
    wrist_floor_bypass: float = 100.0
    # peaks
    fence_iqr: float = 3.0
    peak_threshold_ratio: float = 0.15
    prominence: float = 1.0
    nms_frames: int = 9
    # crossings
    cooldown: int = 15
    crossing_lookback: int = 60
    fault_tolerance: float = 2.0
    # pose
    wrist_reach: float = 150.0
    rescue_reach: float = 120.0
    wrist_conf: float = 0.25
    foot_conf: float = 0.3
    near_miss: tuple[float, float] = (0.05, 0.149)
    rescue_band: tuple[float, float] = (0.05, 0.13)
    position_band: float = 0.12
    # minimap and court view
    minimap_w: int = 360
    minimap_h: int = 600
    pad: int = 20
    court_margin: float = 30.0
    trail: int = 30
    ghost: int = 3
    shift_ratio: float = 0.4
    shift_px: float = 400.0
    bone_scale: float = 1.2


CONFIG = Config()

# A badminton court in metres, x from the left doubles line, y from the near end.
COURT_WIDTH, COURT_LENGTH = 6.10, 13.40
SINGLES_LEFT, SINGLES_RIGHT, NET_Y, END_FAR, END_NEAR = 0.46, 5.64, 6.70, 13.40, 0.00
COURT_X = {"doubles_left": 0.00, "singles_left": 0.46, "center": 3.05, "singles_right": 5.64, "doubles_right": 6.10}
COURT_Y = {
    "end_near": 0.00,
    "back_service_near": 0.76,
    "short_service_near": 4.72,
    "net": 6.70,
    "short_service_far": 8.68,
    "back_service_far": 12.64,
    "end_far": 13.40,
}
# Where the court's corners are in a frame, as shares, if no corners are given.
CORNER_SHARES = ((0.28, 0.46), (0.72, 0.46), (0.85, 0.97), (0.15, 0.97))
# Bones of a COCO-17 skeleton as pairs of key points counted from 1.
BONES = ((16, 14), (14, 12), (17, 15), (15, 13), (12, 13), (6, 12), (7, 13), (6, 7), (6, 8), (7, 9), (8, 10), (9, 11))
