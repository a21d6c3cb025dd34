"""Thresholds of the tracking operators, passed explicitly."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # Operating points of the analysed pipeline.
    min_median_det: float = 12.0
    max_fp_rate: float = 0.20
    min_unique_tracks: int = 8
    max_fallback_rate: float = 0.30
    fp_min_area: float = 900.0
    fp_max_aspect: float = 2.5
    hud_top: float = 0.10
    hud_bottom: float = 0.85
    hud_top_margin: float = 20.0
    hud_bottom_margin: float = 35.0
    head_roi: float = 0.28
    pad: float = 0.5
    chroma_min: float = 18.0
    field_dist_min: float = 25.0
    std_min: float = 4.0
    field_a: float = 92.67
    field_b: float = 156.79
    nms_iou: float = 0.70
    pose_iou: float = 0.5
    helmet_conf: float = 0.20
    helmet_iou: float = 0.12
    helmet_hit_iou: float = 0.05
    label_iou: float = 0.3
    max_gap: int = 30
    max_dist: float = 120.0
    ab_weight: float = 0.5
    quiet_rows: int = 10
    jump_factor: float = 3.0
    play_len: int = 240
    cut_mad: float = 45.0
    cut_cooldown: int = 60
    ema: float = 0.6
    hold: int = 4
    centroid_min: float = 1.5
    brightness_delta: float = 15.0
    helmet_window: int = 10
    helmet_required: int = 1
    helmet_grace: int = 15
    helmet_soft_lock: int = 7
    vote_window: int = 20
    vote_lock: int = 10
    pile_up: float = 80.0
    ocr_min: float = 0.5


P = Params()
