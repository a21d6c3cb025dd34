"""Schemas of the detection table and its companions."""

from pyspark.sql import DataFrame

IR = (
    "clip_id string, frame bigint, track_id bigint, x1 double, y1 double, x2 double, y2 double, conf double, mask_ref string, "
    "mask_is_fallback boolean, feat_lab6d array<double>, torso_px bigint, kpts array<array<double>>, helmet_hits int, ocr_num int, "
    "ocr_conf double, is_cut_frame boolean, team int"
)
ANNOTATIONS = "frame bigint, track_id bigint, predicted_team string, correct_team string, x1 double, y1 double, x2 double, y2 double"
ZERODET = "frame bigint, path string, raw_boxes int, field_mask string, frame_h int, band array<double>, box_cy array<double>"
HOMOGRAPHY = "H array<array<double>>, template_w int, template_h int"
#: Columns that a detection table must have to be judged.
REQUIRED = (
    "clip_id", "frame", "track_id", "x1", "y1", "x2", "y2", "conf", "mask_ref", "mask_is_fallback", "feat_lab6d", "torso_px", "helmet_hits",
    "is_cut_frame", "team",
)


def missing_columns(df: DataFrame, required=REQUIRED) -> list[str]:
    """Required columns that df lacks, in order."""
    return sorted(set(required) - set(df.columns))
