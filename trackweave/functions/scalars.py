"""Scalar operators as SQL expressions over a detection's columns; they stay inside whole-stage codegen."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import P


def truncated(x: str) -> str:
    """Towards zero, as an integer."""
    return f"CAST(CASE WHEN {x} >= 0 THEN floor({x}) ELSE ceil({x}) END AS BIGINT)"


def rounded(x: str, digits: int) -> str:
    """Half up, alike in all engines."""
    scale = float(10**digits)
    return f"(CAST(floor(({x}) * {scale} + 0.5) AS DOUBLE) / {scale})"


def area(b: str = "") -> str:
    return f"(({b}x2 - {b}x1) * ({b}y2 - {b}y1))"


def overlap(a: str, b: str) -> str:
    w = f"greatest(0.0, least({a}x2, {b}x2) - greatest({a}x1, {b}x1))"
    h = f"greatest(0.0, least({a}y2, {b}y2) - greatest({a}y1, {b}y1))"
    return f"({w} * {h})"


def iou(a: str, b: str, mode: str = "plain") -> str:
    """Intersection over union of boxes with column prefixes a and b.

    plain: zero where the union is not positive; guarded: the union counts as one at least.
    """
    common = overlap(a, b)
    union = f"({area(a)} + {area(b)} - {common})"
    if mode == "guarded":
        return f"({common} / greatest(1.0, {union}))"
    return f"(CASE WHEN {union} <= 0 THEN 0.0 ELSE {common} / {union} END)"


def box_fill_score(fill: str) -> str:
    """Score of a mask that fills so much of its box."""
    return f"({fill} / (2 - {fill}))"


FOOT_X, FOOT_Y = "((x1 + x2) / 2)", "y2"


def projected(h: list[list[float]], x: str = FOOT_X, y: str = FOOT_Y) -> tuple[str, str]:
    """Point through a 3x3 homography; null where the scale vanishes."""
    q = [f"({r[0]!r} * {x} + {r[1]!r} * {y} + {r[2]!r})" for r in h]
    return tuple(f"(CASE WHEN abs({q[2]}) < 1e-9 THEN NULL ELSE {q[i]} / {q[2]} END)" for i in (0, 1))


def projected_inside(h: list[list[float]], width: float, height: float) -> tuple[str, str]:
    """As projected, and null outside the template with its margins."""
    x, y = projected(h)
    inside = f"{x} > -100 AND {x} < {width + 100} AND {y} > -50 AND {y} < {height + 50}"
    return f"(CASE WHEN {inside} THEN {x} END)", f"(CASE WHEN {inside} THEN {y} END)"


GATE = {"w": "greatest(x2 - x1, 0.0)", "h": "greatest(y2 - y1, 1.0)"}
GATE |= {"area": f"({GATE['w']} * {GATE['h']})", "aspect": f"({GATE['w']} / {GATE['h']})"}
GATE_FP = f"({GATE['area']} < {P.fp_min_area} OR {GATE['aspect']} > {P.fp_max_aspect})"
BROADCAST = {"area": f"greatest(0.0, {area()})", "aspect": "((x2 - x1) / greatest(1.0, y2 - y1))"}
HEAD_ROI = {
    "hx1": "x1", "hy1": "y1", "hx2": "x2",
    "hy2": f"(y1 + greatest(1, {truncated(f'({P.head_roi} * (y2 - y1))')}))",
}
MIN_MASK = truncated("greatest(400.0, 0.2 * greatest(1.0, (x2 - x1) * (y2 - y1)))")
CHROMA = "greatest(abs(feat_a - 128), abs(feat_b - 128))"
FIELD_DIST = f"sqrt((feat_a - {P.field_a}) * (feat_a - {P.field_a}) + (feat_b - {P.field_b}) * (feat_b - {P.field_b}))"
WEIGHT = "(conf * greatest(1, torso_px))"
QUALITY = "(conf * torso_px / 500.0)"
POSITIVES_BIN = "CASE WHEN n = 0 THEN 'none' WHEN n <= 2 THEN 'few' WHEN n <= 6 THEN 'mid' ELSE 'many' END"
SIZE_BUCKET = "CASE WHEN area < 1024 THEN 'small' WHEN area < 9216 THEN 'medium' ELSE 'large' END"
AREA_BUCKET = "CASE WHEN area < 2000 THEN 'lt2000' WHEN area < 8000 THEN '2000_8000' ELSE 'ge8000' END"
RAW_BUCKET = "CASE WHEN n = 0 THEN '0' WHEN n <= 2 THEN '1-2' WHEN n <= 4 THEN '3-4' ELSE '5+' END"
TEAM_COLOUR = "CASE team WHEN 0 THEN 'blue' WHEN 1 THEN 'red' WHEN -2 THEN 'yellow' ELSE 'grey' END"
CAUSE = (
    "CASE WHEN raw_boxes <= 2 THEN 'SparseRaw' WHEN center_eaten THEN 'CenterEaten' WHEN transient THEN 'Transient' "
    "WHEN narrow_band THEN 'NarrowBand' ELSE 'LegitHUD' END"
)
WHOLE_BOX_HUD = f"(y2 <= {P.hud_top} * frame_h OR y1 >= {P.hud_bottom} * frame_h)"


def hud_limits(extra_top: float = 0.0, extra_bottom: float = 0.0) -> tuple[str, str]:
    """Upper and lower limit of the play area: from the field mask's rows where it has some, else shares of the height."""
    top = f"CASE WHEN mask_bottom > mask_top THEN greatest(0.0, mask_top - {P.hud_top_margin + extra_top}) ELSE {P.hud_top} * frame_h END"
    bottom = f"CASE WHEN mask_bottom > mask_top THEN least(frame_h * 1.0, mask_bottom + {P.hud_bottom_margin + extra_bottom}) ELSE {P.hud_bottom} * frame_h END"
    return top, bottom


VALID_FEATURE = (
    f"(NOT mask_is_fallback AND feat_a IS NOT NULL AND {CHROMA} >= {P.chroma_min} AND {FIELD_DIST} >= {P.field_dist_min} "
    f"AND feat_sa + feat_sb >= {P.std_min})"
)
REFEREE = (
    f"CASE WHEN {CHROMA} > 18 THEN false WHEN feat_sa + feat_sb < 12 THEN false WHEN locked AND margin >= 1.0 THEN false "
    "WHEN (x2 - x1) / greatest(1.0, y2 - y1) < 1.35 THEN false WHEN torso_px > 2500 THEN false ELSE true END"
)
WARMUP_REASON = (
    "CASE WHEN conf < (CASE WHEN helmet THEN 0.30 WHEN fails >= 2 THEN 0.38 ELSE 0.45 END) THEN 'low_conf' WHEN torso_px < 400 THEN 'small_mask' "
    "WHEN upper_px < 50 THEN 'few_upper_pixels' WHEN NOT helmet AND field_overlap < 0.25 THEN 'not_on_field' ELSE 'ok' END"
)
MASK_REASON = (
    f"CASE WHEN mask_area < min_area THEN concat('area<', CAST(min_area AS STRING)) WHEN {box_fill_score('fill')} < 0.65 THEN 'iou<0.65' "
    "WHEN points < 3 THEN 'bad_polygon' ELSE 'ok' END"
)


def add(df: DataFrame, **columns: str) -> DataFrame:
    return df.withColumns({k: F.expr(v) for k, v in columns.items()})
