"""Registered queries of the tracking operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import schema
from .functions import scalars as S
from .operators import aggregates as A
from .operators import clustering, gates, greedy, quantiles, scans
from .operators import relational as R
from .operators import windows as W
from .params import P
from .plans import pass2
from .sources import frames as containers
from .sources import readers, sinks
from .sources.fixture import DET_SQL, FEAT_SQL, FRAME_H, FRAME_W, detections, with_features
from .streaming import online, teams
from .tables import materialize, new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
FLAGSHIP = "pass2_routes"
HOMOGRAPHY = [[0.9, 0.05, 20.0], [0.02, 0.8, 15.0], [0.00001, 0.00002, 1.0]]
FACTOR = 1.5


def query(name: str, sql: str | None = None, features: bool = False, recursive: bool = False):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            body = sql.strip()
            head = f"WITH {'RECURSIVE ' if recursive else ''}{DET_SQL}{FEAT_SQL if features else ''}"
            SQL[name] = head + (", " + body[5:] if body.upper().startswith("WITH ") else "\n" + body)
        return f

    return keep


def scalar(name: str, out: dict[str, str], pre: dict[str, str] | None = None, where: str | None = None, features: bool = False) -> None:
    """A query of expressions over detections. The SQL is FORMULAS[name] over the same inputs (pre), written apart from the expressions."""
    pre = pre or {}
    base = "detf" if features else "det"
    inner = ", ".join(["*", *[f"{v} AS {k}" for k, v in pre.items()]])
    sql = f"WITH pre AS (SELECT {inner} FROM {base}) SELECT event_id, {FORMULAS[name]}"

    @query(name, sql, features)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = with_features(spark, sf) if features else detections(spark, sf)
        rows = rows.selectExpr("*", *[f"{v} AS {k}" for k, v in pre.items()])
        return (rows.filter(where) if where else rows).selectExpr("event_id", *[f"{v} AS {k}" for k, v in out.items()])


def _h6(x: str) -> str:
    return f"floor(({x}) * 1000000 + 0.5) / 1000000"


_CHROMATIC = "greatest(abs(feat_a - 128), abs(feat_b - 128))"
_TO_FIELD = "sqrt(power(feat_a - 92.67, 2) + power(feat_b - 156.79, 2))"
_SCALE = "(0.00001 * fx + 0.00002 * fy + 1.0)"
_FEET = "FROM (SELECT *, (x1 + x2) / 2 AS fx, y2 AS fy FROM pre) AS f"
_PROJECTED = [f"(0.9 * fx + 0.05 * fy + 20.0) / {_SCALE}", f"(0.02 * fx + 0.8 * fy + 15.0) / {_SCALE}"]
_IN_COURT = f"{_PROJECTED[0]} > -100 AND {_PROJECTED[0]} < 1100 AND {_PROJECTED[1]} > -50 AND {_PROJECTED[1]} < 450"
_BAND_TOP = "if(mask_bottom > mask_top, greatest(mask_top - {0}, 0), 72)"
_BAND_END = "if(mask_bottom > mask_top, least(mask_bottom + {0}, 720), 612)"
_MIDDLE = [f"({c} + {d}) / 2 / {n}.0" for c, d, n in (("x1", "x2", FRAME_W), ("y1", "y2", FRAME_H))]
#: SQL of the scalar queries, from the formulas and not from the expressions that Spark runs.
FORMULAS = {
    "prj01_gate_geometry": "w, h, w * h AS area, w / h AS aspect FROM (SELECT event_id, if(x2 > x1, x2 - x1, 0) AS w, if(y2 - y1 > 1, y2 - y1, 1) AS h FROM pre) AS b",
    "prj02_broadcast_geometry": "if((x2 - x1) * (y2 - y1) > 0, (x2 - x1) * (y2 - y1), 0) AS area, (x2 - x1) / if(y2 - y1 > 1, y2 - y1, 1) AS aspect FROM pre",
    "prj03_foot": "fx AS foot_x, fy AS foot_y " + _FEET,
    "prj04_projection": f"if(abs({_SCALE}) < 1e-9, NULL, {_h6(_PROJECTED[0])}) AS court_x, if(abs({_SCALE}) < 1e-9, NULL, {_h6(_PROJECTED[1])}) AS court_y {_FEET}",
    "prj05_projection_inside": f"if({_IN_COURT}, {_h6(_PROJECTED[0])}, NULL) AS court_x, if({_IN_COURT}, {_h6(_PROJECTED[1])}, NULL) AS court_y {_FEET}",
    "prj07_head_roi": "x1 AS hx1, y1 AS hy1, x2 AS hx2, y1 + greatest(1, trunc(0.28 * (y2 - y1))) AS hy2 FROM pre",
    "prj09_padded_box": f"""CAST(greatest(0, trunc(x1) - trunc((x2 - x1) / 2)) AS BIGINT) AS px1, CAST(greatest(0, trunc(y1) - trunc((y2 - y1) / 2)) AS BIGINT) AS py1,
 CAST(least({FRAME_W}, trunc(x2) + trunc((x2 - x1) / 2)) AS BIGINT) AS px2, CAST(least({FRAME_H}, trunc(y2) + trunc((y2 - y1) / 2)) AS BIGINT) AS py2 FROM pre""",
    "prj10_min_mask_area": "CAST(trunc(greatest(400, greatest(1, (x2 - x1) * (y2 - y1)) / 5)) AS BIGINT) AS min_area FROM pre",
    "prj11_normalised_box": f"{_h6(_MIDDLE[0])} AS cx, {_h6(_MIDDLE[1])} AS cy, {_h6(f'(x2 - x1) / {FRAME_W}.0')} AS bw, {_h6(f'(y2 - y1) / {FRAME_H}.0')} AS bh FROM pre WHERE x1 < {FRAME_W} AND y1 < {FRAME_H} AND x1 + x2 <= {2 * FRAME_W} AND y1 + y2 <= {2 * FRAME_H}",
    "prj12_positives_bin": "['none', 'few', 'few', 'mid', 'mid', 'mid', 'mid', 'many', 'many', 'many'][n + 1] AS bin FROM pre",
    "prj13_size_bucket": "if((x2 - x1) * (y2 - y1) < 32 * 32, 'small', if((x2 - x1) * (y2 - y1) < 96 * 96, 'medium', 'large')) AS bucket FROM pre",
    "prj14_area_bucket": "if((x2 - x1) * (y2 - y1) >= 8000, 'ge8000', if((x2 - x1) * (y2 - y1) >= 2000, '2000_8000', 'lt2000')) AS bucket FROM pre",
    "prj15_raw_bucket": "['0', '1-2', '1-2', '3-4', '3-4', '5+', '5+', '5+'][n + 1] AS bucket FROM pre",
    "prj16_hud_cause": "coalesce(if(raw_boxes <= 2, 'SparseRaw', NULL), if(center_eaten, 'CenterEaten', NULL), if(transient, 'Transient', NULL), if(narrow_band, 'NarrowBand', NULL), 'LegitHUD') AS cause FROM pre",
    "prj17_hud_limits": f"CAST({_BAND_TOP.format(20)} AS DOUBLE) AS hud_top, CAST({_BAND_END.format(35)} AS DOUBLE) AS hud_bottom FROM pre",
    "prj18_hud_limits_wide": f"CAST({_BAND_TOP.format(30)} AS DOUBLE) AS hud_top, CAST({_BAND_END.format(50)} AS DOUBLE) AS hud_bottom FROM pre",
    "prj19_chroma": "if(abs(feat_a - 128) > abs(feat_b - 128), abs(feat_a - 128), abs(feat_b - 128)) AS chroma FROM pre",
    "prj20_field_distance": f"{_h6(_TO_FIELD)} AS dist FROM pre",
    "prj21_weight": "conf * if(torso_px > 1, torso_px, 1) AS weight FROM pre",
    "prj22_quality": f"{_h6('conf * torso_px / 500')} AS quality FROM pre",
    "prj24_hsv_blend": "CAST(trunc(0.9 * (k % 180) + 0.1 * (event_id % 180)) AS BIGINT) AS blended FROM pre",
    "prj25_projected_area": f"""{_h6('area')} AS area_frac, coalesce(area >= 0.08, false) AS plausible FROM (
 SELECT event_id, if(list_min(list_transform(q, lambda p: abs(p[3]))) < 1e-9, NULL, abs(list_sum([q[i][1] / q[i][3] * q[i % 4 + 1][2] / q[i % 4 + 1][3] - q[i % 4 + 1][1] / q[i % 4 + 1][3] * q[i][2] / q[i][3] for i in [1, 2, 3, 4]])) / 2 / {FRAME_W * FRAME_H}) AS area
 FROM (SELECT event_id, list_transform([[0, 0], [{FRAME_W}, 0], [{FRAME_W}, {FRAME_H}], [0, {FRAME_H}]], lambda c: [(0.5 + k / 200.0) * c[1] + 0.01 * c[2] + 5, 0.02 * c[1] + (0.3 + event_id % 10 / 20.0) * c[2] + 7, event_id % 5 / 100000.0 * c[1] + 0.00001 * c[2] + 1]) AS q FROM pre) AS z) AS y""",
    "prj26_line_geometry": f"{_h6('y1 + (640 - x1) * (y2 - y1) / (x2 - x1)')} AS y_at, {_h6('atan2(y2 - y1, x2 - x1) * 180 / pi()')} AS angle, if(atan2(y2 - y1, x2 - x1) * 180 / pi() BETWEEN 25 AND 65, 'h', 'v') AS kind FROM pre",
    "prj28_team_colour": "if(team = 0, 'blue', if(team = 1, 'red', if(team = -2, 'yellow', 'grey'))) AS colour FROM pre",
    "prj29_jersey_rows": "CAST(trunc(y1) + trunc((y2 - y1) / 5) AS BIGINT) AS top, CAST(trunc(y1) + trunc((y2 - y1) * 0.75) AS BIGINT) AS bottom FROM pre",
    "flt01_hud_band": f"cy FROM pre WHERE cy > {_BAND_TOP.format(20)} AND cy < {_BAND_END.format(35)}",
    "flt02_whole_box_hud": "NOT (y2 > 72 AND y1 < 612) AS hud FROM pre",
    "flt03_foot_on_field": "foot_frac FROM pre WHERE k % 25 > 10",
    "flt05_fp_like": "greatest(x2 - x1, 0) * greatest(y2 - y1, 1) < 900 OR greatest(x2 - x1, 0) > 2.5 * greatest(y2 - y1, 1) AS fp FROM pre",
    "flt06_fp_broadcast": "NOT (y2 > 72 AND y1 < 612) OR k % 11 = 0 OR (x2 - x1) * (y2 - y1) < 900 OR x2 - x1 > 2.5 * greatest(1, y2 - y1) AS fp FROM pre",
    "flt07_valid_feature": f"track_id FROM pre WHERE event_id % 10 <> 0 AND feat_a IS NOT NULL AND {_CHROMATIC} >= 18 AND {_TO_FIELD} >= 25 AND feat_sa + feat_sb >= 4",
    "flt09_referee": f"{_CHROMATIC} <= 18 AND feat_sa + feat_sb >= 12 AND NOT (locked AND margin >= 1) AND x2 - x1 >= 1.35 * greatest(1, y2 - y1) AND torso_px <= 2500 AS referee FROM pre",
    "flt10_warmup_reason": """list_filter([if(conf < if(helmet, 0.30, if(fails >= 2, 0.38, 0.45)), 'low_conf', ''), if(torso_px < 400, 'small_mask', ''), if(upper_px < 50, 'few_upper_pixels', ''),
 if(NOT helmet AND field_overlap < 0.25, 'not_on_field', ''), 'ok'], lambda r: r <> '')[1] AS reason FROM pre""",
    "flt13_ocr_valid": "ocr_num FROM pre WHERE ocr_conf >= 0.5 AND ocr_num >= 0 AND ocr_num <= 99",
    "flt14_mask_qa": """list_filter([if(mask_area < min_area, 'area<' || min_area, ''), if(fill / (2 - fill) < 0.65, 'iou<0.65', ''), if(points < 3, 'bad_polygon', ''), 'ok'], lambda r: r <> '')[1] AS reason FROM pre""",
    "flt16_green_bypass": "k % 100 >= 55 AND feat_sa + feat_sb < 15 AS bypass FROM pre",
    "flt19_fresh": "frame_age FROM pre WHERE k % 3 = 0",
    "flt20_green_safeguard": "if(k % 100 >= 55 AND feat_sa + feat_sb < 15, torso_px, kept_px) AS kept FROM pre",
    "flt21_turf_guard": "4 * kept_px < torso_px AS skip FROM pre",
}


r6 = lambda x: S.rounded(x, 6)
SCALARS = "clip_id, frame, track_id, x1, y1, x2, y2, conf, mask_ref, mask_is_fallback, torso_px, helmet_hits, ocr_num, ocr_conf, is_cut_frame, team"

# Sources


@query("src01_ir_scan", f"SELECT {SCALARS} FROM det")
def _(spark, sf):
    return detections(spark, sf).selectExpr(*SCALARS.split(", "))


def annotations(spark: SparkSession, sf: str) -> DataFrame:
    rows = detections(spark, sf).filter("k % 2 = 0")
    rows = rows.selectExpr("frame", "track_id", "CASE WHEN k % 8 = 0 THEN ' ' ELSE CAST(user_id % 2 AS STRING) END AS correct_team", "x1", "y1", "x2", "y2")
    return readers.labelled(rows)


ANN = "ann AS (SELECT frame, track_id, CAST(user_id % 2 AS INT) AS correct_team, x1, y1, x2, y2 FROM det WHERE k % 2 = 0 AND k % 8 <> 0)"


@query("src03_annotations", f"WITH {ANN} SELECT frame, track_id, correct_team FROM ann")
def _(spark, sf):
    return annotations(spark, sf).select("frame", "track_id", "correct_team")


@query("src04_has_labels", "SELECT count(*) FILTER (WHERE k % 2 = 0 AND k % 8 <> 0) > 0 AS has_labels FROM det")
def _(spark, sf):
    rows = detections(spark, sf).filter("k % 2 = 0").selectExpr("CASE WHEN k % 8 = 0 THEN ' ' ELSE CAST(user_id % 2 AS STRING) END AS correct_team")
    return readers.has_labels(rows)


@query("src05_jsonl_last", "SELECT frame, arg_max(k, event_id) AS k, arg_max(user_id, event_id) AS user_id FROM det GROUP BY frame")
def _(spark, sf):
    return readers.last_per_frame(detections(spark, sf).select("frame", "event_id", "k", "user_id"), "event_id")


def _two(n: str) -> str:
    return f"lpad(CAST({n} AS STRING), 2, '0')"


def part_lines(spark: SparkSession, sf: str, numbers: list[str], cls: str = "'0'") -> DataFrame:
    text = " || ".join([cls, *[f"' 0.' || {_two(n)}" for n in numbers]])
    return spark.read.parquet(f"{sf}/part.parquet").selectExpr("p_partkey", "CAST(p_size AS STRING) AS stem", "p_partkey AS line_no", f"{text} AS line")


_CENTRE = ["p_partkey % 100", "(7 * p_partkey) % 100", "(3 * p_partkey) % 50", "(5 * p_partkey) % 50"]
_POLY = ["p_partkey % 100", "(7 * p_partkey) % 100", "(3 * p_partkey) % 100", "(5 * p_partkey) % 100", "(11 * p_partkey) % 100", "(13 * p_partkey) % 100"]


def _px(value: str, most: int) -> str:
    return f"least({most}, greatest(0, {S.truncated(value)}))"


@query(
    "src06_yolo_boxes",
    f"""WITH p AS (SELECT p_partkey, ({_CENTRE[0]}) / 100.0 AS cx, ({_CENTRE[1]}) / 100.0 AS cy, ({_CENTRE[2]}) / 100.0 AS bw, ({_CENTRE[3]}) / 100.0 AS bh FROM part)
    SELECT p_partkey, {_px('((CAST(cx AS DOUBLE) - CAST(bw AS DOUBLE) / 2) * 1280)', 1280)} AS x1, {_px('((CAST(cy AS DOUBLE) - CAST(bh AS DOUBLE) / 2) * 720)', 720)} AS y1,
           {_px('((CAST(cx AS DOUBLE) + CAST(bw AS DOUBLE) / 2) * 1280)', 1280)} AS x2, {_px('((CAST(cy AS DOUBLE) + CAST(bh AS DOUBLE) / 2) * 720)', 720)} AS y2 FROM p""",
)
def _(spark, sf):
    return readers.yolo_boxes(part_lines(spark, sf, _CENTRE), FRAME_W, FRAME_H).select("p_partkey", *[F.col(c).cast("long").alias(c) for c in ("x1", "y1", "x2", "y2")])


@query(
    "src07_polygon_boxes",
    f"""WITH p AS (SELECT p_partkey, {', '.join(f'CAST(({n}) / 100.0 AS DOUBLE) AS v{i}' for i, n in enumerate(_POLY))} FROM part)
    SELECT p_partkey, least(v0, v2, v4) * 1280 AS x1, least(v1, v3, v5) * 720 AS y1, greatest(v0, v2, v4) * 1280 AS x2, greatest(v1, v3, v5) * 720 AS y2 FROM p""",
)
def _(spark, sf):
    return readers.polygon_boxes(part_lines(spark, sf, _POLY), FRAME_W, FRAME_H).select("p_partkey", "x1", "y1", "x2", "y2")


@query("src08_class_zero", "SELECT CAST(p_size AS STRING) AS stem, count(*) AS n, min(p_partkey) AS first_line FROM part WHERE p_partkey % 2 = 0 GROUP BY 1")
def _(spark, sf):
    return readers.class_zero(part_lines(spark, sf, _CENTRE, "CAST(p_partkey % 2 AS STRING)"))


@query("src08_class_zero_lines", f"""SELECT CAST(p_size AS STRING) AS stem, p_partkey AS line_no, {" || ".join(["'0'", *[f"' 0.' || {_two(n)}" for n in _CENTRE]])} AS line FROM part WHERE p_partkey % 2 = 0""")
def _(spark, sf):
    return readers.class_zero_lines(part_lines(spark, sf, _CENTRE, "if(p_partkey % 2 = 0, '0 ', '1 ')"))


@query("src16_sampled_frames", "SELECT frame, count(*) AS n FROM det WHERE frame % 15 = 0 GROUP BY frame")
def _(spark, sf):
    return detections(spark, sf).filter("frame % 15 = 0").groupBy("frame").agg(F.count("*").alias("n"))


# Computed columns and predicates

scalar("prj01_gate_geometry", {k: v for k, v in S.GATE.items()})
scalar("prj02_broadcast_geometry", S.BROADCAST)
scalar("prj03_foot", {"foot_x": S.FOOT_X, "foot_y": S.FOOT_Y})
_pj, _po = S.projected(HOMOGRAPHY), S.projected_inside(HOMOGRAPHY, 1000, 400)
scalar("prj04_projection", {"court_x": r6(_pj[0]), "court_y": r6(_pj[1])})
scalar("prj05_projection_inside", {"court_x": r6(_po[0]), "court_y": r6(_po[1])})
scalar("prj07_head_roi", S.HEAD_ROI)
scalar(
    "prj09_padded_box",
    {
        "px1": f"greatest(0, {S.truncated('x1')} - {S.truncated('(0.5 * (x2 - x1))')})", "py1": f"greatest(0, {S.truncated('y1')} - {S.truncated('(0.5 * (y2 - y1))')})",
        "px2": f"least({FRAME_W}, {S.truncated('x2')} + {S.truncated('(0.5 * (x2 - x1))')})", "py2": f"least({FRAME_H}, {S.truncated('y2')} + {S.truncated('(0.5 * (y2 - y1))')})",
    },
)
scalar("prj10_min_mask_area", {"min_area": S.MIN_MASK})
scalar(
    "prj11_normalised_box",
    {"cx": r6(f"(x1 + x2) / 2 / {FRAME_W}.0"), "cy": r6(f"(y1 + y2) / 2 / {FRAME_H}.0"), "bw": r6(f"(x2 - x1) / {FRAME_W}.0"), "bh": r6(f"(y2 - y1) / {FRAME_H}.0")},
    where=f"x1 < {FRAME_W} AND y1 < {FRAME_H} AND (x1 + x2) / 2 / {FRAME_W}.0 <= 1 AND (y1 + y2) / 2 / {FRAME_H}.0 <= 1",
)
scalar("prj12_positives_bin", {"bin": S.POSITIVES_BIN}, {"n": "k % 10"})
scalar("prj13_size_bucket", {"bucket": S.SIZE_BUCKET}, {"area": S.area()})
scalar("prj14_area_bucket", {"bucket": S.AREA_BUCKET}, {"area": S.area()})
scalar("prj15_raw_bucket", {"bucket": S.RAW_BUCKET}, {"n": "k % 8"})
_CAUSES = {"raw_boxes": "k % 12", "center_eaten": "event_id % 5 = 0", "transient": "event_id % 3 = 0", "narrow_band": "event_id % 7 = 0"}
scalar("prj16_hud_cause", {"cause": S.CAUSE}, _CAUSES)
_EXTENT = {"frame_h": str(FRAME_H), "mask_top": "k % 90", "mask_bottom": "CASE WHEN k % 5 = 0 THEN 0 ELSE 500 + k END", "cy": "(y1 + y2) / 2"}
_hud, _wide = S.hud_limits(), S.hud_limits(10, 15)
scalar("prj17_hud_limits", {"hud_top": f"CAST({_hud[0]} AS DOUBLE)", "hud_bottom": f"CAST({_hud[1]} AS DOUBLE)"}, _EXTENT)
scalar("prj18_hud_limits_wide", {"hud_top": f"CAST({_wide[0]} AS DOUBLE)", "hud_bottom": f"CAST({_wide[1]} AS DOUBLE)"}, _EXTENT)
scalar("prj19_chroma", {"chroma": S.CHROMA}, features=True)
scalar("prj20_field_distance", {"dist": r6(S.FIELD_DIST)}, features=True)
scalar("prj21_weight", {"weight": S.WEIGHT})
scalar("prj22_quality", {"quality": r6(S.QUALITY)})
scalar("prj24_hsv_blend", {"blended": S.truncated("(0.9 * (k % 180) + 0.1 * (event_id % 180))")})
_LINE = {"lx1": "x1", "ly1": "y1", "lx2": "x2", "ly2": "y2"}
scalar(
    "prj26_line_geometry",
    {"y_at": r6("ly1 + (ly2 - ly1) * (640 - lx1) / (lx2 - lx1)"), "angle": r6("degrees(atan2(ly2 - ly1, lx2 - lx1))"), "kind": "CASE WHEN abs(degrees(atan2(ly2 - ly1, lx2 - lx1)) - 45) <= 20 THEN 'h' ELSE 'v' END"},
    _LINE,
)
scalar("prj28_team_colour", {"colour": S.TEAM_COLOUR})
scalar("prj29_jersey_rows", {"top": f"{S.truncated('y1')} + {S.truncated('(0.2 * (y2 - y1))')}", "bottom": f"{S.truncated('y1')} + {S.truncated('(0.75 * (y2 - y1))')}"})
scalar("flt01_hud_band", {"cy": "cy"}, _EXTENT, f"cy > {_hud[0].replace('CASE', '(CASE', 1)}) AND cy < {_hud[1].replace('CASE', '(CASE', 1)})")
scalar("flt02_whole_box_hud", {"hud": S.WHOLE_BOX_HUD}, {"frame_h": str(FRAME_H)})
scalar("flt03_foot_on_field", {"foot_frac": "foot_frac"}, {"foot_frac": "CAST((k % 25) / 100.0 AS DOUBLE)"}, "foot_frac > 0.10")
scalar("flt05_fp_like", {"fp": S.GATE_FP})
scalar("flt06_fp_broadcast", {"fp": f"({S.WHOLE_BOX_HUD} OR k % 11 = 0 OR {S.BROADCAST['area']} < 900 OR {S.BROADCAST['aspect']} > 2.5)"}, {"frame_h": str(FRAME_H)})
scalar("flt07_valid_feature", {"track_id": "track_id"}, where=S.VALID_FEATURE, features=True)
scalar("flt09_referee", {"referee": S.REFEREE}, {"locked": "event_id % 2 = 0", "margin": "CAST((k % 30) / 10.0 AS DOUBLE)"}, features=True)
scalar(
    "flt10_warmup_reason", {"reason": S.WARMUP_REASON},
    {"helmet": "helmet_hits > 0", "fails": "k % 4", "upper_px": "k", "field_overlap": "CAST((event_id % 50) / 100.0 AS DOUBLE)"},
)
scalar("flt13_ocr_valid", {"ocr_num": "ocr_num"}, where="ocr_conf >= 0.5 AND ocr_num BETWEEN 0 AND 99")
scalar("flt14_mask_qa", {"reason": S.MASK_REASON}, {"mask_area": "torso_px", "min_area": S.MIN_MASK, "fill": "CAST((k % 100) / 100.0 AS DOUBLE)", "points": "event_id % 9"})
scalar("flt16_green_bypass", {"bypass": "green >= 0.55 AND feat_sa + feat_sb < 15"}, {"green": "CAST((k % 100) / 100.0 AS DOUBLE)"}, features=True)
scalar("flt19_fresh", {"frame_age": "frame_age"}, {"frame_age": "k % 3"}, "frame_age = 0")
scalar("flt21_turf_guard", {"skip": "kept_px < 0.25 * torso_px"}, {"kept_px": "k * 8"})


@query("flt04_foot_rescue", """WITH t AS (SELECT unnest([0.05, 0.08, 0.10, 0.15, 0.20]) AS thr)
SELECT CAST(thr AS DOUBLE) AS threshold, count(*) AS rescued FROM det, t WHERE CAST((k % 25) / 100.0 AS DOUBLE) >= thr GROUP BY 1""")
def _(spark, sf):
    rows = detections(spark, sf).withColumn("threshold", F.explode(F.array(*[F.lit(x) for x in (0.05, 0.08, 0.10, 0.15, 0.20)])))
    return rows.filter("CAST((k % 25) / 100.0D AS DOUBLE) >= threshold").groupBy("threshold").agg(F.count("*").alias("rescued"))


@query("flt08_calibration_prefilter", f"""WITH c AS (SELECT *, NOT ({S.CHROMA} < 18) AND NOT ({S.FIELD_DIST} < 25 AND {S.CHROMA} < 36) AS keep FROM detf),
g AS (SELECT track_id, bool_or(keep) AS any_kept FROM c GROUP BY 1)
SELECT event_id FROM c JOIN g USING (track_id) WHERE keep OR NOT any_kept""", True)
def _(spark, sf):
    rows = S.add(with_features(spark, sf), keep=f"NOT ({S.CHROMA} < 18) AND NOT ({S.FIELD_DIST} < 25 AND {S.CHROMA} < 36)")
    rows = rows.withColumn("any_kept", F.max("keep").over(Window.partitionBy("track_id")))
    return rows.filter("keep OR NOT any_kept").select("event_id")


@query("flt11_route_trim", "SELECT event_id, frame - 23 AS t_from_snap FROM det WHERE frame BETWEEN 23 AND 263")
def _(spark, sf):
    snap = spark.createDataFrame([("events", 23)], "clip_id string, snap_frame long")
    return W.trimmed(detections(spark, sf), snap).select("event_id", "t_from_snap")


@query("flt15_hard_negatives", """SELECT frame, count(*) FILTER (WHERE k % 3 = 0) AS off_field FROM det GROUP BY frame
HAVING count(*) FILTER (WHERE k % 3 <> 0) = 0 AND count(*) FILTER (WHERE k % 3 = 0) >= 2""")
def _(spark, sf):
    rows = detections(spark, sf).groupBy("frame").agg(F.count_if(F.expr("k % 3 = 0")).alias("off_field"), F.count_if(F.expr("k % 3 <> 0")).alias("on_field"))
    return rows.filter("on_field = 0 AND off_field >= 2").select("frame", "off_field")


@query("flt17_number_conflict", """SELECT a.track_id AS a, b.track_id AS b FROM (SELECT track_id, user_id, max(ocr_num) AS n FROM det GROUP BY 1, 2) AS a
JOIN (SELECT track_id, user_id, max(k % 3) AS n FROM det GROUP BY 1, 2) AS b ON a.user_id = b.user_id WHERE a.track_id < b.track_id AND coalesce(a.n <> b.n, false)""")
def _(spark, sf):
    tracks = detections(spark, sf).groupBy("track_id", "user_id").agg(F.max("ocr_num").alias("number"), F.max(F.expr("k % 3")).alias("other"))
    return R.conflicting_pairs(tracks, "user_id", "track_id", "number", "other").select("a", "b")


_NEAR = "sqrt((((a.x1 + a.x2) - (b.x1 + b.x2)) / 2) * (((a.x1 + a.x2) - (b.x1 + b.x2)) / 2) + (((a.y1 + a.y2) - (b.y1 + b.y2)) / 2) * (((a.y1 + a.y2) - (b.y1 + b.y2)) / 2))"


@query("flt18_pile_up", f"SELECT DISTINCT a.event_id FROM det a JOIN det b ON a.frame = b.frame AND a.event_id <> b.event_id WHERE {_NEAR} > 0 AND {_NEAR} < 80")
def _(spark, sf):
    det = detections(spark, sf)
    return det.alias("a").join(det.alias("b"), F.expr(f"a.frame = b.frame AND a.event_id <> b.event_id AND {_NEAR} > 0 AND {_NEAR} < 80"), "left_semi").select("event_id")


@query("prj23_feature_parse", "SELECT p_partkey, CAST(p_partkey AS DOUBLE) + 0.5 AS a, CAST(p_size AS DOUBLE) AS b FROM part")
def _(spark, sf):
    rows = spark.read.parquet(f"{sf}/part.parquet").withColumn("text", F.expr("concat('[', p_partkey, '.5, ', p_size, ']')"))
    return rows.withColumn("v", F.from_json("text", "array<double>")).selectExpr("p_partkey", "v[0] AS a", "v[1] AS b")


@query("prj27_hue_circle", f"""WITH c AS (SELECT track_id, avg(cos(feat_h * pi() / 90)) AS c, avg(sin(feat_h * pi() / 90)) AS s FROM detf GROUP BY 1),
m AS (SELECT track_id, atan2(s, c) AS a, greatest(sqrt(s * s + c * c), 1e-9) AS r FROM c)
SELECT track_id, {S.rounded('(CASE WHEN a < -1e-9 THEN a + 2 * pi() ELSE abs(a) END) * 90 / pi()', 4)} AS hue, {S.rounded('sqrt(greatest(0.0, -2 * ln(least(r, 1.0)))) * 90 / pi()', 3)} AS std FROM m""", True)
def _(spark, sf):
    c = with_features(spark, sf).groupBy("track_id").agg(F.expr("avg(cos(feat_h * pi() / 90))").alias("c"), F.expr("avg(sin(feat_h * pi() / 90))").alias("s"))
    m = c.selectExpr("track_id", "atan2(s, c) AS a", "greatest(sqrt(s * s + c * c), 1e-9) AS r")
    return m.selectExpr("track_id", f"{S.rounded('(CASE WHEN a < -1e-9 THEN a + 2 * pi() ELSE abs(a) END) * 90 / pi()', 4)} AS hue", f"{S.rounded('sqrt(greatest(0.0, -2 * ln(least(r, 1.0)))) * 90 / pi()', 3)} AS std")


# Joins


@query("jon01_team_accuracy", f"""WITH {ANN}, d AS (SELECT frame, track_id, arg_max(team, event_id) AS team FROM det GROUP BY 1, 2)
SELECT count(*) AS n, count(*) FILTER (WHERE team = correct_team) AS n_right, CAST(count(*) FILTER (WHERE team = correct_team) AS DOUBLE) / count(*) AS team_accuracy FROM ann JOIN d USING (frame, track_id)""")
def _(spark, sf):
    return A.team_accuracy(detections(spark, sf), annotations(spark, sf))


@query("jon02_online_labels", f"WITH {ANN} SELECT a.frame, a.track_id, d.team AS label FROM ann a LEFT JOIN det d ON a.frame = d.frame AND a.track_id = d.track_id AND d.team IN (0, 1) AND d.k % 4 <> 0 WHERE coalesce(d.team, -1) >= 0")
def _(spark, sf):
    known = detections(spark, sf).filter("team IN (0, 1) AND k % 4 <> 0").select("frame", "track_id", F.col("team").alias("label"))
    return annotations(spark, sf).join(known, ["frame", "track_id"], "left").withColumn("label", F.coalesce("label", F.lit(-1))).filter("label >= 0").select("frame", "track_id", "label")


def _sides(det: DataFrame, other: DataFrame) -> tuple[DataFrame, DataFrame]:
    box = lambda p: [F.col(c).alias(f"{p}{c}") for c in ("x1", "y1", "x2", "y2")]
    return det.select("frame", F.col("event_id").alias("left_id"), *box("a_")), other.select("frame", F.col("event_id").alias("right_id"), *box("b_"))


_BOXES = "frame, event_id AS {i}, x1 AS {p}x1, y1 AS {p}y1, x2 AS {p}x2, y2 AS {p}y2"
_LEFT, _RIGHT = _BOXES.format(i="left_id", p="a_"), _BOXES.format(i="right_id", p="b_")


def _best_sql(least: float, left: str, right: str) -> str:
    return f"""WITH a AS (SELECT {_LEFT} FROM det WHERE {left}), b AS (SELECT {_RIGHT} FROM det WHERE {right}),
    s AS (SELECT a.frame, left_id, right_id, CASE WHEN right_id IS NOT NULL THEN {S.iou('a_', 'b_')} END AS iou FROM a LEFT JOIN b ON a.frame = b.frame),
    r AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY iou DESC NULLS LAST, right_id) AS rn FROM s)
    SELECT frame, left_id, CASE WHEN iou >= {least} THEN right_id END AS right_id, CASE WHEN iou >= {least} THEN iou END AS iou FROM r WHERE rn = 1"""


@query("jon03_best_iou", _best_sql(P.label_iou, "k % 2 = 0", "team IN (0, 1) AND k % 2 = 1"))
def _(spark, sf):
    det = detections(spark, sf)
    return R.best_match(*_sides(det.filter("k % 2 = 0"), det.filter("team IN (0, 1) AND k % 2 = 1")), ["frame"], "left_id", "right_id", P.label_iou)


@query("jon04_pose_match", _best_sql(P.pose_iou, "true", "event_id % 3 = 0"))
def _(spark, sf):
    det = detections(spark, sf)
    return R.best_match(*_sides(det, det.filter("event_id % 3 = 0")), ["frame"], "left_id", "right_id", P.pose_iou)


def label_boxes(spark: SparkSession, sf: str) -> DataFrame:
    return detections(spark, sf).selectExpr("frame AS image", "CASE WHEN event_id % 2 = 0 THEN 'gt' ELSE 'pred' END AS kind", "event_id AS idx", "x1", "y1", "x2", "y2")


# Rows of a frame or image in order, each with its partners from the best on: what a row takes is the first that is free.
_MATCHING = f"""gt AS (SELECT frame AS image, event_id AS idx, x1 AS a_x1, y1 AS a_y1, x2 AS a_x2, y2 AS a_y2, row_number() OVER (PARTITION BY frame ORDER BY event_id) AS n FROM det WHERE event_id % 2 = 0),
pr AS (SELECT frame AS image, event_id AS p, x1 AS b_x1, y1 AS b_y1, x2 AS b_x2, y2 AS b_y2 FROM det WHERE event_id % 2 = 1),
sc AS (SELECT image, idx, p, {S.iou('a_', 'b_')} AS iou FROM gt JOIN pr USING (image)),
offers AS (SELECT gt.image, gt.idx, gt.n, (a_x2 - a_x1) * (a_y2 - a_y1) AS area, coalesce(o.ps, CAST([] AS BIGINT[])) AS ps FROM gt
 LEFT JOIN (SELECT idx, list(p ORDER BY iou DESC, p) AS ps FROM sc WHERE iou > 0 AND iou >= 0.3 GROUP BY 1) AS o USING (idx)),
matching(image, n, idx, area, matched, used) AS (SELECT DISTINCT image, CAST(0 AS BIGINT), CAST(-1 AS BIGINT), CAST(0 AS DOUBLE), CAST(-1 AS BIGINT), CAST([] AS BIGINT[]) FROM offers
 UNION ALL SELECT o.image, o.n, o.idx, o.area, coalesce(list_filter(o.ps, lambda p: NOT list_contains(m.used, p))[1], -1),
  list_concat(m.used, list_filter(o.ps, lambda p: NOT list_contains(m.used, p))[1:1]) FROM matching m JOIN offers o ON o.image = m.image AND o.n = m.n + 1),
matches AS (SELECT image, idx, matched, area FROM matching WHERE n > 0)"""


@query("jon06_exclusive_match", f"WITH {_MATCHING} SELECT image, idx, matched, area FROM matches", recursive=True)
def _(spark, sf):
    return greedy.matched(label_boxes(spark, sf), 0.3)


@query("agg26_size_recall", f"""WITH {_MATCHING} SELECT CASE WHEN area < 32 * 32 THEN 'small' WHEN area < 96 * 96 THEN 'medium' ELSE 'large' END AS bucket, count(*) AS gt,
count(*) FILTER (WHERE matched >= 0) AS matched, round(count(*) FILTER (WHERE matched >= 0) / count(*), 3) AS recall FROM matches GROUP BY 1""", recursive=True)
def _(spark, sf):
    rows = greedy.matched(label_boxes(spark, sf), 0.3).groupBy(F.expr(S.SIZE_BUCKET).alias("bucket"))
    return rows.agg(F.count("*").alias("gt"), F.count_if(F.col("matched") >= 0).alias("matched")).withColumn("recall", F.round(F.col("matched") / F.col("gt"), 3))


def _tracks(rel: str) -> str:
    """Track summaries of a relation of detections with features."""
    return f"""t0 AS (SELECT clip_id, track_id, min(frame) AS start, max(frame) AS "end", arg_min(struct_pack(x := (x1 + x2) / 2, y := y2), frame) AS head, arg_max(struct_pack(x := (x1 + x2) / 2, y := y2), frame) AS tail, median(feat_a) AS ab_a, median(feat_b) AS ab_b FROM {rel} GROUP BY 1, 2),
tl AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY frame DESC) AS rn FROM {rel}),
tv AS (SELECT l.track_id, coalesce(((l.x1 + l.x2) / 2 - (p.x1 + p.x2) / 2) / greatest(1, l.frame - p.frame), 0.0) AS vx, coalesce((l.y2 - p.y2) / greatest(1, l.frame - p.frame), 0.0) AS vy FROM tl l LEFT JOIN tl p ON l.track_id = p.track_id AND p.rn = 2 WHERE l.rn = 1),
tm AS (SELECT track_id, team FROM (SELECT track_id, team, row_number() OVER (PARTITION BY track_id ORDER BY count(*) DESC, team) AS rn FROM {rel} WHERE team >= 0 GROUP BY 1, 2) AS q WHERE rn = 1),
tn AS (SELECT track_id, ocr FROM (SELECT track_id, ocr_num AS ocr, row_number() OVER (PARTITION BY track_id ORDER BY count(*) DESC, ocr_num) AS rn FROM {rel} WHERE ocr_conf >= 0.5 AND ocr_num IS NOT NULL GROUP BY 1, 2) AS q WHERE rn = 1),
tracks AS MATERIALIZED (SELECT t0.clip_id, t0.track_id, t0.start, t0."end", t0.head.x AS head_x, t0.head.y AS head_y, t0.tail.x AS tail_x, t0.tail.y AS tail_y, vx, vy, coalesce(tm.team, -1) AS team, tn.ocr, ab_a, ab_b
 FROM t0 JOIN tv USING (track_id) LEFT JOIN tm USING (track_id) LEFT JOIN tn USING (track_id))"""


_TRACKS = _tracks("detf")


@query("agg12_track_summary", f"""WITH {_TRACKS} SELECT track_id, start, "end", head_x, head_y, tail_x, tail_y, {r6('vx')} AS vx, {r6('vy')} AS vy, team, ocr, {r6('ab_a')} AS ab_a, {r6('ab_b')} AS ab_b FROM tracks""", True)
def _(spark, sf):
    rows = A.track_summary(with_features(spark, sf))
    return rows.selectExpr("track_id", "start", "end", "head_x", "head_y", "tail_x", "tail_y", f"{r6('vx')} AS vx", f"{r6('vy')} AS vy", "team", "ocr", f"{r6('ab_a')} AS ab_a", f"{r6('ab_b')} AS ab_b")


_GAP = '(b.start - a."end")'
_DIST = f"sqrt((a.tail_x + a.vx * {_GAP} - b.head_x) * (a.tail_x + a.vx * {_GAP} - b.head_x) + (a.tail_y + a.vy * {_GAP} - b.head_y) * (a.tail_y + a.vy * {_GAP} - b.head_y))"


@query("jon07_stitch_candidates", f"""WITH {_TRACKS} SELECT a.track_id AS a, b.track_id AS b, {S.rounded(_DIST, 5)} AS dist,
{S.rounded(f'{_DIST} + 0.5 * sqrt((a.ab_a - b.ab_a) * (a.ab_a - b.ab_a) + (a.ab_b - b.ab_b) * (a.ab_b - b.ab_b))', 5)} AS cost
FROM tracks a JOIN tracks b ON a.clip_id = b.clip_id AND {_GAP} > 0 AND {_GAP} <= 30 WHERE (a.team < 0 OR b.team < 0 OR a.team = b.team) AND NOT coalesce(a.ocr <> b.ocr, false) AND {_DIST} <= 120""", True)
def _(spark, sf):
    rows = R.stitch_candidates(A.track_summary(with_features(spark, sf)))
    return rows.selectExpr("a", "b", f"{S.rounded('dist', 5)} AS dist", f"{S.rounded('cost', 5)} AS cost")


_EDGES = f"""edges AS MATERIALIZED (SELECT row_number() OVER (ORDER BY a."end", a.track_id, {_DIST} + 0.5 * coalesce(sqrt((a.ab_a - b.ab_a) * (a.ab_a - b.ab_a) + (a.ab_b - b.ab_b) * (a.ab_b - b.ab_b)), 0), b.track_id) AS n, a.track_id AS a, b.track_id AS b
FROM tracks a JOIN tracks b ON a.clip_id = b.clip_id AND {_GAP} > 0 AND {_GAP} <= 30 WHERE (a.team < 0 OR b.team < 0 OR a.team = b.team) AND NOT coalesce(a.ocr <> b.ocr, false) AND {_DIST} <= 120)"""
# Edge by edge in order, one is taken if neither its tail nor its head is; then each head follows the tails up to its root.
_EDGE = "struct_pack(a := a, b := b, tails := CAST([] AS BIGINT[]), heads := CAST([] AS BIGINT[]))"
_CHAIN = f"""{_EDGES},
folded AS MATERIALIZED (SELECT list_reduce(list({_EDGE} ORDER BY n), lambda t, e: CASE WHEN list_contains(t.tails, e.a) OR list_contains(t.heads, e.b) THEN t
 ELSE struct_pack(a := e.a, b := e.b, tails := list_append(t.tails, e.a), heads := list_append(t.heads, e.b)) END, struct_pack(a := CAST(0 AS BIGINT), b := CAST(0 AS BIGINT), tails := CAST([] AS BIGINT[]), heads := CAST([] AS BIGINT[]))) AS t FROM edges),
upward(heads, roots, before, tails) AS (SELECT t.heads, t.tails, CAST([] AS BIGINT[]), map(t.heads, t.tails) FROM folded WHERE len(t.heads) > 0
 UNION ALL SELECT heads, list_transform(roots, lambda r: coalesce(tails[r], r)), roots, tails FROM upward WHERE roots <> before),
chains AS (SELECT unnest(heads) AS track_id, unnest(roots) AS stable_id FROM upward WHERE roots = before)"""


@query("srt03_chains", f"WITH {_TRACKS}, {_CHAIN} SELECT 'events' AS clip_id, track_id, stable_id FROM chains", True, True)
def _(spark, sf):
    return greedy.chained_tracks(materialize(A.track_summary(with_features(spark, sf)), "tracks"))


@query("jon08_helmet_hits", f"""WITH a AS (SELECT {_LEFT} FROM det), b AS (SELECT {_RIGHT} FROM det WHERE event_id % 4 = 0)
SELECT a.frame, left_id, count(*) FILTER (WHERE right_id IS NOT NULL AND {S.iou('a_', 'b_', 'guarded')} >= 0.05) AS hits FROM a LEFT JOIN b ON a.frame = b.frame GROUP BY 1, 2""")
def _(spark, sf):
    det = detections(spark, sf)
    return R.helmet_hits(*_sides(det, det.filter("event_id % 4 = 0")), ["frame"], "left_id")


_INSIDE = "(b_x1 + b_x2) / 2 BETWEEN a_x1 AND a_x2 AND (b_y1 + b_y2) / 2 BETWEEN a_y1 AND a_y1 + greatest(1, 0.28 * (a_y2 - a_y1))"


@query("jon09_helmet_semi", f"""WITH a AS (SELECT {_LEFT} FROM det), b AS (SELECT {_RIGHT} FROM det WHERE event_id % 4 = 0 AND conf >= 0.20)
SELECT DISTINCT left_id FROM a JOIN b ON a.frame = b.frame WHERE {_INSIDE} OR {S.iou('a_', 'b_')} >= 0.12""")
def _(spark, sf):
    det = detections(spark, sf)
    a, b = _sides(det, det.filter("event_id % 4 = 0 AND conf >= 0.20"))
    return a.alias("a").join(b.withColumnRenamed("frame", "f"), F.expr(f"frame = f AND ({_INSIDE} OR {S.iou('a_', 'b_')} >= 0.12)"), "left_semi").select("left_id")


@query("jon10_overlapping_pairs", f"""WITH a AS (SELECT {_LEFT} FROM det), b AS (SELECT {_RIGHT} FROM det)
SELECT a.frame, left_id AS a_id, right_id AS b_id, {S.iou('a_', 'b_')} AS iou FROM a JOIN b ON a.frame = b.frame AND left_id < right_id WHERE {S.iou('a_', 'b_')} > 0.3""")
def _(spark, sf):
    return R.overlapping_pairs(detections(spark, sf).selectExpr("frame", "event_id AS id", "x1", "y1", "x2", "y2"), ["frame"], 0.3)


_VOTE = "vote AS (SELECT track_id, team FROM (SELECT track_id, team, row_number() OVER (PARTITION BY track_id ORDER BY count(*) DESC, team) AS rn FROM det WHERE team >= 0 GROUP BY 1, 2) AS q WHERE rn = 1)"


@query("agg10_mode_vote", f"WITH {_VOTE} SELECT track_id, team FROM vote")
def _(spark, sf):
    return A.mode_vote(detections(spark, sf).filter("team >= 0"), "track_id", "team")


@query("jon11_voted_team", f"WITH {_VOTE} SELECT d.event_id, coalesce(v.team, -1) AS team FROM det d LEFT JOIN vote v USING (track_id)")
def _(spark, sf):
    det = detections(spark, sf)
    votes = A.mode_vote(det.filter("team >= 0"), "track_id", "team", "voted")
    return det.join(votes, "track_id", "left").select("event_id", F.coalesce("voted", F.lit(-1)).alias("team"))


_NUMBER = """nv AS (SELECT track_id, ocr_num, row_number() OVER (PARTITION BY track_id ORDER BY round(sum(ocr_conf), 6) DESC, min(frame * 1000000000 + event_id)) AS rn FROM det
WHERE ocr_conf >= 0.5 AND ocr_num BETWEEN 0 AND 99 GROUP BY 1, 2),
numbers AS (SELECT t.track_id, n.ocr_num AS jersey_number FROM (SELECT DISTINCT track_id FROM det) AS t LEFT JOIN nv n ON t.track_id = n.track_id AND n.rn = 1)"""


@query("agg11_number_vote", f"WITH {_NUMBER} SELECT track_id, jersey_number FROM numbers")
def _(spark, sf):
    return A.number_vote(detections(spark, sf))


@query("jon12_jersey_number", f"WITH {_NUMBER} SELECT event_id, jersey_number FROM det LEFT JOIN numbers USING (track_id)")
def _(spark, sf):
    det = detections(spark, sf)
    return det.join(A.number_vote(det), "track_id", "left").select("event_id", "jersey_number")


_ZERO = """z0 AS (SELECT frame, arg_max(struct_pack(p := CASE WHEN k % 3 = 0 THEN 'ID_NONE' WHEN k % 3 = 1 THEN 'HUD_ATE_ALL' ELSE 'odd' END, r := CASE WHEN k % 5 = 0 THEN NULL ELSE k % 7 END), event_id) AS v FROM det WHERE k % 6 <> 0 GROUP BY 1),
z AS (SELECT frame, v.p AS path, v.r AS raw_boxes FROM z0), f AS (SELECT frame, count(*) AS n FROM det GROUP BY 1)"""
_TRUTH = "CASE WHEN path IS NULL OR path NOT IN ('ID_NONE', 'HUD_ATE_ALL') THEN 'tracked/ok' ELSE path || ' ' || CASE WHEN coalesce(raw_boxes, n) = 0 THEN '0' WHEN coalesce(raw_boxes, n) <= 2 THEN '1-2' WHEN coalesce(raw_boxes, n) <= 4 THEN '3-4' ELSE '5+' END END"


def _zero(spark, sf):
    det = detections(spark, sf)
    rows = det.filter("k % 6 <> 0").selectExpr("frame", "event_id", "CASE WHEN k % 3 = 0 THEN 'ID_NONE' WHEN k % 3 = 1 THEN 'HUD_ATE_ALL' ELSE 'odd' END AS path", "CASE WHEN k % 5 = 0 THEN NULL ELSE k % 7 END AS raw_boxes")
    return det.groupBy("frame").agg(F.count("*").alias("n")).join(readers.last_per_frame(rows, "event_id"), "frame", "left")


@query("jon13_zerodet_frames", f"WITH {_ZERO} SELECT f.frame, {_TRUTH} AS bucket FROM f LEFT JOIN z ON f.frame = z.frame")
def _(spark, sf):
    return _zero(spark, sf).selectExpr("frame", f"{_TRUTH} AS bucket")


@query("agg17_truth_buckets", f"WITH {_ZERO}, b AS (SELECT {_TRUTH} AS bucket FROM f LEFT JOIN z ON f.frame = z.frame) SELECT bucket, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER () AS pct FROM b GROUP BY 1")
def _(spark, sf):
    return A.bucket_counts(_zero(spark, sf), _TRUTH)


@query("jon15_grid", "SELECT c AS conf_min, i AS iou_max, (SELECT count(*) FROM det WHERE conf >= c) AS n FROM (SELECT CAST(unnest([0.1, 0.25, 0.4, 0.55]) AS DOUBLE) AS c) AS a, (SELECT CAST(unnest([0.3, 0.5, 0.7]) AS DOUBLE) AS i) AS b")
def _(spark, sf):
    counts = detections(spark, sf).agg(*[F.count_if(F.col("conf") >= c).alias(f"n{j}") for j, c in enumerate((0.1, 0.25, 0.4, 0.55))])
    rows = counts.selectExpr("stack(4, 0.1D, n0, 0.25D, n1, 0.4D, n2, 0.55D, n3) AS (conf_min, n)")
    return rows.withColumn("iou_max", F.explode(F.array(F.lit(0.3), F.lit(0.5), F.lit(0.7)))).select("conf_min", "iou_max", "n")


@query("agg27_grid_average", "SELECT c AS conf_min, round((SELECT count(*) FROM det WHERE conf >= c) / (SELECT count(DISTINCT frame) FROM det), 2) AS avg_det FROM (SELECT CAST(unnest([0.1, 0.25, 0.4, 0.55]) AS DOUBLE) AS c) AS a")
def _(spark, sf):
    counts = detections(spark, sf).agg(F.count_distinct("frame").alias("f"), *[F.count_if(F.col("conf") >= c).alias(f"n{j}") for j, c in enumerate((0.1, 0.25, 0.4, 0.55))])
    return counts.selectExpr("f", "stack(4, 0.1D, n0, 0.25D, n1, 0.4D, n2, 0.55D, n3) AS (conf_min, n)").selectExpr("conf_min", "round(n / f, 2) AS avg_det")


@query("jon16_label_images", "SELECT stem, arg_min(ext, rank) AS ext FROM (SELECT CAST(p_partkey // 3 AS STRING) AS stem, ['jpg', 'jpeg', 'png'][CAST(p_size % 3 AS INT) + 1] AS ext, p_size % 3 AS rank FROM part) AS q GROUP BY 1")
def _(spark, sf):
    images = spark.read.parquet(f"{sf}/part.parquet").selectExpr("CAST(p_partkey div 3 AS STRING) AS stem", "array('jpg', 'jpeg', 'png')[CAST(p_size % 3 AS INT)] AS ext", "p_size % 3 AS rank")
    return images.groupBy("stem").agg(F.min_by("ext", "rank").alias("ext"))


_SEG = """sf AS (SELECT clip_id, frame, bool_or(is_cut_frame) AS cut FROM det GROUP BY 1, 2),
sn AS (SELECT *, sum(CASE WHEN cut AND frame > (SELECT min(frame) FROM sf) THEN 1 ELSE 0 END) OVER (ORDER BY frame) AS segment FROM sf),
ss AS (SELECT clip_id, CAST(segment AS BIGINT) AS segment, min(frame) AS start, max(frame) AS last FROM sn GROUP BY 1, 2),
seg AS (SELECT clip_id, segment, start, coalesce(lead(start) OVER (ORDER BY segment) - 1, last) AS "end" FROM ss)"""


@query("win05_segments", f'WITH {_SEG} SELECT clip_id, segment, start, "end" FROM seg')
def _(spark, sf):
    return R.segments(detections(spark, sf))


@query("jon17_rows_of_segments", f'WITH {_SEG} SELECT d.event_id, s.segment FROM det d JOIN seg s ON d.frame BETWEEN s.start AND s."end"')
def _(spark, sf):
    return R.of_segment(detections(spark, sf)).select("event_id", "segment")


@query("jon18_keep_semi", "SELECT event_id, conf FROM det WHERE track_id IN (SELECT track_id FROM det WHERE conf > 0.95)")
def _(spark, sf):
    det = detections(spark, sf)
    return det.join(det.filter("conf > 0.95").select("track_id").distinct(), "track_id", "left_semi").select("event_id", "conf")


@query("jon19_neighbours", "WITH f AS (SELECT frame, count(*) AS n FROM det GROUP BY 1) SELECT f.frame, coalesce(a.n, 0) AS before2, coalesce(b.n, 0) AS after2 FROM f LEFT JOIN f a ON a.frame = f.frame - 2 LEFT JOIN f b ON b.frame = f.frame + 2")
def _(spark, sf):
    f = detections(spark, sf).groupBy("frame").agg(F.count("*").alias("n"))
    a = f.select((F.col("frame") + 2).alias("frame"), F.col("n").alias("before2"))
    b = f.select((F.col("frame") - 2).alias("frame"), F.col("n").alias("after2"))
    return f.join(a, "frame", "left").join(b, "frame", "left").select("frame", F.coalesce("before2", F.lit(0)).alias("before2"), F.coalesce("after2", F.lit(0)).alias("after2"))


@query("jon21_parity", "SELECT count(DISTINCT frame) FILTER (WHERE k % 2 = 0) AS online_frames, count(DISTINCT frame) AS offline_frames, round(count(*) FILTER (WHERE k % 2 = 0) / greatest(1, count(DISTINCT frame) FILTER (WHERE k % 2 = 0)), 3) AS online_avg, round(count(*) / greatest(1, count(DISTINCT frame)), 3) AS offline_avg FROM det")
def _(spark, sf):
    det = detections(spark, sf)
    side = lambda rows, name: rows.agg(F.count_distinct("frame").alias(f"{name}_frames"), F.round(F.count("*") / F.greatest(F.lit(1), F.count_distinct("frame")), 3).alias(f"{name}_avg"))
    return side(det.filter("k % 2 = 0"), "online").join(side(det, "offline"), F.lit(True))  # one row each


# Aggregations

_GATE = f"""WITH f AS (SELECT frame, count(DISTINCT track_id) AS n FROM det GROUP BY 1), a AS (SELECT count(*) AS n_rows, count(DISTINCT track_id) AS unique_tracks, avg(CAST(mask_is_fallback AS DOUBLE)) AS fallback_rate,
CAST(count(*) FILTER (WHERE {S.GATE_FP}) AS DOUBLE) / greatest(1, count(*)) AS fp_rate FROM det), g AS (SELECT *, (SELECT median(n) FROM f) AS median_det, (SELECT count(*) FROM f) AS frames FROM a)"""


@query("agg05_gate_figures", f"{_GATE} SELECT n_rows, unique_tracks, fallback_rate, fp_rate, median_det, frames FROM g")
def _(spark, sf):
    return A.gate_figures(detections(spark, sf))


@query("gat01_ir_gate", f"""{_GATE} SELECT n_rows, unique_tracks, fallback_rate, fp_rate, median_det, frames, median_det >= 12 AS check_median, fp_rate <= 0.20 AS check_fp, unique_tracks >= 8 AS check_tracks,
fallback_rate <= 0.30 AS check_fallback, median_det >= 12 AND fp_rate <= 0.20 AND unique_tracks >= 8 AND fallback_rate <= 0.30 AS pass, CAST(NULL AS VARCHAR) AS reason FROM g""")
def _(spark, sf):
    return gates.ir_gate(detections(spark, sf))


@query("agg01_per_frame", "SELECT frame, count(DISTINCT track_id) AS n, count(*) AS rows FROM det GROUP BY frame")
def _(spark, sf):
    return A.per_frame(detections(spark, sf))


@query("agg09_route_metrics", f"""WITH {ANN}, s AS (SELECT track_id, count(DISTINCT frame) AS n, max(frame) - min(frame) + 1 AS span FROM det GROUP BY 1), f AS (SELECT frame, count(DISTINCT track_id) AS n FROM det GROUP BY 1),
g AS (SELECT frame - lag(frame) OVER (PARTITION BY track_id ORDER BY frame) AS gap FROM (SELECT DISTINCT track_id, frame FROM det) AS q)
SELECT {r6('avg(n / span)')} AS completeness, {r6('greatest(0, count(*) / greatest(1, (SELECT median(n) FROM f)) - 1)')} AS fragmentation, (SELECT count(*) FILTER (WHERE gap > 1) FROM g) AS id_switches,
(SELECT CAST(count(*) FILTER (WHERE team = correct_team) AS DOUBLE) / count(*) FROM ann JOIN det USING (frame, track_id)) AS team_accuracy FROM s""")
def _(spark, sf):
    rows = A.route_metrics(detections(spark, sf), annotations(spark, sf))
    return rows.selectExpr(f"{r6('completeness')} AS completeness", f"{r6('fragmentation')} AS fragmentation", "id_switches", "team_accuracy")


def many_clips(spark: SparkSession, sf: str) -> DataFrame:
    """The detections as 16 clips, whose frame numbers overlap: a user's tracks are in clip user_id modulo 16."""
    return detections(spark, sf).withColumn("clip_id", F.expr("concat('clip', CAST(user_id % 16 AS STRING))"))


_CLIPS = "c AS (SELECT * REPLACE (concat('clip', CAST(user_id % 16 AS VARCHAR)) AS clip_id) FROM det)"


@query("gat01_gate_of_clips", f"""WITH {_CLIPS}, f AS (SELECT clip_id, frame, count(DISTINCT track_id) AS n FROM c GROUP BY 1, 2), m AS (SELECT clip_id, median(n) AS median_det, count(*) AS frames FROM f GROUP BY 1),
a AS (SELECT clip_id, count(*) AS n_rows, count(DISTINCT track_id) AS unique_tracks, avg(CAST(mask_is_fallback AS DOUBLE)) AS fallback_rate, CAST(count(*) FILTER (WHERE {S.GATE_FP}) AS DOUBLE) / count(*) AS fp_rate FROM c GROUP BY 1)
SELECT clip_id, n_rows, unique_tracks, {r6('fallback_rate')} AS fallback_rate, {r6('fp_rate')} AS fp_rate, median_det, frames,
median_det >= 12 AND fp_rate <= 0.20 AND unique_tracks >= 8 AND fallback_rate <= 0.30 AS pass FROM a JOIN m USING (clip_id)""")
def _(spark, sf):
    rows = gates.ir_gate(many_clips(spark, sf), by=("clip_id",))
    return rows.selectExpr("clip_id", "n_rows", "unique_tracks", f"{r6('fallback_rate')} AS fallback_rate", f"{r6('fp_rate')} AS fp_rate", "median_det", "frames", "pass")


@query("agg09_metrics_of_clips", f"""WITH {_CLIPS}, s AS (SELECT clip_id, track_id, count(DISTINCT frame) AS n, max(frame) - min(frame) + 1 AS span FROM c GROUP BY 1, 2),
f AS (SELECT clip_id, median(n) AS m FROM (SELECT clip_id, frame, count(DISTINCT track_id) AS n FROM c GROUP BY 1, 2) AS q GROUP BY 1),
g AS (SELECT clip_id, count(*) FILTER (WHERE gap > 1) AS id_switches FROM (SELECT clip_id, frame - lag(frame) OVER (PARTITION BY clip_id, track_id ORDER BY frame) AS gap FROM (SELECT DISTINCT clip_id, track_id, frame FROM c) AS q) AS q GROUP BY 1),
t AS (SELECT clip_id, count(*) FILTER (WHERE team = CAST(user_id % 2 AS INT)) / CAST(count(*) AS DOUBLE) AS team_accuracy FROM c WHERE k % 2 = 0 AND k % 8 <> 0 GROUP BY 1)
SELECT s.clip_id, {r6('avg(n / span)')} AS completeness, {r6('greatest(0, count(*) / greatest(1, any_value(m)) - 1)')} AS fragmentation, any_value(id_switches) AS id_switches, {r6('any_value(team_accuracy)')} AS team_accuracy
FROM s JOIN f ON s.clip_id = f.clip_id JOIN g ON s.clip_id = g.clip_id LEFT JOIN t ON s.clip_id = t.clip_id GROUP BY 1""")
def _(spark, sf):
    clip = F.expr("concat('clip', CAST((track_id div 1000) % 16 AS STRING))")
    rows = A.route_metrics(many_clips(spark, sf), annotations(spark, sf).withColumn("clip_id", clip), by=("clip_id",))
    return rows.selectExpr("clip_id", f"{r6('completeness')} AS completeness", f"{r6('fragmentation')} AS fragmentation", "id_switches", f"{r6('team_accuracy')} AS team_accuracy")


@query("agg14_quantiles", "SELECT quantile_cont(conf, 0.1) AS p10, quantile_cont(conf, 0.5) AS p50, quantile_cont(conf, 0.9) AS p90 FROM det")
def _(spark, sf):
    return quantiles.exact_quantiles(detections(spark, sf), "conf", {"p10": 0.1, "p50": 0.5, "p90": 0.9})


@query("agg16_bucket_percent", f"WITH b AS (SELECT {S.AREA_BUCKET.replace('area', S.area())} AS bucket FROM det) SELECT bucket, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER () AS pct FROM b GROUP BY 1")
def _(spark, sf):
    return A.bucket_counts(S.add(detections(spark, sf), area=S.area()), S.AREA_BUCKET)


@query("agg18_detection_stats", "WITH f AS (SELECT frame, count(*) FILTER (WHERE k % 3 = 0) AS n FROM det GROUP BY 1) SELECT count(*) AS frames, CAST(sum(n) AS BIGINT) AS total, max(n) AS most, count(*) FILTER (WHERE n = 0) AS zero_frames FROM f")
def _(spark, sf):
    f = detections(spark, sf).groupBy("frame").agg(F.count_if(F.expr("k % 3 = 0")).alias("n"))
    return f.agg(F.count("*").alias("frames"), F.sum("n").alias("total"), F.max("n").alias("most"), F.count_if(F.col("n") == 0).alias("zero_frames"))


@query("agg19_weighted_hue", f"SELECT team, {r6(f'sum({S.WEIGHT} * feat_h) / sum({S.WEIGHT})')} AS hue FROM detf WHERE team >= 0 GROUP BY 1", True)
def _(spark, sf):
    return with_features(spark, sf).filter("team >= 0").groupBy("team").agg(F.expr(r6(f"sum({S.WEIGHT} * feat_h) / sum({S.WEIGHT})")).alias("hue"))


_CD = " + ".join(f"power(avg({c}) FILTER (WHERE team = 0) - avg({c}) FILTER (WHERE team = 1), 2)" for c in clustering.FEATURES)


@query("agg20_centroid_distance", f"SELECT {r6(f'sqrt({_CD})')} AS dist FROM detf", True)
def _(spark, sf):
    return with_features(spark, sf).agg(F.expr(r6(f"sqrt({_CD})")).alias("dist"))


_SC = ", ".join(f"{r6(f'avg({c})')} AS mean_{c}, {r6(f'stddev_pop({c})')} AS std_{c}" for c in clustering.FEATURES)


@query("agg21_scaler", f"SELECT {_SC} FROM detf", True)
def _(spark, sf):
    return with_features(spark, sf).agg(*[F.expr(r6(f"{f}({c})")).alias(f"{n}_{c}") for c in clustering.FEATURES for f, n in (("avg", "mean"), ("stddev_pop", "std"))])


@query("agg22_hsv_bounds", f"SELECT {S.truncated('greatest(0, quantile_cont(feat_h, 0.05) - 5)')} AS hue_low, {S.truncated('least(179, quantile_cont(feat_h, 0.95) + 5)')} AS hue_high, {S.truncated('greatest(20, quantile_cont(torso_px % 256, 0.10) - 10)')} AS sat_low FROM detf", True)
def _(spark, sf):
    p = lambda c, q: f"percentile({c}, {q})"
    return with_features(spark, sf).agg(
        F.expr(S.truncated(f"greatest(0, {p('feat_h', 0.05)} - 5)")).alias("hue_low"), F.expr(S.truncated(f"least(179, {p('feat_h', 0.95)} + 5)")).alias("hue_high"),
        F.expr(S.truncated(f"greatest(20, {p('torso_px % 256', 0.10)} - 10)")).alias("sat_low"),
    )


_STATE = "CASE WHEN frame < 60 THEN 'WARMUP' WHEN frame < 90 THEN 'CALIBRATING' ELSE 'LOCKED' END"


@query("agg23_state_histogram", f"WITH f AS (SELECT DISTINCT frame, {_STATE} AS state FROM det) SELECT state, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER () AS pct FROM f GROUP BY 1")
def _(spark, sf):
    return A.bucket_counts(detections(spark, sf).select("frame").distinct(), _STATE).withColumnRenamed("bucket", "state")


@query("agg24_label_flips", "WITH l AS (SELECT track_id, team, lag(team) OVER (PARTITION BY track_id ORDER BY frame) AS b FROM det WHERE k % 3 <> 0 AND team IN (0, 1)) SELECT count(*) FILTER (WHERE b <> team) AS flips, count(DISTINCT track_id) AS tracks, CAST(count(*) FILTER (WHERE b <> team) AS DOUBLE) / greatest(1, count(DISTINCT track_id)) AS flip_rate FROM l")
def _(spark, sf):
    return A.label_flips(detections(spark, sf).selectExpr("frame", "track_id", "team AS label", "k % 3 <> 0 AS locked"))


@query("agg25_churn", "WITH f AS (SELECT frame, lag(frame) OVER (ORDER BY frame) AS p FROM (SELECT DISTINCT frame FROM det) AS q), d AS (SELECT frame, lag(frame) OVER (PARTITION BY track_id ORDER BY frame) AS o FROM det) SELECT count(*) FILTER (WHERE o IS NULL OR p IS NULL OR o <> p) AS new_ids, count(DISTINCT d.frame) AS frames, CAST(count(*) FILTER (WHERE o IS NULL OR p IS NULL OR o <> p) AS DOUBLE) / count(DISTINCT d.frame) AS churn FROM d JOIN f ON d.frame = f.frame")
def _(spark, sf):
    return A.churn(detections(spark, sf))


@query("agg28_registration_coverage", "WITH f AS (SELECT frame, bool_or(k % 7 = 0) AS ok FROM det GROUP BY 1) SELECT count(*) FILTER (WHERE ok) AS valid, 100.0 * count(*) FILTER (WHERE ok) / count(*) AS pct, min(frame) FILTER (WHERE ok) AS first_valid FROM f")
def _(spark, sf):
    f = detections(spark, sf).groupBy("frame").agg(F.max(F.expr("k % 7 = 0")).alias("ok"))
    return f.agg(F.count_if("ok").alias("valid"), (100.0 * F.count_if("ok") / F.count("*")).alias("pct"), F.min(F.when(F.col("ok"), F.col("frame"))).alias("first_valid"))


@query("agg29_qa_stats", f"SELECT CAST(count(*) FILTER (WHERE torso_px >= 900) AS DOUBLE) / count(*) AS keep_rate, {r6('avg(conf) FILTER (WHERE torso_px >= 900)')} AS mean_iou, {r6('avg(torso_px) FILTER (WHERE torso_px >= 900)')} AS mean_area FROM det")
def _(spark, sf):
    ok = "torso_px >= 900"
    return detections(spark, sf).selectExpr(f"count_if({ok}) / count(*) AS keep_rate", f"{r6(f'avg(conf) FILTER (WHERE {ok})')} AS mean_iou", f"{r6(f'avg(torso_px) FILTER (WHERE {ok})')} AS mean_area")


@query("agg30_rescue_counts", "WITH t AS (SELECT CAST(unnest([0.05, 0.08, 0.10, 0.15, 0.20]) AS DOUBLE) AS thr), c AS (SELECT thr, count(DISTINCT frame) FILTER (WHERE CAST((k % 25) / 100.0 AS DOUBLE) BETWEEN thr AND 0.3) AS n FROM det, t GROUP BY 1) SELECT thr AS recommended, n FROM c ORDER BY n DESC, thr LIMIT 1")
def _(spark, sf):
    rows = detections(spark, sf).withColumn("thr", F.explode(F.array(*[F.lit(x) for x in (0.05, 0.08, 0.10, 0.15, 0.20)])))
    counts = rows.filter("CAST((k % 25) / 100.0D AS DOUBLE) BETWEEN thr AND 0.3D").groupBy("thr").agg(F.count_distinct("frame").alias("n"))
    return counts.agg(F.max_by("thr", F.struct("n", -F.col("thr"))).alias("recommended"), F.max("n").alias("n"))


@query("agg31_brightness_split", f"WITH {_SEG}, m AS (SELECT segment, avg(torso_px % 200) AS lum FROM det d JOIN seg s ON d.frame BETWEEN s.start AND s.\"end\" GROUP BY 1) SELECT count(*) AS segments, count(*) >= 2 AND max(lum) - min(lum) > 15 AS split FROM m")
def _(spark, sf):
    m = R.of_segment(detections(spark, sf)).groupBy("segment").agg(F.avg(F.expr("torso_px % 200")).alias("lum"))
    return m.agg(F.count("*").alias("segments"), ((F.count("*") >= 2) & (F.max("lum") - F.min("lum") > P.brightness_delta)).alias("split"))


_TOTALS = f"WITH f AS (SELECT frame, count(*) FILTER (WHERE k % 3 = 0) AS n FROM det GROUP BY 1), t AS (SELECT (SELECT count(*) FROM f) AS frames, count(*) AS dets, count(*) FILTER (WHERE {S.GATE_FP}) AS fp, CAST(count(*) FILTER (WHERE {S.GATE_FP}) AS DOUBLE) / greatest(1, count(*)) AS fp_rate, (SELECT CAST(count(*) FILTER (WHERE n = 0) AS DOUBLE) / count(*) FROM f) AS zero_rate FROM det)"


def _totals(spark, sf):
    det = detections(spark, sf)
    f = det.groupBy("frame").agg(F.count_if(F.expr("k % 3 = 0")).alias("n")).agg(F.count("*").alias("frames"), (F.count_if(F.col("n") == 0) / F.count("*")).alias("zero_rate"))
    rows = det.selectExpr("count(*) AS dets", f"count_if({S.GATE_FP}) AS fp", f"count_if({S.GATE_FP}) / greatest(1, count(*)) AS fp_rate")
    return f.join(rows, F.lit(True)).select("frames", "dets", "fp", "fp_rate", "zero_rate")  # one row each


@query("gat02_broadcast_gate", f"{_TOTALS} SELECT *, fp_rate < 0.20 AS pass_fp, zero_rate < 0.05 AS pass_zero, fp_rate < 0.20 AND zero_rate < 0.05 AS pass FROM t")
def _(spark, sf):
    return gates.broadcast_gate(_totals(spark, sf))


@query("agg35_rejection_counter", f"WITH r AS (SELECT frame // 150 AS win, {S.WARMUP_REASON} AS reason FROM (SELECT *, helmet_hits > 0 AS helmet, k % 4 AS fails, k AS upper_px, CAST((event_id % 50) / 100.0 AS DOUBLE) AS field_overlap FROM det) AS q) SELECT win, reason, count(*) AS n FROM r WHERE reason <> 'ok' GROUP BY 1, 2")
def _(spark, sf):
    rows = S.add(detections(spark, sf), helmet="helmet_hits > 0", fails="k % 4", upper_px="k", field_overlap="CAST((event_id % 50) / 100.0 AS DOUBLE)", win="frame div 150")
    return S.add(rows, reason=S.WARMUP_REASON).filter("reason <> 'ok'").groupBy("win", "reason").agg(F.count("*").alias("n"))


# Sequences

_SPEED = "sp AS (SELECT event_id, frame, track_id, sqrt(power((x1 + x2) / 2 - lag((x1 + x2) / 2) OVER w, 2) + power(y2 - lag(y2) OVER w, 2)) AS speed FROM det WINDOW w AS (PARTITION BY track_id ORDER BY frame)), fs AS (SELECT frame, coalesce(median(speed), 0) AS speed FROM sp GROUP BY 1), bl AS (SELECT frame, speed, row_number() OVER (ORDER BY frame) - 1 AS pos, CASE WHEN row_number() OVER (ORDER BY frame) >= 10 THEN median(speed) OVER (ORDER BY frame ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) ELSE 0.0 END AS base FROM fs)"


@query("win01_speed", f"WITH {_SPEED} SELECT event_id, {r6('speed')} AS speed FROM sp")
def _(spark, sf):
    return W.speeds(detections(spark, sf)).selectExpr("event_id", f"{r6('speed')} AS speed")


@query("agg13_frame_speed", f"WITH {_SPEED} SELECT frame, {r6('speed')} AS speed FROM fs")
def _(spark, sf):
    return W.frame_speed(detections(spark, sf)).selectExpr("frame", f"{r6('speed')} AS speed")


@query("win02_baseline", f"WITH {_SPEED} SELECT frame, pos, {r6('base')} AS base FROM bl")
def _(spark, sf):
    return W.baseline(W.frame_speed(detections(spark, sf))).selectExpr("frame", "CAST(pos AS BIGINT) AS pos", f"{r6('base')} AS base")


@query("win03_snap", f"WITH {_SPEED} SELECT 'events' AS clip_id, coalesce(min(frame) FILTER (WHERE pos >= 10 AND speed > {FACTOR} * greatest(base, 0.001)), min(frame)) AS snap_frame FROM bl")
def _(spark, sf):
    return W.snap_frame(detections(spark, sf), factor=FACTOR)


@query("prj06_time_since_snap", f"WITH {_SPEED}, s AS (SELECT coalesce(min(frame) FILTER (WHERE pos >= 10 AND speed > {FACTOR} * greatest(base, 0.001)), min(frame)) AS f FROM bl) SELECT event_id, frame - f AS t_from_snap FROM det, s WHERE frame BETWEEN f AND f + 240")
def _(spark, sf):
    det = detections(spark, sf)
    return W.trimmed(det, W.snap_frame(det, factor=FACTOR)).select("event_id", "t_from_snap")


@query("win04_gap_counts", "WITH g AS (SELECT track_id, frame - lag(frame) OVER (PARTITION BY track_id ORDER BY frame) AS gap FROM (SELECT DISTINCT track_id, frame FROM det) AS q) SELECT track_id, count(*) FILTER (WHERE gap > 1) AS gaps FROM g GROUP BY 1")
def _(spark, sf):
    g = detections(spark, sf).select("track_id", "frame").distinct().withColumn("gap", F.col("frame") - F.lag("frame").over(Window.partitionBy("track_id").orderBy("frame")))
    return g.groupBy("track_id").agg(F.count_if(F.col("gap") > 1).alias("gaps"))


def heartbeat(spark, sf):
    return detections(spark, sf).groupBy("clip_id", "frame").agg(F.max("k").cast("double").alias("mad"), F.min("k").alias("mask_top"), (F.max("k") + 400).alias("mask_bottom"))


@query("win06_cut_flags", "WITH f AS (SELECT frame, max(k) > 45 AS high FROM det GROUP BY 1), i AS (SELECT *, sum(CASE WHEN high THEN 0 ELSE 1 END) OVER (ORDER BY frame) AS g FROM f) SELECT frame, high AND sum(CASE WHEN high THEN 1 ELSE 0 END) OVER (PARTITION BY g ORDER BY frame) % 2 = 0 AS is_cut FROM i")
def _(spark, sf):
    return W.cut_flags(heartbeat(spark, sf)).select("frame", "is_cut")


@query("win08_held_extent", "WITH f AS (SELECT frame, min(k) AS t, max(k) + 400 AS b FROM det GROUP BY 1) SELECT frame, min(t) OVER w AS held_top, max(b) OVER w AS held_bottom FROM f WINDOW w AS (ORDER BY frame RANGE BETWEEN 4 PRECEDING AND CURRENT ROW)")
def _(spark, sf):
    return W.held_extent(heartbeat(spark, sf)).select("frame", "held_top", "held_bottom")


@query("win10_smoothed_box", f"""WITH b AS (SELECT *, CASE WHEN frame - lag(frame) OVER w = 1 THEN 0 ELSE 1 END AS brk FROM det WINDOW w AS (PARTITION BY track_id ORDER BY frame)),
i AS (SELECT *, sum(brk) OVER (PARTITION BY track_id ORDER BY frame) AS island FROM b),
h AS (SELECT event_id, list(x1) OVER w AS xs, list(y1) OVER w AS ys FROM i WINDOW w AS (PARTITION BY track_id, island ORDER BY frame ROWS UNBOUNDED PRECEDING))
SELECT event_id, {S.truncated('list_reduce(xs, lambda m, x: 0.6 * x + 0.4 * m)')} AS sx1, {S.truncated('list_reduce(ys, lambda m, y: 0.6 * y + 0.4 * m)')} AS sy1 FROM h""")
def _(spark, sf):
    return W.smoothed(detections(spark, sf)).select("event_id", "sx1", "sy1")


@query("win11_helmet_votes", "SELECT event_id, sum(CASE WHEN helmet_hits > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY frame ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) >= 1 OR row_number() OVER (PARTITION BY track_id ORDER BY frame) <= 15 AS allowed FROM det")
def _(spark, sf):
    order = Window.partitionBy("track_id").orderBy("frame")
    votes = F.sum(F.when(F.col("helmet_hits") > 0, 1).otherwise(0)).over(order.rowsBetween(1 - P.helmet_window, 0))
    return detections(spark, sf).select("event_id", ((votes >= P.helmet_required) | (F.row_number().over(order) <= P.helmet_grace)).alias("allowed"))


@query("win13_unanimous", "SELECT event_id, count(*) OVER w = 4 AND min(team) OVER w = max(team) OVER w AS sure FROM det WINDOW w AS (PARTITION BY track_id ORDER BY frame ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)")
def _(spark, sf):
    w = Window.partitionBy("track_id").orderBy("frame").rowsBetween(-3, 0)
    return detections(spark, sf).select("event_id", ((F.count("*").over(w) == 4) & (F.min("team").over(w) == F.max("team").over(w))).alias("sure"))


@query("win14_first_locked", f"SELECT min(frame) FILTER (WHERE {_STATE} = 'LOCKED') AS first_locked FROM det")
def _(spark, sf):
    return detections(spark, sf).agg(F.min(F.when(F.expr(_STATE) == "LOCKED", F.col("frame"))).alias("first_locked"))


@query("win15_flips_at_cuts", """WITH c AS (SELECT DISTINCT frame AS cut FROM det WHERE is_cut_frame), s AS (SELECT cut, track_id, frame >= cut AS later, team, count(*) AS n FROM det JOIN c ON abs(det.frame - c.cut) <= 5 WHERE team >= 0 GROUP BY 1, 2, 3, 4),
m AS (SELECT cut, track_id, later, team, row_number() OVER (PARTITION BY cut, track_id, later ORDER BY n DESC, team) AS rn FROM s)
SELECT a.cut, count(*) AS flips FROM m a JOIN m b ON a.cut = b.cut AND a.track_id = b.track_id AND NOT a.later AND b.later AND a.rn = 1 AND b.rn = 1 WHERE a.team <> b.team GROUP BY 1""")
def _(spark, sf):
    det = detections(spark, sf)
    cuts = det.filter("is_cut_frame").select(F.col("frame").alias("cut")).distinct().withColumn("frame", F.explode(F.expr("sequence(cut - 5, cut + 5)")))
    n = det.filter("team >= 0").join(cuts, "frame").groupBy("cut", "track_id", (F.col("frame") >= F.col("cut")).alias("later"), "team").agg(F.count("*").alias("n"))
    side = n.groupBy("cut", "track_id").agg(*[F.max_by(F.when(F.col("later") == f, F.col("team")), F.when(F.col("later") == f, F.struct("n", -F.col("team")))).alias(c) for f, c in ((False, "a"), (True, "b"))])
    return side.filter("a <> b").groupBy("cut").agg(F.count("*").alias("flips"))


# Sorts, limits, sets

_OVER = "(greatest(0, least(b.x2, r.x2) - greatest(b.x1, r.x1)) * greatest(0, least(b.y2, r.y2) - greatest(b.y1, r.y1)))"
_AREAS = "((b.x2 - b.x1) * (b.y2 - b.y1) + (r.x2 - r.x1) * (r.y2 - r.y1))"


@query("srt02_suppressed", f"""WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY conf DESC, track_id) AS n FROM det),
nms(frame, n, track_id, conf, ok, kept) AS (SELECT DISTINCT frame, CAST(0 AS BIGINT), CAST(-1 AS BIGINT), CAST(0 AS DOUBLE), false, CAST([] AS STRUCT(x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE)[]) FROM ranked
 UNION ALL SELECT r.frame, r.n, r.track_id, r.conf, len(list_filter(k.kept, lambda b: {_OVER} > 0.7 * ({_AREAS} - {_OVER}))) = 0,
  CASE WHEN len(list_filter(k.kept, lambda b: {_OVER} > 0.7 * ({_AREAS} - {_OVER}))) = 0 THEN list_append(k.kept, struct_pack(x1 := r.x1, y1 := r.y1, x2 := r.x2, y2 := r.y2)) ELSE k.kept END
 FROM nms k JOIN ranked r ON r.frame = k.frame AND r.n = k.n + 1)
SELECT frame, track_id, conf FROM nms WHERE ok""", recursive=True)
def _(spark, sf):
    return greedy.suppressed(detections(spark, sf)).select("frame", "track_id", "conf")


@query("srt05_reservoir", f"""WITH q AS (SELECT event_id, track_id, {S.QUALITY} AS score FROM det), t AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY score DESC, event_id) AS rn FROM q)
SELECT event_id, {r6('score')} AS score FROM t WHERE rn <= 3 ORDER BY t.score DESC, event_id LIMIT 70""")
def _(spark, sf):
    rows = S.add(detections(spark, sf), score=S.QUALITY)
    top = rows.withColumn("rn", F.row_number().over(Window.partitionBy("track_id").orderBy(F.desc("score"), "event_id"))).filter("rn <= 3")
    return top.orderBy(F.desc("score"), "event_id").limit(70).selectExpr("event_id", f"{r6('score')} AS score")


@query("srt07_strided_sample", f"WITH b AS (SELECT event_id, {S.AREA_BUCKET.replace('area', S.area())} AS bucket FROM det), n AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY event_id) - 1 AS rn, count(*) OVER (PARTITION BY bucket) AS c FROM b) SELECT event_id, bucket FROM n WHERE rn % greatest(1, c // 5) = 0 AND rn // greatest(1, c // 5) < 5")
def _(spark, sf):
    rows = S.add(S.add(detections(spark, sf), area=S.area()), bucket=S.AREA_BUCKET).select("event_id", "bucket")
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("c"))
    n = rows.withColumn("rn", F.row_number().over(Window.partitionBy("bucket").orderBy("event_id")) - 1).join(F.broadcast(sizes), "bucket")  # a row a bucket
    return n.filter("rn % greatest(1, c div 5) = 0 AND rn div greatest(1, c div 5) < 5").select("event_id", "bucket")


@query("srt08_top_causes", f"WITH c AS (SELECT event_id, {S.CAUSE} AS cause FROM (SELECT *, {', '.join(f'{v} AS {k}' for k, v in _CAUSES.items())} FROM det) AS q) SELECT event_id FROM c WHERE cause = 'CenterEaten' ORDER BY event_id LIMIT 12")
def _(spark, sf):
    return S.add(S.add(detections(spark, sf), **_CAUSES), cause=S.CAUSE).filter("cause = 'CenterEaten'").select("event_id").orderBy("event_id").limit(12)


@query("srt10_most_common", "SELECT user_id, count(*) AS n FROM det GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10")
def _(spark, sf):
    return detections(spark, sf).groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(10)


@query("set01_first_source_wins", "WITH s AS (SELECT CASE WHEN p_partkey % 10 = 0 THEN 'val' ELSE 'train' END AS split, CAST(p_partkey % 97 AS STRING) AS stem, p_partkey % 10 AS priority, p_name AS name, p_partkey FROM part WHERE p_size % 7 <> 0) SELECT split, stem, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY split, stem ORDER BY priority, name, p_partkey) AS rn FROM s) AS q WHERE rn = 1")
def _(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet").filter("p_size % 7 <> 0")
    rows = part.selectExpr("CASE WHEN p_partkey % 10 = 0 THEN 'val' ELSE 'train' END AS split", "CAST(p_partkey % 97 AS STRING) AS stem", "p_partkey % 10 AS priority", "p_name AS name", "p_partkey")
    return R.first_wins(rows, ["split", "stem"], ["priority", "name", "p_partkey"]).select("split", "stem", "p_partkey")


@query("set02_new_ids", "SELECT DISTINCT frame, track_id FROM det d WHERE NOT EXISTS (SELECT 1 FROM det p WHERE p.frame = d.frame - 1 AND p.track_id = d.track_id)")
def _(spark, sf):
    det = detections(spark, sf).select("frame", "track_id").distinct()
    return det.join(det.select((F.col("frame") + 1).alias("frame"), "track_id"), ["frame", "track_id"], "left_anti")


@query("set04_disjoint", "SELECT (SELECT count(*) FROM (SELECT user_id FROM det WHERE user_id % 10 = 0 INTERSECT SELECT user_id FROM det WHERE user_id % 10 <> 0) AS q) = 0 AS disjoint")
def _(spark, sf):
    det = detections(spark, sf)
    return det.filter("user_id % 10 = 0").select("user_id").intersect(det.filter("user_id % 10 <> 0").select("user_id")).agg((F.count("*") == 0).alias("disjoint"))


@query("set06_distinct_cuts", "SELECT DISTINCT frame FROM det WHERE is_cut_frame")
def _(spark, sf):
    return detections(spark, sf).filter("is_cut_frame").select("frame").distinct()


@query("set07_upsert", "SELECT track_id, max(frame) AS v FROM det WHERE k % 2 = 0 GROUP BY 1 UNION ALL SELECT track_id, min(frame) AS v FROM det WHERE track_id NOT IN (SELECT track_id FROM det WHERE k % 2 = 0) GROUP BY 1")
def _(spark, sf):
    det = detections(spark, sf)
    return sinks.upserted(det.groupBy("track_id").agg(F.min("frame").alias("v")), det.filter("k % 2 = 0").groupBy("track_id").agg(F.max("frame").alias("v")), "track_id")


@query("set09_stratified_split", """WITH b AS (SELECT event_id, CASE k % 10 WHEN 0 THEN 'none' WHEN 1 THEN 'few' WHEN 2 THEN 'few' WHEN 3 THEN 'mid' WHEN 4 THEN 'mid' WHEN 5 THEN 'mid' WHEN 6 THEN 'mid' ELSE 'many' END AS bin FROM det),
r AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY md5(CAST(event_id AS VARCHAR) || ':42'), event_id) AS rn, count(*) OVER (PARTITION BY bin) AS c FROM b)
SELECT event_id, bin, rn <= ceil(c * 0.1) AS is_val FROM r""")
def _(spark, sf):
    rows = S.add(detections(spark, sf), n="k % 10").selectExpr("event_id", f"{S.POSITIVES_BIN} AS bin")
    sizes = rows.groupBy("bin").agg(F.count("*").alias("c"))
    ranked = rows.withColumn("rn", F.row_number().over(Window.partitionBy("bin").orderBy(F.md5(F.expr("CAST(concat(event_id, ':42') AS BINARY)")), "event_id")))
    return ranked.join(F.broadcast(sizes), "bin").select("event_id", "bin", (F.col("rn") <= F.ceil(F.col("c") * 0.1)).alias("is_val"))  # a row a bin


# Poses, planes, matching


_KP = [(f"CAST((k + {7 * i}) % 30 AS DOUBLE)", f"CAST((k + {5 * i}) % 20 AS DOUBLE)", f"CAST((event_id + {i}) % 10 / 10.0 AS DOUBLE)") for i in range(3)]
_GOOD = " + ".join(f"CASE WHEN {c} >= 0.3 THEN 1 ELSE 0 END" for _, _, c in _KP)


def _kp_sum(axis: int) -> str:
    return " + ".join(f"CASE WHEN {kp[2]} >= 0.3 THEN {kp[axis]} ELSE 0 END" for kp in _KP)


def _kp_edge(axis: int, f: str) -> str:
    far = "1e9" if f == "least" else "-1e9"
    return f"{f}({', '.join(f'CASE WHEN {kp[2]} >= 0.3 THEN {kp[axis]} ELSE {far} END' for kp in _KP)})"


_HALF_W = "greatest(0.18 * (x2 - x1), 1.2 * spread, 6.0)"
_HALF_H = "greatest(0.10 * (y2 - y1), 6.0)"
_POSE_ROI = {
    "hx1": f"greatest(0, {S.truncated(f'floor(x1 + mx - {_HALF_W} + 0.5)')})", "hx2": f"least({FRAME_W}, {S.truncated(f'floor(x1 + mx + {_HALF_W} + 0.5)')})",
    "hy1": f"greatest(0, {S.truncated(f'floor(y1 + my - 1.2 * {_HALF_H} + 0.5)')})", "hy2": f"least({FRAME_H}, {S.truncated(f'floor(y1 + my + 1.4 * {_HALF_H} + 0.5)')})",
}


@query("prj08_pose_head_roi", f"""WITH p AS (SELECT *, {_GOOD} AS good FROM det),
q AS (SELECT *, ({_kp_sum(0)}) / good AS mx, ({_kp_sum(1)}) / good AS my, {_kp_edge(0, 'greatest')} - {_kp_edge(0, 'least')} AS spread FROM p WHERE good > 0)
SELECT event_id, {', '.join(f'{v} AS {k}' for k, v in _POSE_ROI.items())} FROM q""")
def _(spark, sf):
    points = ", ".join(f"named_struct('x', {x}, 'y', {y}, 'c', {c})" for x, y, c in _KP)
    rows = S.add(detections(spark, sf), kpts=f"filter(array({points}), p -> p.c >= 0.3)").filter("size(kpts) > 0")
    mean = lambda a: f"aggregate(kpts, 0D, (s, p) -> s + p.{a}) / size(kpts)"
    rows = S.add(rows, mx=mean("x"), my=mean("y"), spread="array_max(transform(kpts, p -> p.x)) - array_min(transform(kpts, p -> p.x))")
    return rows.selectExpr("event_id", *[f"{v} AS {k}" for k, v in _POSE_ROI.items()])


def corners_through(h: list[str]) -> str:
    """Area of the image's corners through a homography (nine expressions), over the image's area; null if a scale vanishes."""
    corners = [(0, 0), (FRAME_W, 0), (FRAME_W, FRAME_H), (0, FRAME_H)]
    q = [[f"({h[3 * r]} * {x} + {h[3 * r + 1]} * {y} + {h[3 * r + 2]})" for r in range(3)] for x, y in corners]
    xy = [(f"({a} / {c})", f"({b} / {c})") for a, b, c in q]
    cross = " + ".join(f"({xy[i][0]} * {xy[(i + 1) % 4][1]} - {xy[(i + 1) % 4][0]} * {xy[i][1]})" for i in range(4))
    return f"CASE WHEN {' OR '.join(f'abs({c}) < 1e-9' for _, _, c in q)} THEN NULL ELSE abs({cross}) / 2 / {FRAME_W * FRAME_H} END"


_H9 = ["(0.5 + k / 200.0)", "0.01", "5.0", "0.02", "(0.3 + event_id % 10 / 20.0)", "7.0", "(event_id % 5 / 100000.0)", "0.00001", "1.0"]
scalar("prj25_projected_area", {"area_frac": r6("area_frac"), "plausible": "coalesce(area_frac >= 0.08, false)"}, {"area_frac": corners_through(_H9)})


@query("jon14_court_join", f"SELECT event_id, {r6(_pj[0])} AS court_x, {r6(_pj[1])} AS court_y FROM det")
def _(spark, sf):
    h = spark.createDataFrame([("events", [x for row in HOMOGRAPHY for x in row])], "clip_id string, h array<double>")
    rows = detections(spark, sf).join(F.broadcast(h), "clip_id")  # a row a clip
    x, y = S.FOOT_X, S.FOOT_Y
    q = [f"(h[{3 * i}] * {x} + h[{3 * i + 1}] * {y} + h[{3 * i + 2}])" for i in range(3)]
    at = lambda i: r6(f"(CASE WHEN abs({q[2]}) < 1e-9 THEN NULL ELSE {q[i]} / {q[2]} END)")
    return rows.selectExpr("event_id", f"{at(0)} AS court_x", f"{at(1)} AS court_y")


@query("jon20_aligned_labels", f"""WITH c AS (SELECT user_id, avg(feat_a) FILTER (WHERE team = 0) AS a0, avg(feat_a) FILTER (WHERE team = 1) AS a1 FROM detf GROUP BY 1),
r AS (SELECT avg(feat_a) FILTER (WHERE team = 0) AS r0, avg(feat_a) FILTER (WHERE team = 1) AS r1 FROM detf)
SELECT user_id, coalesce(abs(a0 - r1) + abs(a1 - r0) < abs(a0 - r0) + abs(a1 - r1), false) AS swapped FROM c, r""", True)
def _(spark, sf):
    rows = with_features(spark, sf)
    side = lambda t, n: F.avg(F.when(F.col("team") == t, F.col("feat_a"))).alias(n)
    own, ref = rows.groupBy("user_id").agg(side(0, "a0"), side(1, "a1")), rows.agg(side(0, "r0"), side(1, "r1"))
    both = own.join(ref, F.lit(True))  # one row
    return both.selectExpr("user_id", "coalesce(abs(a0 - r1) + abs(a1 - r0) < abs(a0 - r0) + abs(a1 - r1), false) AS swapped")


@query("jon05_mask_indices", f"""WITH kept AS (SELECT frame AS image, event_id AS idx, x1 AS a_x1, y1 AS a_y1, x2 AS a_x2, y2 AS a_y2, row_number() OVER (PARTITION BY frame ORDER BY event_id) AS n FROM det WHERE conf >= 0.5),
orig AS (SELECT frame AS image, event_id AS p, x1 AS b_x1, y1 AS b_y1, x2 AS b_x2, y2 AS b_y2 FROM det),
offers AS (SELECT image, idx, n, list(p ORDER BY iou DESC, p) AS ps FROM (SELECT image, idx, n, p, {S.iou('a_', 'b_')} AS iou FROM kept JOIN orig USING (image)) AS q GROUP BY 1, 2, 3),
reusing(image, n, idx, original, used) AS (SELECT DISTINCT image, CAST(0 AS BIGINT), CAST(-1 AS BIGINT), CAST(-1 AS BIGINT), CAST([] AS BIGINT[]) FROM offers
 UNION ALL SELECT o.image, o.n, o.idx, coalesce(list_filter(o.ps, lambda p: NOT list_contains(m.used, p))[1], o.ps[1]),
  list_append(m.used, coalesce(list_filter(o.ps, lambda p: NOT list_contains(m.used, p))[1], o.ps[1])) FROM reusing m JOIN offers o ON o.image = m.image AND o.n = m.n + 1)
SELECT image, idx, original FROM reusing WHERE n > 0""", recursive=True)
def _(spark, sf):
    import pandas as pd

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        kept, original = rows[rows.conf >= 0.5].sort_values("idx"), rows.sort_values("idx")
        box = ["x1", "y1", "x2", "y2"]
        at = greedy.reuse_indices(kept[box].to_numpy(float), original[box].to_numpy(float))
        return pd.DataFrame({"image": kept.image, "idx": kept.idx, "original": original.idx.to_numpy()[at]})

    boxes = detections(spark, sf).selectExpr("frame AS image", "event_id AS idx", "conf", "x1", "y1", "x2", "y2")
    return boxes.groupBy("image").applyInPandas(run, "image long, idx long, original long")


@query("flt12_helmet_confirmed", f"""WITH a AS (SELECT {_LEFT} FROM det), b AS (SELECT {_RIGHT}, conf AS b_conf FROM det WHERE event_id % 4 = 1)
SELECT left_id, count(right_id) FILTER (WHERE b_conf >= 0.20 AND {_INSIDE}) > 0 AS confirmed FROM a LEFT JOIN b ON a.frame = b.frame GROUP BY 1""")
def _(spark, sf):
    det = detections(spark, sf)
    a, b = _sides(det, det.filter("event_id % 4 = 1 AND conf >= 0.20"))
    return R.helmet_confirmed(a, b, ["frame"], "left_id")


@query("srt01_row_order", "SELECT event_id, row_number() OVER (PARTITION BY track_id ORDER BY frame, event_id) AS pos FROM det")
def _(spark, sf):
    return detections(spark, sf).select("event_id", F.row_number().over(Window.partitionBy("track_id").orderBy("frame", "event_id")).cast("long").alias("pos"))


@query("srt04_chain_roots", f"WITH {_TRACKS}, {_CHAIN} SELECT coalesce(stable_id, track_id) AS stable_id, count(DISTINCT track_id) AS tracks, count(*) AS n FROM det LEFT JOIN chains USING (track_id) GROUP BY 1", True, True)
def _(spark, sf):
    return pass2.stitched(with_features(spark, sf)).groupBy("stable_id").agg(F.count_distinct("track_id").alias("tracks"), F.count("*").alias("n"))


@query("srt11_first_frames", "SELECT count(*) AS n FROM det WHERE frame < 100")
def _(spark, sf):
    return detections(spark, sf).filter("frame < 100").agg(F.count("*").alias("n"))


@query("agg06_completeness", f"WITH s AS (SELECT track_id, count(DISTINCT frame) AS n, max(frame) - min(frame) + 1 AS span FROM det GROUP BY 1) SELECT {r6('avg(n / span)')} AS completeness FROM s")
def _(spark, sf):
    return A.route_metrics(detections(spark, sf)).selectExpr(f"{r6('completeness')} AS completeness")


@query("agg32_broadcast_totals", f"{_TOTALS} SELECT * FROM t")
def _(spark, sf):
    return _totals(spark, sf)


@query("gat05_seg_gate", "SELECT track_id, max(conf) >= 0.75 AND avg(conf) >= 0.75 AND min(conf) >= 0.55 AND max(conf) >= 0.70 AS pass FROM det GROUP BY 1")
def _(spark, sf):
    rows = detections(spark, sf).groupBy("track_id").agg(F.max("conf").alias("recall"), F.avg("conf").alias("map50"), F.min("conf").alias("map75"), F.max("conf").alias("mask_recall"))
    return gates.seg_gate(rows).select("track_id", "pass")


@query("gat09_version_gate", "SELECT p_partkey, coalesce(p_size % 2 = 0 AND p_partkey % 3 <> 0, false) AS ok FROM part")
def _(spark, sf):
    rows = spark.read.parquet(f"{sf}/part.parquet").selectExpr(
        "p_partkey", "CASE WHEN p_size % 2 = 0 THEN 'v2' ELSE 'v1' END AS feature_version", "0.45D AS upper_body_frac", "CASE WHEN p_partkey % 3 <> 0 THEN array(1.0D) END AS scaler"
    )
    return gates.version_gate(rows, "v2", 0.45).select("p_partkey", "ok")


_CANONICAL = f"""h AS (SELECT user_id, sum({S.WEIGHT} * feat_h) FILTER (WHERE team = 0) / sum({S.WEIGHT}) FILTER (WHERE team = 0) AS h0, sum({S.WEIGHT} * feat_h) FILTER (WHERE team = 1) / sum({S.WEIGHT}) FILTER (WHERE team = 1) AS h1 FROM detf GROUP BY 1)
SELECT event_id, CASE WHEN h0 > h1 THEN 1 - team ELSE team END AS label FROM detf JOIN h USING (user_id) WHERE team >= 0"""


def _labelled(spark, sf):
    return with_features(spark, sf).filter("team >= 0").selectExpr("user_id", "event_id", f"{S.WEIGHT} AS w", "feat_h AS hue", "feat_a", "team AS l")


@query("mlc02_canonical_labels", f"WITH {_CANONICAL}", True)
def _(spark, sf):
    return clustering.canonical_rows(_labelled(spark, sf), ["user_id"]).selectExpr("event_id", "l AS label")


@query("mlc03_aligned_labels", f"WITH {_CANONICAL}", True)
def _(spark, sf):
    """Labels aligned to those of all rows and then made canonical: the second step undoes the first."""
    return clustering.canonical_rows(clustering.aligned_rows(_labelled(spark, sf), ["user_id"], "feat_a"), ["user_id"]).selectExpr("event_id", "l AS label")


# Clustering, gates, plans, streams


_X = range(len(clustering.FEATURES))


def _far(centre: str) -> str:
    return " + ".join(f"(x{j} - {centre}{j}) * (x{j} - {centre}{j})" for j in _X)


def _means(name: str, rel: str, group: str = "0", valid: str = S.VALID_FEATURE) -> str:
    """Weighted 2-means of the valid rows of each group of a relation: {name}(g, event_id, track_id, det_team); round by round from the farthest points."""
    cols = lambda p, of="": ", ".join(f"{of}{p}{j}" for j in _X)
    moved = ", ".join(f"coalesce(round(sum(w * x{j}) FILTER (WHERE {'NOT ' if p == 'a' else ''}l) / sum(w) FILTER (WHERE {'NOT ' if p == 'a' else ''}l), 9), first({p}{j}))" for p in "ab" for j in _X)
    pt = f"{name}_pt"
    first = f"row_number() OVER (PARTITION BY g ORDER BY {_far('a')} DESC, event_id) AS rn"
    return f"""{name}_v AS (SELECT {group} AS g, event_id, track_id, CASE WHEN conf * greatest(1, torso_px) > 0 THEN conf * greatest(1, torso_px) ELSE 1e-9 END AS w, {', '.join(clustering.FEATURES)} FROM {rel} WHERE {valid}),
{name}_s AS (SELECT g, count(*) AS c, {', '.join(f'avg({c}) AS m{j}, stddev_pop({c}) AS s{j}' for j, c in enumerate(clustering.FEATURES))} FROM {name}_v GROUP BY g),
{pt} AS MATERIALIZED (SELECT g, event_id, track_id, w, feat_h AS hue, {', '.join(f'({c} - m{j}) / CASE WHEN s{j} = 0 THEN 1 ELSE s{j} END AS x{j}' for j, c in enumerate(clustering.FEATURES))} FROM {name}_v JOIN {name}_s USING (g) WHERE c >= 8),
{name}_c AS (SELECT g, {', '.join(f'round(sum(w * x{j}) / sum(w), 9) AS a{j}' for j in _X)} FROM {pt} GROUP BY g),
{name}_f AS (SELECT g, {', '.join(f'round(x{j}, 9) AS a{j}' for j in _X)} FROM (SELECT {pt}.*, {first} FROM {pt} JOIN {name}_c USING (g)) AS q WHERE rn = 1),
{name}_g AS (SELECT g, {cols('a')}, {', '.join(f'round(x{j}, 9) AS b{j}' for j in _X)} FROM (SELECT {pt}.*, {cols('a')}, {first} FROM {pt} JOIN {name}_f USING (g)) AS q WHERE rn = 1),
{name}_k(g, turn, changed, {cols('a')}, {cols('b')}, {cols('oa')}, {cols('ob')}) AS (SELECT g, 0, CAST(1 AS BIGINT), {cols('a')}, {cols('b')}, {cols('a')}, {cols('b')} FROM {name}_g
 UNION ALL SELECT g, first(turn) + 1, count(*) FILTER (WHERE l <> o), {moved}, {', '.join(f'first({p}{j})' for p in 'ab' for j in _X)}
 FROM (SELECT k.*, {pt}.* EXCLUDE (g), ({_far('b')}) < ({_far('a')}) AS l, turn > 0 AND ({_far('ob')}) < ({_far('oa')}) AS o FROM {name}_k AS k JOIN {pt} ON {pt}.g = k.g WHERE changed > 0 AND turn < 100) AS q GROUP BY g),
{name}_e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn DESC) AS rn FROM {name}_k) AS z WHERE rn = 1),
{name}_l AS (SELECT g, event_id, track_id, w, hue, CAST(({_far('b')}) < ({_far('a')}) AS INT) AS l FROM {pt} JOIN {name}_e USING (g) WHERE sqrt({' + '.join(f'(a{j} - b{j}) * (a{j} - b{j})' for j in _X)}) >= 1.5),
{name}_h AS (SELECT g, coalesce(sum(w * hue) FILTER (WHERE l = 0) / sum(w) FILTER (WHERE l = 0) > sum(w * hue) FILTER (WHERE l = 1) / sum(w) FILTER (WHERE l = 1), false) AS swap FROM {name}_l GROUP BY g),
{name} AS (SELECT g, event_id, track_id, CASE WHEN swap THEN 1 - l ELSE l END AS det_team FROM {name}_l JOIN {name}_h USING (g))"""


# A track's label in each segment, of which the last holds for all its rows.
_LAST_VOTE = """sv AS (SELECT track_id, g, det_team, row_number() OVER (PARTITION BY track_id, g ORDER BY count(*) DESC, det_team) AS rn FROM km GROUP BY 1, 2, 3),
lv AS (SELECT track_id, arg_max(det_team, g) AS voted FROM sv WHERE rn = 1 GROUP BY 1)
SELECT d.event_id, coalesce(lv.voted, d.team, -1) AS team FROM det d LEFT JOIN lv USING (track_id)"""
_SEGMENTED = 'sd AS (SELECT f.*, seg.segment FROM detf f JOIN seg ON f.frame BETWEEN seg.start AND seg."end")'


@query("mlc01_clip_teams", f"WITH {_means('km', 'detf')} SELECT event_id, det_team FROM km", True, True)
def _(spark, sf):
    return clustering.team_rows(with_features(spark, sf), S.VALID_FEATURE).select("event_id", "det_team")


@query("mlc04_segment_teams", f"WITH {_SEG}, {_SEGMENTED}, {_means('km', 'sd', 'segment')}, {_LAST_VOTE}", True, True)
def _(spark, sf):
    return pass2.assign_teams(with_features(spark, sf), by_segment=True).select("event_id", "team")


@query("mlc06_brightness_teams", f"""WITH {_SEG}, {_SEGMENTED}, lf AS (SELECT frame, segment, avg(torso_px % 200) AS lum FROM sd GROUP BY 1, 2), ls AS (SELECT segment, avg(lum) AS lum FROM lf GROUP BY 1),
sw AS (SELECT count(*) >= 2 AND max(lum) - min(lum) > 15 AS split FROM ls), sb AS (SELECT sd.* REPLACE (if(split, segment, 0) AS segment) FROM sd, sw), {_means('km', 'sb', 'segment')}, {_LAST_VOTE}""", True, True)
def _(spark, sf):
    det = with_features(spark, sf)
    luminance = det.groupBy("clip_id", "frame").agg(F.avg(F.expr("torso_px % 200")).alias("lum"))
    return pass2.assign_teams(det, luminance=luminance).select("event_id", "team")


_C = [[128.0, 128.0, 4.0, 4.0, 60.0, 4.0], [130.0, 126.0, 5.0, 5.0, 90.0, 5.0]]
_D = [f"sqrt({' + '.join(f'power({c} - {v}, 2)' for c, v in zip(clustering.FEATURES, centre))})" for centre in _C]


@query("mlc05_nearest_centre", f"SELECT event_id, {r6(_D[0])} AS dist0, {r6(_D[1])} AS dist1, CASE WHEN {_D[0]} < {_D[1]} THEN 0 ELSE 1 END AS nearest FROM detf", True)
def _(spark, sf):
    return clustering.nearest_centre(with_features(spark, sf), _C).selectExpr("event_id", f"{r6('dist0')} AS dist0", f"{r6('dist1')} AS dist1", "nearest")


@query("gat03_acceptance", f"""WITH {ANN}, f AS (SELECT frame, count(*) FILTER (WHERE k % 3 = 0) AS n, count(DISTINCT track_id) AS t FROM det GROUP BY 1),
g AS (SELECT frame - lag(frame) OVER (PARTITION BY track_id ORDER BY frame) AS gap FROM (SELECT DISTINCT track_id, frame FROM det) AS q),
m AS (SELECT count(*) FILTER (WHERE greatest(x2 - x1, 0) * greatest(y2 - y1, 1) < 900 OR greatest(x2 - x1, 0) / greatest(y2 - y1, 1) > 2.5) / greatest(1, count(*)) AS fp_rate,
 (SELECT count(*) FILTER (WHERE n = 0) / count(*) FROM f) AS zero_rate, (SELECT 100.0 * count(*) FILTER (WHERE team = correct_team) / count(*) FROM ann JOIN det USING (frame, track_id)) AS team_pct,
 greatest(0, count(DISTINCT track_id) / greatest(1, (SELECT median(t) FROM f)) - 1) AS fragmentation, (SELECT count(*) FILTER (WHERE gap > 1) FROM g) AS id_switches FROM det)
SELECT fp_rate, zero_rate, {r6('team_pct')} AS team_pct, {r6('fragmentation')} AS fragmentation, id_switches, fp_rate < 0.20 AS ok_fp, zero_rate < 0.05 AS ok_zero, team_pct > 85 AS ok_team, fragmentation < 0.15 AS ok_frag, id_switches < 2 AS ok_switches,
 fp_rate < 0.20 AND zero_rate < 0.05 AND team_pct > 85 AND fragmentation < 0.15 AND id_switches < 2 AS pass FROM m""")
def _(spark, sf):
    metrics = A.route_metrics(detections(spark, sf), annotations(spark, sf)).selectExpr("100 * team_accuracy AS team_pct", "fragmentation", "id_switches")
    rows = gates.acceptance(_totals(spark, sf).select("fp_rate", "zero_rate").join(metrics, F.lit(True)))  # one row each
    return rows.withColumns({c: F.expr(r6(c)) for c in ("team_pct", "fragmentation")})


@query("gat04_release_gate", """WITH r AS (SELECT user_id, frame, event_id, track_id, team, k % 3 <> 0 AS locked, lag(team) OVER (PARTITION BY user_id ORDER BY frame) AS was FROM det),
m AS (SELECT user_id, count(*) / count(DISTINCT frame // 48) AS avg_detections, count(*) FILTER (WHERE team < 0) / count(*) AS zero_rate, count(*) FILTER (WHERE locked) / count(*) AS locked_rate,
 arg_max(locked, frame) AS final_locked, coalesce(min(frame) FILTER (WHERE locked), 100000) - min(frame) AS lock_latency, count(*) FILTER (WHERE was <> team) / count(*) AS flip_rate,
 count(*) FILTER (WHERE team = user_id % 2) / nullif(count(*) FILTER (WHERE team >= 0), 0) AS team_accuracy, count(DISTINCT track_id) / count(DISTINCT frame) AS churn FROM r GROUP BY 1),
g AS (SELECT user_id, CAST(avg_detections >= 18 AS INT) + CAST(zero_rate <= 0.05 AS INT) + CAST(locked_rate >= 0.85 OR final_locked AS INT) + CAST(flip_rate <= 0.10 AS INT) + CAST(lock_latency < 900 AS INT)
 + CAST(team_accuracy IS NULL OR team_accuracy >= 0.90 AS INT) + CAST(churn <= 0.40 AS INT) AS passed FROM m)
SELECT user_id, passed, passed = 7 AS overall, passed >= 5 AS relaxed, passed >= 6 AS overall_relaxed FROM g""")
def _(spark, sf):
    order = Window.partitionBy("user_id").orderBy("frame")
    rows = detections(spark, sf).withColumns({"locked": F.expr("k % 3 <> 0"), "was": F.lag("team").over(order)})
    m = rows.groupBy("user_id").agg(
        (F.count("*") / F.expr("count(DISTINCT frame div 48)")).alias("avg_detections"), (F.count_if(F.col("team") < 0) / F.count("*")).alias("zero_rate"),
        (F.count_if("locked") / F.count("*")).alias("locked_rate"), F.max_by("locked", "frame").alias("final_locked"),
        (F.coalesce(F.min(F.when(F.col("locked"), F.col("frame"))), F.lit(100_000)) - F.min("frame")).alias("lock_latency"),
        (F.count_if(F.col("was") != F.col("team")) / F.count("*")).alias("flip_rate"),
        F.try_divide(F.count_if(F.expr("team = user_id % 2")), F.count_if(F.col("team") >= 0)).alias("team_accuracy"),
        (F.count_distinct("track_id") / F.count_distinct("frame")).alias("churn"),
    )
    return gates.release_gate(m, early_lock=True).select("user_id", "passed", "overall", "relaxed", "overall_relaxed")


@query("gat07_regression", "WITH c AS (SELECT track_id AS metric, avg(conf) AS value FROM det GROUP BY 1), b AS (SELECT track_id AS metric, max(conf) AS reference FROM det WHERE k % 2 = 0 GROUP BY 1) SELECT c.metric, coalesce(b.reference - c.value <= 0.05 * abs(b.reference), true) AS ok FROM c LEFT JOIN b ON c.metric = b.metric")
def _(spark, sf):
    det = detections(spark, sf)
    current = det.groupBy(F.col("track_id").alias("metric")).agg(F.avg("conf").alias("value"))
    baseline = det.filter("k % 2 = 0").groupBy(F.col("track_id").alias("metric")).agg(F.max("conf").alias("reference")).withColumn("higher_is_better", F.lit(True))
    return gates.regression_gate(current, baseline).select("metric", "ok")


def online_frames(spark: SparkSession, sf: str, track: str = "track_id", label: str = "nearest") -> DataFrame:
    """Frames of the online path by clip (here a clip for each 16th of the users), with a row for frames without detections."""
    rows = clustering.nearest_centre(with_features(spark, sf), _C)
    rows = rows.selectExpr("concat('u', user_id % 16) AS clip_id", "frame", f"{track} AS track_id", "x1", "y1", "x2", "y2", "helmet_hits", f"CAST({label} AS INT) AS label", "dist0", "dist1", "torso_px", "CAST(k AS DOUBLE) AS mad", "k % 3 > 0 AS fit_ok")
    clips = rows.groupBy("clip_id").agg(F.min("frame").alias("a"), F.max("frame").alias("b")).select("clip_id", F.explode(F.sequence("a", "b")).alias("frame"))
    shared = rows.groupBy("clip_id", "frame").agg(F.max("mad").alias("mad"), F.max("fit_ok").alias("fit_ok"))
    return clips.join(shared, ["clip_id", "frame"], "left").join(rows.drop("mad", "fit_ok"), ["clip_id", "frame"], "left")


_EMA = ", ".join(f"{S.truncated(f'list_reduce(list({c}) OVER w, lambda m, x: 0.6 * x + 0.4 * m)')} AS s{c}" for c in ("x1", "y1", "x2", "y2"))
#: The rules of a frame and of a track as recursions: cuts and registration by clip, votes by track; boxes and helmets by windows.
def _online(track: str, team: str) -> str:
    return f"""WITH o AS MATERIALIZED (SELECT concat('u', user_id % 16) AS clip_id, frame, {track} AS track_id, x1, y1, x2, y2, helmet_hits, k, CAST(torso_px AS DOUBLE) AS t, abs({_D[0]} - {_D[1]}) AS m, {team} AS lab FROM detf),
sh AS (SELECT clip_id, frame, max(k) AS mad, bool_or(k % 3 > 0) AS ok FROM o GROUP BY 1, 2),
fs AS MATERIALIZED (SELECT c.clip_id, c.frame, row_number() OVER (PARTITION BY c.clip_id ORDER BY c.frame) AS n, coalesce(mad, 0) AS mad, coalesce(ok, false) AS ok
 FROM (SELECT clip_id, unnest(range(min(frame), max(frame) + 1)) AS frame FROM o GROUP BY 1) AS c LEFT JOIN sh ON sh.clip_id = c.clip_id AND sh.frame = c.frame),
walk(clip_id, n, streak, cooldown, field, is_cut) AS (SELECT DISTINCT clip_id, CAST(0 AS BIGINT), 0, 0, 0, false FROM fs UNION ALL
 SELECT w.clip_id, f.n, CASE WHEN w.cooldown > 0 OR f.mad <= 45 OR w.streak = 1 THEN 0 ELSE 1 END, CASE WHEN w.cooldown > 0 THEN w.cooldown - 1 WHEN f.mad > 45 AND w.streak = 1 THEN 60 ELSE 0 END,
 greatest(0, w.field + CASE WHEN f.ok THEN 1 ELSE -1 END), w.cooldown = 0 AND f.mad > 45 AND w.streak = 1 FROM walk AS w JOIN fs AS f ON f.clip_id = w.clip_id AND f.n = w.n + 1),
d AS (SELECT o.*, is_cut, field >= 3 AS field_valid, CASE WHEN frame - lag(frame) OVER (PARTITION BY track_id ORDER BY frame) = 1 THEN 0 ELSE 1 END AS came
 FROM o JOIN fs USING (clip_id, frame) JOIN walk USING (clip_id, n)),
i AS (SELECT *, sum(came) OVER w AS stay, sum(CASE WHEN is_cut THEN 1 ELSE came END) OVER w AS island FROM d WINDOW w AS (PARTITION BY track_id ORDER BY frame)),
b AS (SELECT *, {_EMA}, row_number() OVER s <= 15 OR sum(CASE WHEN helmet_hits > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY track_id, stay ORDER BY frame ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) >= 1 AS helmet_ok
 FROM i WINDOW w AS (PARTITION BY track_id, island ORDER BY frame ROWS UNBOUNDED PRECEDING), s AS (PARTITION BY track_id, stay ORDER BY frame)),
v0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY frame) AS n, EXISTS (SELECT 1 FROM o AS b WHERE b.clip_id = a.clip_id AND b.frame = a.frame AND {_NEAR} > 0 AND {_NEAR} < 80) AS crowd FROM o AS a),
votes(track_id, n, area, votes, last, lock, against, label) AS (SELECT DISTINCT track_id, CAST(0 AS BIGINT), CAST(NULL AS DOUBLE), CAST([] AS INTEGER[]), -1, CAST(NULL AS INTEGER), 0, -1 FROM v0 UNION ALL
 SELECT track_id, n, area, votes, CASE WHEN lock IS NULL AND most >= 0 THEN most ELSE last END, CASE WHEN held THEN lock WHEN begins THEN lab END, CASE WHEN held THEN spoken ELSE 0 END, CASE WHEN held THEN lock ELSE most END
 FROM (SELECT *, lock IS NOT NULL AND spoken < CASE WHEN crowd THEN 20 ELSE 6 END AS held FROM (
 SELECT *, CASE WHEN len(votes) = 0 THEN last WHEN 2 * list_sum(votes) > len(votes) THEN 1 WHEN 2 * list_sum(votes) < len(votes) THEN 0 ELSE votes[1] END AS most,
 CASE WHEN lock IS NOT NULL AND sure AND lab <> lock AND m >= 3 AND t <= 2 * area THEN against + 1 ELSE 0 END AS spoken, lock IS NULL AND sure AND len(votes) >= 10 AND len(list_distinct(votes[-10:])) = 1 AS begins FROM (
 SELECT v.track_id, v.n, coalesce(0.9 * p.area + 0.1 * v.t, v.t) AS area, v.m >= 1.2 AS sure, CASE WHEN v.m >= 1.2 THEN list_append(p.votes, v.lab)[-20:] ELSE p.votes END AS votes,
 CASE WHEN v.m >= 1.2 THEN v.lab ELSE p.last END AS last, p.lock, p.against, v.t, v.m, v.lab, v.crowd FROM votes AS p JOIN v0 AS v ON v.track_id = p.track_id AND v.n = p.n + 1) AS x) AS y) AS z)
SELECT b.clip_id, b.frame, b.track_id, sx1, sy1, sx2, sy2, helmet_ok, votes.label, is_cut, field_valid, CAST(0 AS BIGINT) AS dropped FROM b JOIN v0 ON v0.track_id = b.track_id AND v0.frame = b.frame JOIN votes ON votes.track_id = v0.track_id AND votes.n = v0.n"""


@query("str01_online_batch", _online("track_id", f"CASE WHEN {_D[0]} < {_D[1]} THEN 0 ELSE 1 END"), True, True)
def _(spark, sf):
    return online.batch(online_frames(spark, sf))


_STEADY = "CASE WHEN k % 12 = 0 OR frame // 240 % 2 = 1 AND k % 3 > 0 THEN 1 - user_id % 2 ELSE user_id % 2 END"


@query("str07_locked_votes", _online("user_id", _STEADY), True, True)
def _(spark, sf):
    # A track for each user and labels that mostly agree, so tracks lock and are let go.
    return online.batch(online_frames(spark, sf, "user_id", _STEADY.replace("//", "div")))


_TEAMED = f"""{_means('km', 'detf')},
kv AS (SELECT track_id, det_team AS voted FROM (SELECT track_id, det_team, row_number() OVER (PARTITION BY track_id ORDER BY count(*) DESC, det_team) AS rn FROM km GROUP BY 1, 2) AS q WHERE rn = 1),
teamed AS MATERIALIZED (SELECT detf.* REPLACE (coalesce(kv.voted, detf.team, -1) AS team) FROM detf LEFT JOIN kv USING (track_id))"""
_ROUTES = f"""{_TEAMED}, {_tracks('teamed')}, {_CHAIN},
st AS MATERIALIZED (SELECT teamed.*, coalesce(chains.stable_id, track_id) AS stable_id FROM teamed LEFT JOIN chains USING (track_id)),
sv AS (SELECT stable_id, team AS voted FROM (SELECT stable_id, team, row_number() OVER (PARTITION BY stable_id ORDER BY count(*) DESC, team) AS rn FROM st WHERE team >= 0 GROUP BY 1, 2) AS q WHERE rn = 1),
sn0 AS (SELECT stable_id, ocr_num, row_number() OVER (PARTITION BY stable_id ORDER BY round(sum(ocr_conf), 6) DESC, min(frame * 1000000000 + event_id)) AS rn FROM st WHERE ocr_conf >= 0.5 AND ocr_num BETWEEN 0 AND 99 GROUP BY 1, 2),
sp AS (SELECT frame, sqrt(power((x1 + x2) / 2 - lag((x1 + x2) / 2) OVER w, 2) + power(y2 - lag(y2) OVER w, 2)) AS speed FROM st WINDOW w AS (PARTITION BY stable_id ORDER BY frame)),
fs AS (SELECT frame, coalesce(median(speed), 0) AS speed FROM sp GROUP BY 1),
bl AS (SELECT frame, speed, row_number() OVER (ORDER BY frame) - 1 AS pos, median(speed) OVER (ORDER BY frame ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS base FROM fs),
sf AS (SELECT coalesce(min(frame) FILTER (WHERE pos >= 10 AND speed > {FACTOR} * greatest(base, 0.001)), min(frame)) AS f FROM bl),
routes AS (SELECT st.* EXCLUDE (team), coalesce(sv.voted, -1) AS team, sn0.ocr_num AS jersey_number, frame - f AS t_from_snap FROM st LEFT JOIN sv USING (stable_id) LEFT JOIN sn0 ON st.stable_id = sn0.stable_id AND sn0.rn = 1, sf WHERE frame BETWEEN f AND f + 240)"""


@query("pass2_routes", f"WITH {_ROUTES} SELECT event_id, frame, track_id, stable_id, team, jersey_number, {r6(_pj[0])} AS court_x, {r6(_pj[1])} AS court_y, t_from_snap FROM routes", True, True)
def _(spark, sf):
    rows = pass2.analyse(with_features(spark, sf), HOMOGRAPHY, FACTOR)
    return rows.selectExpr("event_id", "frame", "track_id", "stable_id", "team", "jersey_number", f"{r6('court_x')} AS court_x", f"{r6('court_y')} AS court_y", "t_from_snap")


@query("pass2_route_metrics", f"""WITH {_TRACKS}, {_CHAIN}, {ANN}, st AS (SELECT det.*, coalesce(chains.stable_id, track_id) AS stable_id FROM det LEFT JOIN chains USING (track_id)),
s AS (SELECT stable_id, count(DISTINCT frame) AS n, max(frame) - min(frame) + 1 AS span FROM st GROUP BY 1), f AS (SELECT frame, count(DISTINCT stable_id) AS n FROM st GROUP BY 1),
g AS (SELECT frame - lag(frame) OVER (PARTITION BY stable_id ORDER BY frame) AS gap FROM (SELECT DISTINCT stable_id, frame FROM st) AS q)
SELECT {r6('avg(n / span)')} AS completeness, {r6('greatest(0, count(*) / greatest(1, (SELECT median(n) FROM f)) - 1)')} AS fragmentation, (SELECT count(*) FILTER (WHERE gap > 1) FROM g) AS id_switches,
(SELECT CAST(count(*) FILTER (WHERE team = correct_team) AS DOUBLE) / count(*) FROM ann JOIN det USING (frame, track_id)) AS team_accuracy FROM s""", True, True)
def _(spark, sf):
    rows = materialize(pass2.stitched(materialize(with_features(spark, sf), "detections")), "stitched")
    rows = A.route_metrics(rows, annotations(spark, sf), "stable_id")
    return rows.selectExpr(f"{r6('completeness')} AS completeness", f"{r6('fragmentation')} AS fragmentation", "id_switches", "team_accuracy")


# Single figures, pixel statistics, holds and counters


@query("src02_any_scan", "SELECT s_suppkey, s_nationkey FROM supplier")
def _(spark, sf):
    return readers.read_any(spark, f"{sf}/supplier.parquet").select("s_suppkey", "s_nationkey")


@query("src09_images", "SELECT user_id AS image, count(*) AS n, sum(x2 - x1) AS width FROM det GROUP BY 1")
def _(spark, sf):
    rows = detections(spark, sf).selectExpr("user_id AS image", "'Helmet' AS label", "x1 AS left", "y1 AS top", "x2 - x1 AS width", "y2 - y1 AS height")
    return readers.images_of(rows).selectExpr("image", "n", "aggregate(boxes.width, 0D, (t, w) -> t + w) AS width")


@query("src11_source_clip", "SELECT event_id, CASE WHEN event_id % 7 > 1 THEN concat('clip', CAST(user_id AS STRING), '.mp4') END AS source FROM det")
def _(spark, sf):
    good = "concat('{\"source\": \"clip', CAST(user_id AS STRING), '.mp4\", \"rows\": 3}')"
    rows = S.add(detections(spark, sf), value=f"CASE WHEN event_id % 7 = 0 THEN '{{\"source' WHEN event_id % 7 = 1 THEN '{{\"rows\": 3}}' ELSE {good} END")
    return readers.source_clip(rows).select("event_id", "source")


@query("src18_first_frames", "SELECT event_id FROM det WHERE frame < 30")
def _(spark, sf):
    return detections(spark, sf).filter("frame < 30").select("event_id")


@query("prj30_rounded", "SELECT event_id, round_even(conf * 0.37, 4) AS rate, round_even(conf * 37, 1) AS pct FROM det")
def _(spark, sf):
    return detections(spark, sf).selectExpr("event_id", "bround(conf * 0.37D, 4) AS rate", "bround(conf * 37D, 1) AS pct")


scalar("flt20_green_safeguard", {"kept": "CASE WHEN green >= 0.55 AND feat_sa + feat_sb < 15 THEN torso_px ELSE kept_px END"}, {"green": "CAST((k % 100) / 100.0 AS DOUBLE)", "kept_px": "k * 8"}, features=True)


@query("agg02_distinct", "SELECT count(DISTINCT track_id) AS unique_tracks, count(DISTINCT frame) AS frames FROM det")
def _(spark, sf):
    return A.gate_figures(detections(spark, sf)).select("unique_tracks", "frames")


@query("agg03_fallback_rate", "SELECT avg(CAST(mask_is_fallback AS DOUBLE)) AS fallback_rate FROM det")
def _(spark, sf):
    return A.gate_figures(detections(spark, sf)).select("fallback_rate")


@query("agg04_fp_rate", f"SELECT count(*) FILTER (WHERE {S.GATE_FP}) / greatest(1, count(*)) AS fp_rate FROM det")
def _(spark, sf):
    return A.gate_figures(detections(spark, sf)).select("fp_rate")


@query("agg07_fragmentation", """WITH f AS (SELECT count(DISTINCT track_id) AS n FROM det GROUP BY frame)
SELECT greatest(0.0, (SELECT count(DISTINCT track_id) FROM det) / greatest(1.0, (SELECT median(n) FROM f)) - 1) AS fragmentation""")
def _(spark, sf):
    return A.route_metrics(detections(spark, sf)).select("fragmentation")


@query("agg08_id_switches", """WITH d AS (SELECT DISTINCT track_id, frame FROM det), g AS (SELECT frame - lag(frame) OVER (PARTITION BY track_id ORDER BY frame) AS gap FROM d)
SELECT count(*) FILTER (WHERE gap > 1) AS id_switches FROM g""")
def _(spark, sf):
    return A.route_metrics(detections(spark, sf)).select("id_switches")


@query("agg15_area_buckets", f"""WITH a AS (SELECT *, {S.area()} AS area FROM det)
SELECT {S.AREA_BUCKET} AS bucket, count(*) AS n, count(*) FILTER (WHERE helmet_hits > 0) AS with_helmet, count(*) FILTER (WHERE ocr_num IS NOT NULL) AS with_number FROM a GROUP BY 1""")
def _(spark, sf):
    rows = S.add(detections(spark, sf), area=S.area()).groupBy(F.expr(S.AREA_BUCKET).alias("bucket"))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("helmet_hits") > 0).alias("with_helmet"), F.count("ocr_num").alias("with_number"))


_PX_SQL = "px AS (SELECT vec_id, i, embedding FROM embeddings, (SELECT unnest(range(0, 21)) AS i) AS q)"
_STATS = {c: S.rounded(c, 4) for c in ("mean_a", "mean_b", "std_a", "std_b", "hue", "hue_std")}


def _three(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", F.explode(F.expr("sequence(0, 20)")).alias("i"))
    return vectors.selectExpr("vec_id", "i", *[f"CAST(embedding[3 * i + {j}] AS DOUBLE) AS v{j}" for j in range(3)])


@query("agg33_pixel_stats", f"""WITH {_PX_SQL}, t AS (SELECT vec_id, {', '.join(f'CAST(embedding[3 * i + {j + 1}] AS DOUBLE) AS v{j}' for j in range(3))} FROM px),
m AS (SELECT vec_id, 128 + 100 * v0 AS a, 128 + 100 * v1 AS b, floor(abs(180 * v2)) % 180 AS h FROM t WHERE v2 > -0.02),
g AS (SELECT vec_id, count(*) AS n, avg(a) AS mean_a, avg(b) AS mean_b, stddev_pop(a) AS std_a, stddev_pop(b) AS std_b, avg(cos(h * pi() / 90)) AS c, avg(sin(h * pi() / 90)) AS s FROM m GROUP BY 1),
r AS (SELECT vec_id, n, mean_a, mean_b, std_a, std_b, {A.HUE} AS hue, {A.HUE_STD} AS hue_std FROM g)
SELECT vec_id, n, {', '.join(f'CASE WHEN n >= 10 THEN {v} END AS {k}' for k, v in _STATS.items())} FROM r""")
def _(spark, sf):
    pixels = _three(spark, sf).filter("v2 > -0.02").selectExpr("vec_id", "128 + 100 * v0 AS a", "128 + 100 * v1 AS b", "floor(abs(180 * v2)) % 180 AS h")
    return A.pixel_stats(pixels, "vec_id").selectExpr("vec_id", "n", *[f"{v} AS {k}" for k, v in _STATS.items()])


@query("agg34_frame_difference", """WITH p AS (SELECT vec_id, embedding AS e, lag(embedding) OVER (PARTITION BY vec_id % 8 ORDER BY vec_id) AS b FROM embeddings)
SELECT vec_id, CASE WHEN b IS NOT NULL THEN round(list_sum([abs(CAST(e[i] AS DOUBLE) - CAST(b[i] AS DOUBLE)) for i in range(1, 65)]) / 64, 6) END AS mad FROM p""")
def _(spark, sf):
    frames = spark.read.parquet(f"{sf}/embeddings.parquet").selectExpr("vec_id", "vec_id % 8 AS clip_id", "vec_id AS frame", "CAST(embedding AS array<double>) AS pixels")
    return A.frame_difference(frames).select("vec_id", F.round("mad", 6).alias("mad"))


@query("agg36_green_fraction", f"""WITH px AS (SELECT vec_id, i, embedding FROM embeddings, (SELECT unnest(range(0, 64)) AS i) AS q),
t AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, floor(abs(180 * CAST(embedding[i + 1] AS DOUBLE))) % 180 AS h, (7 * i + vec_id) % 256 AS s, (11 * i) % 256 AS v FROM px)
SELECT vec_id, count(*) FILTER (WHERE {A.GREEN}) / count(*) AS green FROM t WHERE {A.centre(8, 8)} GROUP BY 1""")
def _(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.posexplode("embedding").alias("i", "e"))
    pixels = rows.selectExpr("vec_id", "i div 8 AS y", "i % 8 AS x", "floor(abs(180 * CAST(e AS DOUBLE))) % 180 AS h", "(7 * i + vec_id) % 256 AS s", "(11 * i) % 256 AS v")
    return A.green_fraction(pixels, "vec_id", 8, 8)


_MAD = "mads AS (SELECT frame, CAST(max(k) AS DOUBLE) AS mad, max(k) % 3 > 0 AS fit_ok, max(k) % 17 = 0 AS event FROM det GROUP BY 1), pos AS (SELECT *, row_number() OVER (ORDER BY frame) AS n FROM mads)"


def _frames(spark, sf):
    rows = detections(spark, sf).groupBy("clip_id", "frame").agg(F.max("k").alias("k"))
    return rows.selectExpr("clip_id", "frame", "CAST(k AS DOUBLE) AS mad", "k % 3 > 0 AS fit_ok", "k % 17 = 0 AS event")


@query("win07_cooldown_cuts", f"""WITH {_MAD}, walk(n, streak, cooldown, is_cut) AS (
SELECT CAST(0 AS BIGINT), 0, 0, false UNION ALL
SELECT p.n, CASE WHEN w.cooldown > 0 OR p.mad <= 45 OR w.streak = 1 THEN 0 ELSE w.streak + 1 END, CASE WHEN w.cooldown > 0 THEN w.cooldown - 1 WHEN p.mad > 45 AND w.streak = 1 THEN 60 ELSE 0 END,
 w.cooldown = 0 AND p.mad > 45 AND w.streak = 1 FROM walk w JOIN pos p ON p.n = w.n + 1)
SELECT frame, is_cut FROM walk JOIN pos USING (n)""", recursive=True)
def _(spark, sf):
    return scans.cuts(_frames(spark, sf)).select("frame", "is_cut")


@query("win09_last_velocity", f"WITH {_TRACKS} SELECT track_id, {r6('vx')} AS vx, {r6('vy')} AS vy FROM tracks", True)
def _(spark, sf):
    return A.track_summary(with_features(spark, sf)).selectExpr("track_id", f"{r6('vx')} AS vx", f"{r6('vy')} AS vy")


@query("win12_majority", """WITH c AS (SELECT user_id, frame, event_id, team, sum(2 * team - 1) OVER w AS balance, first_value(team) OVER w AS oldest FROM det WHERE team IN (0, 1) AND k % 4 <> 0
WINDOW w AS (PARTITION BY user_id ORDER BY frame, event_id ROWS 19 PRECEDING)) SELECT event_id, CASE WHEN balance > 0 THEN 1 WHEN balance < 0 THEN 0 ELSE oldest END AS voted FROM c""")
def _(spark, sf):
    rows = detections(spark, sf).filter("team IN (0, 1) AND k % 4 <> 0")
    return W.majority(rows, "user_id", ["frame", "event_id"], "team").select("event_id", "voted")


@query("srt06_last_rows", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY frame DESC, event_id) AS rn FROM det) AS q WHERE rn <= 35")
def _(spark, sf):
    return W.tail(detections(spark, sf), "user_id", [F.desc("frame"), "event_id"], 35).select("event_id")


_MID = "(y1 + (y2 - y1) * (640 - x1) / (x2 - x1))"


@query("srt09_field_lines", f"""WITH l AS (SELECT event_id, user_id, {r6(_MID)} AS y_at, (x2 - x1) >= (y2 - y1) AS flat FROM det),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, flat ORDER BY CASE WHEN flat THEN y_at ELSE 0.0 END, event_id) AS rn FROM l) SELECT event_id, flat FROM r WHERE rn <= CASE WHEN flat THEN 8 ELSE 2 END""")
def _(spark, sf):
    lines = detections(spark, sf).selectExpr("event_id", "user_id", f"{r6(_MID)} AS y_at", "(x2 - x1) >= (y2 - y1) AS flat")
    flat = W.tail(lines.filter("flat"), "user_id", ["y_at", "event_id"], 8)
    return flat.unionByName(W.tail(lines.filter("NOT flat"), "user_id", ["event_id"], 2)).select("event_id", "flat")


@query("set03_stale_tracks", """WITH s AS (SELECT DISTINCT frame, track_id FROM det), f AS (SELECT frame, lead(frame) OVER (ORDER BY frame) AS nxt FROM (SELECT DISTINCT frame FROM det) AS q)
SELECT f.nxt AS frame, s.track_id FROM s JOIN f USING (frame) WHERE f.nxt IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s AS t WHERE t.frame = f.nxt AND t.track_id = s.track_id)""")
def _(spark, sf):
    return R.stale_keys(detections(spark, sf)).select("frame", "track_id")


@query("set05_missing_columns", "SELECT 'feat_lab6d' AS missing")
def _(spark, sf):
    missing = schema.missing_columns(detections(spark, sf))
    return spark.createDataFrame([(c,) for c in missing], "missing string")


# Classes of a helmet data set that count, and those that don't.
HELMETS, OTHERS = ("Helmet", "Helmet-Partial", "Helmet-Blurred", "Helmet-Difficult"), ("Helmet-Sideline",)
_KIND = "CASE p_partkey % 6 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(HELMETS + OTHERS)) + " ELSE 'Ball' END"
_COUNTED = f"label IN ({', '.join(repr(v) for v in HELMETS)})"


@query("set08_helmet_classes", f"WITH l AS (SELECT p_partkey, {_KIND} AS label FROM part) SELECT p_partkey, label FROM l WHERE {_COUNTED}")
def _(spark, sf):
    return spark.read.parquet(f"{sf}/part.parquet").selectExpr("p_partkey", f"{_KIND} AS label").filter(F.col("label").isin(*HELMETS))


@query("str03_interpolated", """WITH fl AS (SELECT frame, CAST(max(k) % 5 AS DOUBLE) AS dx, CAST(max(k) % 3 AS DOUBLE) AS dy FROM det GROUP BY 1)
SELECT f.frame, d.event_id, CASE WHEN f.frame % 3 = 0 THEN 0 ELSE 1 END AS frame_age, d.x1 + CASE WHEN f.frame % 3 = 0 THEN 0 ELSE dx END AS x1, d.y2 + CASE WHEN f.frame % 3 = 0 THEN 0 ELSE dy END AS y2
FROM fl f JOIN det d ON d.frame = f.frame - f.frame % 3""")
def _(spark, sf):
    det = detections(spark, sf)
    flow = det.groupBy("clip_id", "frame").agg((F.max("k") % 5).cast("double").alias("dx"), (F.max("k") % 3).cast("double").alias("dy"))
    return W.interpolated(det, flow, 3).select("frame", "event_id", "frame_age", "x1", "y2")


@query("str04_mask_refresh", f"WITH {_MAD}, b AS (SELECT *, coalesce(max(CASE WHEN event THEN n END) OVER (ORDER BY frame), 1) AS base FROM pos) SELECT frame, (n - base) % 30 = 0 AS refresh FROM b")
def _(spark, sf):
    return W.refreshed(_frames(spark, sf), "event").select("frame", "refresh")


@query("str15_cached_labels", """WITH r AS (SELECT *, CASE WHEN k % 3 = 0 THEN team END AS locked, CASE WHEN k % 5 > 1 THEN 1 - team END AS held FROM det)
SELECT event_id, coalesce(locked, held, CASE WHEN k % 2 = 0 THEN 1 END, -1) AS label FROM r""")
def _(spark, sf):
    rows = detections(spark, sf).selectExpr("event_id", "CASE WHEN k % 3 = 0 THEN team END AS locked", "CASE WHEN k % 5 > 1 THEN 1 - team END AS last", "CASE WHEN k % 2 = 0 THEN 1 END AS voted")
    return rows.select("event_id", F.coalesce("locked", "last", "voted", F.lit(-1)).alias("label"))


@query("str16_hsv_start", f"""WITH {_MAD}, r AS (SELECT *, count(*) FILTER (WHERE fit_ok) OVER (ORDER BY frame) >= 30 AS ready FROM pos), a AS (SELECT *, count(*) FILTER (WHERE ready) OVER (ORDER BY frame) - 1 AS after FROM r)
SELECT frame, ready, ready AND after > 0 AND after % 300 = 0 AS blend FROM a""")
def _(spark, sf):
    return W.initialised(_frames(spark, sf), "fit_ok").select("frame", "ready", "blend")


@query("str17_registration", f"""WITH {_MAD}, s AS (SELECT frame, sum(CASE WHEN fit_ok THEN 1 ELSE -1 END) OVER (ORDER BY frame) AS walk FROM pos),
m AS (SELECT frame, walk - least(0, min(walk) OVER (ORDER BY frame)) AS streak FROM s) SELECT frame, CAST(streak AS BIGINT) AS streak, streak >= 3 AS valid FROM m""")
def _(spark, sf):
    return W.registration(_frames(spark, sf)).select("frame", "streak", "valid")


@query("str20_message", f"WITH {_MAD}, b AS (SELECT frame, n - max(CASE WHEN event THEN n END) OVER (ORDER BY frame) AS since FROM pos) SELECT frame, CAST(coalesce(greatest(0, 60 - since), 0) AS BIGINT) AS ticks FROM b")
def _(spark, sf):
    return W.countdown(_frames(spark, sf), "event").select("frame", F.col("left").cast("long").alias("ticks"))


@query("mlc07_line_up_split", """WITH o AS (SELECT frame, y2, count(*) OVER r AS n, sum(y2) OVER r AS s, sum(y2 * y2) OVER r AS q, count(*) OVER w AS tn, sum(y2) OVER w AS ts, sum(y2 * y2) OVER w AS tq FROM det
WINDOW r AS (PARTITION BY frame ORDER BY y2, event_id ROWS UNBOUNDED PRECEDING), w AS (PARTITION BY frame)),
c AS (SELECT frame, n, round((q - s * s / n) + ((tq - q) - (ts - s) * (ts - s) / (tn - n)), 4) AS cost FROM o WHERE n < tn),
b AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY cost, n) AS rn FROM c) SELECT frame, n AS lower, cost FROM b WHERE rn = 1""")
def _(spark, sf):
    return A.line_up_split(detections(spark, sf), "frame", "y2", "event_id")


def team_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Frames of the team labels by clip (here a clip for each 16th of the users), with a row for frames without detections."""
    rows = S.add(with_features(spark, sf), margin="0.0D", locked="false")
    rows = rows.selectExpr(
        "concat('u', user_id % 16) AS clip_id", "frame", "track_id", "x1", "y1", "x2", "y2", "conf", "torso_px", "k * 5 AS upper_px",
        "CAST((event_id % 50) / 100.0D AS DOUBLE) AS field_overlap", "helmet_hits > 0 AS helmet", f"{S.REFEREE} AS referee", "CAST(NULL AS DOUBLE) AS field_y", *clustering.FEATURES, "is_cut_frame",
    )
    clips = rows.groupBy("clip_id").agg(F.min("frame").alias("a"), F.max("frame").alias("b")).select("clip_id", F.explode(F.sequence("a", "b")).alias("frame"))
    cut = rows.groupBy("clip_id", "frame").agg(F.max("is_cut_frame").alias("is_cut"))
    return clips.join(cut, ["clip_id", "frame"], "left").join(rows.drop("is_cut_frame"), ["clip_id", "frame"], "left")


@query("str09_team_states")
def _(spark, sf):
    return teams.batch(team_frames(spark, sf))


@query("str10_warmup_refusals")
def _(spark, sf):
    return teams.batch(team_frames(spark, sf)).filter("reason IS NOT NULL").groupBy("clip_id", "reason").agg(F.count("*").alias("n"))


@query("str18_homographies", """WITH f AS (SELECT frame, max(k) AS k FROM det GROUP BY 1),
s AS (SELECT frame, sum(CASE WHEN k % 20 >= 10 THEN k % 7 - 3 ELSE 0 END) OVER (ORDER BY frame) AS dx, sum(CASE WHEN k % 20 >= 10 THEN k % 5 - 2 ELSE 0 END) OVER (ORDER BY frame) AS dy FROM f)
SELECT frame, CAST(0.9 AS DOUBLE) AS h0, CAST(0.05 AS DOUBLE) AS h1, round(20 - CAST(0.9 AS DOUBLE) * dx - CAST(0.05 AS DOUBLE) * dy, 6) AS h2, CAST(0.02 AS DOUBLE) AS h3, CAST(0.8 AS DOUBLE) AS h4,
round(15 - CAST(0.02 AS DOUBLE) * dx - CAST(0.8 AS DOUBLE) * dy, 6) AS h5, CAST(0.00001 AS DOUBLE) AS h6, CAST(0.00002 AS DOUBLE) AS h7, round(1 - CAST(0.00001 AS DOUBLE) * dx - CAST(0.00002 AS DOUBLE) * dy, 6) AS h8 FROM s""")
def _(spark, sf):
    rows = _frames(spark, sf).selectExpr("clip_id", "frame", "array(1D, 0D, mad % 7 - 3, 0D, 1D, mad % 5 - 2) AS m", "CAST(mad AS INT) % 20 AS inliers")
    return teams.homographies(rows, HOMOGRAPHY).select("frame", *[F.round(F.col("h")[i], 6).alias(f"h{i}") for i in range(9)])


@query("str19_label_figures")
def _(spark, sf):
    return teams.figures(teams.batch(team_frames(spark, sf)))


@query("str19_running_figures", """WITH l AS (SELECT event_id % 4 AS b, concat('u', user_id % 16) AS clip_id, frame, track_id, team, k % 3 > 0 AS locked FROM det),
u AS (SELECT e.b AS epoch, l.* FROM (SELECT DISTINCT b FROM l) AS e JOIN l ON l.b <= e.b),
f AS (SELECT epoch, clip_id, count(DISTINCT frame) AS frames, count(DISTINCT frame) FILTER (WHERE locked) AS locked_frames, count(DISTINCT frame) FILTER (WHERE team >= 0) AS labelled_frames,
 count(*) FILTER (WHERE locked AND team >= 0) AS locked_labels FROM u GROUP BY 1, 2),
m AS (SELECT epoch, clip_id, count(*) AS mixed FROM (SELECT epoch, clip_id, track_id FROM u WHERE locked AND team >= 0 GROUP BY 1, 2, 3 HAVING min(team) < max(team)) AS t GROUP BY 1, 2)
SELECT f.*, coalesce(mixed, 0) AS mixed_tracks FROM f LEFT JOIN m USING (epoch, clip_id) WHERE (epoch, clip_id) IN (SELECT (b, clip_id) FROM l)""")
def _(spark, sf):
    rows = detections(spark, sf).selectExpr("event_id % 4 AS b", "concat('u', user_id % 16) AS clip_id", "frame", "track_id", "team AS label", "if(k % 3 > 0, 'locked', 'warmup') AS state")
    path = _path(spark, "running")
    rows = materialize(rows, "labels")
    for b in range(4):  # a batch arrives; the query starts anew on its checkpoint
        rows.filter(F.col("b") == b).drop("b").write.mode("append").parquet(f"{path}/in")
        arrived = spark.readStream.schema(rows.drop("b").schema).parquet(f"{path}/in")
        teams.stream_figures(arrived, f"{path}/parts", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return teams.running_figures(spark, f"{path}/parts")


# Sinks and readers, by round trips through the shared folder


def _path(spark: SparkSession, name: str) -> str:
    return new_path(spark, name)


_FRAMES_SQL = """SELECT CAST(vec_id % 8 AS VARCHAR) AS clip_id, CAST(vec_id AS BIGINT) AS frame, 8 AS width, 8 AS height,
array_to_string([printf('%02X', CAST(floor(abs(180 * CAST(v AS DOUBLE))) AS BIGINT) % 180) for v in embedding], '') AS pixels FROM embeddings"""


def _container(spark: SparkSession, sf: str) -> str:
    """Frames of 8 by 8 pixels out of the vectors, written as containers."""
    path = _path(spark, "frames")
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    values = "transform(embedding, v -> CAST(floor(abs(180 * CAST(v AS DOUBLE))) AS BIGINT) % 180)"
    containers.write_frames(containers.as_frames(vectors, "vec_id % 8", "vec_id", values, 8), path, block_bytes=1 << 10)
    return path


@query("src14_frames", _FRAMES_SQL)
def _(spark, sf):
    return containers.read_container(spark, _container(spark, sf)).withColumn("pixels", F.hex("pixels"))


@query("src15_frame_range", f"SELECT * FROM ({_FRAMES_SQL}) AS f WHERE frame BETWEEN 100 AND 131")
def _(spark, sf):
    return containers.read_container(spark, _container(spark, sf), first=100, last=131).withColumn("pixels", F.hex("pixels"))


@query("snk01_ir_with_meta", "SELECT clip_id, count(*) AS rows, count(DISTINCT frame) AS frames, CAST(sum(torso_px) AS BIGINT) AS torso, 'clip.mp4' AS source FROM det GROUP BY 1")
def _(spark, sf):
    path = _path(spark, "ir")
    sinks.write_ir(detections(spark, sf), path, "clip.mp4")
    read = spark.read.parquet(path).groupBy("clip_id").agg(F.sum("torso_px").alias("torso"))
    meta = spark.read.json(path + ".meta.json").filter(F.col("out_parquet") == path).select("clip_id", "rows", "frames", "source")
    return meta.join(read, "clip_id")


@query("snk02_stitched_parquet", f"WITH {_TRACKS}, {_CHAIN} SELECT event_id, coalesce(stable_id, track_id) AS stable_id FROM det LEFT JOIN chains USING (track_id)", True, True)
def _(spark, sf):
    path = _path(spark, "stitched")
    pass2.stitched(with_features(spark, sf)).write.parquet(path)
    return spark.read.parquet(path).select("event_id", "stable_id")


@query("snk03_routes_csv", "SELECT event_id, frame, x1, '[' || CAST(frame AS VARCHAR) || ',' || CAST(track_id AS VARCHAR) || ']' AS pair FROM det WHERE frame BETWEEN 23 AND 263")
def _(spark, sf):
    path = _path(spark, "routes")
    sinks.write_csv(detections(spark, sf).filter("frame BETWEEN 23 AND 263").select("event_id", "frame", "x1", F.array("frame", "track_id").alias("pair")), path)
    return spark.read.schema("event_id long, frame long, x1 double, pair string").option("header", True).option("escape", "\"").csv(path)


@query("snk04_metrics_json", "SELECT count(DISTINCT track_id) AS tracks, min(frame) AS snap_frame FROM det")
def _(spark, sf):
    path = _path(spark, "metrics")
    sinks.write_json(detections(spark, sf).agg(F.count_distinct("track_id").alias("tracks"), F.min("frame").alias("snap_frame")), path)
    return spark.read.json(path).select("tracks", "snap_frame")


@query("snk05_gate_report", f"{_GATE} SELECT median_det >= 12 AND fp_rate <= 0.20 AND unique_tracks >= 8 AND fallback_rate <= 0.30 AS pass, unique_tracks, frames, fp_rate <= 0.20 AS check_fp FROM g")
def _(spark, sf):
    path = _path(spark, "gate")
    sinks.write_csv(gates.ir_gate(detections(spark, sf)), path)
    return readers.read_metrics(spark, path).selectExpr("CAST(pass AS BOOLEAN) AS pass", "CAST(unique_tracks AS BIGINT) AS unique_tracks", "CAST(frames AS BIGINT) AS frames", "CAST(check_fp AS BOOLEAN) AS check_fp")


@query("snk06_eval_log", "SELECT team, count(*) AS n FROM det GROUP BY 1 UNION ALL SELECT team, count(*) AS n FROM det WHERE k % 2 = 0 GROUP BY 1 UNION ALL SELECT 99 AS team, 1 AS n")
def _(spark, sf):
    """Two appends, and a row for the header lines that the log has."""
    path, det = _path(spark, "log"), detections(spark, sf)
    for rows in (det, det.filter("k % 2 = 0")):
        sinks.append_report(rows.groupBy("team").agg(F.count("*").alias("n")), path)
    headers = spark.read.text(path).filter("value = 'team,n'").agg(F.lit(99).alias("team"), F.count("*").alias("n"))
    return sinks.read_report(spark, path, "team int, n bigint").union(headers)


def _dumped(spark: SparkSession, sf: str, fmt: str) -> DataFrame:
    """Events as a stream into files of a format, until all that is there has been taken."""
    kind = spark.read.parquet(f"{sf}/events.parquet").schema
    rows = spark.readStream.schema(kind).option("pathGlobFilter", "events.parquet").parquet(sf).selectExpr("event_id", "user_id", "event_type")
    path, checkpoint = _path(spark, "dump"), _path(spark, "dump-state")
    stream = rows.writeStream.format(fmt).option("header", True).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    reader = spark.read.schema("event_id long, user_id long, event_type string")
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.json(path)


@query("snk06_epoch_log", "SELECT CAST(k % 3 AS VARCHAR) AS epoch, team, count(*) AS n FROM det GROUP BY 1, 2")
def _(spark, sf):
    path, det = _path(spark, "epochs"), detections(spark, sf)
    for epoch in (0, 1, 1, 2, 0):  # two of them twice
        sinks.commit_report(det.filter(f"k % 3 = {epoch}").groupBy("team").agg(F.count("*").alias("n")), path, epoch)
    return sinks.read_commits(spark, path, "team int, n long").select("epoch", "team", "n")


@query("snk07_stream_csv", "SELECT event_id, user_id, event_type FROM events")
def _(spark, sf):
    return _dumped(spark, sf, "csv")


@query("snk08_stream_jsonl", "SELECT event_id, user_id, event_type FROM events")
def _(spark, sf):
    return _dumped(spark, sf, "json")


@query("snk09_sweep_csv", "SELECT c AS conf_min, (SELECT count(*) FROM det WHERE conf >= c) AS n FROM (SELECT CAST(unnest([0.1, 0.25, 0.4, 0.55]) AS DOUBLE) AS c) AS a")
def _(spark, sf):
    path = _path(spark, "sweep")
    sinks.write_csv(QUERIES["jon15_grid"](spark, sf).filter("iou_max = 0.5").select("conf_min", "n"), path)
    return spark.read.schema("conf_min double, n long").option("header", True).csv(path)


@query("snk10_rejections", "SELECT 'area' AS reason, count(*) AS n FROM det WHERE torso_px < 900 UNION ALL SELECT 'kept' AS reason, count(*) AS n FROM det WHERE torso_px >= 900")
def _(spark, sf):
    """Rejected boxes as CSV, statistics as JSON."""
    rows, path, stats = detections(spark, sf), _path(spark, "rejections"), _path(spark, "stats")
    sinks.write_csv(rows.filter("torso_px < 900").selectExpr("'train' AS split", "frame AS stem", "event_id AS box_idx", "'area' AS reason", "conf AS iou", "torso_px AS area"), path)
    sinks.write_json(rows.filter("torso_px >= 900").agg(F.count("*").alias("n")).withColumn("reason", F.lit("kept")), stats)
    rejected = spark.read.option("header", True).csv(path).groupBy("reason").agg(F.count("*").alias("n"))
    return rejected.union(spark.read.json(stats).select("reason", "n"))


@query("snk11_distributions", "SELECT quantile_cont(conf, 0.1) AS p10, quantile_cont(conf, 0.5) AS p50, quantile_cont(conf, 0.9) AS p90 FROM det")
def _(spark, sf):
    path = _path(spark, "distributions")
    sinks.write_json(QUERIES["agg14_quantiles"](spark, sf), path)
    return spark.read.json(path).select("p10", "p50", "p90")


@query("snk12_diagnosis_markdown", "WITH t AS (SELECT team, count(*) AS n FROM det GROUP BY 1) SELECT '| team | n |' AS line UNION ALL SELECT '|-|-|' UNION ALL SELECT '| ' || team || ' | ' || n || ' |' FROM t")
def _(spark, sf):
    path = _path(spark, "diagnosis")
    sinks.markdown(detections(spark, sf).groupBy("team").agg(F.count("*").alias("n"))).orderBy("position").select("value").coalesce(1).write.text(path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("snk14_label_files", "SELECT CASE WHEN p_size % 10 = 0 THEN 'val' ELSE 'train' END AS split, CAST(p_size AS BIGINT) AS stem, count(*) AS n FROM part GROUP BY 1, 2")
def _(spark, sf):
    path = _path(spark, "labels")
    sinks.write_labels(part_lines(spark, sf, _CENTRE).withColumn("split", F.expr("CASE WHEN stem % 10 = 0 THEN 'val' ELSE 'train' END")), path)
    return spark.read.text(path).groupBy("split", F.col("stem").cast("long").alias("stem")).agg(F.count("*").alias("n"))


@query("src17_calibration", """SELECT 'v2' AS feature_version, CAST(0.45 AS DOUBLE) AS upper_body_frac, count(*) AS centres, max(x) AS far, true AS ok
FROM (SELECT team, CAST(max(x1) AS DOUBLE) AS x FROM det GROUP BY team) AS t""")
def _(spark, sf):
    """A calibration of the given rows (a centre a team) as SNK15 writes it, read again and judged by its version."""
    path = _path(spark, "model")
    # Three teams at most, whatever the rows.
    centres = [[r.x] for r in detections(spark, sf).groupBy("team").agg(F.max("x1").cast("double").alias("x")).orderBy("team").collect()]
    sinks.save_model(spark, {"feature_version": "v2", "upper_body_frac": 0.45, "scaler": [0.0, 1.0], "centres": centres}, path)
    model = gates.version_gate(readers.read_model(spark, path), "v2", 0.45)
    return model.selectExpr("feature_version", "upper_body_frac", "CAST(size(centres) AS BIGINT) AS centres", "array_max(transform(centres, c -> c[0])) AS far", "ok")


@query("src10_homography", """SELECT p_partkey AS a, CASE WHEN p_partkey % 2 = 0 THEN p_size + 400 ELSE 533 END AS h, CASE WHEN p_partkey % 2 = 0 THEN p_size + 600 ELSE 1200 END AS w, count(*) AS n
FROM part GROUP BY 1, 2, 3""")
def _(spark, sf):
    """A homography for each part, every other with dimensions of its own."""
    path = _path(spark, "homography")
    own = F.col("p_partkey") % 2 == 0
    matrix = F.expr("array(array(double(p_partkey), 0D, 0D), array(0D, 1D, 0D), array(0D, 0D, 1D))")
    fields = F.struct(matrix.alias("H"), F.when(own, F.col("p_size") + 600).alias("template_w"), F.when(own, F.col("p_size") + 400).alias("template_h"))
    # A document holds a list of 1000 parts at most, and a file one document.
    lists = spark.read.parquet(f"{sf}/part.parquet").groupBy(F.expr("p_partkey div 1000").alias("document")).agg(F.to_json(F.collect_list(fields)).alias("value"))
    lists.write.partitionBy("document").text(path)
    found = readers.read_homography(spark, path)
    return found.groupBy(F.col("H")[0][0].cast("long").alias("a"), F.col("template_h").alias("h"), F.col("template_w").alias("w")).agg(F.count("*").alias("n"))


@query("src12_metrics", "SELECT CAST(min(frame) AS VARCHAR) AS first, CAST(count(*) AS VARCHAR) AS n FROM det")
def _(spark, sf):
    path = _path(spark, "report")
    sinks.write_csv(detections(spark, sf).agg(F.min("frame").alias("first"), F.count("*").alias("n")), path)
    return readers.read_metrics(spark, path).select("first", "n")


@query("src13_dataset_contract", """SELECT p_partkey, concat_ws(',', CASE WHEN p_size % 3 <> 1 THEN 'nc' END, CASE WHEN p_partkey % 4 >= 2 OR p_partkey % 5 = 0 THEN 'names' END) AS wrong FROM part""")
def _(spark, sf):
    parts = spark.read.parquet(f"{sf}/part.parquet").withColumn("class", F.expr("if(p_partkey % 5 = 0, 'ball', if(p_partkey % 4 = 0, 'Player', if(p_partkey % 4 = 1, 'helmet', p_name)))"))
    shown = "if(p_partkey % 3 = 0, concat('names:\n  0: ', class, '\n'), if(p_partkey % 3 = 1, concat('names:\n- ', class, '\n'), concat('names: [\\'', class, '\\']\n')))"
    rows = parts.select("p_partkey", F.expr(f"concat('train: a\n', 'nc: ', p_size % 3, '\n', {shown})").alias("text"), F.expr("if(p_partkey % 4 = 1, 'helmet', 'seg')").alias("task"))
    return readers.dataset_checks(rows).select("p_partkey", "wrong")


@query("src19_splits", "SELECT 'train' AS split UNION ALL SELECT 'val' AS split")
def _(spark, sf):
    path = _path(spark, "dataset")
    rows = spark.read.parquet(f"{sf}/part.parquet").selectExpr("CAST(p_partkey AS STRING) AS value", "CASE p_partkey % 3 WHEN 0 THEN 'val' ELSE 'train' END AS split").coalesce(1)
    for split, kind in (("train", "images"), ("train", "labels"), ("val", "images"), ("val", "labels"), ("test", "images")):
        rows.filter(F.col("split") == split).select("value").write.text(f"{path}/{split}/{kind}")
    return readers.split_folders(spark, path)


@query("gat06_dataset_gate", "SELECT count(*) AS shared, 'nc' AS wrong, false AS pass FROM (SELECT p_partkey // 3 AS stem FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey % 10 = 0) > 1) AS q")
def _(spark, sf):
    images = spark.read.parquet(f"{sf}/part.parquet").selectExpr("CASE WHEN p_partkey % 10 = 0 THEN 'val' ELSE 'train' END AS split", "p_partkey div 3 AS stem")
    return gates.dataset_gate(sinks.dataset_text("train/images", "val/images", ["helmet", "ball"]), "helmet", images)
