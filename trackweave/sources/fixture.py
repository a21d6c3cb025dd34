"""Projection of the events and embeddings tables to a detection table, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FRAME_H, FRAME_W = 720, 1280
#: Vectors are broadcast up to so many bytes of _FEATURE_BYTES each.
BROADCAST_BYTES, _FEATURE_BYTES = 32 << 20, 64
_COLUMNS = {
    "clip_id": "'events'",
    "frame": "frame",
    "track_id": "track_id",
    "x1": "CAST((13 * user_id) % 1200 + k AS DOUBLE)",
    "y1": "CAST((7 * user_id) % 600 + (3 * k) % 50 AS DOUBLE)",
    "x2": "CAST((13 * user_id) % 1200 + k + 20 + 10 * (event_id % 5) AS DOUBLE)",
    "y2": "CAST((7 * user_id) % 600 + (3 * k) % 50 + 30 + 10 * (event_id % 7) AS DOUBLE)",
    "conf": "CAST((event_id % 100) / 100.0 AS DOUBLE)",
    "mask_ref": "CASE WHEN event_id % 10 = 0 THEN NULL ELSE concat('m', CAST(event_id AS STRING)) END",
    "mask_is_fallback": "event_id % 10 = 0",
    "torso_px": "500 + 10 * k",
    "helmet_hits": "CAST(event_id % 3 AS INT)",
    "ocr_num": "CASE WHEN k % 4 = 0 THEN CAST(user_id % 100 AS INT) END",
    "ocr_conf": "CAST(CASE WHEN k % 4 = 0 THEN 0.6 ELSE 0.0 END AS DOUBLE)",
    "is_cut_frame": "event_type = 'error' AND k >= 95",
    "team": "CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE -1 END",
    "event_id": "event_id",
    "user_id": "user_id",
    "k": "k",
}


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detection table without colour features."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = events.select(
        "event_id",
        "user_id",
        "event_type",
        F.expr("CAST(floor((unix_micros(CAST(ts AS TIMESTAMP)) - 1704067200000000) / 3600000000) AS BIGINT)").alias("frame"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )
    first = rows.groupBy("frame", "user_id").agg(F.min_by(F.struct("event_id", "event_type", "k"), "event_id").alias("e"))
    first = first.select("frame", "user_id", "e.*")
    order = Window.partitionBy("user_id").orderBy("frame")
    gap = F.col("frame") - F.lag("frame").over(order)
    broken = first.withColumn("brk", F.when(gap.isNull() | (gap > 12), 1).otherwise(0))
    numbered = broken.withColumn("track_id", F.col("user_id") * 1000 + F.sum("brk").over(order))
    return numbered.selectExpr(*[f"{v} AS {k}" for k, v in _COLUMNS.items()])


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id and the six colour statistics of a feature, as columns."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    v = [f"CAST(embedding[{i}] AS DOUBLE)" for i in range(6)]
    return vectors.selectExpr("vec_id", *_feature_columns(v))


def _feature_columns(v: list[str]) -> list[str]:
    r = lambda x: f"(CAST(floor(({x}) * 1000 + 0.5) AS DOUBLE) / 1000)"
    wrapped = f"(abs(180 * {v[4]}) - 180 * floor(abs(180 * {v[4]}) / 180))"
    return [
        f"{r(f'128 + 100 * {v[0]}')} AS feat_a", f"{r(f'128 + 100 * {v[1]}')} AS feat_b", f"{r(f'abs(20 * {v[2]}) + 2')} AS feat_sa",
        f"{r(f'abs(20 * {v[3]}) + 2')} AS feat_sb", f"{r(wrapped)} AS feat_h", f"{r(f'128 + 100 * {v[5]}')} AS feat_sh",
    ]


def with_features(spark: SparkSession, sf_dir: str, det: DataFrame | None = None) -> DataFrame:
    """Detections with the colour statistics of vector event_id modulo the number of vectors (numbered from 0)."""
    det = detections(spark, sf_dir) if det is None else det
    feats = features(spark, sf_dir)
    n = feats.count()
    if n * _FEATURE_BYTES <= BROADCAST_BYTES:
        feats = F.broadcast(feats)
    return det.join(feats, F.col("event_id") % max(1, n) == F.col("vec_id")).drop("vec_id")


DET_SQL = f"""
e0 AS (SELECT event_id, user_id, event_type, (epoch_us(ts) - 1704067200000000) // 3600000000 AS frame, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
e1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame, user_id ORDER BY event_id) AS rn FROM e0) AS q WHERE rn = 1),
e2 AS (SELECT *, CASE WHEN lag(frame) OVER w IS NULL OR frame - lag(frame) OVER w > 12 THEN 1 ELSE 0 END AS brk FROM e1 WINDOW w AS (PARTITION BY user_id ORDER BY frame)),
e3 AS (SELECT *, CAST(user_id * 1000 + sum(brk) OVER (PARTITION BY user_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS BIGINT) AS track_id FROM e2),
det AS (SELECT {', '.join(f'{v} AS {k}' for k, v in _COLUMNS.items())} FROM e3)"""
FEAT_SQL = f""",
fe AS (SELECT vec_id, {', '.join(_feature_columns([f'CAST(embedding[{i + 1}] AS DOUBLE)' for i in range(6)]))} FROM embeddings),
detf AS (SELECT det.*, fe.* EXCLUDE (vec_id) FROM det JOIN fe ON det.event_id % (SELECT greatest(1, count(*)) FROM embeddings) = fe.vec_id)"""
