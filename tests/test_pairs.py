"""Joins of the boxes of a frame, without a row a pair."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackweave.operators import relational
from trackweave.queries import QUERIES
from trackweave.sources.fixture import detections
from trackweave.streaming import online

BOX = "frame long, {0}_id long, {1}x1 double, {1}y1 double, {1}x2 double, {1}y2 double"


def test_frames_meet_without_a_row_a_pair(spark):
    rows = [(1, i, float(i % 7), 0.0, float(i % 7 + 10), 10.0) for i in range(30)] + [(2, 50, 0.0, 0.0, 5.0, 5.0), (3, 51, None, 0.0, 5.0, 5.0), (None, 52, 0.0, 0.0, 5.0, 5.0), (1, 3, 3.0, 0.0, 13.0, 10.0)]
    right = [(1, 9, 0.0, 0.0, 10.0, 10.0), (1, 8, 0.0, 0.0, 10.0, 10.0), (1, 7, 6.0, 0.0, 16.0, 10.0), (3, 6, 0.0, 0.0, 5.0, 5.0), (None, 5, 0.0, 0.0, 5.0, 5.0), (1, None, 0.0, 0.0, 10.0, 10.0)]
    a = spark.createDataFrame(rows, BOX.format("left", "a_"))
    b = spark.createDataFrame(right, BOX.format("right", "b_"))
    best = relational.best_match(a, b, ["frame"], "left_id", "right_id", 0.5)
    got = {(r.frame, r.left_id): (r.right_id, r.iou) for r in best.collect()}
    assert len(got) == best.count() == 33
    assert got[1, 0] == (8, 1.0) and got[1, 6] == (7, 1.0) and got[1, 3] == (7, pytest.approx(7 / 13))
    assert all(got[k] == (None, None) for k in ((2, 50), (3, 51), (None, 52)))
    hits = relational.helmet_hits(a, b, ["frame"], "left_id")
    assert {r.left_id: r.hits for r in hits.collect()} == {i: 8 if i == 3 else 4 for i in range(30)} | {50: 0, 51: 0, 52: 0}
    sure = relational.helmet_confirmed(a, b.filter("right_id = 7").withColumn("b_y2", b.b_y1 + 4), ["frame"], "left_id")
    assert {r.left_id for r in sure.collect() if r.confirmed} == {i for i in range(30) if i % 7 >= 1} and sure.count() == 33
    boxes = a.selectExpr("frame", "left_id AS id", "a_x1 AS x1", "a_y1 AS y1", "a_x2 AS x2", "a_y2 AS y2").filter("frame = 1 AND id < 9").distinct()
    pairs = relational.overlapping_pairs(boxes, ["frame"], 0.8)
    assert {(r.a_id, r.b_id) for r in pairs.collect()} == {(i, j) for i in range(9) for j in range(i + 1, 9) if abs(i % 7 - j % 7) <= 1}
    for df in (best, hits, sure, pairs):
        assert "Join" not in df._jdf.queryExecution().executedPlan().toString()


def test_number_conflicts_are_asked_of_all_pairs(spark):
    rows = [("g", 1, 7, 7), ("g", 2, None, 1), ("g", 3, 8, None), ("g", 4, 9, 8), ("h", 5, 7, 9), (None, 6, 1, 2), (None, 7, 3, 4)]
    tracks = spark.createDataFrame(rows, "g string, t long, n long, m long")
    got = {(r.g, r.a, r.b) for r in relational.conflicting_pairs(tracks, "g", "t", "n").collect()}
    assert got == {("g", 1, 3), ("g", 1, 4), ("g", 3, 4)}
    assert {(r.a, r.b) for r in relational.conflicting_pairs(tracks, "g", "t", "n", "m").collect()} == {(1, 2), (1, 4)}


def test_number_conflict_query_compares_more_than_neighbours(spark, sf):
    got = QUERIES["flt17_number_conflict"](spark, sf)
    tracks = detections(spark, sf).groupBy("user_id", "track_id").agg(F.max("ocr_num").alias("n"), F.max(F.expr("k % 3")).alias("m")).collect()
    want = {(a.track_id, b.track_id) for a in tracks for b in tracks if a.user_id == b.user_id and a.track_id < b.track_id and None not in (a.n, b.m) and a.n != b.m}
    assert {(r.a, r.b) for r in got.collect()} == want and any(b - a > 1 for a, b in want)


def test_clips_are_folded_some_rows_at_a_time(spark):
    """Small batches that cut frames and clips, with and without null tracks: each frame comes whole, once, in order, to its clip's state."""
    rows = [(f"c{c}", f, None if f % 5 == 0 else t) for c in range(3) for f in range(40) for t in range(1 if f % 5 == 0 else 4)]

    def run(state, clip, part):
        assert len(part) <= 20
        state["seen"] += [(int(f), len(g), str(next(iter(g.track_id)))) for f, g in part.groupby("frame")]
        return pd.DataFrame({"clip_id": [clip], "n": [len(state["seen"])], "sorted": [state["seen"] == sorted(set(state["seen"]))], "keys": [",".join(sorted({k for *_, k in state["seen"]}))]})

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        frames = spark.createDataFrame(rows, "clip_id string, frame long, track_id long")
        got = online.in_order(frames, "clip_id string, n long, sorted boolean, keys string", lambda: {"seen": []}, run).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    last = {c: max((r for r in got if r.clip_id == c), key=lambda r: r.n) for c in ("c0", "c1", "c2")}
    assert all(r.n == 40 and r.keys == "0,<NA>" for r in last.values()) and all(r.sorted for r in got) and len(got) > 12
