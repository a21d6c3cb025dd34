import itertools
import json
import math
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackweave import schema
from trackweave.functions import scalars as S
from trackweave.operators import aggregates, clustering, gates, greedy, quantiles, relational, scans, windows
from trackweave.plans import pass2
from trackweave.queries import HOMOGRAPHY, online_frames
from trackweave.sources import readers, sinks
from trackweave.sources.fixture import detections, with_features
from trackweave.streaming import online


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(0, w) * max(0, h)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return both / union if union > 0 else 0.0


def boxes(rng, n):
    xy = rng.integers(0, 40, (n, 2))
    return np.hstack([xy, xy + rng.integers(5, 30, (n, 2))]).astype(float)


def test_scalar_facts(spark):
    row = S.add(spark.createDataFrame([(10.0, 20.0, 50.0, 120.0)], "x1 double, y1 double, x2 double, y2 double"), **S.HEAD_ROI).first()
    assert (row.hx1, row.hy1, row.hx2, row.hy2) == (10, 20, 50, 48)
    df = spark.createDataFrame([(100.0, 150.0, 140.0, 220.0)], "x1 double, y1 double, x2 double, y2 double")
    identity = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
    x, y = S.projected_inside(identity, 1200, 533)
    assert tuple(S.add(df, cx=x, cy=y).select("cx", "cy").first()) == (120.0, 220.0)
    x, y = S.projected_inside([[1.0, 0.0, 2000.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]], 1200, 533)
    assert tuple(S.add(df, cx=x, cy=y).select("cx", "cy").first()) == (None, None)


def test_suppression_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = []
    for frame in range(12):
        for t, b in enumerate(boxes(rng, int(rng.integers(1, 12)))):
            rows.append(("c", frame, t, float(rng.integers(0, 5)) / 5, *map(float, b)))
    df = spark.createDataFrame(rows, "clip_id string, frame long, track_id long, conf double, x1 double, y1 double, x2 double, y2 double")
    got = {(r.frame, r.track_id) for r in greedy.suppressed(df.repartition(5), 0.3).collect()}
    want = set()
    for frame, part in itertools.groupby(rows, key=lambda r: r[1]):
        kept = []
        for r in sorted(part, key=lambda r: (-r[3], r[2])):
            if all(iou(r[4:], k[4:]) <= 0.3 for k in kept):
                kept.append(r)
        want |= {(frame, r[2]) for r in kept}
    assert got == want


def test_exclusive_matching():
    rng = np.random.default_rng(2)
    for _ in range(30):
        gt, pred = boxes(rng, 6), boxes(rng, 5)
        free, want = list(range(5)), []
        for g in gt:
            best = max(free, key=lambda j: (iou(g, pred[j]), -j), default=None)
            if best is not None and iou(g, pred[best]) >= 0.2:
                free.remove(best)
                want.append(best)
            else:
                want.append(-1)
        assert greedy.exclusive(gt, pred, 0.2) == want
    assert greedy.reuse_indices(boxes(rng, 3), np.zeros((0, 4))) == [0, 0, 0]
    same = np.array([[0, 0, 10, 10]] * 3, float)
    assert greedy.reuse_indices(same, same[:2]) == [0, 1, 0]


def test_stitching(spark):
    def track(t, frames, x0, vx, team=0, num=None):
        return [("c", f, t, float(x0 + vx * f), 0.0, float(x0 + vx * f + 10), 20.0, 0.9, 130.0, 120.0, team, num, 0.6 if num is not None else 0.0, f * 10 + t) for f in frames]

    rows = track(1, range(11), 0, 3, num=7) + track(2, range(15, 31), 0, 3) + track(3, range(15, 31), 1, 3, team=1) + track(4, range(16, 31), 1, 3, num=9) + track(5, range(61, 70), 0, 3)
    names = "clip_id string, frame long, track_id long, x1 double, y1 double, x2 double, y2 double, conf double, feat_a double, feat_b double, team int, ocr_num int, ocr_conf double, event_id long"
    det = spark.createDataFrame(rows, names)
    edges = relational.stitch_candidates(aggregates.track_summary(det))
    assert {(r.a, r.b) for r in edges.collect()} == {(1, 2)}
    ids = {r.track_id: r.stable_id for r in pass2.stitched(det).select("track_id", "stable_id").distinct().collect()}
    assert ids == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_clips_are_judged_apart(spark, sf):
    """Figures of a table of many clips are those of each clip alone, whatever else is in the table."""
    det = detections(spark, sf).withColumn("clip_id", F.expr("concat('c', user_id % 4)"))
    for whole in (lambda d, by: gates.ir_gate(d, by=by), lambda d, by: aggregates.route_metrics(d, by=by)):
        got = {r.clip_id: r.asDict() for r in whole(det, ("clip_id",)).collect()}
        assert set(got) == {"c0", "c1", "c2", "c3"}
        for clip, figures in got.items():
            alone = whole(det.filter(F.col("clip_id") == clip), ()).first().asDict()
            assert {k: v for k, v in figures.items() if k != "clip_id"} == {k: pytest.approx(v) if isinstance(v, float) else v for k, v in alone.items()}
    assert gates.ir_gate(det.limit(0), by=("clip_id",)).count() == 0


EDGES = "clip_id string, a long, b long, a_end long, cost double"


def test_chain_takes_each_head_once(spark):
    edges = spark.createDataFrame([("c", 1, 3, 5, 1.0), ("c", 2, 3, 4, 2.0), ("c", 1, 4, 5, 3.0), ("c", 3, 5, 9, 1.0)], EDGES)
    for finish in (0, 100):
        links, _ = greedy.matched_edges(edges, finish)
        assert {(r.track_id, r.stable_id) for r in greedy.chain_roots(links).collect()} == {(3, 2), (4, 1), (5, 2)}
    assert greedy.chained(edges.limit(0)).count() == 0


def plain_chain(edges):
    """Edge by edge in order, then up to each root."""
    parent, used = {}, set()
    for c, a, b, _, _ in sorted(edges, key=lambda e: (e[0], e[3], e[1], e[4], e[2])):
        if (c, a) not in used and (c, b) not in parent:
            parent[c, b] = a
            used.add((c, a))
    out = set()
    for c, b in parent:
        root = b
        while (c, root) in parent:
            root = parent[c, root]
        out.add((c, b, root))
    return out


@pytest.mark.parametrize("seed, finish", [(0, 0), (1, 0), (2, 40), (3, 0), (4, 10**6)])
def test_matching_in_rounds_equals_one_by_one(spark, seed, finish):
    """Random edges of several clips that share track ids, with equal ends and costs; long chains; repeated edges."""
    rng = np.random.default_rng(seed)
    ends = {t: int(rng.integers(0, 25)) for t in range(120)}
    edges = set()
    for _ in range(900):
        a, b = (int(x) for x in rng.integers(0, 120, 2))
        if 0 < ends[b] - ends[a] + 3 <= 9 and a < b:
            edges.add((f"c{rng.integers(0, 3) ** 2 // 2}", a, b, ends[a], float(rng.integers(0, 4))))
    edges = list({e[:3]: e for e in edges}.values())
    links, counts = greedy.matched_edges(spark.createDataFrame(edges + edges[:20], EDGES), finish)
    got = {(r.clip_id, r.track_id, r.stable_id) for r in greedy.chain_roots(links).collect()}
    assert got == plain_chain(edges)
    assert counts[0] == len(edges) and counts == sorted(counts, reverse=True) and (finish or counts[-1] == 0)


def test_long_chains_find_their_root(spark):
    links = spark.createDataFrame([("c", i, i + 1) for i in range(300)] + [("d", 5, 9)], "clip_id string, a long, b long")
    got = {(r.clip_id, r.track_id): r.stable_id for r in greedy.chain_roots(links).collect()}
    assert got == {("c", i): 0 for i in range(1, 301)} | {("d", 9): 5}


@pytest.mark.parametrize("speed", [0.5, 8.0, 400.0])
def test_swept_cells_lose_no_pair(spark, speed):
    """Against all pairs: slow and fast tails, feet left of and above the frame, gaps at both limits, missing feet."""
    rng = np.random.default_rng(int(speed))
    rows = []
    for t in range(400):
        start = int(rng.integers(0, 90))
        x, y = (float(v) for v in rng.uniform(-300, 900, 2))
        vx, vy = (float(v) for v in np.round(rng.normal(0, speed, 2), 1))
        head = (None, None) if t % 50 == 0 else (x, y)
        rows.append(("c" if t % 3 else "d", t, start, start + int(rng.integers(0, 9)), *head, x + 5, y, vx, vy, int(rng.integers(-1, 2)), None, 0.0, 0.0))
    names = ["clip_id", "track_id", "start", "end", "head_x", "head_y", "tail_x", "tail_y", "vx", "vy", "team", "ocr", "ab_a", "ab_b"]
    kinds = "clip_id string, track_id long, start long, end long, head_x double, head_y double, tail_x double, tail_y double, vx double, vy double, team int, ocr int, ab_a double, ab_b double"
    want = set()
    for a in (dict(zip(names, r)) for r in rows):
        for b in (dict(zip(names, r)) for r in rows):
            gap = b["start"] - a["end"]
            if a["clip_id"] == b["clip_id"] and 0 < gap <= 30 and b["head_x"] is not None and (min(a["team"], b["team"]) < 0 or a["team"] == b["team"]):
                dx, dy = a["tail_x"] + a["vx"] * gap - b["head_x"], a["tail_y"] + a["vy"] * gap - b["head_y"]
                if math.sqrt(dx * dx + dy * dy) <= 120:
                    want.add((a["track_id"], b["track_id"]))
    got = [(r.a, r.b) for r in relational.stitch_candidates(spark.createDataFrame(rows, kinds)).select("a", "b").collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_swept_cells_compare_few(spark):
    """On a dense clip a tenth of the pairs that share a bucket of the gap's length in time is compared, at most."""
    rng = np.random.default_rng(3)
    rows = [("c", t, s := int(rng.integers(0, 300)), s + 5, float(rng.uniform(0, 1280)), float(rng.uniform(0, 720)), float(rng.uniform(0, 1280)), float(rng.uniform(0, 720)), 1.0, -1.0, -1, None, 0.0, 0.0) for t in range(3000)]
    tracks = spark.createDataFrame(rows, "clip_id string, track_id long, start long, end long, head_x double, head_y double, tail_x double, tail_y double, vx double, vy double, team int, ocr int, ab_a double, ab_b double")
    bucketed = sum((a + 1) // 30 <= b // 30 <= (a + 30) // 30 for a in (r[3] for r in rows) for b in (r[2] for r in rows))
    assert relational.met_pairs(tracks).count() * 10 <= bucketed


def test_snap(spark):
    rows = [("c", f, t, float((1 if f < 15 else 10) * f + t), 0.0, float((1 if f < 15 else 10) * f + t + 4), 10.0) for f in range(30) for t in range(4)]
    det = spark.createDataFrame(rows, "clip_id string, frame long, track_id long, x1 double, y1 double, x2 double, y2 double")
    assert windows.snap_frame(det).first().snap_frame == 15
    assert windows.snap_frame(det.withColumn("frame", det.frame + 100)).first().snap_frame == 115
    assert windows.snap_frame(det.filter("frame < 8")).first().snap_frame == 0


def test_planted_clusters(spark):
    rng = np.random.default_rng(3)
    rows = pd.DataFrame(np.vstack([rng.normal(m, 1.0, (40, 6)) for m in (100, 120)]), columns=clustering.FEATURES)
    rows["conf"], rows["torso_px"] = 0.9, 500
    label = clustering.cluster(rows)
    assert (label[:40] == 0).all() and (label[40:] == 1).all()
    order = rng.permutation(80)
    assert (clustering.cluster(rows.iloc[order]) == label[order]).all()
    assert clustering.cluster(rows.head(7)) is None
    assert clustering.canonical(np.array([120.0, 25.0]), np.ones(2), np.array([0, 1])).tolist() == [1, 0]
    values = rng.integers(0, 50, 20).astype(float)
    label, cost = clustering.split_1d(values)
    s = np.sort(values)
    assert cost == pytest.approx(min(((s[:i] - s[:i].mean()) ** 2).sum() + ((s[i:] - s[i:].mean()) ** 2).sum() for i in range(1, 20)))


def test_distributed_clusters_match_the_kernel(spark):
    rng = np.random.default_rng(4)
    parts = []
    for clip, means in (("a", (100, 120)), ("b", (100, 100.5)), ("c", (90, 96)), ("few", (100, 120))):
        part = pd.DataFrame(np.vstack([rng.normal(m, 1.0, (60, 6)) for m in means]), columns=clustering.FEATURES)
        part["clip_id"], part["conf"], part["torso_px"] = clip, rng.uniform(0, 1, 120), rng.integers(0, 900, 120)
        parts.append(part.head(6) if clip == "few" else part)
    rows = pd.concat(parts, ignore_index=True)
    rows["event_id"], rows["track_id"] = np.arange(len(rows)), np.arange(len(rows)) % 11
    got = {r.event_id: r.det_team for r in clustering.team_rows(spark.createDataFrame(rows).repartition(5), "conf >= 0").collect()}
    want = {}
    for _, part in rows.groupby("clip_id"):
        label = clustering.cluster(part)
        want |= {} if label is None else dict(zip(part.event_id, label))
    assert got == want and len(want) >= 240
    assert clustering.team_rows(spark.createDataFrame(rows).limit(0), "true").count() == 0


def test_rounds_take_places_not_rows(spark, monkeypatch):
    """Rows of equal features are one point in the rounds of 2-means, however many; teams are those of all rows."""
    rng = np.random.default_rng(5)
    places = np.vstack([rng.normal(m, 1.0, (9, 6)) for m in (100, 104)])
    rows = pd.DataFrame(places[rng.integers(0, 18, 600)], columns=clustering.FEATURES)
    rows["clip_id"], rows["conf"], rows["torso_px"] = np.where(np.arange(600) % 3, "a", "b"), rng.uniform(0, 1, 600), rng.integers(0, 900, 600)
    rows["event_id"], rows["track_id"] = np.arange(600), np.arange(600) % 11
    taken, run = [], clustering.two_centres
    monkeypatch.setattr(clustering, "two_centres", lambda rows, by: taken.append(rows.count()) or run(rows, by))
    got = {r.event_id: r.det_team for r in clustering.team_rows(spark.createDataFrame(rows).repartition(5), "true").collect()}
    want = {}
    for _, part in rows.groupby("clip_id"):
        want |= dict(zip(part.event_id, clustering.cluster(part)))
    assert got == want and len(got) == 600 and taken[0] <= 36


def test_smoothing_reaches_far_enough(spark):
    rng = np.random.default_rng(6)
    x = rng.integers(0, 2000, 300).astype(float)
    rows = [("c", i, 1, v, 2 * v) for i, v in enumerate(x.tolist())]
    got = [r.sx1 for r in windows.smoothed(spark.createDataFrame(rows, "clip_id string, frame long, track_id long, x1 double, y1 double")).orderBy("frame").collect()]
    mean, want = x[0], []
    for v in x:
        mean = v if not want else 0.6 * v + 0.4 * mean
        want.append(int(mean))
    assert got == want


def test_plan_scans_little(spark, sf):
    from trackweave.queries import QUERIES

    plan = QUERIES["pass2_routes"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") < 10


class Halves:
    """A provider that finds a box in each frame of even number."""

    schema = "clip_id string, frame long, x1 double"

    def open(self):
        self.width = 640.0

    def detect(self, frames):
        import pyarrow as pa
        import pyarrow.compute as pc

        kept = frames.filter(pc.equal(pc.bit_wise_and(frames.column("frame"), 1), 0))
        return pa.RecordBatch.from_arrays([kept.column("clip_id"), kept.column("frame"), pa.array([self.width / 2] * kept.num_rows)], names=["clip_id", "frame", "x1"])


def test_provider(spark):
    from trackweave.streaming.provider import perceive

    frames = spark.createDataFrame([("c", f, bytearray(b"x")) for f in range(9)], "clip_id string, frame long, content binary")
    assert sorted((r.frame, r.x1) for r in perceive(frames, Halves()).collect()) == [(f, 320.0) for f in (0, 2, 4, 6, 8)]
    assert perceive(frames.limit(0), Halves()).count() == 0


def test_eval_log_has_one_header(spark, tmp_path):
    from trackweave.sources import sinks

    path = str(tmp_path / "log")
    for n in (1, 2, 3):
        sinks.append_report(spark.createDataFrame([(f"c{n}", n)], "clip string, n int"), path)
    assert spark.read.text(path).filter("value = 'clip,n'").count() == 1
    assert sorted(tuple(r) for r in sinks.read_report(spark, path, "clip string, n int").collect()) == [("c1", 1), ("c2", 2), ("c3", 3)]


def test_line_up_lock():
    two = np.array([130.0 + 4 * i for i in range(7)] + [290.0 + 4 * i for i in range(7)])
    assert clustering.spatial_lock(two, 720)
    assert not clustering.spatial_lock(np.array([130.0 + 2 * i for i in range(10)] + [290.0 + 4 * i for i in range(4)]), 720)
    assert not clustering.spatial_lock(two[:13], 720)


def test_gate_contract(spark):
    rows = [("c", f, t, 10.0, 10.0, 40.0, 80.0, False) for f in range(12) for t in range(12)]
    det = spark.createDataFrame(rows, "clip_id string, frame long, track_id long, x1 double, y1 double, x2 double, y2 double, mask_is_fallback boolean")
    out = gates.ir_gate(det).first()
    assert out["pass"] and out.n_rows == 144 and out.median_det == 12 and out.unique_tracks == 12 and out.reason is None
    empty = gates.ir_gate(det.limit(0)).first()
    assert not empty["pass"] and empty.reason == "empty_ir"
    assert schema.missing_columns(det.select("clip_id", "frame")) == sorted(set(schema.REQUIRED) - {"clip_id", "frame"})
    assert aggregates.route_metrics(det.limit(0)).first().asDict() == {"completeness": 0.0, "fragmentation": 0.0, "id_switches": 0, "team_accuracy": None}


def test_helmet_gate():
    from dataclasses import replace

    p = replace(online.P, helmet_window=3, helmet_required=2, helmet_soft_lock=3, helmet_grace=0)
    track = {}
    assert [online.helmet(track, c, p) for c in (True, True, True, False, False, False)] == [False, True, True, True, True, False]
    p, track = replace(p, helmet_grace=1, helmet_required=1), {}
    assert [online.helmet(track, c, p) for c in (False, False)] == [True, False]


def test_cut_rules(spark):
    state = online.new_state()
    assert [online.cut(state, m) for m in (50, 50, 50, 50, 50)] == [False, True, False, False, False]
    rows = spark.createDataFrame([("c", i, m) for i, m in enumerate([1.0, 50.0, 50.0, 50.0, 50.0, 1.0, 50.0, 50.0])], "clip_id string, frame long, mad double")
    assert [r.is_cut for r in windows.cut_flags(rows).orderBy("frame").collect()] == [False, False, True, False, True, False, False, True]


@pytest.mark.parametrize(("chunk", "fan"), [(1, 2), (7, 3), (64, 2), (1024, 1024)])
def test_cuts_as_a_scan_of_maps(spark, chunk, fan):
    """Equal to the step function for any chunk and any fan; clips of nulls, gaps, negative frames, and repeated rows."""
    rng = random.Random(5)
    rows = [(c, f - 40, rng.choice([10.0, 50.0, 50.0, 60.0, None, float("nan")]), "x") for c in ("a", "b", None) for f in range(400) if rng.random() > 0.1]
    rows += [("one", 5, 50.0, "x"), ("a", None, 50.0, "x")]
    want = {}
    for clip in ("a", "b", None, "one"):
        state = online.new_state()
        for c, f, mad, _ in sorted((r for r in rows if r[0] == clip and r[1] is not None), key=lambda r: r[1]):
            want[c, f] = online.cut(state, None if mad is None or mad != mad else mad)
    df = spark.createDataFrame(rows, "clip_id string, frame long, mad double, entry string").repartition(5)
    got = {(r.clip_id, r.frame): r.is_cut for r in scans.cuts(df, chunk=chunk, fan=fan).collect()}
    assert got == want and sum(want.values()) > 8
    assert scans.cuts(df.limit(0)).count() == 0


@pytest.mark.parametrize(("bins", "few"), [(32, 3), (1024, 4096)])
def test_quantiles_of_any_size_of_group(spark, bins, few):
    """Equal to percentile with one key that has most rows, ties, a null key, and values over many exponents."""
    rng = random.Random(6)
    rows = [("hot", rng.choice([rng.random(), 0.5, -3.0, 10.0 ** rng.randint(-3, 3)])) for _ in range(600)]
    rows += [(None, float(i)) for i in range(9)] + [("one", 4.0), ("two", 1.0), ("two", 2.0), ("none", None), ("none", float("nan")), ("ends", -1.7e308), ("ends", 1.7e308), ("ends", 0.0), ("tiny", 1.5e-323), ("tiny", 2e-323)]
    df = spark.createDataFrame(rows, "g string, x double")
    at = {"a": 0.0, "b": 0.1, "m": 0.5, "c": 0.933, "z": 1.0}
    got = quantiles.exact_quantiles(df, "x", at, ("g",), bins, few).collect()
    real = df.filter("NOT isnan(x)")
    want = real.groupBy("g").agg(*[F.expr(f"percentile(x, {q})").alias(n) for n, q in at.items()]).filter("g IS NULL OR g <> 'none'").collect()
    assert sorted(map(repr, got)) == sorted([*map(repr, want), "Row(g='none', a=None, b=None, m=None, c=None, z=None)"])
    whole = quantiles.exact_quantiles(df.filter("g = 'hot'"), "x", at, (), bins, few).collect()
    assert [tuple(r) for r in whole] == [tuple(r)[1:] for r in want if r.g == "hot"]
    assert [tuple(r) for r in quantiles.exact_quantiles(df.limit(0), "x", at).collect()] == [(None,) * 5]


def test_votes():
    rule, track = online.margins(10.0), {}
    assert online.margins(10.0) == (1.2, 3.0, 10) and online.margins(20.0, warmup=True) == (1.0, 5.0, 6)
    for _ in range(9):
        assert online.vote(track, 1, 5.0, 1.0, 100.0, False, rule) == 1 and track.get("lock") is None
    online.vote(track, 1, 5.0, 1.0, 100.0, False, rule)
    assert track["lock"] == 1
    assert [online.vote(track, 0, 1.0, 9.0, 100.0, False, rule) for _ in range(5)] == [1] * 5
    assert online.vote(track, 0, 1.0, 9.0, 900.0, False, rule) == 1 and track["against"] == 0  # frozen
    assert [online.vote(track, 0, 1.0, 9.0, 100.0, False, rule) for _ in range(6)] == [1] * 5 + [0]
    assert track["lock"] is None and track["votes"].count(0) == 12
    mixed = {}
    for label in [0] * 10 + [1] * 10:
        mixed.setdefault("lock", None)
        last = online.vote(mixed, label, 5.0, 1.0, 0.0, False, (1.2, 99.0, 11))
    assert last == 0 and mixed["lock"] is None  # a tie goes to the label seen first
    assert online.vote({}, 1, 1.0, 1.0, 0.0, False, rule) == -1
    assert online.crowded([0, 0, 10, 10], [[0, 0, 10, 10]]) is False and online.crowded([0, 0, 10, 10], [[20, 0, 30, 10]]) is True


def test_smoothing_matches_fold(spark, sf):
    rows = windows.smoothed(detections(spark, sf)).select("track_id", "frame", "x1", "sx1").collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r.track_id, r.frame)):
        last = by.get(r.track_id)
        value = r.x1 if last is None or last[0] != r.frame - 1 else 0.6 * r.x1 + 0.4 * last[1]
        by[r.track_id] = (r.frame, value)
        assert abs(r.sx1 - int(value)) <= 1e-6 or abs(value - round(value)) < 1e-6


@pytest.fixture
def typed_state(spark):
    """The RocksDB store, which typed state needs, for one test."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, online.ROCKSDB)
    yield
    spark.conf.set(key, before)


def test_batch_equals_stream(spark, sf, tmp_path, typed_state):
    frames = online_frames(spark, sf).filter("frame < 120").cache()
    want = sorted(map(repr, online.batch(frames).collect()))
    source = tmp_path / "frames"
    for i in range(4):
        frames.filter(f"frame >= {30 * i} AND frame < {30 * i + 30}").coalesce(1).write.parquet(str(source / f"b{i}"))
    reader = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(source))
    run = online.stream(reader).writeStream.format("memory").queryName("online_rows").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    try:
        assert run.awaitTermination(60)
    finally:
        run.stop()
    got = spark.table("online_rows").collect()
    assert sorted(map(repr, got)) == want and len(want) > 100


def test_stream_restarts_and_writes_only_tracks_it_saw(spark, sf, tmp_path, typed_state):
    """Three micro-batches, each by a query started anew on one checkpoint, the last with one track of each clip and a late frame."""
    frames = online_frames(spark, sf).filter("frame < 90").cache()
    one = frames.groupBy("clip_id").agg({"track_id": "min"}).withColumnRenamed("min(track_id)", "track_id")
    parts = [frames.filter("frame < 40"), frames.filter("frame BETWEEN 40 AND 69"), frames.filter("frame >= 70").join(one, ["clip_id", "track_id"])]
    late = parts[2].dropDuplicates(["clip_id"]).selectExpr(*["CAST(5 AS BIGINT) AS frame" if c == "frame" else c for c in frames.columns])
    want = sorted(map(repr, online.batch(parts[0].unionByName(parts[1]).unionByName(parts[2])).drop("dropped").collect()))
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    updated, operators = [], None
    for i, part in enumerate(parts):
        (part.unionByName(late) if i == 2 else part).coalesce(1).write.mode("append").parquet(source)
        run = (
            online.stream(spark.readStream.schema(frames.schema).parquet(source))
            .writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        )
        try:
            assert run.awaitTermination(120)
        finally:
            run.stop()
        updated.append(sum(o["numRowsUpdated"] for o in run.lastProgress["stateOperators"]))
    got = spark.read.parquet(out)
    assert sorted(map(repr, got.drop("dropped").select(*[c for c in online.batch(frames).columns if c != "dropped"]).collect())) == want
    clips = parts[2].select("clip_id").distinct().count()
    assert late.count() == clips == got.filter("dropped > 0").select("clip_id").distinct().count() > 0
    assert 0 < updated[2] <= 2 * clips < updated[0]  # the clip's value and one track each


def test_state_of_a_clip_that_is_gone_expires(spark, sf, tmp_path, typed_state):
    """The same frames twice: late while the state is kept, taken anew, as if nothing had been before, once it is gone."""
    frames = online_frames(spark, sf).filter("clip_id = 'u0' AND frame < 100").cache()
    once = online.batch(frames).collect()
    n = frames.count()
    assert once

    def read(run, rows: int) -> None:  # a query with timed state never comes to rest, so its progress is watched
        end = time.monotonic() + 40
        while sum(p["numInputRows"] for p in run.recentProgress) < rows:
            assert time.monotonic() < end and run.isActive
            time.sleep(0.2)

    for name, keep_ms, want in (("short", 1, once + once), ("long", 3_600_000, once)):
        source = str(tmp_path / name)
        frames.coalesce(1).write.parquet(source)
        reader = spark.readStream.schema(frames.schema).parquet(source)
        run = online.stream(reader, keep_ms).writeStream.format("memory").queryName(f"kept_{name}").option("checkpointLocation", str(tmp_path / f"cp_{name}")).start()
        try:
            read(run, n)
            frames.coalesce(1).write.mode("append").parquet(source)
            read(run, 2 * n)
        finally:
            run.stop()
        assert sorted(map(repr, spark.table(f"kept_{name}").collect())) == sorted(map(repr, want))


def test_typed_state_names_its_store(spark):
    with pytest.raises(ValueError, match="stateStore"):
        online.stream(spark.range(1).selectExpr("'c' AS clip_id"))


def test_late_frames_are_counted():
    state, rows = online.new_state(), [{"track_id": 1, "x1": 0, "y1": 0, "x2": 9, "y2": 9, "helmet_hits": 0, "label": 0, "dist0": 0.0, "dist1": 5.0, "torso_px": 100, "mad": 0.0, "fit_ok": True}]
    assert len(online.step(state, "c", 5, rows)) == 1 and online.step(state, "c", 5, rows) == [] and state["dropped"] == 1


def test_long_polygons(spark):
    points = [f"0.{100 + i % 300} 0.5" for i in range(600)] + ["0.9 0.75"]
    rows = [(1, "0 " + " ".join(points)), (2, "0 " + " ".join(points) + " 0.1"), (3, ""), (4, "0"), (5, "1 0.1 0.2 0.3 0.4 0.5 0.6")]
    got = readers.polygon_boxes(spark.createDataFrame(rows, "line_no int, line string"), 100, 100).orderBy("line_no").collect()
    assert [(r.line_no, r.cls) + tuple(round(r[c]) for c in ("x1", "y1", "x2", "y2")) for r in got] == [(1, 0, 10, 50, 90, 75), (5, 1, 10, 20, 50, 60)]


def test_class_zero_lines(spark):
    rows = [("a", 1, "00  0.1\t0.2 "), ("a", 2, "1 0.3 0.4"), ("a", 3, ""), ("b", 1, "0"), ("b", 2, "0 0.5 0.50")]
    got = readers.class_zero_lines(spark.createDataFrame(rows, "stem string, line_no int, line string")).collect()
    assert sorted(map(tuple, got)) == [("a", 1, "0 0.1 0.2"), ("b", 1, "0"), ("b", 2, "0 0.5 0.50")]


def test_features_are_of_all_vectors(spark):
    sf = "/root/testdata/sf0.1"
    vectors = [r.embedding[0] for r in spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()]
    got = with_features(spark, sf, spark.range(2 * len(vectors)).withColumnRenamed("id", "event_id")).select("event_id", "feat_a").collect()
    assert len(vectors) > 500 and len(got) == 2 * len(vectors)
    assert all(abs(r.feat_a - (128 + 100 * vectors[r.event_id % len(vectors)])) < 0.001 for r in got)


def test_sources_and_sinks(spark, sf, tmp_path):
    det = with_features(spark, sf)
    ir = det.selectExpr("clip_id", "frame", "track_id", "x1", "array(feat_a, feat_b) AS feat_lab6d", "team")
    sinks.write_ir(ir, str(tmp_path / "ir"))
    back = readers.read_ir(spark, str(tmp_path / "ir"))
    assert back.count() == det.count() and back.filter("feat_lab6d[0] IS NULL").count() == 0
    sinks.write_csv(ir, str(tmp_path / "routes"))
    assert json.loads(readers.read_any(spark, str(tmp_path / "routes")).first().feat_lab6d)
    for _ in range(2):
        sinks.append_report(ir.limit(3), str(tmp_path / "log"))
    names = "clip_id string, frame long, track_id long, x1 double, feat_lab6d string, team int"
    assert sinks.read_report(spark, str(tmp_path / "log"), names).count() == 6
    sinks.write_json(ir.limit(2), str(tmp_path / "m.json"))
    assert readers.read_any(spark, str(tmp_path / "m.json")).count() == 2
    path = tmp_path / "zero.jsonl"
    path.write_text('{"frame": 1, "path": "ID_NONE", "raw_boxes": 0}\n\n{"frame": 1, "path": "HUD_ATE_ALL", "raw_boxes": 4, "band": [1, 2]}\n{"frame": 2, "path": "x"}\n')
    rows = {r.frame: (r.path, r.raw_boxes) for r in readers.read_zerodet(spark, str(path)).collect()}
    assert rows == {1: ("HUD_ATE_ALL", 4), 2: ("x", None)}
    (tmp_path / "ann.csv").write_text("frame,track_id,predicted_team,correct_team\n0,1,0,1\n0,2,0,\n")
    assert [r.correct_team for r in readers.read_annotations(spark, str(tmp_path / "ann.csv")).collect()] == [1]
    sinks.write_labels(spark.createDataFrame([("train", "a", "0 1 2"), ("val", "b", "0 3 4")], "split string, stem string, line string"), str(tmp_path / "labels"))
    assert spark.read.text(str(tmp_path / "labels")).count() == 2
    sinks.save_model(spark, {"feature_version": "v2", "upper_body_frac": 0.45, "scaler": [1.0]}, str(tmp_path / "model"))
    assert gates.version_gate(spark.read.json(str(tmp_path / "model")), "v2", 0.45).first().ok


def test_reports_by_epoch(spark, tmp_path):
    """A repeated epoch replaces itself, writers at once don't disturb each other, and there is one header."""
    from concurrent.futures import ThreadPoolExecutor

    path, rows = str(tmp_path / "log"), spark.range(4).selectExpr("id AS a", "concat('x,', id) AS b")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda e: sinks.commit_report(rows.filter(f"a >= {e}"), path, e), [0, 1, 2, 3]))
    for epoch in (1, 1, 7):
        sinks.commit_report(rows.filter(f"a >= {epoch}"), path, epoch)
    got = sorted(map(tuple, sinks.read_commits(spark, path, "a long, b string").collect()))
    assert got == sorted((a, f"x,{a}", str(e)) for e in range(4) for a in range(e, 4))
    files = [f for f in tmp_path.rglob("*.csv") if not f.name.startswith((".", "_"))]
    assert sum(f.read_text().splitlines().count("a,b") for f in files if f.is_file()) == 1


def test_stream_of_reports_after_a_failed_batch(spark, tmp_path):
    """A micro-batch that failed after its rows were written is replayed on the same checkpoint, and they are there once."""
    source, path = str(tmp_path / "in"), str(tmp_path / "log")
    reader = lambda: spark.readStream.schema("a long").parquet(source)
    spark.range(5).withColumnRenamed("id", "a").write.parquet(source)

    def fails(rows, number):
        sinks.commit_report(rows, path, number)
        raise RuntimeError("after the commit")

    broken = reader().writeStream.foreachBatch(fails).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="after the commit"):
        broken.awaitTermination(60)
    assert sinks.read_commits(spark, path, "a long").count() == 5
    for part in (None, spark.range(5, 8)):
        if part is not None:
            part.withColumnRenamed("id", "a").write.mode("append").parquet(source)
        assert sinks.stream_report(reader(), path, str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(60)
    assert sorted((r.a, r.epoch) for r in sinks.read_commits(spark, path, "a long").collect()) == [(i, "0" if i < 5 else "1") for i in range(8)]


def test_pass2_is_stable_under_row_order(spark, sf):
    det = with_features(spark, sf)
    rows = lambda d: sorted(map(repr, pass2.analyse(d, HOMOGRAPHY, 1.5).select("event_id", "stable_id", "team", "t_from_snap").collect()))
    assert rows(det) == rows(det.orderBy("event_id", ascending=False).repartition(7))


def test_clips_are_apart(spark, sf):
    one = with_features(spark, sf).filter("frame < 300").cache()
    two = one.selectExpr("'other' AS clip_id", "CASE WHEN ocr_num IS NULL THEN NULL ELSE 99 - ocr_num END AS ocr_num", "128 + (feat_a - 128) / 2 AS feat_a", *[c for c in one.columns if c not in ("clip_id", "ocr_num", "feat_a")])
    pick = lambda d: sorted(map(repr, pass2.analyse(d, HOMOGRAPHY, 1.5).select("clip_id", "event_id", "stable_id", "team", "jersey_number", "t_from_snap").collect()))
    assert pick(one.unionByName(two)) == sorted(pick(one) + pick(two))


def test_teams_by_brightness(spark, sf):
    det = with_features(spark, sf)
    rows = lambda d: sorted(map(tuple, d.select("event_id", "team").collect()))
    flat = det.select("clip_id", "frame").distinct().selectExpr("*", "50.0D AS lum")
    assert rows(pass2.assign_teams(det, luminance=flat)) == rows(pass2.assign_teams(det)) == rows(pass2.assign_teams(det, luminance=flat.limit(0)))
    bright = relational.of_segment(det).select("clip_id", "frame", "segment").distinct().selectExpr("clip_id", "frame", "40.0D * segment AS lum")
    assert rows(pass2.assign_teams(det, luminance=bright)) == rows(pass2.assign_teams(det, by_segment=True))
    few = det.orderBy("event_id").limit(5)
    assert rows(pass2.assign_teams(few)) == rows(few)
