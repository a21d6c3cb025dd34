import json
import random

import numpy as np
import pytest

from trackweave.operators import aggregates, clustering, gates, relational, windows
from trackweave.queries import team_frames
from trackweave.sources import readers, sinks
from trackweave.streaming import online, teams


def detection(track, colour, **changes):
    base = {
        "track_id": track, "feature": [float(c) for c in colour], "conf": 0.9, "torso_px": 900, "upper_px": 200, "field_overlap": 0.9, "helmet": False,
        "referee": False, "field_y": None, "box": [100.0 * track, 0.0, 100.0 * track + 40, 80.0],
    }
    return base | changes


def players(rng, **changes):
    teams_apart = np.array([60, -40, 9, 9, 60, 9])
    return [detection(t, rng.normal(np.array([160, 170, 8, 8, 30, 5]) + teams_apart * (t % 2), 1.0), **changes) for t in range(16)]


def test_warm_up_locks_on_two_colours():
    rng, state = np.random.default_rng(0), teams.new_state()
    seen = {}
    for frame in range(1, 40):
        for row in teams.step(state, "c", frame, players(rng)):
            seen.setdefault(row[3], []).append(row)
    assert state["mode"] == "locked" and seen["warmup"][0][4] == -1
    last = {r[2]: r[4] for r in seen["locked"]}
    assert len({last[t] for t in range(0, 16, 2)}) == 1 and {last[0], last[1]} == {0, 1}
    assert len({last[t] for t in range(1, 16, 2)}) == 1
    assert teams.cached(state, 0) == last[0] and teams.cached(state, 99) == -1
    assert teams.step(state, "c", 5, players(rng)) == []


def test_like_colours_fail_and_lower_the_limit():
    state = teams.new_state()
    same = [[[150.0, 160.0, 8.0, 8.0, 30.0, 5.0], 1.0, i % 12] for i in range(40)]
    for n in range(1, 4):
        state["samples"] = [list(s) for s in same]
        assert not teams.calibrate(state)
        assert (state["fails"], state["cooldown"], state["message"], len(state["samples"])) == (n, 150, 60, 35)
    assert state["least"] == 1.0 and state["mode"] == "warmup"


def test_warm_up_refusals_and_caps():
    state = teams.new_state()
    one = detection(1, [160, 170, 8, 8, 30, 5])
    assert [teams.collect(state, one) for _ in range(4)] == [None, None, None, "track_cap"]
    assert teams.collect(state, one | {"track_id": 2, "conf": 0.4}) == "low_conf"
    assert teams.collect(state, one | {"track_id": 2, "conf": 0.4, "helmet": True, "field_overlap": 0.0}) is None
    assert teams.collect(state, one | {"track_id": 3, "torso_px": 10}) == "small_mask"
    assert teams.collect(state, one | {"track_id": 3, "upper_px": 10}) == "few_upper_pixels"
    assert teams.collect(state, one | {"track_id": 3, "field_overlap": 0.1}) == "not_on_field"
    for t in range(10, 10 + teams.CAP):
        teams.collect(state, one | {"track_id": t, "conf": 0.5 if t == 30 else 0.9})
    assert len(state["samples"]) == teams.CAP and 30 not in {s[2] for s in state["samples"]}
    state = teams.new_state()
    for _ in range(1200):
        teams.warm_tick(state)
    assert state["tracks_needed"] == 6


def test_line_up_locks_at_once():
    rng, state = np.random.default_rng(1), teams.new_state()
    dets = players(rng)
    for d in dets:
        d["field_y"] = 130.0 + d["track_id"] if d["track_id"] % 2 else 290.0 + d["track_id"]
    assert teams.step(state, "c", 15, dets)[0][3] == "locked"
    state = teams.new_state()
    assert teams.step(state, "c", 16, dets)[0][3] == "warmup"
    assert not clustering.spatial_lock(np.full(14, 3.0), 720)


def test_after_a_cut_labels_are_the_own_ones():
    rng, state = np.random.default_rng(0), teams.new_state()
    for frame in range(1, 40):
        rows = teams.step(state, "c", frame, players(rng))
    first = {r[2]: r[4] for r in rows}
    swapped = [d | {"track_id": d["track_id"] ^ 1} for d in players(rng)]
    assert all(r[4] == 1 - first[r[2]] for r in teams.step(state, "c", 40, swapped, is_cut=True))
    state["post_cut"] = 0
    assert all(r[4] == first[r[2]] for r in teams.step(state, "c", 41, swapped))


def test_state_survives_json(spark, sf):
    rows = team_frames(spark, sf).toPandas()
    for clip, part in list(rows.groupby("clip_id"))[:3]:
        want = teams.run_rows(teams.new_state(), clip, part)
        state, got = teams.new_state(), []
        for _, some in part.groupby(part.frame // 50):
            state = json.loads(json.dumps(state))
            got += teams.run_rows(state, clip, some).astype(object).values.tolist()
        assert [list(map(str, r)) for r in got] == [list(map(str, r)) for r in want.astype(object).values.tolist()] and len(got) > 20


def test_homography_fold(spark):
    h = [[1.0, 0.0, 5.0], [0.0, 1.0, 6.0], [0.0, 0.0, 1.0]]
    assert teams.moved_homography(h, [[1, 0, 2], [0, 1, 3]], 10) == [[1.0, 0.0, 3.0], [0.0, 1.0, 3.0], [0.0, 0.0, 1.0]]
    assert teams.moved_homography(h, [[1, 0, 2], [0, 1, 3]], 9) == h and teams.moved_homography(h, [[0, 0, 2], [0, 0, 3]], 20) == h
    rows = spark.createDataFrame([("c", 2, [1.0, 0.0, 1.0, 0.0, 1.0, 1.0], 20), ("c", 1, [1.0, 0.0, 2.0, 0.0, 1.0, 3.0], 20)], "clip_id string, frame long, m array<double>, inliers int")
    assert [r.h[2] for r in teams.homographies(rows, h).orderBy("frame").collect()] == [3.0, 2.0]


def test_holds_match_their_state_machines(spark):
    rng = np.random.default_rng(4)
    rows = [("c", f, bool(rng.integers(2)), bool(rng.integers(12) == 0)) for f in range(200)]
    frames = spark.createDataFrame(rows, "clip_id string, frame long, fit_ok boolean, event boolean")
    state = online.new_state()
    assert [r.valid for r in windows.registration(frames).orderBy("frame").collect()] == [online.field(state, r[2]) for r in rows]
    left, want = 0, []
    for r in rows:
        left = 60 if r[3] else max(0, left - 1)
        want.append(left)
    assert [r.left for r in windows.countdown(frames, "event").orderBy("frame").collect()] == want
    since, want = 0, []
    for i, r in enumerate(rows):
        fresh = r[3] or i == 0 or since == 30
        since = 1 if fresh else since + 1
        want.append(fresh)
    assert [r.refresh for r in windows.refreshed(frames, "event").orderBy("frame").collect()] == want


def test_pixels_and_frames(spark, tmp_path):
    pixels = spark.createDataFrame([(1, 130.0, 120.0, 179)] * 6 + [(1, 132.0, 120.0, 1)] * 6 + [(2, 1.0, 1.0, 5)] * 9, "t int, a double, b double, h int")
    out = {r.t: r for r in aggregates.pixel_stats(pixels, "t").collect()}
    assert out[1].mean_a == 131.0 and out[1].std_a == pytest.approx(1.0) and min(out[1].hue, 180 - out[1].hue) < 1e-6 and out[2].mean_a is None and out[2].n == 9
    for clip, n in (("a", 0), ("a", 12), ("b", 3)):
        (tmp_path / clip).mkdir(exist_ok=True)
        (tmp_path / clip / f"{n:06d}.png").write_bytes(bytes([n]))
    got = readers.read_frames(spark, str(tmp_path)).filter("frame < 10").collect()
    assert sorted((r.clip_id, r.frame, bytes(r.content)) for r in got) == [("a", 0, b"\x00"), ("b", 3, b"\x03")]
    for folder in ("train/images", "train/labels", "test/labels"):
        (tmp_path / "set" / folder).mkdir(parents=True)
        (tmp_path / "set" / folder / "x.txt").write_text("0")
    assert [r.split for r in readers.split_folders(spark, str(tmp_path / "set")).collect()] == ["train"]


def test_descriptions(spark, tmp_path):
    assert readers.check_dataset(sinks.dataset_text("a", "b", ["player"]), "seg") == []
    assert readers.check_dataset("nc: 2\nnames:\n  0: ball\n  1: helmet\n", "helmet") == ["nc"]
    assert readers.check_dataset("nc: 1\nnames:\n- Ball\n", "seg") == ["names"] and readers.check_dataset("", "seg") == ["nc", "names"]
    with pytest.raises(ValueError):
        readers.check_dataset("", "other")
    images = spark.createDataFrame([("train", "a"), ("val", "b"), ("train", "a")], "split string, stem string")
    assert gates.dataset_gate("nc: 1\nnames: ['helmet']\n", "helmet", images).first()["pass"]
    both = images.union(spark.createDataFrame([("val", "a")], images.schema))
    assert not gates.dataset_gate("nc: 1\nnames: ['helmet']\n", "helmet", both).first()["pass"]
    (tmp_path / "h.json").write_text('{"H": [[1, 0, 0], [0, 1, 0],\n [0, 0, 1]]}')
    row = readers.read_homography(spark, str(tmp_path / "h.json")).first()
    assert (row.template_w, row.template_h, row.H[2][2]) == (1200, 533, 1.0)
    with pytest.raises(ValueError):
        readers.images_of(spark.createDataFrame([], "image string, label string, left double, top double, width double, height double"))


def test_stream_sink(spark, tmp_path):
    source = tmp_path / "in"
    spark.range(5).selectExpr("id", "array(id) AS v").write.parquet(str(source))
    rows = spark.readStream.schema("id long, v array<long>").parquet(str(source))
    run = sinks.write_stream(rows, str(tmp_path / "out"), str(tmp_path / "cp"), "csv")
    try:
        run.processAllAvailable()
    finally:
        run.stop()
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 5


def test_dataset_checks_equal_the_function(spark):
    texts = ["", "nc: 1", "nc: 1\nnames: ['player']\n", "nc: 2\nnames:\n  0: ball\n  1: helmet\n", "nc: 1\nnames:\n- Ball\n", "names: {0: \"Player\"}\nnc:  1  \n", "nc: x\nnames: []\n", "nc: 1\nnames: [ball,\n player]\nval: b\n", "nc: 99999999999999999999\nnames:\n\t- helmet", "train: a\nval: b\nnc: 1\nnames: ['helmet']\n"]
    rows = [(t, k) for t in texts for k in readers.TASKS]
    got = {(r.text, r.task): r.wrong for r in readers.dataset_checks(spark.createDataFrame(rows, "text string, task string")).collect()}
    assert got == {(t, k): ",".join(readers.check_dataset(t, k)) for t, k in rows}
    odd = spark.createDataFrame([(None, "seg"), ("nc: 1\nnames: [player]", None), ("nc: 1\nnames: [player]", "other")], "text string, task string")
    assert [r.wrong for r in readers.dataset_checks(odd).collect()] == ["nc,names", "names", "names"]


def test_number_conflicts(spark):
    rows = [("g", 1, 7), ("g", 2, 7), ("g", 3, 8), ("g", 4, None), ("g", 5, 9), ("g", 5, 4), ("h", 6, 1), (None, 7, 1), (None, 8, 2), ("g", None, 1)]
    got = relational.number_conflicts(spark.createDataFrame(rows, "g string, t long, n long"), "g", "t", "n").collect()
    assert {(r.g, r.a, r.b, r.conflict) for r in got} == {("g", 1, 2, False), ("g", 2, 3, True), ("g", 3, 4, False), ("g", 4, 5, False), ("g", 5, 5, True), (None, 7, 8, True)}


FIGURES = ("frames", "locked_frames", "labelled_frames", "locked_labels", "mixed_tracks")
LABELS = "clip_id string, frame long, track_id long, label int, state string"


def test_figures_of_a_stream(spark, tmp_path):
    """After each micro-batch the figures are those of all rows so far; a batch written twice changes nothing."""
    rng = random.Random(8)
    batches = [[(rng.choice(["a", "b", None]), rng.randrange(30), rng.choice([1, 2, 3, None]), rng.choice([0, 1, -1, None]), rng.choice(["locked", "warmup", None])) for _ in range(40)] for _ in range(3)]
    batches.append([("late", 1, 1, 0, "locked")])
    where, parts = f"{tmp_path}/in", f"{tmp_path}/parts"
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, LABELS).write.mode("append").parquet(where)
        seen = spark.readStream.schema(LABELS).parquet(where)
        teams.stream_figures(seen, parts, f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        want = teams.figures(spark.createDataFrame([r for b in batches[: n + 1] for r in b], LABELS)).collect()
        want = {r.clip_id: tuple(int(r[c]) for c in FIGURES) for r in want}
        got = {r.clip_id: tuple(r[c] for c in FIGURES) for r in teams.running_figures(spark, parts).orderBy("epoch").collect()}
        assert {k: v for k, v in got.items() if k is not None} == {k: v for k, v in want.items() if k is not None}
    before = sorted(map(str, teams.running_figures(spark, parts).collect()))
    spark.read.schema(teams.PARTS).parquet(parts).filter("epoch = 1").drop("epoch").write.parquet(f"{parts}/epoch=9")
    again = teams.running_figures(spark, parts).filter("epoch < 9")
    assert sorted(map(str, again.collect())) == before
    last = {r.clip_id: tuple(r[c] for c in FIGURES) for r in teams.running_figures(spark, parts).filter("epoch = 9").collect()}
    assert all(got[k] == v for k, v in last.items())
