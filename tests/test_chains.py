"""Chaining from tracks against taking all candidate edges one by one."""

import numpy as np
import pytest

from trackweave.operators import greedy, relational

from .test_operators import plain_chain

TRACKS = (
    "clip_id string, track_id long, start long, end long, head_x double, head_y double, tail_x double, tail_y double, vx double, vy double, "
    "team int, ocr int, ab_a double, ab_b double"
)


@pytest.mark.parametrize("most", [25, 10**6])
def test_chains_of_tracks_equal_edges_one_by_one(spark, monkeypatch, most):
    """Dense clips that share track ids, with equal ends and feet, teams, numbers, missing feet, frames and colours, in one batch and in many."""
    monkeypatch.setattr(greedy, "TAILS", 3)
    rng, rows = np.random.default_rng(8), []
    for t in range(330):
        start = int(rng.integers(0, 60))
        x, y, vx, vy = (float(v) for v in (*rng.integers(0, 40, 2) * 10, *rng.integers(-3, 4, 2)))
        foot = (None, None) if t % 41 == 0 else (x, y)
        end = None if t % 43 == 0 else start + int(rng.integers(0, 6))
        colour = (None, 1.0) if t % 7 == 0 else (float(rng.integers(0, 9)), float(rng.integers(0, 9)))
        rows.append((f"c{t % 2}", t // 2, start, end, *foot, x + 5, y, vx, None if t % 47 == 0 else vy, int(rng.integers(-1, 2)), int(rng.integers(0, 3)) if t % 3 == 0 else None, *colour))
    tracks = spark.createDataFrame(rows, TRACKS)
    edges = [tuple(r) for r in relational.stitch_candidates(tracks).select("clip_id", "a", "b", "a_end", "cost").collect()]
    got = greedy.chain_roots(greedy.continued(tracks, most=most)).collect()
    assert {(r.clip_id, r.track_id, r.stable_id) for r in got} == plain_chain(edges) and len(edges) > 3 * len(got) > 300
    assert greedy.chained_tracks(tracks.limit(0)).count() == 0


def test_chaining_makes_no_edges(spark, monkeypatch):
    """A crowd of n tracks has n squared edges, which chaining must not build."""
    monkeypatch.setattr(relational, "stitch_candidates", lambda *a: pytest.fail("edges"))
    rows = [("c", t, t % 40, t % 40, 5.0, 5.0, 5.0, 5.0, 0.0, 0.0, 0, None, 0.0, 0.0) for t in range(400)]
    links = greedy.continued(spark.createDataFrame(rows, TRACKS)).collect()
    free, want = set(range(400)), set()
    for a in sorted(range(400), key=lambda t: (t % 40, t)):
        b = min((b for b in free if 0 < b % 40 - a % 40 <= 30), default=None)
        if b is not None:
            free.remove(b)
            want.add((a, b))
    assert {(r.a, r.b) for r in links} == want


def test_candidates_shuffle_a_track_a_few_times(spark):
    """A fast tail swept some hundred cells, each a shuffled row; now it is in the four slots of frames that it can reach."""
    rows = [("c", t, 40 * t, 40 * t, 5.0, 5.0, 5.0, 5.0, 90.0, 90.0, 0, None, 0.0, 0.0) for t in range(20)]
    edges = relational.stitch_candidates(spark.createDataFrame(rows, TRACKS))
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and edges.count() == 0
    met = edges._jdf.queryExecution().optimizedPlan().toString()
    assert met.count("explode") == 1


@pytest.mark.parametrize("twins,held,most", [(1, 64, 10**6), (20, 3, 50)])
def test_tails_look_as_far_as_they_need(monkeypatch, twins, held, most):
    """All free candidates of each tail were compared, with the square of a dense clip's tracks; here also with twins, who compete for the same heads."""
    monkeypatch.setattr(greedy, "HELD", held)
    monkeypatch.setattr(greedy, "TAILS", 100)
    rng, compared = np.random.default_rng(3), []
    scored = relational.scored
    monkeypatch.setattr(relational, "scored", lambda t, i, *others: compared.append(len(i)) or scored(t, i, *others))

    def side(n, foot, frame, frames):
        columns = {f"{foot}_x": rng.uniform(0, 900, n), f"{foot}_y": rng.uniform(0, 500, n), "vx": rng.uniform(-3, 3, n), "vy": rng.uniform(-3, 3, n), "team": rng.integers(-1, 2, n), "ocr": np.where(rng.random(n) < 0.5, np.nan, rng.integers(0, 9, n)), "ab_a": rng.normal(0, 9, n), "ab_b": rng.normal(0, 9, n)}
        rows = {c: np.repeat(v.astype(float), twins) for c, v in columns.items()}
        return rows | {frame: np.repeat(rng.integers(*frames, n), twins), "track_id": np.arange(n * twins)}

    tails, heads = side(400 // twins, "tail", "end", (7, 8)), side(6000 // twins, "head", "start", (8, 38))
    got, used = greedy.takers(tails, heads, 30, 120.0, 0.5, most).tolist(), set()
    pairs, candidates = sum(compared), 0
    for i in range(len(got)):
        gap = heads["start"] - 7
        x, y = tails["tail_x"][i] + tails["vx"][i] * gap, tails["tail_y"][i] + tails["vy"][i] * gap
        _, b, _, cost = scored(tails, np.full(len(gap), i), heads, np.arange(len(gap)), x, y, 120.0, 0.5)
        candidates += len(b)
        want = min(((c, int(j)) for c, j in zip(cost, b) if int(j) not in used), default=(0, -1))[1]
        assert got[i] == want
        used.add(want)
    assert twins > 1 or pairs < candidates / 2
