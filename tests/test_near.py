"""Near boxes against all pairs, in bounded memory."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest

from trackweave.operators import greedy, near


def crowd(rng, n, wide=False):
    """Boxes with repeats, missing and infinite coordinates, boxes without area and, if wide, some very large ones."""
    xy, size = rng.integers(0, 60, (n, 2)) * 4.0, rng.integers(-1, 9, (n, 2)) * 6.0
    if wide:
        size[:: 7] *= 40
    out = np.hstack([xy, xy + size])
    out[3::19, 1], out[5::23, 2] = np.nan, np.inf
    return np.vstack([out, out[: n // 4]])


@pytest.mark.filterwarnings("ignore:invalid value")
@pytest.mark.parametrize("least, guarded, wide", [(0.05, True, False), (0.3, False, True), (0.5, False, False), (0.7, False, True), (1.0, False, False)])
def test_overlapping_loses_no_pair(least, guarded, wide):
    rng = np.random.default_rng(int(least * 100))
    a = crowd(rng, 300, wide)
    b = np.vstack([crowd(rng, 220, wide), a[:40]])
    want = set()
    for j, other in enumerate(b):
        score = near.overlaps(a, np.tile(other, (len(a), 1)), guarded)
        whole = np.isfinite(a).all(1) & np.isfinite(other).all()
        want |= {(int(i), j, float(score[i])) for i in np.flatnonzero(whole & (score >= least))}
    got = [(int(i), int(j), float(s)) for block in near.overlapping(a, b, least, guarded) for i, j, s in zip(*block)]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_blocks_are_small_and_keep_a_box_together(monkeypatch):
    monkeypatch.setattr(near, "PAIRS", 64)
    monkeypatch.setattr(near, "ROWS", 8)
    box = crowd(np.random.default_rng(4), 200)
    blocks = [set(i.tolist()) for i, _, _ in near.overlapping(box, box, 0.2) if len(i)]
    assert len(blocks) > 3 and sum(map(len, blocks)) == len(set().union(*blocks))


def dense(n):
    rng = np.random.default_rng(5)
    xy = rng.integers(0, 1200, (n, 2)) * 1.0
    return np.hstack([xy, xy + rng.integers(20, 60, (n, 2))])


@pytest.mark.parametrize("work", [
    lambda b: greedy.suppress(pd.DataFrame(b, columns=["x1", "y1", "x2", "y2"]).assign(conf=0.5, track_id=np.arange(len(b))), 0.7),
    lambda b: greedy.exclusive(b[::2], b[1::2], 0.3),
    lambda b: greedy.reuse_indices(b[::2], b),
])
def test_greedy_operators_need_no_square(work):
    """4000 boxes of a frame: a matrix of their overlaps has 128 MB."""
    box = dense(4000)
    work(box[:10])
    tracemalloc.start()
    work(box)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48 << 20


@pytest.mark.filterwarnings("ignore:invalid value")
def test_reuse_takes_the_best_free_one_of_all():
    rng = np.random.default_rng(6)
    for _ in range(20):
        a, b = crowd(rng, 12), crowd(rng, 10)
        used, want = set(), []
        for row in np.nan_to_num(greedy.box_iou(a, b), nan=-1.0):
            order = np.argsort(-row, kind="stable").tolist()
            want.append(next((j for j in order if j not in used), order[0]))
            used.add(want[-1])
        assert greedy.reuse_indices(a, b) == want
