"""Greedy operators: duplicate suppression and exclusive matching by kernels over one frame or image; chaining of tracks
by rounds over tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..params import P
from ..tables import BROADCAST_BYTES, discard, materialize
from . import near, relational


def box_iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Overlap of each of a with each of b; zero where the union isn't positive."""
    w = np.minimum(a[:, None, 2], b[None, :, 2]) - np.maximum(a[:, None, 0], b[None, :, 0])
    h = np.minimum(a[:, None, 3], b[None, :, 3]) - np.maximum(a[:, None, 1], b[None, :, 1])
    both = np.clip(w, 0, None) * np.clip(h, 0, None)
    size = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    union = size(a)[:, None] + size(b)[None, :] - both
    return np.divide(both, union, out=np.zeros_like(both), where=union > 0)


_BOX = ["x1", "y1", "x2", "y2"]


def suppress(rows: pd.DataFrame, least: float) -> pd.DataFrame:
    """Rows by confidence (then id), without those that overlap a kept one by more than least (above 0)."""
    rows = rows.sort_values(["conf", "track_id"], ascending=[False, True], kind="stable")
    box, ids = rows[_BOX].to_numpy(float), rows["track_id"].to_numpy()
    gone = np.zeros(len(rows), bool)
    for i, j, score in near.overlapping(box, box, least, skip=gone):
        later = (j > i) & (score > least) & (ids[i] != ids[j])
        for at, others in near.of_each(i[later], j[later]):
            if not gone[at]:
                gone[others] = True
    return rows[~gone]


def suppressed(det: DataFrame, least: float = 0.70) -> DataFrame:
    """Duplicate suppression in each frame. Frames with one row skip the kernel."""
    cols = det.select("clip_id", "frame", "track_id", "conf", *_BOX)
    sizes = cols.groupBy("clip_id", "frame").agg(F.count("*").alias("n"))
    counted = cols.join(sizes, ["clip_id", "frame"])
    many = counted.filter("n > 1").drop("n").groupBy("clip_id", "frame").applyInPandas(lambda x: suppress(x, least), cols.schema)
    return counted.filter("n = 1").drop("n").union(many)


def exclusive(gt: np.ndarray, pred: np.ndarray, least: float) -> list[int]:
    """For each gt box, in order, the free pred box of greatest overlap, or -1 if it is below least (above 0)."""
    out, used = np.full(len(gt), -1), np.zeros(len(pred), bool)
    for i, j, score in near.overlapping(gt, pred, least):
        order = np.lexsort((j, -score, i))
        for at, others in near.of_each(i[order], j[order]):
            free = others[~used[others]]
            if len(free):
                out[at] = free[0]
                used[free[0]] = True
    return out.tolist()


def matched(boxes: DataFrame, least: float = 0.5) -> DataFrame:
    """boxes (image, kind, idx, x1..) to image, idx of gt, matched (idx of pred or -1), area."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        gt = rows[rows.kind == "gt"].sort_values("idx")
        pred = rows[rows.kind == "pred"].sort_values("idx")
        hit = exclusive(gt[_BOX].to_numpy(float), pred[_BOX].to_numpy(float), least)
        idx = pred.idx.to_numpy()
        area = (gt.x2 - gt.x1) * (gt.y2 - gt.y1)
        return pd.DataFrame({"image": gt.image, "idx": gt.idx, "matched": [int(idx[i]) if i >= 0 else -1 for i in hit], "area": area.astype(float)})

    return boxes.groupBy("image").applyInPandas(run, "image long, idx long, matched long, area double")


#: Originals that overlap a filtered box by so much are looked at first; only where none of them is free, all are.
NEAREST = 0.7


def reuse_indices(filtered: np.ndarray, original: np.ndarray) -> list[int]:
    """For each filtered box the free original of greatest overlap; if all are taken, the best again; no originals: 0."""
    if not len(original):
        return [0] * len(filtered)
    out, used, done = np.zeros(len(filtered), int), np.zeros(len(original), bool), 0

    def of_all(low: int, high: int) -> None:
        for at in range(low, high):
            score = box_iou(filtered[at : at + 1], original)[0]
            score = np.where(np.isnan(score), -np.inf, score)
            free = np.flatnonzero(~used)
            out[at] = free[score[free].argmax()] if len(free) else score.argmax()
            used[out[at]] = True

    for i, j, score in near.overlapping(filtered, original, NEAREST):
        order = np.lexsort((j, -score, i))
        for at, others in near.of_each(i[order], j[order]):
            of_all(done, at)
            free = others[~used[others]]
            if len(free):
                out[at] = free[0]
                used[free[0]] = True
            else:
                of_all(at, at + 1)
            done = at + 1
    of_all(done, len(filtered))
    return out.tolist()


def one_by_one(edges: pd.DataFrame) -> pd.DataFrame:
    """Edges (clip_id, a, b, a_end, cost) of a clip to those taken in the order (a_end, a, cost, b): of free ends only."""
    order = np.lexsort([edges[c].to_numpy() for c in ("b", "cost", "a", "a_end")])
    tails: set[int] = set()
    heads: set[int] = set()
    taken = []
    a, b = edges["a"].to_numpy().tolist(), edges["b"].to_numpy().tolist()
    for i in order.tolist():
        if a[i] not in tails and b[i] not in heads:
            tails.add(a[i])
            heads.add(b[i])
            taken.append(i)
    return edges.iloc[taken][["clip_id", "a", "b"]]


#: Rounds of the matching in one job, and jumps to the root.
ROUNDS, JUMPS = 4, 2
#: Undecided edges of all clips together up to which one task a clip decides them (40 bytes an edge); more go on in rounds.
FINISH_EDGES = BROADCAST_BYTES // 40
_ALIVE, _SETTLED, _GONE = 0, 1, 2


def _round(edges: DataFrame) -> DataFrame:
    """One round over edges (clip_id, a, b, a_end, cost, state): each tail asks the best head that hasn't refused it, and
    each head refuses all tails that come after the first that asks it, whether they have asked yet or not.

    asks: the tail's choice; died: refused in this round. A tail that no earlier tail can put out any more is settled
    and its other edges go. Windows are by a track and its clip, so only the edges of a track meet.
    """
    tail, head = Window.partitionBy("clip_id", "a"), Window.partitionBy("clip_id", "b")
    alive, rank, choice = F.col("state") == _ALIVE, F.struct("a_end", "a"), F.struct("cost", "b")
    rows = edges.withColumn("done", F.max(F.col("state") == _SETTLED).over(tail))
    rows = rows.withColumn("state", F.when(alive & F.col("done"), _GONE).otherwise(F.col("state")))
    rows = rows.withColumn("best", F.min(F.when(alive, choice)).over(tail)).withColumn("asks", F.coalesce(alive & (choice == F.col("best")), F.lit(False)))
    rows = rows.withColumn("first", F.min(F.when(F.col("asks"), rank)).over(head)).withColumn("least", F.min(F.when(alive, rank)).over(head))
    rows = rows.withColumn("died", F.coalesce(alive & (rank > F.col("first")), F.lit(False)))
    settled = F.col("asks") & (rank == F.col("least"))
    state = F.when(F.col("died"), _GONE).when(settled, _SETTLED).otherwise(F.col("state"))
    return rows.select("clip_id", "a", "b", "a_end", "cost", state.alias("state"), "asks", "died")


def matched_edges(candidates: DataFrame, finish: int = FINISH_EDGES) -> tuple[DataFrame, list[int]]:
    """The edges (clip_id, a, b) that taking edges one by one in the order (a_end, a, cost, b) takes, where each track has
    one successor and one predecessor at most; and the number of undecided edges at first and after each job.

    Taking tails in order, each its best free head, is the one stable matching of tails that prefer heads by (cost, b) with
    heads that all prefer tails by (a_end, a). All tails may therefore ask at once and ask again when refused, in any
    order, with the same result; when a round refuses none, all choices stand. Nothing is grouped by clip, and a dense clip
    takes some tens of rounds where the order of tails alone has as many steps as it has tails. Once no more than `finish`
    edges are undecided, counted, they are decided one by one. Of repeated edges the one with the least end and cost
    counts; edges need an end and a cost.
    """
    edges = candidates.groupBy("clip_id", "a", "b").agg(F.min("a_end").alias("a_end"), F.min("cost").alias("cost"))
    left = materialize(edges.withColumn("state", F.lit(_ALIVE)), "edges")
    counts, sure = [left.count()], []
    while counts[-1] > finish:
        for _ in range(ROUNDS):
            left = _round(left)
        left = left.withColumn("done", F.max(F.col("state") == _SETTLED).over(Window.partitionBy("clip_id", "a")))
        part = materialize(left.filter(f"state = {_SETTLED} OR died OR (state = {_ALIVE} AND NOT done)").drop("done"), "edges")
        undecided, died = part.agg(F.count_if(F.col("state") == _ALIVE), F.count_if("died")).first()
        sure.append(part.filter(f"state = {_SETTLED}" if died else f"state = {_SETTLED} OR (state = {_ALIVE} AND asks)"))
        counts.append(undecided if died else 0)
        left = part.filter(f"state = {_ALIVE}").drop("asks", "died")
    taken = [rows.select("clip_id", "a", "b") for rows in sure]
    if counts[-1]:
        kind = left.select("clip_id", "a", "b").schema
        taken.append(left.drop("state").groupBy("clip_id").applyInPandas(one_by_one, kind))
    return reduce(DataFrame.union, taken or [left.select("clip_id", "a", "b")]), counts


#: Tails of a frame that are decided together, and candidates of a tail that are held at once.
TAILS, HELD = 1 << 12, 64
#: Heads that the first circle around a tail has on average, over all frames that it can reach.
AROUND = 24


def takers(tails: dict[str, np.ndarray], heads: dict[str, np.ndarray], max_gap: int, max_dist: float, ab_weight: float, most: int = near.PAIRS) -> np.ndarray:
    """For each of a frame's tails, in order, the number of the head that it takes, or -1: of its candidates among the
    heads, as relational.stitch_candidates has them, that no tail before it takes, the one of least (cost, track_id).

    A cost is no less than its distance, so a tail looks around itself as far as the heads that it needs, and farther only
    if earlier tails take all of these. Heads are all those that start in the max_gap frames after the tails' end.
    """
    out, free = np.full(len(tails["end"]), -1), np.ones(len(heads["start"]), bool)
    if not len(out) or not len(free):
        return out
    x, y = heads["head_x"], heads["head_y"]
    sane = np.isfinite(x) & np.isfinite(y)
    if not sane.any():
        return out
    with np.errstate(over="ignore"):
        first = float(np.sqrt(AROUND / np.pi * np.ptp(x[sane]) * np.ptp(y[sane]) / sane.sum()))
    first = min(max_dist, max(first, max_dist / 64)) if ab_weight >= 0 else max_dist
    cells = near.Cells(heads["start"] - tails["end"][0] - 1, max_gap, x, y, first)
    for begin in range(0, len(out), TAILS):
        mine = {c: v[begin : begin + TAILS] for c, v in tails.items()}
        taken, by = _asked(mine, heads, free, cells, first, max_gap, max_dist, ab_weight, most)
        out[begin + by] = taken
        free[taken] = False
    return out


def _asked(t: dict[str, np.ndarray], h: dict[str, np.ndarray], free: np.ndarray, cells: near.Cells, first: float, max_gap: int, max_dist: float, ab_weight: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Heads that are taken, and the numbers of the tails that take them.

    All tails ask their best head at once; a head keeps the first of the tails that ask and refuses the others for good,
    who ask their next (see matched_edges: in whatever order, the result is that of tails in order). A tail that has asked
    all that it holds seeks more: farther on, or as far as before if there were more than HELD.
    """
    n, gaps = len(t["end"]), np.arange(1, max_gap + 1)
    keeps = np.where(free, n, -1)  # the first tail that has asked; n: none; -1: taken before
    reach, more, ways = np.full(n, first), np.zeros(n, bool), [iter(())] * n
    seeking = np.arange(n)
    while len(seeking):
        x, y = (t[f"tail_{c}"][seeking, None] + t[f"v{c}"][seeking, None] * gaps for c in "xy")
        more[seeking] = False
        for i, b in cells.near(x, y, reach[seeking] + relational.SLACK, most):
            i = seeking[i]
            open_to = keeps[b] > i
            i, b = i[open_to], b[open_to]
            gap = h["start"][b] - t["end"][i]
            i, b, _, cost = relational.scored(t, i, h, b, t["tail_x"][i] + t["vx"][i] * gap, t["tail_y"][i] + t["vy"][i] * gap, reach[i], ab_weight)
            sure = (cost <= reach[i]) | (reach[i] >= max_dist)
            i, b, cost = i[sure], b[sure], cost[sure]
            order = np.lexsort((h["track_id"][b], cost, i))
            for at, others in near.of_each(i[order], b[order]):
                ways[at], more[at] = iter(others[:HELD].tolist()), len(others) > HELD
        asking, again = seeking.tolist()[::-1], []
        while asking:
            i = asking.pop()
            for b in ways[i]:
                before = keeps[b]
                if before > i:
                    keeps[b] = i
                    if before < n:
                        asking.append(int(before))
                    break
            else:
                if more[i] or reach[i] < max_dist:
                    again.append(i)
        seeking = np.array(again, int)
        reach[seeking] = np.where(more[seeking], reach[seeking], np.minimum(2 * reach[seeking], max_dist))
    taken = np.flatnonzero((keeps >= 0) & (keeps < n))
    return taken, keeps[taken]


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Scalar, int, pa.Table]]:
    """(clip_id, turn, rows) of each turn of each clip, of rows in that order."""
    rest: list[pa.Table] = []
    last = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        clips = pc.dictionary_encode(rows.column("clip_id").combine_chunks()).indices.to_numpy()
        turns = rows.column("turn").to_numpy()
        begins = [0, *(1 + np.flatnonzero((np.diff(clips) != 0) | (np.diff(turns) != 0))).tolist()] if len(turns) else []
        for low, high in zip(begins, [*begins[1:], len(turns)]):
            key = (rows.column("clip_id")[low], int(turns[low]))
            if rest and key != last:
                yield *last, pa.concat_tables(rest)
                rest = []
            rest.append(rows.slice(low, high - low))
            last = key
    if rest:
        yield *last, pa.concat_tables(rest)


def linked(tracks: DataFrame, max_gap: int = P.max_gap, max_dist: float = P.max_dist, ab_weight: float = P.ab_weight, most: int = near.PAIRS) -> DataFrame:
    """The links (clip_id, a, b, root) of the greedy rule over tracks: matched_edges(stitch_candidates(tracks)), without the
    edges, and the first track of the chain that a link is in.

    The rule takes tails in order, so a clip is one task's, but not as a group: a track is two rows, its head at the turn at
    which tails first reach it and its tail at that of its end, which come sorted by turn. A task holds the
    tails of a turn, the free heads of the max_gap frames after it and the roots of tracks that haven't ended. A track ends
    where it starts or later, so its own link is known when it asks. most: pairs that are compared at once.
    """
    usable = tracks.filter("clip_id IS NOT NULL AND track_id IS NOT NULL")
    null = F.lit(None).cast("double")
    heads = usable.filter("start IS NOT NULL").select(
        "clip_id", (F.col("start") - int(max_gap)).alias("turn"), F.lit(False).alias("is_tail"), "track_id", F.col("start").alias("frame"), F.col("head_x").alias("x"), F.col("head_y").alias("y"), null.alias("vx"), null.alias("vy"), *relational.HEAD[4:]
    )
    tails = usable.filter("end IS NOT NULL").select(
        "clip_id", F.col("end").alias("turn"), F.lit(True).alias("is_tail"), "track_id", F.col("end").alias("frame"), F.col("tail_x").alias("x"), F.col("tail_y").alias("y"), "vx", "vy", *relational.TAIL[6:]
    )
    names = ["clip_id", "a", "b", "root"]
    kind = StructType([tracks.schema["clip_id"], *[StructField(c, LongType()) for c in names[1:]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clip, heads, roots = None, {}, {}
        for of, turn, rows in _turns(batches):
            if of != clip:
                clip, heads, roots = of, {}, {}
            is_tail = rows.column("is_tail")
            new, t = (relational.turned(rows.filter(side), prefix) for side, prefix in ((pc.invert(is_tail), "head"), (is_tail, "tail")))
            heads = {c: np.concatenate([heads[c], v]) for c, v in new.items()} if heads else new
            if not len(t["end"]):
                continue
            reached = heads["start"] > turn
            heads = {c: v[reached] for c, v in heads.items()}
            order = np.argsort(t["track_id"], kind="stable")
            t = {c: v[order] for c, v in t.items()}
            took = takers(t, heads, max_gap, max_dist, ab_weight, most)
            a, links = t["track_id"].tolist(), np.flatnonzero(took >= 0)
            own = [roots.pop(i, i) for i in a]
            b = heads["track_id"][took[links]]
            root = [own[i] for i in links.tolist()]
            roots.update(zip(b.tolist(), root))
            free = np.ones(len(heads["start"]), bool)
            free[took[links]] = False
            heads = {c: v[free] for c, v in heads.items()}
            if len(links):
                clips = pa.repeat(clip, len(links))
                yield pa.RecordBatch.from_arrays([clips, pa.array(t["track_id"][links]), pa.array(b), pa.array(root, pa.int64())], names=names)

    rows = heads.unionByName(tails).repartition("clip_id").sortWithinPartitions("clip_id", "turn")
    return rows.mapInArrow(run, kind)


def continued(tracks: DataFrame, max_gap: int = P.max_gap, max_dist: float = P.max_dist, ab_weight: float = P.ab_weight, most: int = near.PAIRS) -> DataFrame:
    """The links (clip_id, a, b) alone."""
    return linked(tracks, max_gap, max_dist, ab_weight, most).select("clip_id", "a", "b")


def chain_roots(links: DataFrame) -> DataFrame:
    """Links (clip_id, a, b), a before b, without forks, to (clip_id, track_id, stable_id): the first track of b's chain.

    The way up doubles with each jump, so the number of jobs goes with the logarithm of the longest chain.
    """
    ways = materialize(links.select("clip_id", F.col("b").alias("track_id"), F.col("a").alias("stable_id")), "ways")
    while True:
        last = ways
        for _ in range(JUMPS):
            further = ways.select("clip_id", F.col("track_id").alias("stable_id"), F.col("stable_id").alias("up"))
            ways = ways.join(further, ["clip_id", "stable_id"], "left")
            ways = ways.select("clip_id", "track_id", F.coalesce("up", "stable_id").alias("stable_id"))
        ways = materialize(ways, "ways")
        moved = ways.join(last.withColumnRenamed("stable_id", "before"), ["clip_id", "track_id"]).filter("stable_id <> before").limit(1).count()
        discard(last)
        if not moved:
            return ways


def chained(candidates: DataFrame) -> DataFrame:
    """Stable ids of the tracks that continue another: the greedy matching of the candidate edges, then its chains."""
    links, _ = matched_edges(candidates)
    return chain_roots(links)


def chained_tracks(tracks: DataFrame, max_gap: int = P.max_gap, max_dist: float = P.max_dist, ab_weight: float = P.ab_weight) -> DataFrame:
    """The same from the tracks' summaries (see relational.stitch_candidates)."""
    return linked(tracks, max_gap, max_dist, ab_weight).select("clip_id", F.col("b").alias("track_id"), F.col("root").alias("stable_id"))
