"""Joins, filters and set operations over detections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from ..params import P
from . import near


def prefixed(df: DataFrame, prefix: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in df.columns])


def last_row_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key, that with the largest order; an aggregate, not a window."""
    others = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("r")).select(*keys, "r.*")


def _of_frames(left: DataFrame, right: DataFrame, on: list[str], run, kind: StructType) -> DataFrame:
    """run(rows of left, rows of right) of each frame that left has; right rows without a frame belong to none."""
    empty = to_arrow_schema(kind).empty_table()
    return left.groupBy(*on).cogroup(right.dropna(subset=on).groupBy(*on)).applyInArrow(lambda a, b: run(a, b) if a.num_rows else empty, kind)


def _corners(rows: pa.Table, prefix: str) -> np.ndarray:
    return np.column_stack([rows.column(f"{prefix}{c}").cast(pa.float64()).to_numpy() for c in ("x1", "y1", "x2", "y2")])


def best_match(left: DataFrame, right: DataFrame, on: list[str], left_id: str, right_id: str, least: float, mode: str = "plain") -> DataFrame:
    """left rows with the right box of greatest overlap in the same frame (ties: smallest right_id); null if none reaches least (above 0).

    left: on, left_id, a_x1.. ; right: on, right_id, b_x1.. . A frame's rows meet in one task, where only near boxes are
    compared (operators.near): no row is made for a pair, and a box of a coordinate that isn't finite has no match.
    """
    kind = StructType([*[left.schema[c] for c in (*on, left_id)], right.schema[right_id], StructField("iou", DoubleType())])

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        b = b.sort_by(right_id)
        at, score = near.best(_corners(a, "a_"), _corners(b, "b_"), least, mode == "guarded")
        ids = pc.dictionary_encode(a.column(left_id).combine_chunks(), null_encoding="encode").indices.to_numpy()
        order = np.lexsort((at, -score, ids))  # rows of one id are one row
        order = order[np.diff(ids[order], prepend=-1) > 0]
        none = at[order] < 0
        found = b.column(right_id).take(pa.array(at[order], mask=none))
        return pa.table([*[a.column(c).take(order) for c in (*on, left_id)], found, pa.array(score[order], mask=none)], names=[*on, left_id, right_id, "iou"])

    return _of_frames(left, right.filter(F.col(right_id).isNotNull()), on, run, kind)


def overlapping_pairs(boxes: DataFrame, on: list[str], least: float) -> DataFrame:
    """Pairs a_id < b_id of boxes of a frame whose overlap is more than least (above 0); boxes: on, id, x1.. .

    A frame's boxes meet in one task, which hands on its pairs some at a time.
    """
    kind = StructType([*[boxes.schema[c] for c in on], StructField("a_id", boxes.schema["id"].dataType), StructField("b_id", boxes.schema["id"].dataType), StructField("iou", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).sort_by("id")
        box, ids = _corners(rows, ""), rows.column("id").combine_chunks()
        _, rank = np.unique(ids.to_numpy(zero_copy_only=False), return_inverse=True)
        for i, j, score in near.overlapping(box, box, least):
            kept = (rank[i] < rank[j]) & (score > least)
            i, j = i[kept], j[kept]
            if len(i):
                yield pa.RecordBatch.from_arrays([*[rows.column(c).combine_chunks().take(i) for c in on], ids.take(i), ids.take(j), pa.array(score[kept])], names=[*on, "a_id", "b_id", "iou"])

    return boxes.dropna(subset=[*on, "id"]).groupBy(*on).applyInArrow(run, kind)


def helmet_hits(det: DataFrame, helmets: DataFrame, on: list[str], det_id: str, least: float = P.helmet_hit_iou) -> DataFrame:
    """Helmet boxes that overlap each detection by least (above 0) or more; none: 0."""
    kind = StructType([*[det.schema[c] for c in (*on, det_id)], StructField("hits", LongType())])

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        hits = np.zeros(a.num_rows, np.int64)
        for i, _, _ in near.overlapping(_corners(a, "a_"), _corners(b, "b_"), least, guarded=True):
            hits += np.bincount(i, minlength=len(hits))
        return a.select([*on, det_id]).append_column("hits", pa.array(hits)).group_by([*on, det_id]).aggregate([("hits", "sum")]).rename_columns([*on, det_id, "hits"])

    return _of_frames(det, helmets, on, run, kind)


def helmet_confirmed(det: DataFrame, helmets: DataFrame, on: list[str], det_id: str, head: float = P.head_roi) -> DataFrame:
    """(det_id, confirmed): whether a detection's upper part, a pixel high at least, has the centre of a helmet box of its frame."""
    kind = StructType([det.schema[det_id], StructField("confirmed", BooleanType())])

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        box, other = _corners(a, "a_"), _corners(b, "b_")
        x, y, end = (other[:, 0] + other[:, 2]) / 2, (other[:, 1] + other[:, 3]) / 2, box[:, 1] + np.fmax(1.0, head * (box[:, 3] - box[:, 1]))
        found = np.zeros(a.num_rows, bool)
        strip = np.median(end - box[:, 1]) / 2
        for i, j in near.Points(x, y, float(strip)).near(box[:, 0], box[:, 2], box[:, 1], end):
            found[i[(y[j] >= box[i, 1]) & (y[j] <= end[i])]] = True
        return pa.table([a.column(det_id), pa.array(found)], names=[det_id, "confirmed"])

    return _of_frames(det, helmets, on, run, kind).groupBy(det_id).agg(F.max("confirmed").alias("confirmed"))


def segments(det: DataFrame) -> DataFrame:
    """clip_id, segment, start, end: runs of frames between cut frames; a cut at the first frame begins no new one."""
    frames = det.groupBy("clip_id", "frame").agg(F.max(F.col("is_cut_frame").cast("int")).alias("cut"))
    clip = Window.partitionBy("clip_id").orderBy("frame")
    marked = frames.withColumn("first", F.min("frame").over(Window.partitionBy("clip_id")))
    numbered = marked.withColumn("segment", F.sum(F.when((F.col("cut") == 1) & (F.col("frame") > F.col("first")), 1).otherwise(0)).over(clip))
    spans = numbered.groupBy("clip_id", "segment").agg(F.min("frame").alias("start"), F.max("frame").alias("last"))
    following = F.lead("start").over(Window.partitionBy("clip_id").orderBy("segment"))
    return spans.select("clip_id", "segment", "start", F.coalesce(following - 1, "last").alias("end"))


def of_segment(det: DataFrame) -> DataFrame:
    """det with its segment number: a running count of cut frames instead of a range join."""
    frames = det.groupBy("clip_id", "frame").agg(F.max(F.col("is_cut_frame").cast("int")).alias("cut"))
    marked = frames.withColumn("first", F.min("frame").over(Window.partitionBy("clip_id")))
    clip = Window.partitionBy("clip_id").orderBy("frame")
    numbered = marked.withColumn("segment", F.sum(F.when((F.col("cut") == 1) & (F.col("frame") > F.col("first")), 1).otherwise(0)).over(clip))
    return det.join(numbered.select("clip_id", "frame", "segment"), ["clip_id", "frame"])


#: Frames of a slot in which heads and tails meet, and what is added around a foot for rounding.
SLOT, SLACK = 10, 1e-3
TAIL = ["track_id", "end", "tail_x", "tail_y", "vx", "vy", "team", "ocr", "ab_a", "ab_b"]
HEAD = ["track_id", "start", "head_x", "head_y", "team", "ocr", "ab_a", "ab_b"]


def as_arrays(rows: pa.Table, columns: list[str]) -> dict[str, np.ndarray]:
    """Columns as numbers: frames and ids as integers, others as doubles with NaN for null."""
    whole = {"track_id", "start", "end"}
    return {c: rows.column(c).cast(pa.int64() if c in whole else pa.float64()).to_numpy() for c in columns}


def turned(rows: pa.Table, side: str) -> dict[str, np.ndarray]:
    """Rows with frame, x, y and the other columns of heads or tails as the arrays of that side."""
    names = {"start": "frame", "end": "frame", **{f"{side}_{c}": c for c in "xy"}}
    columns = TAIL if side == "tail" else HEAD
    found = rows.select([names.get(c, c) for c in columns]).rename_columns(columns)
    return as_arrays(found, columns)


def scored(tails: dict[str, np.ndarray], i: np.ndarray, heads: dict[str, np.ndarray], b: np.ndarray, x: np.ndarray, y: np.ndarray, max_dist: float | np.ndarray, ab_weight: float) -> tuple[np.ndarray, ...]:
    """Those of the pairs (tail i, head b) that may continue, with distance and cost; x, y: where the tail of each would be."""
    dx, dy = x - heads["head_x"][b], y - heads["head_y"][b]
    dist = np.sqrt(dx * dx + dy * dy)
    fits = dist <= max_dist
    i, b, dist = i[fits], b[fits], dist[fits]
    ours, theirs, n, m = tails["team"][i], heads["team"][b], tails["ocr"][i], heads["ocr"][b]
    fits = ((ours < 0) | (theirs < 0) | (ours == theirs)) & ~((n != m) & ~np.isnan(n) & ~np.isnan(m))
    i, b, dist = i[fits], b[fits], dist[fits]
    da, db = tails["ab_a"][i] - heads["ab_a"][b], tails["ab_b"][i] - heads["ab_b"][b]
    colour = np.sqrt(da * da + db * db)
    return i, b, dist, dist + ab_weight * np.where(np.isnan(colour), 0.0, colour)


def stitch_candidates(tracks: DataFrame, max_gap: int = P.max_gap, max_dist: float = P.max_dist, ab_weight: float = P.ab_weight) -> DataFrame:
    """(clip_id, a, b, a_end, dist, cost): tracks b that may continue a.

    tracks: clip_id, track_id, start, end, head_x, head_y, tail_x, tail_y, vx, vy, team, ocr, ab_a, ab_b. Heads and tails of a
    clip meet in slots of SLOT frames: a head is in that of its first frame, a tail in those of the max_gap frames after it
    (four of them), so a track is shuffled five times and not once for each cell that it may sweep. In a slot the heads of a
    frame near where a tail would be then are found by operators.near and handed on some at a time. A track without a
    foot, a frame or a velocity has no candidates.
    """
    of = lambda columns, side: [(F.col(c) if c in columns else F.lit(None).cast(tracks.schema[c].dataType)).alias(c) for c in dict.fromkeys(TAIL + HEAD)] + [F.lit(side).alias("is_tail")]
    slots = F.explode(F.expr(f"sequence(floor((end + 1) / {SLOT}), floor((end + {int(max_gap)}) / {SLOT}))")).alias("slot")
    known = tracks.filter("clip_id IS NOT NULL AND track_id IS NOT NULL")
    rows = known.filter("end IS NOT NULL").select("clip_id", slots, *of(TAIL, True)).unionByName(known.filter("start IS NOT NULL").select("clip_id", F.floor(F.col("start") / SLOT).alias("slot"), *of(HEAD, False)))
    names = ["clip_id", "a", "b", "a_end", "dist", "cost"]
    kind = StructType([tracks.schema["clip_id"], *[StructField(c, LongType() if c in ("a", "b", "a_end") else DoubleType()) for c in names[1:]]])
    reach = max_dist + SLACK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = pa.Table.from_batches(list(batches))
        t = as_arrays(met.filter(met.column("is_tail")).sort_by("end"), TAIL)
        h = as_arrays(met.filter(pc.invert(met.column("is_tail"))).sort_by("start"), HEAD)
        for frame in np.unique(h["start"]).tolist():
            first, last = np.searchsorted(h["start"], [frame, frame + 1])
            points = near.Points(h["head_x"][first:last], h["head_y"][first:last], max_dist / 2)
            low, high = np.searchsorted(t["end"], [frame - max_gap, frame])
            mine = {c: v[low:high] for c, v in t.items()}
            gap = frame - mine["end"]
            x, y = mine["tail_x"] + mine["vx"] * gap, mine["tail_y"] + mine["vy"] * gap
            for i, j in points.near(x - reach, x + reach, y - reach, y + reach):
                i, b, dist, cost = scored(mine, i, h, first + j, x[i], y[i], max_dist, ab_weight)
                if len(i):
                    columns = [mine["track_id"][i], h["track_id"][b], mine["end"][i], dist, cost]
                    yield pa.RecordBatch.from_arrays([met.column("clip_id").take(np.zeros(len(i), int)).combine_chunks(), *map(pa.array, columns)], names=names)

    return rows.groupBy("clip_id", "slot").applyInArrow(run, kind)


#: Frames of a key of slow tails.
SWEEP_FRAMES = 5


def head_keys(tracks: DataFrame, cell: float = P.max_dist) -> DataFrame:
    """tracks with `step`, `slot`, `cx`, `cy`: the cell of the first foot, once with its frame and once with its slot of frames."""
    keyed = tracks.withColumn("step", F.explode(F.array(F.lit(1), F.lit(SWEEP_FRAMES))))
    return keyed.withColumn("slot", F.floor(F.col("start") / F.col("step"))).withColumns({f"c{c}": F.floor(F.col(f"head_{c}") / cell) for c in "xy"})


def swept_keys(tracks: DataFrame, max_gap: int = P.max_gap, max_dist: float = P.max_dist, cell: float = P.max_dist) -> DataFrame:
    """tracks with a row for each (`step`, `slot`, `cx`, `cy`) that a continuation's first foot can be in.

    A tail moves on with its velocity; in a slot of frames it sweeps a rectangle, and a head may be max_dist around it.
    Slow tails take slots of SWEEP_FRAMES frames, others single frames, so a tail has some hundred keys at most (30 frames of 9
    cells, or 7 slots of 16), whatever its velocity. A head has one key of either kind, so a pair meets once.
    """
    fast = f"greatest(abs(vx), abs(vy)) * {SWEEP_FRAMES - 1} > {cell}"
    keyed = tracks.withColumn("step", F.expr(f"IF({fast}, 1, {SWEEP_FRAMES})"))
    keyed = keyed.withColumn("slot", F.explode(F.expr(f"sequence(floor((end + 1) / step), floor((end + {max_gap}) / step))")))
    gaps = {"g0": F.expr("greatest(1, slot * step - end)"), "g1": F.expr(f"least({max_gap}, slot * step + step - 1 - end)")}
    keyed = keyed.withColumns(gaps)
    for c in "xy":
        low, high = f"least(v{c} * g0, v{c} * g1) - {max_dist + SLACK}", f"greatest(v{c} * g0, v{c} * g1) + {max_dist + SLACK}"
        keyed = keyed.withColumn(f"c{c}", F.explode(F.expr(f"sequence(floor((tail_{c} + {low}) / {cell}), floor((tail_{c} + {high}) / {cell}))")))
    return keyed.drop("g0", "g1")


_KEYS = ("clip_id", "step", "slot", "cx", "cy")


def met_pairs(tracks: DataFrame, max_gap: int = P.max_gap, max_dist: float = P.max_dist) -> DataFrame:
    """Pairs (a_, b_) of tracks that meet in a key: a join for tracks that are few or far apart (a tail has some hundred keys)."""
    a = prefixed(swept_keys(tracks.drop("head_x", "head_y", "start"), max_gap, max_dist, max_dist), "a_", _KEYS)
    b = prefixed(head_keys(tracks.drop("tail_x", "tail_y", "vx", "vy", "end"), max_dist), "b_", _KEYS)
    return a.join(b, list(_KEYS))


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of the rows of a key the first by order."""
    others = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("r"))
    return first.select(*keys, "r.*")


def stale_keys(det: DataFrame) -> DataFrame:
    """(clip_id, frame, track_id): tracks of the detection frame before that this frame hasn't, whose state goes."""
    seen = det.select("clip_id", "frame", "track_id").distinct()
    following = seen.select("clip_id", "frame").distinct().withColumn("next", F.lead("frame").over(Window.partitionBy("clip_id").orderBy("frame")))
    expected = seen.join(following.filter("next IS NOT NULL"), ["clip_id", "frame"]).select("clip_id", F.col("next").alias("frame"), "track_id")
    return expected.join(seen, ["clip_id", "frame", "track_id"], "left_anti")


def number_conflicts(tracks: DataFrame, group: str, track: str, number: str, other: str | None = None) -> DataFrame:
    """(group, a, b, conflict) of each two tracks of a group that follow one another by id: both have a number and these differ.

    other: the column that holds the following track's number, if another reading is compared. A group of n tracks has
    n - 1 candidates, so a hot one isn't squared. Null numbers don't conflict; tracks without an id are left out; rows of
    one id count one after the other, by number.
    """
    order = Window.partitionBy(group).orderBy(track, number)
    rows = tracks.filter(F.col(track).isNotNull()).select(group, F.col(track).alias("a"), F.lead(track).over(order).alias("b"), F.col(number).alias("n"), F.lead(other or number).over(order).alias("m"))
    return rows.filter("b IS NOT NULL").select(group, "a", "b", F.coalesce(F.col("n") != F.col("m"), F.lit(False)).alias("conflict"))


def conflicting_pairs(tracks: DataFrame, group: str, track: str, number: str, other: str | None = None) -> DataFrame:
    """(group, a, b) of all two tracks a < b of a group that both have a number, where these differ.

    other: the column of b's number, if another reading is compared. An equi-join by group on which only pairs in conflict
    are kept; tracks without a group or a number have none and don't take part.
    """
    side = lambda name, n: tracks.filter(F.col(n).isNotNull()).select(group, F.col(track).alias(name), F.col(n).alias(f"{name}_number"))
    return side("a", number).join(side("b", other or number), group).filter("a < b AND a_number <> b_number").select(group, "a", "b")
