"""Sequence operators: speed, snap, cuts, holds, islands."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import FOOT_X, FOOT_Y
from ..params import P
from ..tables import small_side


def speeds(det: DataFrame, key: str = "track_id") -> DataFrame:
    """det with the distance of a track's foot from its row before (null at the first); not divided by the frame gap."""
    order = Window.partitionBy("clip_id", key).orderBy("frame")
    rows = det.withColumn("fx", F.expr(FOOT_X)).withColumn("fy", F.expr(FOOT_Y))
    dx, dy = F.col("fx") - F.lag("fx").over(order), F.col("fy") - F.lag("fy").over(order)
    return rows.withColumn("speed", F.sqrt(dx * dx + dy * dy))


def frame_speed(det: DataFrame, key: str = "track_id") -> DataFrame:
    """clip_id, frame, speed: median over tracks; frames without any count as 0."""
    return speeds(det, key).groupBy("clip_id", "frame").agg(F.coalesce(F.median("speed"), F.lit(0.0)).alias("speed"))


def baseline(frames: DataFrame, rows: int = P.quiet_rows) -> DataFrame:
    """frames with pos (from 0) and the median speed of the last `rows` frames, this one included; 0 until there are so many."""
    order = Window.partitionBy("clip_id").orderBy("frame")
    numbered = frames.withColumn("pos", F.row_number().over(order) - 1)
    trailing = F.expr(f"percentile(speed, 0.5) OVER (PARTITION BY clip_id ORDER BY frame ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)")
    return numbered.withColumn("base", F.when(F.col("pos") >= rows - 1, trailing).otherwise(0.0))


def snap_frame(det: DataFrame, key: str = "track_id", rows: int = P.quiet_rows, factor: float = P.jump_factor) -> DataFrame:
    """clip_id, snap_frame: the first frame whose speed jumps over the baseline, else the first frame."""
    based = baseline(frame_speed(det, key), rows)
    jump = (F.col("pos") >= rows) & (F.col("speed") > factor * F.greatest("base", F.lit(1e-3)))
    return based.groupBy("clip_id").agg(
        F.coalesce(F.when(F.count("*") > rows, F.min(F.when(jump, F.col("frame")))), F.min("frame")).alias("snap_frame")
    )


def trimmed(det: DataFrame, snap: DataFrame, play_len: int = P.play_len) -> DataFrame:
    """Rows from the snap to play_len frames after it, both inclusive, with t_from_snap; one row of snap a clip."""
    rows = det.join(small_side(snap, snap.count(), 64), "clip_id").withColumn("t_from_snap", F.col("frame") - F.col("snap_frame"))
    return rows.filter(F.col("t_from_snap").between(0, play_len)).drop("snap_frame")


def cut_flags(frames: DataFrame, high: float = P.cut_mad) -> DataFrame:
    """frames (clip_id, frame, mad) with is_cut: every second frame of a run of high differences."""
    order = Window.partitionBy("clip_id").orderBy("frame")
    is_high = F.col("mad") > high
    rows = frames.withColumn("high", F.coalesce(is_high, F.lit(False)))
    rows = rows.withColumn("island", F.sum(F.when(F.col("high"), 0).otherwise(1)).over(order))
    run = F.sum(F.when(F.col("high"), 1).otherwise(0)).over(Window.partitionBy("clip_id", "island").orderBy("frame"))
    return rows.withColumn("is_cut", F.col("high") & (run % 2 == 0)).drop("island")


def held_extent(frames: DataFrame, hold: int = P.hold) -> DataFrame:
    """Smallest top and largest bottom of the mask over the last frames; missing frames are skipped."""
    order = Window.partitionBy("clip_id").orderBy("frame").rangeBetween(-hold, 0)
    return frames.withColumn("held_top", F.min("mask_top").over(order)).withColumn("held_bottom", F.max("mask_bottom").over(order))


def islands(det: DataFrame) -> DataFrame:
    """det with `island`: a number for each run of consecutive frames of a track."""
    order = Window.partitionBy("clip_id", "track_id").orderBy("frame")
    broken = F.when(F.col("frame") - F.lag("frame").over(order) == 1, 0).otherwise(1)
    return det.withColumn("brk", broken).withColumn("island", F.sum("brk").over(order)).drop("brk")


def smoothed(det: DataFrame, alpha: float = P.ema) -> DataFrame:
    """Exponential mean of x1 and y1 along each island, cut towards zero.

    A fold over the last rows of the island, so many that a row before them weighs less than a double's last digit.
    """
    rows = islands(det)
    reach = math.ceil(-40 / math.log(1 - alpha)) if alpha < 1 else 1
    last = Window.partitionBy("clip_id", "track_id", "island").orderBy("frame").rowsBetween(-reach, 0)
    fold = lambda c: (
        f"aggregate(slice(transform(h, e -> e.{c}), 2, size(h)), h[0].{c}, (acc, x) -> {alpha} * x + {1 - alpha} * acc)"
    )
    upto = rows.withColumn("h", F.collect_list(F.struct("x1", "y1")).over(last))
    return upto.withColumn("sx1", F.expr(fold("x1")).cast("long")).withColumn("sy1", F.expr(fold("y1")).cast("long")).drop("h")


def majority(rows: DataFrame, key: str, order: list[str], label: str = "label", last: int = P.vote_window) -> DataFrame:
    """rows with `voted`: of labels 0 and 1 the more frequent among a key's last rows, this one included; tie: the oldest of them."""
    span = Window.partitionBy(key).orderBy(*order).rowsBetween(1 - last, 0)
    balance = F.sum(2 * F.col(label) - 1).over(span)
    return rows.withColumn("voted", F.when(balance > 0, 1).when(balance < 0, 0).otherwise(F.first(label).over(span)).cast("int"))


def tail(rows: DataFrame, key: str, order: list, n: int) -> DataFrame:
    """The n rows of each key that come first by order."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rn") <= n).drop("rn")


def registration(frames: DataFrame, least: int = 3) -> DataFrame:
    """frames (clip_id, frame, fit_ok) with streak (one up for a good fit, one down for a bad or unknown one, never below 0) and valid.

    A walk that is held at 0 is the free walk less its smallest value so far, so no state is needed.
    """
    order = Window.partitionBy("clip_id").orderBy("frame")
    walk = frames.withColumn("walk", F.sum(F.when(F.col("fit_ok"), 1).otherwise(-1)).over(order))
    streak = F.col("walk") - F.least(F.lit(0), F.min("walk").over(order))
    return walk.withColumn("streak", streak).drop("walk").withColumn("valid", F.col("streak") >= least)


def countdown(frames: DataFrame, event: str, ticks: int = 60) -> DataFrame:
    """frames with `left`: ticks (rows) a message still shows after the last event, which begins anew at each event."""
    order = Window.partitionBy("clip_id").orderBy("frame")
    at = frames.withColumn("pos", F.row_number().over(order))
    at = at.withColumn("since", F.col("pos") - F.max(F.when(F.expr(event), F.col("pos"))).over(order))
    return at.withColumn("left", F.coalesce(F.greatest(F.lit(0), ticks - F.col("since")), F.lit(0))).drop("pos", "since")


def refreshed(frames: DataFrame, updated: str, every: int = 30) -> DataFrame:
    """frames with `refresh`: the first of a clip, each update, and each `every` rows since the last of these."""
    order = Window.partitionBy("clip_id").orderBy("frame")
    at = frames.withColumn("pos", F.row_number().over(order) - 1)
    base = F.coalesce(F.max(F.when(F.expr(updated), F.col("pos"))).over(order), F.lit(0))
    return at.withColumn("refresh", (F.col("pos") - base) % every == 0).drop("pos")


def initialised(frames: DataFrame, qualifies: str, least: int = 30, every: int = 300) -> DataFrame:
    """frames with `ready` (enough frames that qualify, this one included) and `blend` (each `every` rows after that)."""
    order = Window.partitionBy("clip_id").orderBy("frame")
    at = frames.withColumn("ready", F.sum(F.when(F.expr(qualifies), 1).otherwise(0)).over(order) >= least)
    after = F.sum(F.when(F.col("ready"), 1).otherwise(0)).over(order) - 1
    return at.withColumn("after", after).withColumn("blend", F.col("ready") & (F.col("after") > 0) & (F.col("after") % every == 0)).drop("after")


def interpolated(det: DataFrame, flow: DataFrame, every: int) -> DataFrame:
    """Boxes of every frame of flow (clip_id, frame, dx, dy): those of the last detected frame, moved by the frame's own flow.

    Detection runs on each frame that `every` divides, where frame_age is 0 and nothing moves; elsewhere it is 1.
    """
    base = flow.withColumn("base", F.col("frame") - F.col("frame") % every).withColumn("frame_age", F.when(F.col("frame") == F.col("base"), 0).otherwise(1))
    seen = det.filter(F.col("frame") % every == 0).withColumnRenamed("frame", "base")
    rows = base.join(seen, ["clip_id", "base"])
    moved = {c: F.col(c) + F.when(F.col("frame_age") == 1, F.col(d)).otherwise(0.0) for c, d in (("x1", "dx"), ("y1", "dy"), ("x2", "dx"), ("y2", "dy"))}
    return rows.withColumns(moved).drop("base", "dx", "dy")
