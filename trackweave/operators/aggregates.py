"""Aggregations: gate figures, votes, track summaries, route and label metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import FOOT_X, FOOT_Y, GATE_FP
from ..params import P


def per_frame(det: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Tracks and rows of each frame; by: the clip's columns, for a table of many clips."""
    return det.groupBy(*by, "frame").agg(F.count_distinct("track_id").alias("n"), F.count("*").alias("rows"))


def _beside(left: DataFrame, right: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Figures side by side: a row a clip, or one row each; clips that only the left has keep nulls."""
    return left.join(right, list(by), "left") if by else left.join(right, F.lit(True))


def gate_figures(det: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row, or one for each clip: rows, frames, median detections a frame, unique tracks, fallback rate, fp rate."""
    frames = per_frame(det, by).groupBy(*by).agg(F.median("n").alias("median_det"), F.count("*").alias("frames"))
    rows = det.groupBy(*by).agg(
        F.count("*").alias("n_rows"),
        F.count_distinct("track_id").alias("unique_tracks"),
        F.avg(F.col("mask_is_fallback").cast("double")).alias("fallback_rate"),
        (F.count_if(F.expr(GATE_FP)) / F.greatest(F.lit(1), F.count("*"))).alias("fp_rate"),
    )
    return _beside(rows, frames, by)


def _keys(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def mode_vote(rows: DataFrame, key: str | list[str], label: str, out: str = "team") -> DataFrame:
    """The label that most rows of a key have; ties: the smallest."""
    return rows.filter(F.col(label).isNotNull()).groupBy(*_keys(key)).agg(F.mode(label, True).alias(out))


def number_vote(det: DataFrame, key: str | list[str] = "track_id", least: float = P.ocr_min) -> DataFrame:
    """The number with the most confidence of a key (ties: seen first); keys without a vote have null."""
    keys = _keys(key)
    voted = det.withColumn("num", F.expr(f"CASE WHEN ocr_conf >= {least} AND ocr_num BETWEEN 0 AND 99 THEN ocr_num END"))
    votes = voted.groupBy(*keys, "num").agg(F.round(F.sum("ocr_conf"), 6).alias("s"), F.min(F.struct("frame", "event_id")).alias("seen"))
    rank = F.when(F.col("num").isNotNull(), F.struct("s", -F.col("seen.frame"), -F.col("seen.event_id")))
    return votes.groupBy(*keys).agg(F.max_by("num", rank).alias("jersey_number"))


def track_summary(det: DataFrame) -> DataFrame:
    """One row a track: first and last frame, foot at both, velocity of the last two rows, team, number, median colour.

    One shuffle by track: the row before is a lag over the rows that the aggregate then reads.
    """
    key = ["clip_id", "track_id"]
    order = Window.partitionBy(*key).orderBy("frame")
    foot = det.select(
        *key, "frame", F.expr(FOOT_X).alias("fx"), F.expr(FOOT_Y).alias("fy"), "feat_a", "feat_b", F.expr("CASE WHEN team >= 0 THEN team END").alias("team"),
        F.expr(f"CASE WHEN ocr_conf >= {P.ocr_min} THEN ocr_num END").alias("ocr"),
    )
    foot = foot.withColumns({f"p{c}": F.lag(c).over(order) for c in ("frame", "fx", "fy")})
    step = F.greatest(F.lit(1), F.col("l.frame") - F.col("l.pframe"))
    rows = foot.groupBy(*key).agg(
        F.min("frame").alias("start"),
        F.max("frame").alias("end"),
        F.min_by(F.struct("fx", "fy"), "frame").alias("head"),
        F.max_by(F.struct("frame", "fx", "fy", "pframe", "pfx", "pfy"), "frame").alias("l"),
        F.mode("team", True).alias("team"),
        F.mode("ocr", True).alias("ocr"),
        F.median("feat_a").alias("ab_a"),
        F.median("feat_b").alias("ab_b"),
    )
    return rows.select(
        *key, "start", "end", F.col("head.fx").alias("head_x"), F.col("head.fy").alias("head_y"), F.col("l.fx").alias("tail_x"), F.col("l.fy").alias("tail_y"),
        *[F.when(F.col("l.pframe").isNotNull(), (F.col(f"l.f{c}") - F.col(f"l.pf{c}")) / step).otherwise(0.0).alias(f"v{c}") for c in "xy"],
        F.coalesce("team", F.lit(-1)).alias("team"), "ocr", "ab_a", "ab_b",
    )


def route_metrics(det: DataFrame, annotations: DataFrame | None = None, key: str = "track_id", by: tuple[str, ...] = ()) -> DataFrame:
    """One row, or one for each clip (by: its columns, which annotations have too): completeness, fragmentation, id
    switches, team accuracy (null without labels). Frames and tracks of different clips are different."""
    spans = det.groupBy(*by, key).agg(F.count_distinct("frame").alias("n"), (F.max("frame") - F.min("frame") + 1).alias("span"))
    complete = spans.groupBy(*by).agg(F.coalesce(F.avg(F.col("n") / F.greatest(F.lit(1), "span")), F.lit(0.0)).alias("completeness"), F.count("*").alias("tracks"))
    frames = det.groupBy(*by, "frame").agg(F.count_distinct(key).alias("n")).groupBy(*by).agg(F.coalesce(F.median("n"), F.lit(0.0)).alias("m"))
    before = F.lag("frame").over(Window.partitionBy(*by, key).orderBy("frame"))
    switches = det.select(*by, key, "frame").distinct().withColumn("gap", F.col("frame") - before).groupBy(*by).agg(F.count_if(F.col("gap") > 1).alias("id_switches"))
    out = _beside(_beside(complete, frames, by), switches, by)
    if annotations is None:
        accuracy = F.lit(None).cast("double").alias("team_accuracy")
    else:
        out = _beside(out, team_accuracy(det, annotations, by).select(*by, "team_accuracy"), by)
        accuracy = F.col("team_accuracy")
    return out.select(
        *by,
        "completeness",
        F.when(F.col("tracks") > 0, F.greatest(F.lit(0.0), F.col("tracks") / F.greatest(F.lit(1.0), "m") - 1)).otherwise(0.0).alias("fragmentation"),
        "id_switches",
        accuracy,
    )


def team_accuracy(det: DataFrame, annotations: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row, or one for each clip: matched annotations, right ones, and their share."""
    last = det.groupBy(*by, "frame", "track_id").agg(F.max_by("team", "event_id").alias("team"))
    joined = annotations.join(last, [*by, "frame", "track_id"])
    right = F.count_if(F.col("team") == F.col("correct_team"))
    return joined.groupBy(*by).agg(F.count("*").alias("n"), right.alias("n_right"), F.when(F.count("*") > 0, right / F.count("*")).alias("team_accuracy"))


def bucket_counts(rows: DataFrame, bucket: str) -> DataFrame:
    """Rows of each bucket and their share in percent."""
    counts = rows.groupBy(F.expr(bucket).alias("bucket")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(total, F.lit(True)).select("bucket", "n", (100.0 * F.col("n") / F.col("total")).alias("pct"))  # one row


def churn(det: DataFrame) -> DataFrame:
    """One row: tracks that weren't in the detection frame before, over frames; a track that comes back counts again."""
    frames = det.select("clip_id", "frame").distinct()
    previous = frames.withColumn("before", F.lag("frame").over(Window.partitionBy("clip_id").orderBy("frame")))
    seen = det.select("clip_id", "frame", "track_id").distinct()
    last = seen.withColumn("own", F.lag("frame").over(Window.partitionBy("clip_id", "track_id").orderBy("frame"))).join(previous, ["clip_id", "frame"])
    new = F.count_if(F.col("own").isNull() | F.col("before").isNull() | (F.col("own") != F.col("before")))
    n = F.count_distinct("clip_id", "frame")
    return last.agg(new.alias("new_ids"), n.alias("frames"), (new / n).alias("churn"))


def label_flips(rows: DataFrame) -> DataFrame:
    """One row: changes of a track's locked label over tracks that were ever locked; rows: frame, track_id, label, locked."""
    locked = rows.filter("locked AND label IN (0, 1)")
    before = F.lag("label").over(Window.partitionBy("track_id").orderBy("frame"))
    flips = locked.withColumn("before", before)
    return flips.agg(
        F.count_if(F.col("before") != F.col("label")).alias("flips"),
        F.count_distinct("track_id").alias("tracks"),
        (F.count_if(F.col("before") != F.col("label")) / F.greatest(F.lit(1), F.count_distinct("track_id"))).alias("flip_rate"),
    )


HUE = "(CASE WHEN atan2(s, c) < -1e-9 THEN atan2(s, c) + 2 * pi() ELSE abs(atan2(s, c)) END) * 90 / pi()"
HUE_STD = "sqrt(greatest(0.0, -2 * ln(least(1.0, greatest(1e-9, sqrt(s * s + c * c)))))) * 90 / pi()"


def pixel_stats(pixels: DataFrame, key: str, least: int = 10) -> DataFrame:
    """Colour feature of each key from its mask's pixels (a, b, h): means, population deviations, circular hue in [0, 180).

    Keys of fewer than `least` pixels have a row of nulls; keys without pixels have none.
    """
    rows = pixels.groupBy(key).agg(
        F.count("*").alias("n"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.stddev_pop("a").alias("std_a"), F.stddev_pop("b").alias("std_b"),
        F.expr("avg(cos(h * pi() / 90))").alias("c"), F.expr("avg(sin(h * pi() / 90))").alias("s"),
    )
    rows = rows.withColumns({"hue": F.expr(HUE), "hue_std": F.expr(HUE_STD)})
    return rows.select(key, "n", *[F.when(F.col("n") >= least, F.col(c)).alias(c) for c in ("mean_a", "mean_b", "std_a", "std_b", "hue", "hue_std")])


# Green in hue, saturation and value, and the centre of an image as shares of its rows and columns.
GREEN = "h BETWEEN 35 AND 85 AND s >= 40 AND v >= 40"
CENTRE_ROWS, CENTRE_COLUMNS = (0.35, 0.85), (0.10, 0.90)


def centre(height: int, width: int) -> str:
    (y0, y1), (x0, x1) = CENTRE_ROWS, CENTRE_COLUMNS
    return f"y >= {int(height * y0)} AND y < {int(height * y1)} AND x >= {int(width * x0)} AND x < {int(width * x1)}"


def green_fraction(pixels: DataFrame, key: str, height: int, width: int) -> DataFrame:
    """Share of green pixels (x, y, h, s, v) in the centre of each image; images without pixels there have no row."""
    return pixels.filter(centre(height, width)).groupBy(key).agg((F.count_if(F.expr(GREEN)) / F.count("*")).alias("green"))


def frame_difference(frames: DataFrame, pixels: str = "pixels") -> DataFrame:
    """frames (clip_id, frame, pixels) with mad: mean absolute difference to the frame before; null at the first and where sizes differ."""
    before = F.lag(pixels).over(Window.partitionBy("clip_id").orderBy("frame"))
    diff = F.expr(f"aggregate(zip_with({pixels}, before, (a, b) -> abs(a - b)), 0D, (t, d) -> t + d) / size({pixels})")
    rows = frames.withColumn("before", before)
    return rows.withColumn("mad", F.when(F.size(pixels) == F.size("before"), diff)).drop("before")


def line_up_split(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Exact 2-means of each key's numbers by prefix sums: size of the lower group and squared error; keys of one row have none."""
    run = Window.partitionBy(key).orderBy(value, order).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(key)
    v = F.col(value)
    sums = rows.select(
        key, F.count("*").over(run).alias("n"), F.sum(v).over(run).alias("s"), F.sum(v * v).over(run).alias("q"),
        F.count("*").over(whole).alias("tn"), F.sum(v).over(whole).alias("ts"), F.sum(v * v).over(whole).alias("tq"),
    )
    cost = F.expr("(q - s * s / n) + ((tq - q) - (ts - s) * (ts - s) / (tn - n))")
    return sums.filter("n < tn").withColumn("cost", F.round(cost, 4)).groupBy(key).agg(F.min(F.struct("cost", "n")).alias("b")).select(key, F.col("b.n").alias("lower"), F.col("b.cost").alias("cost"))
