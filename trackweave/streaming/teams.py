"""Team labels online: warm-up samples, calibration, line-up calibration, locked classification, and their figures.

One step a frame over a plain dictionary, as in the online path; the same dictionary is the state of a stream. Rows
carry a torso's colour feature (null where it can't be measured), so pixels stay outside. Once locked the margins of a
locked clip hold, whichever way it locked.
"""

from __future__ import annotations

import itertools
import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.clustering import FEATURES, scaler, spatial_lock, split_1d, two_means
from ..params import P, Params
from .online import in_order, margins, vote
from .online import crowded as is_crowded

# Operating points of warm-up and calibration.
SAMPLES, CAP, PER_TRACK, MIN_TRACKS = 35, 70, 3, 8
RELAX_AT, ALL_RELAXED_AT, RELAXED_TRACKS = 600, 1200, 6
TIMEOUT, TIMEOUT_SAMPLES = 1500, 20
COOLDOWN, NEW_SAMPLES, MAX_FAILS, LOWER_DISTANCE = 150, 15, 3, 1.0
LINE_UP_EVERY, LINE_UP_CONF, LINE_UP_HEIGHT = 15, 0.35, 533.0
POST_CUT, MESSAGE = 60, 60
CONF, CONF_HELMET, CONF_RELAXED, RELAX_FAILS = 0.45, 0.30, 0.38, 2
MIN_MASK, MIN_UPPER, MIN_FIELD = 400, 50, 0.25

OUTPUT = "clip_id string, frame long, track_id long, state string, label int, reason string, message int"


def new_state() -> dict:
    return {
        "mode": "warmup", "ticks": 0, "tracks_needed": MIN_TRACKS, "samples": [], "attempted": 0, "cooldown": 0, "fails": 0,
        "least": P.centroid_min, "model": None, "votes": {}, "given": {}, "post_cut": 0, "message": 0, "frame": None,
    }


def refused(state: dict, det: dict) -> str | None:
    """Why a detection is no warm-up sample, or None."""
    least = CONF_HELMET if det["helmet"] else CONF_RELAXED if state["fails"] >= RELAX_FAILS else CONF
    checks = (
        ("low_conf", det["conf"] < least),
        ("small_mask", det["torso_px"] < MIN_MASK),
        ("few_upper_pixels", det["upper_px"] < MIN_UPPER),
        ("not_on_field", not det["helmet"] and det["field_overlap"] is not None and det["field_overlap"] < MIN_FIELD),
        ("track_cap", sum(s[2] == det["track_id"] for s in state["samples"]) >= PER_TRACK),
    )
    return next((name for name, hit in checks if hit), None)


def collect(state: dict, det: dict) -> str | None:
    """Keeps a sample (feature, score, track); beyond the cap the one with the lowest score goes."""
    reason = refused(state, det)
    if reason is None:
        state["samples"].append([det["feature"], det["conf"] * det["upper_px"] / 500.0, det["track_id"]])
        if len(state["samples"]) > CAP:
            state["samples"].remove(min(state["samples"], key=lambda s: s[1]))
    return reason


def ready(state: dict) -> bool:
    return len(state["samples"]) >= SAMPLES and len({s[2] for s in state["samples"]}) >= state["tracks_needed"]


def coloured(x: np.ndarray, p: Params = P) -> np.ndarray:
    """Which samples are neither grey nor like the turf."""
    chroma = np.abs(x[:, :2] - 128).max(1)
    turf = np.hypot(x[:, 0] - p.field_a, x[:, 1] - p.field_b) < p.field_dist_min
    return (chroma >= p.chroma_min) & ~(turf & (chroma < 2 * p.chroma_min))


def calibrate(state: dict) -> bool:
    """Two groups of the samples; locks if their centres are farther apart than the limit, else keeps the last samples."""
    state["attempted"] = len(state["samples"])
    kept = state["samples"][-CAP:]
    x, w = np.array([s[0] for s in kept], float), np.array([s[1] for s in kept], float)
    usable = coloured(x)
    if usable.sum() >= SAMPLES // 2:
        x, w = x[usable], w[usable]
    mean, std = scaler(x)
    _, centres = two_means((x - mean) / std, w if w.sum() > 0 else np.ones(len(w)))
    distance = float(np.linalg.norm(centres[0] - centres[1]))
    state["model"] = {"mean": mean.tolist(), "std": std.tolist(), "centres": centres.tolist(), "distance": distance}
    if distance > state["least"]:
        lock(state)
        return True
    state["fails"] += 1
    state["samples"] = state["samples"][-SAMPLES:]
    state["message"], state["cooldown"] = MESSAGE, COOLDOWN
    if state["fails"] >= MAX_FAILS:
        state["least"] = LOWER_DISTANCE
    return False


def lock(state: dict) -> None:
    state["mode"], state["votes"] = "locked", {}


def line_up(state: dict, dets: list[dict]) -> bool:
    """Locks from where players stand: two lines by the projected foot, if their colours differ enough too."""
    seen = [d for d in dets if d["conf"] >= LINE_UP_CONF and d["feature"] is not None and d["field_y"] is not None and not d["referee"]]
    y = np.array([d["field_y"] for d in seen], float)
    if not spatial_lock(y, LINE_UP_HEIGHT):
        return False
    label, _ = split_1d(y)
    x = np.array([d["feature"] for d in seen], float)
    mean, std = scaler(x)
    centres = np.array([((x[label == k] - mean) / std).mean(0) for k in (0, 1)])
    distance = float(np.linalg.norm(centres[0] - centres[1]))
    if distance <= state["least"]:
        return False
    state["model"] = {"mean": mean.tolist(), "std": std.tolist(), "centres": centres.tolist(), "distance": distance}
    lock(state)
    return True


def distances(model: dict, feature: list[float]) -> tuple[float, float]:
    x = (np.array(feature) - model["mean"]) / model["std"]
    d = np.linalg.norm(x - np.array(model["centres"]), axis=1)
    return float(d[0]), float(d[1])


def labelled(state: dict, det: dict, boxes: list[list[float]], p: Params = P) -> int:
    """The voted label of a detection; for some frames after a cut the label of its own colour, which only becomes the last one."""
    d0, d1 = distances(state["model"], det["feature"])
    own, key, locked = 0 if d0 < d1 else 1, str(det["track_id"]), state["mode"] == "locked"
    track = state["votes"].setdefault(key, {})
    if locked and state["post_cut"] > 0:
        track["last"] = own
        return own
    rule = margins(state["model"]["distance"], warmup=not locked)
    near = locked and is_crowded(det["box"], boxes, p)
    return vote(track, own, d0, d1, float(det["torso_px"]) if locked else 0.0, near, rule, p)


def cached(state: dict, track_id: int) -> int:
    """The label of a track on a frame without detection: the locked one, else the last given, else the last voted, else -1."""
    key = str(track_id)
    track = state["votes"].get(key, {})
    lock = track.get("lock")
    return lock if lock is not None else state["given"].get(key, track.get("last", -1))


def warm_tick(state: dict) -> None:
    state["ticks"] += 1
    if state["ticks"] == RELAX_AT:
        state["tracks_needed"] = max(RELAXED_TRACKS, state["tracks_needed"] - 4)
    elif state["ticks"] == ALL_RELAXED_AT:
        state["tracks_needed"] = RELAXED_TRACKS
    if state["ticks"] > TIMEOUT and len(state["samples"]) >= TIMEOUT_SAMPLES:
        calibrate(state)


def attempt(state: dict) -> None:
    """After each sample: the pause after a failure counts detections; a further attempt needs some new samples."""
    if state["cooldown"] > 0:
        state["cooldown"] -= 1
    elif ready(state) and (state["attempted"] == 0 or len(state["samples"]) - state["attempted"] >= NEW_SAMPLES):
        calibrate(state)


def step(state: dict, clip_id: str, frame: int, dets: list[dict], is_cut: bool = False, p: Params = P) -> list[tuple]:
    """Labels of a frame's detections: -1 unknown, -2 referee. Frames at or before the last one are left out."""
    if state["frame"] is not None and frame <= state["frame"]:
        return []
    state["frame"] = frame
    if is_cut:
        state["post_cut"] = POST_CUT
    if state["mode"] == "warmup" and dets and frame % LINE_UP_EVERY == 0:
        line_up(state, dets)
    if state["mode"] == "warmup":
        warm_tick(state)
    out, boxes, shown = [], [d["box"] for d in dets], state["message"]
    state["message"] = max(0, shown - 1)
    for det in dets:
        reason, label = None, -1
        if det["feature"] is None:
            reason = "features"
        elif det["referee"] and not (state["mode"] == "locked" and abs(np.subtract(*distances(state["model"], det["feature"]))) >= 1.0):
            label = -2
        elif state["mode"] == "warmup":
            reason = collect(state, det)
            attempt(state)
            if state["model"] is not None:
                label = labelled(state, det, boxes, p)
        else:
            label = labelled(state, det, boxes, p)
        state["given"][str(det["track_id"])] = label
        out.append((clip_id, frame, det["track_id"], state["mode"], label, reason, shown))
    state["post_cut"] = max(0, state["post_cut"] - 1)
    return out


def _detection(r: dict) -> dict:
    feature = [r[c] for c in FEATURES]
    return {
        "track_id": r["track_id"], "feature": None if any(v is None for v in feature) else [float(v) for v in feature], "conf": r["conf"],
        "torso_px": r["torso_px"], "upper_px": r["upper_px"], "field_overlap": r["field_overlap"], "helmet": bool(r["helmet"]),
        "referee": bool(r["referee"]), "field_y": r["field_y"], "box": [float(r[c]) for c in ("x1", "y1", "x2", "y2")],
    }


def run_rows(state: dict, clip_id: str, rows: pd.DataFrame) -> pd.DataFrame:
    records = rows.astype(object).where(rows.notna(), None).to_dict("records")
    records.sort(key=lambda r: (r["frame"], -1 if r["track_id"] is None else r["track_id"]))
    out = []
    for frame, part in itertools.groupby(records, key=lambda r: r["frame"]):
        part = list(part)
        dets = [_detection(r) for r in part if r["track_id"] is not None]
        out += step(state, clip_id, int(frame), dets, any(bool(r["is_cut"]) for r in part))
    return pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])


def batch(frames: DataFrame) -> DataFrame:
    """frames: clip_id, frame, track_id (null: a frame without detections), is_cut, box, conf, torso_px, upper_px, field_overlap,
    helmet, referee, field_y and the six features. A clip's state is sequential, so a clip is one task's work, some rows at a time."""
    return in_order(frames, OUTPUT, new_state, run_rows)


def stream(frames: DataFrame) -> DataFrame:
    """The same on a streaming DataFrame, the state kept as JSON for each clip."""

    def run(key, batches, state):
        held = json.loads(state.get[0]) if state.exists else new_state()
        yield run_rows(held, key[0], pd.concat(list(batches)))
        state.update((json.dumps(held),))

    return frames.groupBy("clip_id").applyInPandasWithState(run, OUTPUT, "state string", "append", "NoTimeout")


def figures(labels: DataFrame) -> DataFrame:
    """One row a clip of step's rows: frames by state, frames with a label, locked labels, and tracks seen with both teams when locked."""
    known, locked = F.col("label").isin(0, 1), F.col("state") == "locked"
    frames = labels.groupBy("clip_id", "frame").agg(F.max(locked.cast("int")).alias("locked"), F.max(known.cast("int")).alias("known"))
    per_frame = frames.groupBy("clip_id").agg(F.count("*").alias("frames"), F.sum("locked").alias("locked_frames"), F.sum("known").alias("labelled_frames"))
    tracks = labels.filter(known & locked).groupBy("clip_id", "track_id").agg(F.count("*").alias("n"), F.count_distinct("label").alias("teams"))
    per_track = tracks.groupBy("clip_id").agg(F.sum("n").alias("locked_labels"), F.count_if(F.col("teams") > 1).alias("mixed_tracks"))
    return per_frame.join(per_track, "clip_id", "left").fillna(0, ["locked_labels", "mixed_tracks"])


def figure_parts(labels: DataFrame) -> DataFrame:
    """What figures() counts, a row for each frame and each track of a clip, from a batch or a streaming DataFrame of step's rows.

    (clip_id, kind, key, locked, known, n, teams). Each value only grows with more rows, so parts of the same key merge by
    their maximum: a part that comes twice, or late, changes nothing.
    """
    known, locked = F.col("label").isin(0, 1), F.col("state") == "locked"
    both = F.coalesce(known & locked, F.lit(False))
    as_bit = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    nothing = F.lit(0)
    frame = F.struct(F.lit("frame").alias("kind"), F.col("frame").alias("key"), as_bit(locked).alias("locked"), as_bit(known).alias("known"), nothing.alias("n"), nothing.alias("teams"))
    team = F.when(both, F.col("label").cast("int") + 1).otherwise(0)
    track = F.struct(F.lit("track").alias("kind"), F.col("track_id").alias("key"), nothing.alias("locked"), nothing.alias("known"), both.cast("int").alias("n"), team.alias("teams"))
    rows = labels.select("clip_id", F.explode(F.array(frame, track)).alias("p")).select("clip_id", "p.*")
    return rows.groupBy("clip_id", "kind", "key").agg(F.max("locked").alias("locked"), F.max("known").alias("known"), F.sum("n").alias("n"), F.bit_or("teams").alias("teams"))


def stream_figures(labels: DataFrame, path: str, checkpoint: str):
    """Keeps the parts of a stream of step's rows as Spark's own aggregation state; returns the writer, to be started.

    A micro-batch writes the parts that it changed under path, in a folder of its number that a repeat replaces. State is a
    row for each frame and track; a hot clip's are spread over all tasks.
    """

    def keep(parts: DataFrame, number: int) -> None:
        parts.write.mode("overwrite").parquet(f"{path}/epoch={number}")

    return figure_parts(labels).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint)


PARTS = "clip_id string, kind string, key long, locked int, known int, n long, teams int, epoch long"


def running_figures(spark: SparkSession, path: str) -> DataFrame:
    """epoch, clip_id and figures() of all rows up to each micro-batch that changed a clip.

    A part's growth belongs to the epoch that brought it, so epochs are summed and not gathered again for each.
    """
    order = Window.partitionBy("clip_id", "kind", "key").orderBy("epoch")
    counted = {
        "frames": "if(kind = 'frame', 1, 0)",
        "locked_frames": "if(kind = 'frame', locked, 0)",
        "labelled_frames": "if(kind = 'frame', known, 0)",
        "locked_labels": "n",
        "mixed_tracks": "if(teams = 3, 1, 0)",
    }
    parts = spark.read.schema(PARTS).parquet(path).selectExpr("epoch", "clip_id", "kind", "key", *[f"CAST({v} AS BIGINT) AS {k}" for k, v in counted.items()])
    grown = parts.select("epoch", "clip_id", *[(F.max(c).over(order) - F.coalesce(F.max(c).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias(c) for c in counted])
    each = grown.groupBy("clip_id", "epoch").agg(*[F.sum(c).alias(c) for c in counted])
    upto = Window.partitionBy("clip_id").orderBy("epoch")
    return each.select("epoch", "clip_id", *[F.sum(c).over(upto).alias(c) for c in counted])


def moved_homography(h: list[list[float]], motion: list[list[float]], inliers: int, least: int = 10) -> list[list[float]]:
    """A homography after the camera moved by an affine map (two rows); too few inliers or a map without inverse change nothing."""
    a = np.vstack([np.array(motion, float), [0.0, 0.0, 1.0]])
    if inliers < least or abs(np.linalg.det(a)) < 1e-12:
        return h
    return (np.array(h, float) @ np.linalg.inv(a)).tolist()


def homographies(motions: DataFrame, start: list[list[float]]) -> DataFrame:
    """(clip_id, frame, h) by folding a clip's motions (clip_id, frame, m: six numbers, inliers) over a first homography."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows, h, out = rows.sort_values("frame"), start, []
        for m, n in zip(rows.m, rows.inliers):
            h = moved_homography(h, [list(m[:3]), list(m[3:])], n)
            out.append([v for row in h for v in row])
        return rows[["clip_id", "frame"]].assign(h=out)

    return motions.groupBy("clip_id").applyInPandas(run, "clip_id string, frame long, h array<double>")
