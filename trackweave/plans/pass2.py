"""The offline analysis of a detection table: gate, teams, stitching, numbers, snap, projection, routes, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import VALID_FEATURE, projected
from ..operators import aggregates, clustering, greedy, relational, windows
from ..params import P, Params
from ..tables import discard, materialize


def brightness_split(det: DataFrame, luminance: DataFrame, delta: float = P.brightness_delta) -> DataFrame:
    """(clip_id, split): whether the mean luminance (clip_id, frame, lum) of a clip's segments differs by more than delta.

    Frames without detections and frames without luminance don't count; a clip of fewer than two known segments isn't split.
    """
    frames = relational.of_segment(det).select("clip_id", "frame", "segment").distinct().join(luminance, ["clip_id", "frame"])
    means = frames.groupBy("clip_id", "segment").agg(F.avg("lum").alias("lum")).filter("lum IS NOT NULL")
    return means.groupBy("clip_id").agg(((F.count("*") >= 2) & (F.max("lum") - F.min("lum") > delta)).alias("split"))


def assign_teams(det: DataFrame, by_segment: bool = False, luminance: DataFrame | None = None) -> DataFrame:
    """det with team from clustering: a track's valid rows vote, ties to the smaller team; without votes the team it had, else -1.

    by_segment: clusters each segment between cuts; the vote of a track's last segment holds for all its rows. With
    luminance (clip_id, frame, lum) only clips whose brightness changes are clustered by segment, the others whole.
    """
    if luminance is not None:
        flags = brightness_split(det, luminance)
        parts = relational.of_segment(det).join(flags, "clip_id", "left").withColumn("segment", F.when(F.col("split"), F.col("segment")).otherwise(0)).drop("split")
    elif by_segment:
        parts = relational.of_segment(det)
    else:
        parts = det.withColumn("segment", F.lit(0).cast("long"))
    rows = clustering.team_rows(parts, VALID_FEATURE, ["clip_id", "segment"])
    each = aggregates.mode_vote(rows, ["clip_id", "track_id", "segment"], "det_team", "t")
    votes = each.groupBy("clip_id", "track_id").agg(F.max_by("t", "segment").alias("voted"))
    return det.join(votes, ["clip_id", "track_id"], "left").withColumn("team", F.coalesce("voted", "team", F.lit(-1)).cast("int")).drop("voted")


def stitched(det: DataFrame, p: Params = P) -> DataFrame:
    """det with stable_id: the first track of the chain that a track continues."""
    tracks = materialize(aggregates.track_summary(det), "tracks")
    roots = materialize(greedy.chained_tracks(tracks, p.max_gap, p.max_dist, p.ab_weight), "chains")
    discard(tracks)
    return det.join(roots, ["clip_id", "track_id"], "left").withColumn("stable_id", F.coalesce("stable_id", "track_id"))


def analyse(det: DataFrame, homography: list[list[float]] | None = None, factor: float = P.jump_factor) -> DataFrame:
    """Routes: rows from the snap on, with stable_id, team, jersey_number, court_x, court_y, t_from_snap.

    Each step's rows are a table in the shared folder: the detections, then with teams, then with chains. The source is
    read once, and clustering, summaries and votes run once.
    """
    det = materialize(det, "detections")
    teamed = materialize(assign_teams(det), "teams")
    discard(det)
    rows = materialize(stitched(teamed), "stitched")
    discard(teamed)
    key = ["clip_id", "stable_id"]
    teams = aggregates.mode_vote(rows.filter("team >= 0"), key, "team", "voted")
    numbers = aggregates.number_vote(rows, key)
    snap = materialize(windows.snap_frame(rows, "stable_id", factor=factor), "snap")
    rows = rows.drop("team").join(teams, key, "left").join(numbers, key, "left")
    rows = rows.withColumn("team", F.coalesce("voted", F.lit(-1))).drop("voted")
    if homography:
        x, y = projected(homography)
        rows = rows.withColumn("court_x", F.expr(x)).withColumn("court_y", F.expr(y))
    return windows.trimmed(rows, snap)
