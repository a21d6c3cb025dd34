"""Two-group clustering of colour features, canonical labels, 1-D splits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..params import P
from ..tables import discard, materialize, small_side

FEATURES = ["feat_a", "feat_b", "feat_sa", "feat_sb", "feat_h", "feat_sh"]


def scaler(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation; a constant column is left as it is."""
    std = x.std(axis=0)
    return x.mean(axis=0), np.where(std == 0, 1.0, std)


def two_means(x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels and centres of weighted 2-means from a fixed start: the point farthest from the mean, and that farthest from it.
    Ends when no label changes, or when rounding brings labels back that there were before."""
    mean = np.average(x, axis=0, weights=w)
    a = x[((x - mean) ** 2).sum(1).argmax()]
    centres = np.array([a, x[((x - a) ** 2).sum(1).argmax()]])
    label, seen = np.zeros(len(x), int), set()
    while True:
        d = ((x[:, None] - centres[None]) ** 2).sum(2)
        new = (d[:, 1] < d[:, 0]).astype(int)
        for k in (0, 1):
            if (new == k).any():
                centres[k] = np.average(x[new == k], axis=0, weights=w[new == k])
        if (new == label).all() or new.tobytes() in seen:
            return new, centres
        seen.add(new.tobytes())
        label = new


def cluster(rows: pd.DataFrame, least: float = P.centroid_min) -> np.ndarray | None:
    """Team of each row (0: the lower weighted mean hue), or None: too few rows, or centres too near in scaled space."""
    if len(rows) < 8:
        return None
    x = rows[FEATURES].to_numpy(float)
    mean, std = scaler(x)
    w = (rows.conf * rows.torso_px.clip(lower=1)).to_numpy(float)
    w = np.where(w > 0, w, 1e-9)
    label, centres = two_means((x - mean) / std, w)
    if np.linalg.norm(centres[0] - centres[1]) < least:
        return None
    return canonical(rows.feat_h.to_numpy(float), w, label)


def canonical(hue: np.ndarray, w: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Labels changed so that group 0 has the lower weighted (linear) mean hue; one empty group: as they are."""
    if not (label == 0).any() or not (label == 1).any():
        return label
    hues = [np.average(hue[label == k], weights=w[label == k]) for k in (0, 1)]
    return 1 - label if hues[0] > hues[1] else label


def split_1d(values: np.ndarray) -> tuple[np.ndarray, float]:
    """Exact 2-means of numbers: the cut of the sorted values with the least squared error, by prefix sums."""
    order = np.argsort(values, kind="stable")
    v = values[order].astype(float)
    n = np.arange(1, len(v))
    s, q = np.cumsum(v), np.cumsum(v * v)
    cost = (q[:-1] - s[:-1] ** 2 / n) + ((q[-1] - q[:-1]) - (s[-1] - s[:-1]) ** 2 / (len(v) - n))
    cut = int(cost.argmin()) + 1
    label = np.empty(len(v), int)
    label[order] = (np.arange(len(v)) >= cut).astype(int)
    return label, float(cost.min())


def spatial_lock(y: np.ndarray, height: float) -> bool:
    """Whether players stand in two lines: 14 of them, and spread, distance of the groups' means and group sizes within bounds."""
    if len(y) < 14 or y.max() - y.min() > 0.6 * height:
        return False
    spread = y.max() - y.min()
    if spread <= 0:
        return False
    label, _ = split_1d(y)
    a, b = y[label == 0], y[label == 1]
    return min(len(a), len(b)) >= 5 and (b.mean() - a.mean()) / spread >= 0.20


#: Digits of a centre's coordinates in scaled space: sums over tasks in any order give the same centres.
CENTRE_DIGITS = 9
_A, _B = [f"a{j}" for j in range(len(FEATURES))], [f"b{j}" for j in range(len(FEATURES))]


def _squared(centre: list[str]) -> str:
    """Squared distance of a point x0.. to a centre."""
    return " + ".join(f"(x{j} - {c}) * (x{j} - {c})" for j, c in enumerate(centre))


def weighted(det: DataFrame, valid: str, by: list[str]) -> DataFrame:
    """The valid rows: by, event_id, track_id, weight w, and the features."""
    return det.filter(valid).selectExpr(
        *by, "event_id", "track_id", "CASE WHEN conf * greatest(1, torso_px) > 0 THEN conf * greatest(1, torso_px) ELSE 1e-9D END AS w", *FEATURES
    )


def points(rows: DataFrame, by: list[str], least: int = 8) -> DataFrame:
    """The weighted rows of groups that have so many: by, event_id, track_id, weight w, hue, and the scaled features x0.. ."""
    moments = [f(c).alias(f"{n}{j}") for j, c in enumerate(FEATURES) for f, n in ((F.avg, "m"), (F.stddev_pop, "s"))]
    stats = rows.groupBy(*by).agg(F.count("*").alias("n"), *moments).filter(F.col("n") >= least).drop("n")
    scaled = [f"({c} - m{j}) / CASE WHEN s{j} = 0 THEN 1 ELSE s{j} END AS x{j}" for j, c in enumerate(FEATURES)]
    return rows.join(stats, by).selectExpr(*by, "event_id", "track_id", "w", "feat_h AS hue", *scaled)


def combined(rows: DataFrame, by: list[str]) -> DataFrame:
    """Points of a group at one place as one: its smallest event and the sum of their weights, which is all that 2-means has of them."""
    return rows.groupBy(*by, *[f"x{j}" for j in range(len(FEATURES))]).agg(F.min("event_id").alias("event_id"), F.sum("w").alias("w"))


#: Rounds of 2-means in one job.
ROUNDS = 4


def two_centres(rows: DataFrame, by: list[str]) -> tuple[DataFrame, list[DataFrame]]:
    """by, a0.., b0..: the centres of weighted 2-means of each group, from the point farthest from the mean and that farthest
    from it (ties: the smallest event); and the tables they were made in.

    A round is one aggregate over all groups, which combines before its shuffle; only the centres, a row a group, go to
    the points: broadcast if their counted size allows it, joined by group otherwise. A job has some rounds, of which
    those after the last change change nothing. Jobs end when the last round changes no label, or when rounding brings
    centres back that there were before; there is no other bound.
    """
    x = [F.col(f"x{j}") for j in range(len(FEATURES))]
    means = rows.groupBy(*by).agg(*[F.round(F.sum(F.col("w") * v) / F.sum("w"), CENTRE_DIGITS).alias(c) for v, c in zip(x, _A)])
    made = [materialize(means, "centres")]
    n = made[0].count()

    def near(centres: DataFrame) -> DataFrame:
        return rows.join(small_side(centres, n, 400), by)

    def farthest(centres: DataFrame, names: list[str]) -> DataFrame:
        """Of each group the point farthest from a0.., beside what the centres have."""
        best = F.max_by(F.struct(*[F.round(v, CENTRE_DIGITS).alias(c) for v, c in zip(x, names)]), F.struct(F.expr(_squared(_A)), -F.col("event_id")))
        kept = [c for c in centres.columns if c not in by and c not in names]
        found = near(centres).groupBy(*by).agg(best.alias("f"), *[F.first(c).alias(c) for c in kept])
        return materialize(found.select(*by, "f.*", *kept), "centres")

    made.append(farthest(made[-1], [f"f{c}" for c in _A]))
    start = made[-1].select(*by, *[F.col(f"f{c}").alias(c) for c in _A])
    made.append(farthest(start, _B))
    now = made[-1].withColumns({f"old_{c}": F.col(c) for c in (*_A, *_B)})
    label, before = f"({_squared(_B)}) < ({_squared(_A)})", "false"  # before the first round all points have label 0
    olds = [F.first(c).alias(f"old_{c}") for c in (*_A, *_B)]
    state, states = F.sum(F.xxhash64(*by, *_A, *_B).cast("decimal(38,0)")).alias("state"), set()
    while True:
        for _ in range(ROUNDS):
            labelled = near(now).withColumn("l", F.expr(label)).withColumn("o", F.expr(before))
            sums = [
                F.coalesce(F.round(F.sum(F.when(F.col("l") == side, F.col("w") * v)) / F.sum(F.when(F.col("l") == side, F.col("w"))), CENTRE_DIGITS), F.first(c)).alias(c)
                for side, names in ((False, _A), (True, _B))
                for v, c in zip(x, names)
            ]
            now = labelled.groupBy(*by).agg(*sums, *olds, F.count_if(F.col("l") != F.col("o")).alias("changed"))
            before = f"({_squared([f'old_{c}' for c in _B])}) < ({_squared([f'old_{c}' for c in _A])})"
        seen = Observation()
        made.append(materialize(now.observe(seen, F.coalesce(F.sum("changed"), F.lit(0)).alias("n"), state), "centres"))
        now, got = made[-1].drop("changed"), seen.get
        if not got["n"] or got["state"] in states:
            break
        states.add(got["state"])
    return now.select(*by, *_A, *_B), made


def canonical_rows(labelled: DataFrame, by: list[str]) -> DataFrame:
    """labelled (by, w, hue, l) with labels changed so that label 0 of a group has the lower weighted mean hue; a group of
    one label stays as it is."""
    hues = labelled.groupBy(*by).agg(*[F.expr(f"sum(w * hue) FILTER (WHERE l = {k}) / sum(w) FILTER (WHERE l = {k})").alias(f"h{k}") for k in (0, 1)])
    swapped = hues.select(*by, F.coalesce(F.col("h0") > F.col("h1"), F.lit(False)).alias("swap"))
    return labelled.join(swapped, by).withColumn("l", F.expr("CASE WHEN swap THEN 1 - l ELSE l END")).drop("swap")


def aligned_rows(labelled: DataFrame, by: list[str], column: str) -> DataFrame:
    """labelled (by, l, column) with the labels of each group changed if that brings its two means nearer to those of all rows."""
    means = lambda prefix: [F.avg(F.when(F.col("l") == k, F.col(column))).alias(f"{prefix}{k}") for k in (0, 1)]
    both = labelled.groupBy(*by).agg(*means("a")).join(labelled.agg(*means("r")), F.lit(True))  # one row
    swap = F.expr("coalesce(abs(a0 - r1) + abs(a1 - r0) < abs(a0 - r0) + abs(a1 - r1), false)")
    rows = labelled.join(both.select(*by, swap.alias("swap")), by)
    return rows.withColumn("l", F.expr("CASE WHEN swap AND l IN (0, 1) THEN 1 - l ELSE l END")).drop("swap")


def team_rows(det: DataFrame, valid: str, by: list[str] | None = None, least: float = P.centroid_min) -> DataFrame:
    """(by, event_id, track_id, det_team) of the valid rows, clustered in each clip (or clip and segment).

    Team 0 has the lower weighted mean hue. Groups of fewer than eight valid rows, and those whose centres are nearer
    than `least` in scaled space, have no rows. Null rows of `valid` don't count.
    """
    by = by or ["clip_id"]
    valid_rows = materialize(weighted(det, valid, by), "valid-rows")
    rows = points(valid_rows, by)
    places = materialize(combined(rows, by), "points")
    centres, made = two_centres(places, by)
    labelled = rows.join(small_side(centres, made[0].count(), 400), by).withColumn("l", F.expr(f"CAST(({_squared(_B)}) < ({_squared(_A)}) AS INT)"))
    apart = F.expr(f"sqrt({' + '.join(f'({a} - {b}) * ({a} - {b})' for a, b in zip(_A, _B))}) >= {least}")
    labelled = labelled.filter(apart).select(*by, "event_id", "track_id", "w", "hue", "l")
    out = canonical_rows(labelled, by).select(*by, "event_id", "track_id", F.col("l").alias("det_team"))
    out = materialize(out, "team-rows")
    for used in (valid_rows, places, *made):
        discard(used)
    return out


def nearest_centre(det: DataFrame, centres: list[list[float]]) -> DataFrame:
    """det with dist0, dist1 and the nearer centre (ties: 1)."""
    d = [F.sqrt(sum(((F.col(c) - v) ** 2 for c, v in zip(FEATURES, centre)), F.lit(0.0))) for centre in centres]
    rows = det.withColumn("dist0", d[0]).withColumn("dist1", d[1])
    return rows.withColumn("nearest", F.when(F.col("dist0") < F.col("dist1"), 0).otherwise(1))
