"""Gates and reports: thresholds over one-row figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import P, Params
from ..sources.readers import check_dataset
from .aggregates import gate_figures


def ir_gate(det: DataFrame, p: Params = P, by: tuple[str, ...] = ()) -> DataFrame:
    """One row, or one for each clip (by: its columns): figures, checks, pass and reason (empty_ir for a table without rows)."""
    checks = {
        "check_median": F.col("median_det") >= p.min_median_det,
        "check_fp": F.col("fp_rate") <= p.max_fp_rate,
        "check_tracks": F.col("unique_tracks") >= p.min_unique_tracks,
        "check_fallback": F.col("fallback_rate") <= p.max_fallback_rate,
    }
    out = gate_figures(det, by).withColumns({k: F.coalesce(v, F.lit(False)) for k, v in checks.items()})
    every = F.col("check_median") & F.col("check_fp") & F.col("check_tracks") & F.col("check_fallback")
    return out.withColumn("pass", every & (F.col("n_rows") > 0)).withColumn("reason", F.when(F.col("n_rows") == 0, "empty_ir"))


def broadcast_gate(totals: DataFrame) -> DataFrame:
    """totals: fp_rate, zero_rate."""
    return totals.withColumn("pass_fp", F.col("fp_rate") < 0.20).withColumn("pass_zero", F.col("zero_rate") < 0.05).withColumn(
        "pass", F.col("pass_fp") & F.col("pass_zero")
    )


def acceptance(figures: DataFrame) -> DataFrame:
    """figures: fp_rate, zero_rate, team_pct, fragmentation, id_switches; team is skipped when unmeasured, the last two fail."""
    checks = {
        "ok_fp": "coalesce(fp_rate < 0.20, false)",
        "ok_zero": "coalesce(zero_rate < 0.05, false)",
        "ok_team": "coalesce(team_pct > 85, true)",
        "ok_frag": "coalesce(fragmentation < 0.15, false)",
        "ok_switches": "coalesce(id_switches < 2, false)",
    }
    out = figures.withColumns({k: F.expr(v) for k, v in checks.items()})
    return out.withColumn("pass", F.expr(" AND ".join(checks)))


RELEASE = {
    "avg_detections": "avg_detections >= 18", "zero_rate": "zero_rate <= 0.05", "locked": "locked_rate >= 0.85 OR final_locked",
    "flip_rate": "flip_rate <= 0.10", "lock_latency": "lock_latency < 900", "team_accuracy": "coalesce(team_accuracy >= 0.90, true)",
    "churn": "churn <= 0.40",
}


def release_gate(figures: DataFrame, early_lock: bool = False) -> DataFrame:
    """Seven criteria; the latency only counts with early_lock. relaxed: all but two, overall_relaxed: all but one, four at least."""
    out = figures.withColumns({f"ok_{k}": F.coalesce(F.expr(v), F.lit(False)) for k, v in RELEASE.items()})
    counted = [k for k in RELEASE if early_lock or k != "lock_latency"]
    passed = " + ".join(f"CAST(ok_{k} AS INT)" for k in counted)
    n = len(counted)
    return out.withColumn("passed", F.expr(passed)).withColumns(
        {
            "overall": F.col("passed") == n,
            "relaxed": F.col("passed") >= max(4, n - 2),
            "overall_relaxed": F.col("passed") >= max(4, n - 1),
        }
    )


def seg_gate(figures: DataFrame) -> DataFrame:
    return figures.withColumn("pass", F.expr("recall >= 0.75 AND map50 >= 0.75 AND map75 >= 0.55 AND mask_recall >= 0.70"))


def regression_gate(current: DataFrame, baseline: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """(metric, value, reference, higher_is_better, ok): not worse than the baseline by more than the tolerance of it."""
    rows = current.join(baseline, "metric", "left")
    worse = F.when(F.col("higher_is_better"), F.col("reference") - F.col("value")).otherwise(F.col("value") - F.col("reference"))
    return rows.withColumn("ok", F.coalesce(worse <= tolerance * F.abs("reference"), F.lit(True)))


def version_gate(model: DataFrame, version: str, fraction: float) -> DataFrame:
    return model.withColumn("ok", (F.col("feature_version") == version) & (F.col("upper_body_frac") == fraction) & F.col("scaler").isNotNull())


def dataset_gate(text: str, task: str, images: DataFrame) -> DataFrame:
    """One row (wrong, shared, pass): faults of the description, and stems of images (split, stem) that more than one split has."""
    shared = images.groupBy("stem").agg(F.count_distinct("split").alias("n")).filter("n > 1").agg(F.count("*").alias("shared"))
    wrong = check_dataset(text, task)
    return shared.withColumn("wrong", F.lit(",".join(wrong))).withColumn("pass", (F.col("wrong") == "") & (F.col("shared") == 0))
