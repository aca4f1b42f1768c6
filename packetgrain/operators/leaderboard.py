"""Checkpoint leaderboard: collapse rules, eligibility and running best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetgrain.operators.ordering import fits, running

# Fixed values of the selection rules.
COLLAPSE_FPR = 0.50
COLLAPSE_AUC = 0.55
SIGMA_DRIFT = 1.0
FPR_BUDGET = 0.01
ABORT_STREAK = 3


def step_of(name: Column) -> Column:
    """L1: the training step in a checkpoint name, -1 without one."""
    found = F.regexp_extract(name, r"_gs(\d+)_", 1)
    return F.when(found != "", found.try_cast("long")).otherwise(F.lit(-1)).cast("long")


def operating_points(metrics: DataFrame) -> DataFrame:
    """L2: the compared numbers of nested metrics documents."""
    held = "holdout.results"

    def rate(rule: str, kind: str) -> Column:
        return F.col(f"{held}.{rule}.holdout_{kind}")

    return metrics.select(
        *[c for c in metrics.columns if c not in ("caveats", "calibration", "holdout")],
        F.col("calibration.auc").alias("auc"),
        F.col("calibration.per_file_mean_score.benign_calibration").alias("sigma"),
        *[
            rate(rule, kind).alias(f"{short}_{out}")
            for rule, short in (("evt", "evt"), ("target_fpr", "target"), ("youden", "youden"))
            for kind, out in (("attack_detection_rate", "dr"), ("benign_false_positive_rate", "fpr"))
        ],
    )


def judge(points: DataFrame, keys: list[str], order: list[Column], drift: float = SIGMA_DRIFT, budget: float = FPR_BUDGET) -> DataFrame:
    """Status, eligibility, running best and collapse streaks in evaluation order.

    ``points`` has auc, evt_dr, evt_fpr and sigma per checkpoint.
    """
    within = fits(points, keys)
    prior = running(points, keys, order, {"sigma_min": ("min", F.col("sigma"))}, False, within=within)
    collapsed = (
        F.coalesce(F.col("evt_fpr") > COLLAPSE_FPR, F.lit(False))
        | F.coalesce(F.col("auc") <= COLLAPSE_AUC, F.lit(False))
        | F.coalesce(F.col("sigma") - F.col("sigma_min") > drift, F.lit(False))
    )
    reason = (
        F.when(F.col("evt_fpr") > COLLAPSE_FPR, "false alarms")
        .when(F.col("auc") <= COLLAPSE_AUC, "chance level")
        .when(F.col("sigma") - F.col("sigma_min") > drift, "baseline drift")
        .otherwise("")
    )
    judged = prior.withColumn("status", F.when(collapsed, "COLLAPSED").otherwise("OK")).withColumn("note", reason)
    eligible = (F.col("status") == "OK") & F.col("evt_dr").isNotNull() & (F.col("evt_fpr") <= budget)
    judged = judged.withColumn("metric", F.when(eligible, F.col("evt_dr")))
    best = running(judged, keys, order, {"best_before": ("max", F.col("metric"))}, False, within=within)
    verdict = (
        F.when(F.col("status") == "COLLAPSED", "COLLAPSED")
        .when(F.col("metric").isNull(), "NOT ELIGIBLE")
        .when(F.col("best_before").isNull() | (F.col("metric") > F.col("best_before")), "NEW BEST")
        .otherwise("KEPT")
    )
    best = best.withColumn("verdict", verdict)
    healthy = F.when(F.col("status") == "OK", 1).otherwise(0)
    islands = running(best, keys, order, {"_island": ("sum", healthy)}, within=within)
    broken = F.when(F.col("status") == "COLLAPSED", 1).otherwise(0)
    streak = running(islands, [*keys, "_island"], order, {"collapse_streak": ("sum", broken)}, within=within)
    return streak.withColumn("abort", F.col("collapse_streak") >= ABORT_STREAK).drop("_island")


def beats_benchmark(detection: Column, benchmark: float) -> Column:
    """Verdict against a fixed published detection."""
    return F.when(detection.isNull(), "UNKNOWN").when(detection > benchmark, "BEATS").otherwise("BELOW")


def rows(judged: DataFrame, at: Column) -> DataFrame:
    """The leaderboard's line of each judged checkpoint."""
    def six(name: str) -> Column:
        return F.round(name, 6)

    return judged.select(
        at.alias("timestamp"), "checkpoint", "status", F.when(F.col("metric").isNotNull(), "yes").otherwise("no").alias("eligible"),
        six("auc").alias("calib_auc"), six("evt_dr").alias("evt_detection"), six("evt_fpr").alias("evt_fpr"),
        six("target_dr").alias("target_fpr_detection"), six("target_fpr").alias("target_fpr_fpr"),
        six("youden_dr").alias("youden_detection"), six("youden_fpr").alias("youden_fpr"),
        F.round("sigma", 3).alias("benign_sigma_proxy"), "note",
    )


def best_record(judged: DataFrame, keys: list[str], order: Column, at: Column, budget: float = FPR_BUDGET) -> DataFrame:
    """The record of the checkpoint that is the best now: the last one to be a new best."""
    last = judged.where(F.col("verdict") == "NEW BEST").groupBy(*keys).agg(
        F.max_by(F.struct("checkpoint", F.col("metric").alias("evt_detection"), "evt_fpr", F.col("auc").alias("calib_auc"),
                          F.col("sigma").alias("benign_sigma_proxy")), order).alias("b")
    )
    return last.select(
        *keys, "b.*", at.alias("selected_at"), F.lit(f"max held-out EVT detection s.t. held-out FPR <= {budget}").alias("criterion")
    )


def monitor_rows(metrics: DataFrame, at: Column) -> DataFrame:
    """The short line of a remote monitor: calibration area and the youden rule on the holdout."""
    youden = "holdout.results.youden"
    return metrics.select(
        at.alias("timestamp"), "checkpoint", F.format_string("%.4f", "calibration.auc").alias("calib_auc"),
        F.coalesce(F.format_string("%.3f", f"{youden}.threshold"), F.lit("nan")).alias("youden_threshold_bits"),
        F.col(f"{youden}.holdout_attack_detection_rate").alias("holdout_detection"),
        F.col(f"{youden}.holdout_benign_false_positive_rate").alias("holdout_fpr"),
    )
