"""Evaluation report: thresholds from calibration sets, rates on holdout sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetgrain.operators import calibrate
from packetgrain.session import cut

RUN = ["run"]


def file_means(scores: DataFrame, by: list[str], file: str = "file", score: str = "score") -> DataFrame:
    """A5: mean score per file; all benign calibration rows count as one file."""
    named = F.when((F.col("role") == "calibration") & (F.col("label") == 0), F.lit("benign_calibration")).otherwise(F.col(file))
    return scores.groupBy(*by, named.alias(file)).agg(F.avg(score).alias("mean_score"))


def baseline(benign: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Mean and population deviation of the benign fit set."""
    return benign.groupBy(*keys).agg(F.avg(score).alias("mu"), F.stddev_pop(score).alias("sigma"))


RULES = ("youden", "target_fpr", "evt")


def thresholds(scores: DataFrame, target_fpr: float) -> DataFrame:
    """One row per run and rule: youden, target_fpr and, when it can be fitted, evt.

    ``scores`` has run, role, label (1 attack, 0 benign) and score. The tail fit's own numbers stand in ``fit``.
    """
    fit = scores.where(F.col("role") == "calibration")
    points = calibrate.pick_thresholds(calibrate.roc_points(fit, RUN), RUN, target_fpr)
    rows = points.select(
        *RUN,
        F.inline(F.array(*[
            F.struct(
                F.lit(name).alias("rule"), F.col(f"{rule}_threshold").alias("threshold"),
                F.col(f"{rule}_tpr").alias("tpr"), F.col(f"{rule}_fpr").alias("fpr"),
            )
            for name, rule in (("youden", "youden"), ("target_fpr", "target"))
        ])),
    )
    tail = calibrate.evt_thresholds(fit.where(F.col("label") == 0), RUN, target_fpr)
    own = F.struct("threshold", "t0", "gpd_shape", "gpd_scale", "num_tail_points", "tail_quantile", "target_fpr")
    return rows.unionByName(
        tail.select(*RUN, F.lit("evt").alias("rule"), "threshold", own.alias("fit")), allowMissingColumns=True
    )


def holdout_rates(scores: DataFrame, rules: DataFrame) -> DataFrame:
    """T7 per run and rule: false-positive and detection rate on the holdout windows.

    There are three rules, so each score meets three thresholds and is averaged at once.
    """
    held = scores.where(F.col("role") == "holdout").join(rules.select(*RUN, "rule", "threshold"), RUN)
    over = (F.col("score") > F.col("threshold")).cast("double")
    return held.groupBy(*RUN, "rule").agg(
        F.max("threshold").alias("threshold"),
        F.avg(F.when(F.col("label") == 0, over)).alias("holdout_benign_false_positive_rate"),
        F.avg(F.when(F.col("label") == 1, over)).alias("holdout_attack_detection_rate"),
    )


def metrics_documents(scores: DataFrame, target_fpr: float) -> DataFrame:
    """One nested row per run: caveats, the calibration with its three rules, the holdout results.

    A ``file`` column names the attack files of ``per_file_mean_score``; without one they count as one.
    """
    rules = cut(thresholds(scores, target_fpr))
    fit = scores.where(F.col("role") == "calibration")
    area = calibrate.auc(fit, RUN)
    results = holdout_rates(scores, rules).groupBy(*RUN).agg(
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct(
                "rule",
                F.struct("threshold", "holdout_benign_false_positive_rate", "holdout_attack_detection_rate").alias("r"),
            )))
        ).alias("results")
    )

    def rule(name: str, value: Column) -> Column:
        return F.max(F.when(F.col("rule") == name, value)).alias(name)

    point = F.struct("threshold", "tpr", "fpr")
    picked = rules.groupBy(*RUN).agg(rule("youden", point), rule("target_fpr", point), rule("evt", F.col("fit")))
    named = scores if "file" in scores.columns else scores.withColumn("file", F.lit("attack"))
    means = file_means(named.where(F.col("role") == "calibration"), RUN).groupBy(*RUN).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("file", "mean_score")))).alias("per_file_mean_score")
    )
    held = scores.groupBy(*RUN).agg(
        F.count_if((F.col("role") == "holdout") & (F.col("label") == 0)).alias("_held_benign"),
        F.count_if((F.col("role") == "holdout") & (F.col("label") == 1)).alias("_held_attack"),
    )
    joined = area.join(picked, RUN).join(means, RUN).join(held, RUN).join(results, RUN, "left")
    return calibrate.caveats(joined).select(
        *RUN,
        "caveats",
        F.struct(
            F.col("benign").alias("num_benign_windows"), F.col("attack").alias("num_attack_windows"), "auc", *RULES, "per_file_mean_score"
        ).alias("calibration"),
        F.struct(
            F.col("_held_benign").alias("num_benign_windows"), F.col("_held_attack").alias("num_attack_windows"), "results"
        ).alias("holdout"),
    )
