"""Thresholds from benign scores, ROC analysis, drift and recalibration."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetgrain.operators import trailing
from packetgrain.operators.ordering import fits, order_statistics, quantiles, row_index, running
from packetgrain.session import HOT_ROWS, cut, limit

DEFAULT_THRESHOLD = 12.0
GOLD_MARGIN = 3.0
PSI_DRIFT = 0.25
PSI_FREEZE = 0.40
MIN_CLASS_WINDOWS = 30


def roc_points(scores: DataFrame, keys: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """Cumulative true and false positives at every distinct threshold (score >= threshold)."""
    per = scores.groupBy(*keys, score).agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("_pos"),
        F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("_neg"),
    )
    sums = per.groupBy(*keys).agg(F.sum("_pos").alias("positives"), F.sum("_neg").alias("negatives"))
    points = running(
        per, keys, [-F.col(score)], {"tp": ("sum", F.col("_pos")), "fp": ("sum", F.col("_neg"))}
    )
    return (
        points.join(sums, keys)
        .withColumnRenamed(score, "threshold")
        .withColumn("tpr", F.try_divide("tp", "positives"))
        .withColumn("fpr", F.try_divide("fp", "negatives"))
        .drop("_pos", "_neg")
    )


def _gain() -> Column:
    """tpr - fpr scaled to an exact integer, so equal gains compare equal."""
    wide = "decimal(38,0)"
    tp, fp = F.col("tp").cast("decimal(19,0)"), F.col("fp").cast("decimal(19,0)")
    n, p = F.col("negatives").cast("decimal(19,0)"), F.col("positives").cast("decimal(19,0)")
    return (tp * n).cast(wide) - (fp * p).cast(wide)


def pick_thresholds(points: DataFrame, keys: list[str], target_fpr: float) -> DataFrame:
    """The highest threshold of greatest tpr - fpr, and the one nearest a target rate."""
    row = F.struct("threshold", "tpr", "fpr")
    best = points.groupBy(*keys).agg(
        F.max_by(row, F.struct(_gain(), F.col("threshold"))).alias("youden"),
        F.min_by(row, F.struct(F.abs(F.col("fpr") - target_fpr), -F.col("threshold"))).alias("target"),
    )
    named = [
        F.col(f"{rule}.{field}").alias(f"{rule}_{field}")
        for rule in ("youden", "target")
        for field in ("threshold", "tpr", "fpr")
    ]
    return best.select(*keys, *named)


def auc(scores: DataFrame, keys: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """Mann-Whitney area with average ranks for ties."""
    per = scores.groupBy(*keys, score).agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("_pos"),
        F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("_neg"),
    )
    below = running(per, keys, [F.col(score)], {"_below": ("sum", F.col("_neg"))})
    won = F.col("_pos") * (F.col("_below") - F.col("_neg") / 2.0)
    return below.groupBy(*keys).agg(
        F.sum("_pos").alias("attack"),
        F.sum("_neg").alias("benign"),
        F.try_divide(F.sum(won), F.sum("_pos").cast("double") * F.sum("_neg")).alias("auc"),
    )


def threshold_at_fpr(benign: DataFrame, keys: list[str], fpr: float, score: str = "score") -> DataFrame:
    """T5: the ceil((1-f)n)-1 th smallest benign score."""
    sizes = benign.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    at = F.ceil(F.lit(1.0 - fpr) * F.col("_n")) - 1
    ranks = sizes.select(*keys, F.greatest(F.lit(0), F.least(at, F.col("_n") - 1)).alias("rank"))
    return order_statistics(benign, keys, score, ranks).select(*keys, F.col(score).alias("threshold"))


def exceedance_rate(scores: DataFrame, keys: list[str], threshold: Column, score: str = "score") -> DataFrame:
    """Share of scores strictly above the threshold."""
    return scores.groupBy(*keys).agg(F.avg((F.col(score) > threshold).cast("double")).alias("rate"))


def nearest_rank(df: DataFrame, keys: list[str], fraction: float, score: str = "score") -> DataFrame:
    """The round-half-even(q (n-1)) th smallest value."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    at = F.bround(F.lit(float(fraction)) * (F.col("_n") - 1), 0).cast("long")
    ranks = sizes.select(*keys, F.greatest(F.lit(0), F.least(at, F.col("_n") - 1)).alias("rank"))
    return order_statistics(df, keys, score, ranks).select(*keys, F.col(score).alias("value"))


def budget_thresholds(
    scores: DataFrame, keys: list[str], per_hour: float, score: str = "score", ts: str = "ts_us"
) -> DataFrame:
    """The quantile that lets ``per_hour`` benign windows through at the measured rate."""
    sizes = scores.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_windows"),
        ((F.max(ts) - F.min(ts)) / 1e6).alias("elapsed_seconds"),
    )
    rate = F.when(F.col("elapsed_seconds") > 0, F.col("num_windows") / F.col("elapsed_seconds")).otherwise(0.0)
    sizes = sizes.withColumn("window_rate_per_sec", rate)
    allowed = F.lit(float(per_hour)) / (F.col("window_rate_per_sec") * 3600.0)
    frac = F.least(F.greatest(allowed, F.lit(1e-6)), F.lit(0.5))
    sized = sizes.where(F.col("window_rate_per_sec") > 0).withColumn("budget_quantile", 1.0 - frac)
    at = F.col("budget_quantile") * (F.col("num_windows") - 1)
    ranks = sized.select(*keys, at.alias("_at")).select(
        *keys, "_at", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))).alias("rank")
    )
    found = order_statistics(scores, keys, score, ranks)
    spread = F.max(score) - F.min(score)
    values = found.groupBy(*keys).agg(F.min(score).alias("_low"), spread.alias("_spread"))
    joined = sized.join(values, keys)
    part = at - F.floor(at)
    return joined.select(
        *keys, "window_rate_per_sec", "elapsed_seconds", "budget_quantile",
        (F.col("_low") + F.col("_spread") * part).alias("budget_threshold"),
    )


def calibration_records(
    scores: DataFrame,
    keys: list[str],
    metric: str,
    per_hour: float = 0.0,
    score: str = "score",
    ts: str = "ts_us",
    calibrated_at: Column | None = None,
) -> DataFrame:
    """One calibration row per sensor."""
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    fractions = [i / 100 for i in range(101)] + [0.999]
    facts = [
        F.avg(score).alias("mean"),
        F.coalesce(F.stddev_samp(score), F.lit(0.0)).alias("std"),
        F.count(score).alias("num_windows"),
        ((F.max(ts) - F.min(ts)) / 1e6).alias("elapsed_seconds"),
    ]
    if fits(scores, keys):
        listed = F.percentile(score, F.array(*[F.lit(f) for f in fractions])).alias("_q")
        base = scores.groupBy(*keys).agg(*facts, listed)
    else:
        base = scores.groupBy(*keys).agg(*facts).join(quantiles(scores, keys, score, fractions, "_q"), keys)
    base = base.select(
        *keys, "mean", "std", "num_windows", "elapsed_seconds",
        F.slice("_q", 1, 101).alias("score_quantiles"),
        F.element_at("_q", 102).alias("quantile_999"),
        (F.col("mean") + 3 * F.col("std")).alias("mean_plus_3sigma"),
    )
    fallback = F.greatest("quantile_999", "mean_plus_3sigma")
    if per_hour > 0:
        found = budget_thresholds(scores, keys, per_hour, score, ts).drop("elapsed_seconds")
        base = base.join(found, keys, "left")
        threshold = F.coalesce("budget_threshold", fallback)
        method = F.when(
            F.col("budget_threshold").isNotNull(),
            F.format_string(f"alert-budget ({per_hour:g}/hr -> q%.5f)", "budget_quantile"),
        ).otherwise("max(q99.9, mean+3sigma)")
    else:
        rate = F.when(F.col("elapsed_seconds") > 0, F.col("num_windows") / F.col("elapsed_seconds"))
        base = (
            base
            .withColumn("window_rate_per_sec", F.coalesce(rate, F.lit(0.0)))
            .withColumn("budget_quantile", F.lit(None).cast("double"))
            .withColumn("budget_threshold", F.lit(None).cast("double"))
        )
        threshold, method = fallback, F.lit("max(q99.9, mean+3sigma)")
    return (
        base.withColumn("score_metric", F.lit(metric))
        .withColumn("byte_threshold", threshold)
        .withColumn("anchor_threshold", F.col("byte_threshold"))
        .withColumn("gold_threshold", F.round(F.col("byte_threshold") + GOLD_MARGIN, 4))
        .withColumn("threshold_method", method)
        .withColumn("calibrated_at", now if calibrated_at is None else calibrated_at)
        .withColumn("target_incidents_per_hour", F.lit(float(per_hour)))
        .withColumn("elapsed_seconds", F.round("elapsed_seconds", 1))
        .withColumn("window_rate_per_sec", F.round("window_rate_per_sec", 3))
    )


def score_percentile(score: Column, score_quantiles: Column) -> Column:
    """Number of percentile values below the score, at most 100."""
    return F.least(F.lit(100), F.size(F.filter(score_quantiles, lambda q: q < score)))


def cusum_reference(score_quantiles: Column, mean: Column, std: Column, pct: int = 99, k: float = 0.5) -> Column:
    """A high benign percentile, else mean + k sigma."""
    listed = F.when(F.size(score_quantiles) >= 101, F.get(score_quantiles, F.lit(pct)))
    return F.coalesce(listed, mean + k * F.greatest(std, F.lit(1e-6)))


def resolve_threshold(explicit: Column, saved: Column) -> Column:
    """Explicit, else saved, else the default."""
    return F.coalesce(explicit, saved, F.lit(DEFAULT_THRESHOLD))


def psi(
    live: DataFrame, calibration: DataFrame, keys: list[str], score: str = "score", minimum: int = 100
) -> DataFrame:
    """Population stability index of live scores against the calibration deciles.

    ``calibration`` has one row per sensor with ``score_quantiles``. The ten bin counts
    are ten conditional sums, so a sensor of any size is combined map-side and an empty
    bin still counts with the floor.
    """
    by = sensor_keys(keys, calibration)
    joined = live.join(calibration.select(*by, "score_quantiles"), by)
    counts = joined.withColumn("_bin", _bins(score)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum((F.col("_bin") == b).cast("long")).alias(f"_b{b}") for b in range(10)],
    )
    share = [F.greatest(F.col(f"_b{b}") / F.col("n"), F.lit(1e-4)) for b in range(10)]
    total = sum(((o - 0.1) * F.ln(o / 0.1) for o in share), F.lit(0.0))
    return counts.select(
        *keys, "n", F.when(F.col("n") >= minimum, total).alias("psi")
    ).withColumn("drift_flag", F.coalesce(F.col("psi") > PSI_DRIFT, F.lit(False)))


def sensor_keys(keys: list[str], calibration: DataFrame) -> list[str]:
    """The part of ``keys`` the calibration is kept by; the rest are time buckets and the like."""
    return [k for k in keys if k in calibration.columns]


def _bins(score: str) -> Column:
    """Decile of a score, from the calibration's ``score_quantiles`` beside it."""
    edges = F.transform(F.sequence(F.lit(0), F.lit(10)), lambda i: F.get("score_quantiles", i * 10))
    at = F.size(F.filter(edges, lambda e: e <= F.col(score))) - 1
    return F.least(F.lit(9), F.greatest(F.lit(0), at))


def psi_of(counts: list[int], minimum: int = 100) -> float | None:
    """T22 of ten bin counts; None for too few scores."""
    n = sum(counts)
    if n < minimum:
        return None
    shares = [max(c / n, 1e-4) for c in counts]
    return sum((o - 0.1) * math.log(o / 0.1) for o in shares)


@dataclass(frozen=True)
class Recalibration:
    """What the recalibrator is set to."""

    ref_pct: float = 99.0
    interval_us: int = 900_000_000
    min_samples: int = 5000
    trailing: int = 200_000
    digest_us: int = 3_600_000_000
    recent: int = 50_000
    max_psi: float = PSI_FREEZE
    step: float = 1.0
    cap: float = 3.0

    def __post_init__(self):
        if self.digest_us % self.interval_us:
            raise ValueError("digest_us must be a multiple of interval_us")

    def ranks(self, n: int, budget_quantile: float) -> tuple[int, int]:
        """Places of the threshold and of the reference among ``n`` ordered scores."""
        return tuple(min(n - 1, max(0, round(q * (n - 1)))) for q in (budget_quantile, self.ref_pct / 100.0))

    def measures(self, bucket: int) -> bool:
        """At a digest's end its scores have just been cleared, so drift is not known there."""
        return (bucket + 1) * self.interval_us % self.digest_us != 0

    def moved(self, candidate: float, current: float, anchor: float) -> float:
        near = min(current + self.step, max(current - self.step, candidate))
        return min(anchor + self.cap, max(anchor - self.cap, near))

    def applies(self, n: int, drift: float | None) -> bool:
        return n >= self.min_samples and (drift is None or drift <= self.max_psi)


def adaptive_thresholds(
    scores: DataFrame,
    calibration: DataFrame,
    keys: list[str],
    order: list[str],
    how: Recalibration,
    score: str = "score",
    flagged: str = "flagged",
) -> DataFrame:
    """Replay of the adaptive recalibration at the end of every interval of event time that has scores.

    The sample is the last ``trailing`` scores without a flag, over as many intervals as they lie in. Fewer than
    ``min_samples``, or a PSI above the limit over the last ``recent`` scores of the running digest, leave the thresholds
    as they are. ``order[0]`` is the time in microseconds. ``calibration`` holds ``byte_threshold``,
    ``budget_quantile`` and ``score_quantiles`` per sensor. Rows: bucket, n, psi, applied, threshold, reference.
    """
    bucket = F.floor(F.col(order[0]) / how.interval_us)
    live = scores.where(F.col(score).isNotNull()).select(
        *keys, *order, F.col(score).alias("_x"), F.coalesce(F.col(flagged), F.lit(False)).alias("_flag"), bucket.alias("bucket"),
        F.floor(F.col(order[0]) / how.digest_us).alias("digest"),
    ).join(calibration.select(*keys, "score_quantiles"), keys).withColumn("_bin", _bins("_x")).drop("score_quantiles")
    places = [F.col(c) for c in order]
    clean = row_index(live.where(~F.col("_flag")), keys, places).select(*keys, "idx", "_x")
    binned = row_index(live, [*keys, "digest"], places).select(*keys, "digest", "idx", "_bin")

    # One row per sensor and interval: a year of quarter hours is 35,000 rows a sensor.
    counts = live.groupBy(*keys, "digest", "bucket").agg(
        F.sum((~F.col("_flag")).cast("long")).alias("_clean"), F.count(F.lit(1)).alias("_all")
    )
    so_far = Window.partitionBy(*keys).orderBy("bucket")
    in_digest = Window.partitionBy(*keys, "digest").orderBy("bucket")
    checks = cut(counts.select(
        *keys, "digest", "bucket", F.sum("_clean").over(so_far).alias("upto"), F.sum("_all").over(in_digest).alias("_seen")
    ))

    def candidates(rows, lo, hi, wanted):
        quantile = wanted["budget_quantile"].to_pylist()
        ranks = np.array([how.ranks(max(1, n), q) for n, q in zip((hi - lo).tolist(), quantile)]).reshape(-1, 2)
        found = trailing.order_values(rows["_x"].to_numpy().astype(float), lo, hi, ranks)
        return [pa.array(hi - lo), *(pa.array(found[:, i], from_pandas=True) for i in (0, 1))]

    def shares(rows, lo, hi, wanted):
        return [pa.array(trailing.bin_counts(rows["_bin"].to_numpy(), lo, hi, 10).tolist(), pa.list_(pa.int64()))]

    budget = calibration.select(*keys, "budget_quantile")
    picked = trailing.over_last(
        clean, checks.join(budget, keys).select(*keys, "bucket", "upto", "budget_quantile"), keys, how.trailing, candidates,
        "n bigint, cand_t double, cand_r double",
    )
    binned_at = checks.select(*keys, "digest", "bucket", F.col("_seen").alias("upto"))
    drift = trailing.over_last(binned, binned_at, [*keys, "digest"], how.recent, shares, "bins array<bigint>")
    anchors = calibration.select(
        *keys, F.col("byte_threshold").alias("_at"), F.get("score_quantiles", F.lit(int(how.ref_pct))).alias("_ar")
    )
    steps = picked.select(*keys, "bucket", "n", "cand_t", "cand_r").join(
        drift.select(*keys, "bucket", "bins"), [*keys, "bucket"]
    ).join(anchors, keys)

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by("bucket")
        out, rows = [], table.to_pylist()
        t, r = rows[0]["_at"], rows[0]["_ar"]
        for row in rows:
            psi = psi_of(row["bins"]) if how.measures(row["bucket"]) else None
            use = how.applies(row["n"], psi)
            if use:
                t, r = how.moved(row["cand_t"], t, row["_at"]), how.moved(row["cand_r"], r, row["_ar"])
            out.append((psi, use, t, r))
        table = table.select([*keys, "bucket", "n"])
        for i, (name, kind) in enumerate((("psi", pa.float64()), ("applied", pa.bool_()), ("threshold", pa.float64()), ("reference", pa.float64()))):
            table = table.append_column(name, pa.array([row[i] for row in out], kind))
        return table

    kinds = ", ".join(f"`{k}` {calibration.schema[k].dataType.simpleString()}" for k in keys)
    return steps.groupBy(*keys).applyInArrow(
        fold, f"{kinds}, bucket bigint, n bigint, psi double, applied boolean, threshold double, reference double"
    )


def caveats(counts: DataFrame) -> DataFrame:
    """Notes on window numbers that are too small. ``counts`` has those of benign, attack, calibration and fit that
    an evaluation knows."""
    few = {
        "benign": [(F.col("benign") < MIN_CLASS_WINDOWS, "few benign windows")],
        "attack": [(F.col("attack") < MIN_CLASS_WINDOWS, "few attack windows")],
        "calibration": [(F.col("calibration") < 10, "calibration too short")],
        "fit": [(F.col("fit") < 100, "fit period too short"), ((F.col("fit") >= 100) & (F.col("fit") < 1000), "fit period short")],
    }
    notes = [F.when(when, F.lit(text)) for name, rules in few.items() if name in counts.columns for when, text in rules]
    if {"benign", "attack"} <= set(counts.columns):
        notes.append(F.when((F.col("benign") == 0) | (F.col("attack") == 0), F.lit("empty set")))
    return counts.withColumn("caveats", F.array_compact(F.array(*notes)))


def evt_thresholds(
    benign: DataFrame,
    keys: list[str],
    target_fpr: float,
    tail_quantile: float = 0.98,
    score: str = "score",
    grid: int = 64,
    passes: int = 5,
) -> DataFrame:
    """Peaks over threshold with a generalised Pareto tail, many series at once.

    With theta = shape / scale the likelihood has one free parameter:
    shape(theta) = mean(ln(1 + theta x)). A pass looks at a grid of theta and narrows around the
    best. The tail of a series within ``hotRows`` is one array in one task, which does all
    passes; a longer one is summed for all thetas of a pass at once, batch by batch.
    """
    t0 = quantiles(benign, keys, score, [tail_quantile], "_q").select(
        *keys, F.element_at("_q", 1).alias("t0")
    )
    sizes = benign.groupBy(*keys).agg(F.count(score).alias("n"))
    tail = cut(
        benign.join(t0, keys).where(F.col(score) > F.col("t0")).select(*keys, (F.col(score) - F.col("t0")).cast("double").alias("x"))
    )
    counts = tail.groupBy(*keys).agg(F.count("x").alias("num_tail_points")).where("num_tail_points >= 10")
    long_ = counts.where(F.col("num_tail_points") > limit(tail.sparkSession, HOT_ROWS))
    kinds = ", ".join(f"`{k}` {tail.schema[k].dataType.simpleString()}" for k in keys)

    def fit(table: pa.Table) -> pa.Table:
        x = table["x"].to_numpy()
        head = table.slice(0, 1 if len(x) >= 10 else 0).select(keys)
        shape = scale = 0.0
        if len(head):
            low, high, mean = -0.999 / x.max(), 5.0 / x.mean(), float(x.mean())
            for _ in range(passes):
                thetas = low + (high - low) * np.arange(grid + 1) / grid
                shapes = np.array([np.log1p(theta * x).mean() for theta in thetas])
                low, high, shape, scale = _narrowed(thetas, shapes, mean, grid)
        for name, value, kind in (("num_tail_points", len(x), pa.int64()), ("gpd_shape", shape, pa.float64()), ("gpd_scale", scale, pa.float64())):
            head = head.append_column(name, pa.array([value] * len(head), kind))
        return head

    fitted_schema = f"{kinds}, num_tail_points bigint, gpd_shape double, gpd_scale double"
    if long_.isEmpty():
        fitted = tail.groupBy(*keys).applyInArrow(fit, fitted_schema)
    else:
        hot = cut(long_)
        short = tail.join(F.broadcast(hot.select(*keys)), keys, "left_anti").groupBy(*keys).applyInArrow(fit, fitted_schema)
        fitted = short.unionByName(_fit_long(tail, hot, keys, kinds, grid, passes))
    joined = fitted.join(t0, keys).join(sizes, keys).where(F.col("n") >= 30)
    return joined.withColumn(
        "threshold",
        evt_threshold(F.col("t0"), F.col("gpd_shape"), F.col("gpd_scale"), F.col("n"), F.col("num_tail_points"), target_fpr),
    ).withColumn("tail_quantile", F.lit(tail_quantile)).withColumn("target_fpr", F.lit(target_fpr))


def _narrowed(thetas: np.ndarray, shapes: np.ndarray, mean: float, grid: int) -> tuple[float, float, float, float]:
    """Bounds of the next pass, and shape and scale of the likeliest theta; the highest of equals."""
    flat = np.abs(thetas) < 1e-9
    scales = np.where(flat, mean, shapes / np.where(flat, 1.0, thetas))
    value = -np.log(scales) - np.where(flat, 0.0, shapes) - 1
    best = len(thetas) - 1 - int(np.argmax(value[::-1]))
    width = (thetas[-1] - thetas[0]) * 2 / grid
    low, high = max(thetas[0], thetas[best] - width), min(thetas[-1], thetas[best] + width)
    return float(low), float(high), float(shapes[best]), float(scales[best])


def _fit_long(tail: DataFrame, hot: DataFrame, keys: list[str], kinds: str, grid: int, passes: int) -> DataFrame:
    """The fit of series too long for one task. There are few: each has over ``hotRows`` tail points."""
    rows = cut(tail.join(F.broadcast(hot.select(*keys)), keys, "left_semi"))
    span = rows.groupBy(*keys).agg(
        (-0.999 / F.max("x")).alias("low"), (5.0 / F.avg("x")).alias("high"), F.avg("x").alias("mean"), F.count("x").alias("num_tail_points")
    )
    span = cut(span.withColumn("shape", F.lit(0.0)).withColumn("scale", F.lit(0.0)))
    held = ["low", "high", "mean", "num_tail_points"]

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, part in pdf.groupby(keys, sort=False, dropna=False):
                low, high = part["low"].iloc[0], part["high"].iloc[0]
                x = part["x"].to_numpy()
                total = [np.log1p((low + (high - low) * i / grid) * x).sum() for i in range(grid + 1)]
                yield part[keys].iloc[:1].loc[lambda f: f.index.repeat(grid + 1)].assign(i=np.arange(grid + 1), s=total)

    def next_(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        low, high, mean, n = (table[c][0].as_py() for c in held)
        thetas = low + (high - low) * np.arange(grid + 1) / grid
        found = _narrowed(thetas, table["s"].to_numpy() / n, mean, grid)
        head = table.slice(0, 1).select([*keys, "mean", "num_tail_points"])
        for name, value in zip(("low", "high", "shape", "scale"), found):
            head = head.append_column(name, pa.array([value], pa.float64()))
        return head

    for _ in range(passes):
        bounds = F.broadcast(span.select(*keys, "low", "high"))
        total = rows.join(bounds, keys).mapInPandas(sums, f"{kinds}, i int, s double").groupBy(*keys, "i").agg(F.sum("s").alias("s"))
        span = cut(total.join(span.select(*keys, *held), keys).groupBy(*keys).applyInArrow(
            next_, f"{kinds}, mean double, num_tail_points bigint, low double, high double, shape double, scale double"
        ))
    return span.select(*keys, "num_tail_points", F.col("shape").alias("gpd_shape"), F.col("scale").alias("gpd_scale"))


def evt_threshold(t0: Column, shape: Column, scale: Column, n: Column, tail: Column, fpr: float) -> Column:
    """Score expected to be exceeded by a share ``fpr`` of benign windows."""
    share = n / tail * fpr
    return F.when(F.abs(shape) < 1e-6, t0 - scale * F.ln(share)).otherwise(
        t0 + scale / shape * (F.pow(share, -shape) - 1)
    )
