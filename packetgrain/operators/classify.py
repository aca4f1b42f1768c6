"""Supervised classes over window features."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetgrain.operators.ordering import row_index


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def byte_histogram(data: pd.Series) -> pd.Series:
    """Share of each byte value in a window."""
    parts = [raw or b"" for raw in data]
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    cell = np.repeat(np.arange(len(parts)) * 256, size) + np.frombuffer(b"".join(parts), np.uint8)
    counts = np.bincount(cell, minlength=256 * len(parts)).reshape(-1, 256)
    return pd.Series(list(counts / np.maximum(size, 1)[:, None]))


def assemble(sources: dict[str, DataFrame | None]) -> DataFrame:
    """One labelled source per class; missing ones are skipped, ids have no holes."""
    present = [(name, df) for name, df in sources.items() if df is not None]
    out = None
    for label, (name, df) in enumerate(present):
        one = df.withColumn("class", F.lit(name)).withColumn("label", F.lit(label))
        out = one if out is None else out.unionByName(one)
    return out


def stratified_split(df: DataFrame, label: str, seed: int = 42, share: float = 0.2, tie: str = "vec_id") -> DataFrame:
    """Mark ``share`` of each class as test rows, in an order drawn from the seed."""
    drawn = df.withColumn("_draw", F.xxhash64(F.lit(seed), F.col(tie)).cast("double"))
    placed = row_index(drawn, [label], [F.col("_draw"), F.col(tie)], "_at")
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    return placed.join(sizes, label).withColumn(
        "test", F.col("_at") < F.round(F.col("_n") * share)
    ).drop("_draw", "_at", "_n")


def fit_forest(train: DataFrame, features: str, label: str, seed: int = 42):
    """100 trees of depth 12; at least two classes are needed."""
    if train.select(label).distinct().limit(2).count() < 2:
        raise ValueError("a classifier needs at least two classes")
    ready = train.withColumn("_features", array_to_vector(F.col(features).cast("array<double>")))
    forest = RandomForestClassifier(
        featuresCol="_features", labelCol=label, numTrees=100, maxDepth=12, seed=seed
    )
    return forest.fit(ready)


def predict(model, df: DataFrame, features: str) -> DataFrame:
    ready = df.withColumn("_features", array_to_vector(F.col(features).cast("array<double>")))
    return model.transform(ready).drop("_features", "rawPrediction", "probability")


def report(predicted: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy and per-class precision, recall, F1 and support.

    The pairs are counted first; everything else works on the confusion counts, whose
    size is the square of the number of classes.
    """
    pairs = predicted.groupBy(
        F.col(label).cast("long").alias("truth"), F.col(prediction).cast("long").alias("guess")
    ).agg(F.count(F.lit(1)).alias("n"))
    truth = pairs.groupBy(F.col("truth").alias("class")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0)).alias("hit")
    )
    guess = pairs.groupBy(F.col("guess").alias("class")).agg(F.sum("n").alias("named"))
    both = truth.join(guess, "class", "left")
    precision = F.coalesce(F.try_divide("hit", "named"), F.lit(0.0))
    recall = F.try_divide("hit", "support")
    scored = both.withColumn("precision", precision).withColumn("recall", recall).withColumn(
        "f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    )
    everyone = Window.partitionBy(F.lit(0))
    return scored.withColumn(
        "accuracy", F.sum("hit").over(everyone) / F.sum("support").over(everyone)
    ).drop("hit", "named")
