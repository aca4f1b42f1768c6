"""Window scores from per-byte bits, corrections, patches and model quality."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_PATCH = 64
MIN_PROBABILITY = 1e-9


def score_with(windows: DataFrame, scorer: Callable[[list[bytes]], list[np.ndarray]], data: str = "bytes") -> DataFrame:
    """M5: bits per byte from a user's model.

    ``scorer`` gets the byte strings of one Arrow batch and returns an array of bits per
    predicted byte for each; this is where a trained network plugs in.
    """
    schema = T.StructType([*windows.schema.fields, T.StructField("bits", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bits = [np.asarray(b, float) for b in scorer(list(pdf[data]))]
            yield pdf.assign(bits=bits)

    return windows.mapInPandas(run, schema)


def window_score(bits: Column, how: str, width: int, topk_frac: float = 0.1) -> Column:
    """M4: mean, max or top-k of a window's bits; NaN and null entries are padding.

    ``topk`` takes k of the full width and averages what is valid of it. A window
    without a valid byte scores null and is to be dropped.
    """
    valid = F.filter(bits, lambda b: b.isNotNull() & ~F.isnan(b))
    if how == "max":
        return F.array_max(valid)
    if how == "topk":
        k = max(1, min(width, round(topk_frac * width)))
        valid = F.slice(F.sort_array(valid, asc=False), 1, k)
    elif how != "mean":
        raise ValueError(f"unknown window score {how}")
    total = F.aggregate(valid, F.lit(0.0), lambda a, b: a + b)
    return F.when(F.size(valid) > 0, total / F.size(valid))


def window_scores(bits: list[np.ndarray], width: int, topk_frac: float = 0.1) -> pd.DataFrame:
    """M4 for a batch: mean, max and topk of every window's valid bits, each as ``window_score`` has it; NaN without any."""
    size = np.fromiter(map(len, bits), np.int64, len(bits))
    grid = np.full((len(bits), int(size.max(initial=0))), np.nan)
    grid[np.arange(grid.shape[1]) < size[:, None]] = np.concatenate([np.zeros(0), *bits])
    valid = ~np.isnan(grid)
    count = valid.sum(axis=1)
    k = max(1, min(width, round(topk_frac * width)))
    # Padding sorts behind every number.
    low = -np.where(valid, grid, -np.inf)
    if k < grid.shape[1]:
        low = np.partition(low, k - 1, axis=1)[:, :k]
    some = np.where(count > 0, count, np.nan)
    return pd.DataFrame({
        "mean": np.where(valid, grid, 0.0).sum(axis=1) / some,
        "max": np.where(count > 0, -low.min(axis=1, initial=np.inf), np.nan),
        "topk": -np.where(np.isinf(low), 0.0, low).sum(axis=1) / np.minimum(some, k),
    })


def packet_surprise(probabilities: Column, threshold: float = 5.5) -> Column:
    """M6: mean and highest bits of a packet from its target probabilities."""
    bits = F.transform(probabilities, lambda p: -F.log2(F.greatest(p, F.lit(MIN_PROBABILITY))))
    mean = F.aggregate(bits, F.lit(0.0), lambda a, b: a + b) / F.size(bits)
    return F.struct(
        mean.alias("mean_bits"), F.array_max(bits).alias("max_bits"), (mean > threshold).alias("anomalous")
    )


@F.pandas_udf(T.DoubleType())
def code_length(data: pd.Series) -> pd.Series:
    """M7: bits per byte of an ideal order-1 code fitted to the window itself."""

    def one(raw):
        b = np.frombuffer(raw, np.uint8).astype(np.int64)
        if len(b) < 2:
            return 0.0
        pair = b[:-1] * 256 + b[1:]
        values, n = np.unique(pair, return_counts=True)
        total = np.bincount(b[:-1], minlength=256)[values >> 8]
        return float(-(n * np.log2(n / total)).sum() / len(b))

    return data.map(one)


def compressor_bits(compress: Callable[[bytes], bytes]):
    """M7: bits per byte under a user's compressor, such as ``lambda b: zlib.compress(b, 6)``."""

    @F.pandas_udf(T.DoubleType())
    def ratio(data: pd.Series) -> pd.Series:
        return data.map(lambda raw: 8.0 * len(compress(raw)) / max(1, len(raw)))

    return ratio


def corrected(windows: DataFrame, score: str = "score", length: str = "complexity") -> DataFrame:
    """M8: the score less the window's own code length."""
    return windows.withColumn("corrected", F.col(score) - F.col(length))


def typicality(scores: DataFrame, calibration: Column, score: str = "score") -> DataFrame:
    """M9: distance from the mean of the benign calibration rows, for all sets."""
    mean = scores.where(calibration).agg(F.avg(score).alias("_mean")).withColumn("_one", F.lit(1))
    # The mean is one row.
    return scores.withColumn("_one", F.lit(1)).join(F.broadcast(mean), "_one").withColumn(
        "typicality", F.abs(F.col(score) - F.col("_mean"))
    ).drop("_one", "_mean")


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def patch_lengths(spikes: pd.Series) -> pd.Series:
    """Lengths of patches that end after a spike or at the size limit.

    A stretch between spikes is full patches and what is left of it.
    """

    def one(flags):
        if flags is None:
            return None
        ends = np.flatnonzero(np.asarray(flags, bool)) + 1
        edges = np.unique(np.concatenate([[0], ends, [len(flags)]]))
        stretch = np.diff(edges)
        full, rest = stretch // MAX_PATCH, stretch % MAX_PATCH
        pieces = full + (rest > 0)
        out = np.full(int(pieces.sum()), MAX_PATCH, np.int32)
        last = pieces.cumsum() - 1
        out[last[rest > 0]] = rest[rest > 0]
        return out

    return spikes.map(one)


def patch_statistics(lengths: Column) -> Column:
    """Count, mean, extremes and cumulative boundaries of a window's patches.

    ``lengths`` must be a plain column, as the result reads it several times.
    """
    total = F.aggregate(lengths, F.lit(0), lambda a, b: a + b)
    ends = F.transform(
        F.sequence(F.lit(1), F.size(lengths)),
        lambda i: F.aggregate(F.slice(lengths, F.lit(1), i), F.lit(0), lambda a, b: a + b),
    )
    return F.struct(
        F.size(lengths).alias("patches"), (total / F.size(lengths)).alias("mean_len"),
        F.array_min(lengths).alias("min_len"), F.array_max(lengths).alias("max_len"), ends.alias("ends"),
    )


def focal_loss(p: Column, gamma: float = 2.0) -> Column:
    """Focal loss of the target's probability; gamma 0 is cross entropy."""
    return -F.pow(1 - p, F.lit(float(gamma))) * F.ln(p)


def mean_loss(positions: DataFrame, keys: list[str], p: str = "p", gamma: float = 0.0, byte: str = "byte") -> DataFrame:
    """Mean loss per data set over non-pad positions; 0 when all are padding."""
    kept = F.when(F.col(byte) >= 0, focal_loss(F.col(p), gamma))
    return positions.groupBy(*keys).agg(F.coalesce(F.avg(kept), F.lit(0.0)).alias("loss"))


def generalisation_gap(losses: DataFrame, split: str = "split") -> DataFrame:
    """Validation loss less training loss. The result is one row."""
    return losses.agg(
        (
            F.max(F.when(F.col(split) == "validation", F.col("loss")))
            - F.max(F.when(F.col(split) == "train", F.col("loss")))
        ).alias("gap")
    )


def heatmap(bits: Column, bytes_: Column, columns: int = 32) -> Column:
    """Grid cells of a flagged window; bits[i] is the surprise of byte i + 1."""
    return F.transform(
        bits,
        lambda b, i: F.struct(
            F.floor(i / columns).cast("int").alias("row"), (i % columns).alias("column"),
            F.get(bytes_, i + 1).alias("byte"), F.round(b, 2).alias("bits"),
            F.least(F.lit(1.0), F.greatest(F.lit(0.0), b / 8.0)).alias("intensity"),
        ),
    )


def scan_alerts(scored: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    """A line per packet of a scan that reaches the threshold."""
    return scored.where(F.col(score) >= threshold).select(
        (F.col("ts_us") / 1e6).alias("timestamp"), "packet_index", F.length("data").alias("pkt_len"),
        F.round(score, 4).alias("surprise_bits"), F.lit(threshold).alias("threshold"), F.lit("ALERT").alias("status"),
    )


def scan_summary(scored: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    """Packets and anomalies of a scan; here the threshold itself counts."""
    return scored.agg(
        F.count(F.lit(1)).alias("packets"), F.count_if(F.col(score) >= threshold).alias("anomalies")
    )
