"""Volumetric detection from SYN counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetgrain.operators.ordering import running

# Fixed values of the detectors.
FLOOD_SYNS = 50
FLOOD_SPAN_US = 1_000_000
LIVE_BUCKET_US = 100_000
LIVE_SYNS = 75


def trailing_counts(
    packets: DataFrame, keys: list[str], span_us: int, ts: str = "ts_us", tie: str = "packet_index", name: str = "in_span"
) -> DataFrame:
    """Packets of the key in the trailing span, up to and including the row itself.

    Each packet enters the count at its time and leaves it just after the span, so the
    answer is one running sum over entries and exits; equal times count in row order.
    """
    enter = packets.withColumn("_at", F.col(ts)).withColumn("_d", F.lit(1)).withColumn("_k", F.lit(1))
    leave = packets.withColumn("_at", F.col(ts) + span_us + 1).withColumn("_d", F.lit(-1)).withColumn("_k", F.lit(0))
    # Exits sort before entries of the same microsecond.
    order = [F.col("_at"), F.col("_k"), F.col(tie)]
    counted = running(enter.unionByName(leave), keys, order, {name: ("sum", F.col("_d"))})
    return counted.where(F.col("_k") == 1).drop("_at", "_d", "_k")


def syn_floods(syns: DataFrame, keys: list[str], limit: int = FLOOD_SYNS, span_us: int = FLOOD_SPAN_US, ts: str = "ts_us", tie: str = "packet_index") -> DataFrame:
    """A source is flagged at every SYN that makes more than ``limit`` in the span."""
    return trailing_counts(syns, keys, span_us, ts, tie, "syns").withColumn("flood", F.col("syns") > limit)


def bucket_rates(
    packets: DataFrame, capture: list[str], src: str, syn: Column, span_us: int, whole_seconds: bool = False, ts: str = "ts_us"
) -> DataFrame:
    """Per bucket the highest SYN count of one source; buckets without SYN are absent."""
    first = packets.groupBy(*capture).agg(F.min(ts).alias("_first"))
    syns = packets.where(syn).join(first, capture)
    elapsed = F.col(ts) - F.col("_first")
    if whole_seconds:
        elapsed = (F.floor(F.col(ts) / 1_000_000) - F.floor(F.col("_first") / 1_000_000)) * 1_000_000
    per = syns.groupBy(*capture, "_first", F.floor(elapsed / span_us).alias("bucket"), src).agg(
        F.count(F.lit(1)).alias("n")
    )
    return per.groupBy(*capture, "_first", "bucket").agg(F.max("n").alias("score")).select(
        *capture, "bucket", (F.col("_first") + F.col("bucket") * span_us).alias("bucket_us"), "score"
    )


def rate_threshold(fit: DataFrame, all_buckets: DataFrame, keys: list[str], alarms_per_10k: float) -> DataFrame:
    """The smallest whole threshold from 1 whose fit exceedances stay within budget.

    Exceedances only fall as the threshold rises, so the answer is read off the running
    counts of the distinct scores. Below the lowest fit score all fit buckets exceed; a key
    without fit buckets has no exceedance at all, so its threshold is 1.
    """
    sizes = fit.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    share = alarms_per_10k / 10000.0
    counted = fit.groupBy(*keys, "score").agg(F.count(F.lit(1)).alias("_n"))
    above = running(counted, keys, [-F.col("score")], {"_above": ("sum", F.col("_n"))}, inclusive=False)
    # A distinct score v qualifies as threshold when the scores above it fit the budget.
    ok = above.join(sizes, keys).where(F.coalesce("_above", F.lit(0)) <= share * F.col("_size"))
    lowest = ok.groupBy(*keys).agg(F.greatest(F.lit(1), F.min("score")).alias("threshold"))
    top = all_buckets.groupBy(*keys).agg((F.max("score") + 1).alias("_top"))
    size = F.coalesce("_size", F.lit(0))
    found = F.when(size <= share * size, F.lit(1)).otherwise(F.coalesce("threshold", "_top"))
    return top.join(sizes, keys, "left").join(lowest, keys, "left").select(
        *keys, found.cast("double").alias("threshold")
    )


def live_rate_alerts(
    packets: DataFrame, keys: list[str], syn: Column, bucket_us: int = LIVE_BUCKET_US, limit: int = LIVE_SYNS, ts: str = "ts_us"
) -> DataFrame:
    """SYNs of all sources per tumbling bucket above the limit."""
    per = packets.where(syn).groupBy(*keys, F.floor(F.col(ts) / bucket_us).alias("bucket")).agg(
        F.count(F.lit(1)).alias("syns")
    )
    return per.where(F.col("syns") > limit).withColumn("bucket_us", F.col("bucket") * bucket_us)
