"""The supplied tables bound to the packet, byte-stream and score shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    # Stored timestamps carry no zone; every cast below must read them as UTC.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores when a scan has fewer splits than there are; large scans pass through."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Packet-like rows: time in microseconds, source, port-like ``k``, kind and size."""
    return table(spark, folder, "events").select(
        "event_id",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        "user_id",
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def packet_meta(spark: SparkSession, folder: str) -> DataFrame:
    """D3 rows: ``error`` events stand for bare SYN packets, ``value`` for the size."""
    return events(spark, folder).select(
        "event_id",
        "ts_us",
        F.format_string("10.0.%d.%d", F.floor(F.col("user_id") / 256), F.col("user_id") % 256).alias("src"),
        F.format_string("192.168.0.%d", F.col("k")).alias("dst"),
        F.col("k").alias("dport"),
        F.col("event_type").alias("proto"),
        F.floor(F.col("value")).cast("long").alias("size"),
        (F.col("event_type") == "error").alias("is_syn"),
    )


def scores(spark: SparkSession, folder: str) -> DataFrame:
    """Score series: one per user, ordered by time."""
    return events(spark, folder).select(
        F.col("user_id").alias("series"), "event_id", "ts_us", F.col("value").alias("score")
    )


def byte_streams(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as byte streams with their class: 1 attack, 0 benign, null holdout."""
    docs = spread(table(spark, folder, "documents")).select(
        "doc_id", "source", F.encode("text", "UTF-8").alias("data")
    )
    labels = table(spark, folder, "labels").select("doc_id", F.col("toxic").alias("label"))
    return docs.join(labels, "doc_id", "left")
