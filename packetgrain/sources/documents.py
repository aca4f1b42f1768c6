"""Ground-truth flows, metrics documents, calibration and leaderboard files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Positions in the headerless 49-column flow table and protocol numbers.
FLOW_COLUMNS = {0: "srcip", 1: "sport", 2: "dstip", 3: "dsport", 4: "proto", 28: "stime", 29: "ltime", 47: "attack_cat", 48: "label"}
WIDTH = 49
PROTOCOLS = {"tcp": 6, "udp": 17, "icmp": 1}


def based_integer(text: Column) -> Column:
    """Port text in decimal or with a 0x, 0o or 0b prefix; null when it is no number."""
    t = F.lower(F.trim(text))
    return (
        F.when(t.rlike("^0x[0-9a-f]+$"), F.conv(F.substring(t, 3, 16), 16, 10))
        .when(t.rlike("^0o[0-7]+$"), F.conv(F.substring(t, 3, 22), 8, 10))
        .when(t.rlike("^0b[01]+$"), F.conv(F.substring(t, 3, 64), 2, 10))
        .when(t.rlike("^(0+|[1-9][0-9]*)$"), t)
    ).cast("long")


def attack_flows(spark: SparkSession, path: str) -> DataFrame:
    """Labelled attack flows; short rows, unknown protocols and bad numbers are skipped.

    ``ordinal`` keeps the order of file and row, which decides between matching flows.
    """
    schema = ", ".join(f"c{i} string" for i in range(WIDTH))
    rows = (
        spark.read.schema(schema).option("mode", "PERMISSIVE").csv(path)
        .select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
        .withColumn("_row", F.monotonically_increasing_id())
    )
    named = rows.select(*[F.col(f"c{i}").alias(n) for i, n in FLOW_COLUMNS.items()], "_file", "_block", "_row")
    number = F.create_map(*[F.lit(x) for pair in PROTOCOLS.items() for x in pair])
    proto = F.try_element_at(number, F.lower(F.trim("proto")))
    cat = F.lower(F.trim("attack_cat"))

    def port(name: str) -> Column:
        return F.when(F.coalesce(F.trim(name), F.lit("")) == "", F.lit(0).cast("long")).otherwise(based_integer(F.col(name)))

    out = named.where(F.trim("label") == "1").select(
        F.trim("srcip").alias("srcip"), port("sport").alias("sport"), F.trim("dstip").alias("dstip"),
        port("dsport").alias("dsport"), proto.alias("proto"),
        F.floor(F.trim("stime").try_cast("double")).alias("stime"), F.floor(F.trim("ltime").try_cast("double")).alias("ltime"),
        F.when(F.coalesce(cat, F.lit("")) == "", "unknown").otherwise(cat).alias("cat"),
        F.struct("_file", "_block", "_row").alias("ordinal"),
    )
    return out.dropna(subset=["sport", "dsport", "proto", "stime", "ltime"])


def metrics(spark: SparkSession, path: str, schema: str | StructType | None = None, lines: bool = False) -> DataFrame:
    """Nested metrics documents, one per file or one per line."""
    reader = spark.read.option("multiLine", not lines).option("recursiveFileLookup", "true")
    return (reader.schema(schema) if schema else reader).json(path)


def calibrations(spark: SparkSession, path: str, metric: str) -> DataFrame:
    """Stored calibration rows of the metric in use; others are stale."""
    return spark.read.parquet(path).where((F.col("score_metric") == metric) & F.col("byte_threshold").isNotNull())


def leaderboard(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Earlier results; a blank or odd number is null."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    rows = spark.read.schema(schema).csv(path, header=True)
    texts = {"timestamp", "checkpoint", "status", "eligible", "note"}
    return rows.select(*[F.col(c) if c in texts else F.trim(c).try_cast("double").alias(c) for c in columns])
