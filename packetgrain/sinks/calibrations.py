"""K7: calibrations of all sensors as whole versions in Parquet, with conditional writes.

A version is a complete table of one row per sensor and knows how many rows it has and who wrote it. A reader takes the
newest version that is complete, so it never sees half of one. Two writers that start from one version write the same
number; the smaller writer name holds for every reader, and the other one learns that it has lost.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetgrain.session import cut

MARKS = ["version", "writer", "rows"]


class Conflict(RuntimeError):
    """Another writer has published a version first."""


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.option("mergeSchema", True).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _newest(stored: DataFrame) -> tuple[int, str] | None:
    whole = stored.groupBy(*MARKS).count().where("count = rows")
    found = whole.orderBy(F.desc("version"), "writer").first()
    return (found["version"], found["writer"]) if found else None


def latest(spark: SparkSession, path: str) -> tuple[int, DataFrame | None]:
    """Number and rows of the newest whole version; 0 and None for an empty store."""
    stored = _stored(spark, path)
    newest = None if stored is None else _newest(stored)
    if newest is None:
        return 0, None
    rows = stored.where((F.col("version") == newest[0]) & (F.col("writer") == newest[1]))
    return newest[0], rows.drop(*MARKS)


def publish(rows: DataFrame, path: str, expected: int) -> int:
    """Write all sensors' ``rows`` as the version after ``expected``; ``Conflict`` where that is not the newest."""
    spark = rows.sparkSession
    rows = cut(rows)
    if latest(spark, path)[0] != expected:
        raise Conflict(f"the store has moved on from version {expected}")
    writer = uuid.uuid4().hex
    marked = rows.withColumn("writer", F.lit(writer)).withColumn("rows", F.lit(rows.count()))
    marked.withColumn("version", F.lit(expected + 1)).write.mode("append").partitionBy("version").parquet(path)
    if _newest(_stored(spark, path)) != (expected + 1, writer):
        raise Conflict(f"another writer has published version {expected + 1}")
    return expected + 1


def adapt(changes: DataFrame, path: str, keys: list[str], tries: int = 5) -> int:
    """Set byte_threshold of the sensors in ``changes(keys…, threshold, reference)``; the anchor and all else stay.

    Reads, merges and publishes again where another writer was first. Returns the version that holds the change.
    """
    changes = cut(changes.select(*keys, "threshold", "reference"))
    version, rows = latest(changes.sparkSession, path)
    if rows is None:
        raise ValueError(f"no calibration to adapt in {path}")
    if changes.isEmpty():
        return version
    for _ in range(tries):
        known = rows
        for name, kind in (("adapted_ref", "double"), ("adapted_at", "string")):
            if name not in known.columns:
                known = known.withColumn(name, F.lit(None).cast(kind))
        now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
        new = F.col("threshold").isNotNull()
        merged = known.join(changes, keys, "left").select(
            *[
                F.when(new, F.round("threshold", 4)).otherwise(F.col(c)).alias(c) if c == "byte_threshold"
                else F.when(new, F.round("reference", 4)).otherwise(F.col(c)).alias(c) if c == "adapted_ref"
                else F.when(new, now).otherwise(F.col(c)).alias(c) if c == "adapted_at"
                else F.col(c)
                for c in known.columns
            ]
        )
        try:
            return publish(merged, path, version)
        except Conflict:
            version, rows = latest(changes.sparkSession, path)
    raise Conflict(f"no turn to write in {tries} tries")
