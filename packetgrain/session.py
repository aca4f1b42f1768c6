"""Session settings, scale limits and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Rows one window group or one grouped task may hold before it is split.
HOT_ROWS = ("packetgrain.hotRows", 2_000_000)
# Rows of one ordered fold chunk.
FOLD_ROWS = ("packetgrain.foldRows", 500_000)
# Rows a side may have to be broadcast.
BROADCAST_ROWS = ("packetgrain.broadcastRows", 1_000_000)
# Distinct (context, byte) entries a broadcast n-gram model may have.
MODEL_ROWS = ("packetgrain.modelRows", 8_000_000)


def limit(spark: SparkSession, setting: tuple[str, int]) -> int:
    name, default = setting
    return int(spark.conf.get(name, str(default)))


def local_session(cpus: str = "8", app: str = "packetgrain") -> SparkSession:
    """Session for tests and the local benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; one of our own only in local runs."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        folder = tempfile.mkdtemp(prefix="packetgrain-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and continue from its files.

    Used where several branches read one expensive intermediate, or where an iteration
    would grow the plan. The files survive the loss of an executor, later reads prune
    their columns, and unlike a checkpoint the work behind them runs only once.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame) -> bool:
    """True when ``df`` has been counted and is within the broadcast bound."""
    bound = limit(df.sparkSession, BROADCAST_ROWS)
    return df.limit(bound + 1).count() <= bound
