"""Attack schedules of capture days."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "day string, name string, start string, end string"

# The published attack times of a public capture week, local clock.
DAYS = {
    "tuesday": [("FTP-Patator", "09:20", "10:20"), ("SSH-Patator", "14:00", "15:00")],
    "wednesday": [
        ("DoS-slowloris", "09:47", "10:10"),
        ("DoS-Slowhttptest", "10:14", "10:35"),
        ("DoS-Hulk", "10:43", "11:00"),
        ("DoS-GoldenEye", "11:10", "11:23"),
        ("Heartbleed", "15:12", "15:32"),
    ],
    "thursday": [
        ("Web-BruteForce", "09:20", "10:00"),
        ("Web-XSS", "10:15", "10:35"),
        ("Web-SQLi", "10:40", "10:42"),
        ("Infiltration", "14:19", "15:45"),
    ],
    "friday": [
        ("Botnet-ARES", "10:02", "11:02"),
        ("PortScan", "13:55", "15:29"),
        ("DDoS-LOIT", "15:56", "16:16"),
    ],
}


def schedule(spark: SparkSession, day: str | None = None, path: str | None = None) -> DataFrame:
    """One built-in day, all of them, or a JSON list of name, start and end."""
    if path is not None:
        return spark.read.schema("name string, start string, end string").json(path, multiLine=True)
    rows = [(d, *row) for d, listed in DAYS.items() if day in (None, d) for row in listed]
    return spark.createDataFrame(rows, SCHEMA)
