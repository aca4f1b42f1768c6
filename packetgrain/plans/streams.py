"""Streaming queries replayed over the supplied tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetgrain.plans import byte_streams, detection, thresholds
from packetgrain.plans.thresholds import EV
from packetgrain.sources import tables
from packetgrain.streaming import live, recalibration

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US
TURNS = 3


def _events(spark: SparkSession, folder: str) -> DataFrame:
    rows = live.source(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.select(
        "event_id", "ts", F.unix_micros("ts").alias("ts_us"), "user_id", "event_type", "value"
    )


def stream_rate(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly buckets closed by the watermark."""
    alerts = live.rate_alerts(_events(spark, folder), F.col("event_type") == "error", "1 hour", 4, "ts", "0 seconds")
    return live.run_available(alerts)


def stream_incidents(spark: SparkSession, folder: str) -> DataFrame:
    rows = _events(spark, folder).where(F.col("value") > 90).select("ts", F.col("event_type").alias("type"), F.col("value").alias("score"))
    return live.run_available(live.alert_sessions(rows, ["type"], "1 hour", "ts", "0 seconds"))


def _turns(spark: SparkSession, folder: str) -> tuple[DataFrame, Column]:
    """Events and the third of the month they are delivered in."""
    rows = tables.table(spark, folder, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        "user_id", "event_type", "value",
    )
    return rows, F.least(F.lit(TURNS - 1), F.floor((F.dayofmonth("ts") - 1) / 10))


def stream_flow_cusum(spark: SparkSession, folder: str) -> DataFrame:
    """Three turns; a user without events for two days starts from zero."""
    rows, turn = _turns(spark, folder)
    out = live.run_parts(rows, turn, TURNS, lambda stream: live.cusum_levels(
        stream.select("user_id", "event_id", "ts", "ts_us", (F.col("value") - 60.0).alias("step")), "user_id", 100.0
    ))
    return out.select("user_id", "event_id", F.round("level", 6).alias("level"), "alarm")


def stream_byte_alerts(spark: SparkSession, folder: str) -> DataFrame:
    """Learn on the first half in batch, then gate the stream against that table."""
    fitted = thresholds._calibration(spark, folder)
    rows = _events(spark, folder).select("event_id", F.col("event_type").alias("sensor"), F.col("value").alias("score"))
    out = live.run_available(live.byte_alerts(rows, fitted, ["sensor"]))
    return out.select("event_id", F.col("score_percentile").cast("long").alias("score_percentile"), "type")


def stream_flow_windows(spark: SparkSession, folder: str) -> DataFrame:
    turns = live.source(spark, folder, "conversations")
    packets = turns.select(
        F.col("conv_id").cast("string").alias("flow"), F.col("turn").alias("packet_index"), F.col("turn").alias("ts_us"),
        F.encode("text", "UTF-8").alias("data"),
    )
    out = live.run_available(live.flow_windows(packets, 128))
    return out.select(
        F.col("flow").cast("long").alias("conv_id"), "win_idx", F.col("ts_us").alias("first_turn"), F.md5(F.hex("bytes")).alias("digest")
    )


def stream_capture_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Pauses of over an hour within an event kind; cells still open are not yet seen."""
    rows = _events(spark, folder).select("ts", "event_type")
    out = live.capture_gaps(rows, "event_type", "ts", "1 hour", HOUR_US, "0 seconds")
    return live.run_available(out)


def stream_syn_flood(spark: SparkSession, folder: str) -> DataFrame:
    """``syn_flood_trailing`` over three turns, spans across their bounds included."""
    rows, turn = _turns(spark, folder)
    syns = rows.where("event_type = 'error'")
    return live.run_parts(syns, turn, TURNS, lambda stream: live.syn_floods(stream, "user_id", 2, DAY_US, "event_id"))


def stream_recalibration(spark: SparkSession, folder: str) -> DataFrame:
    """``adaptive_thresholds`` over three turns; each sensor's last interval is still open."""
    rows, turn = _turns(spark, folder)
    live_rows = rows.select(
        F.col("event_type").alias("sensor"), "event_id", "ts", "ts_us", F.col("value").alias("score"), (F.col("value") > 250).alias("flagged")
    )
    fitted = thresholds._calibration(spark, folder).withColumn("budget_quantile", F.lit(0.98))
    out = live.run_parts(live_rows, turn, TURNS, lambda stream: recalibration.recalibration(
        stream, fitted, "sensor", thresholds.RECALIBRATION
    ))
    return out.select(*thresholds._rounded(out, ["psi", "threshold", "reference"]))


def stream_late_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Five turns of six days, a watermark of a day. Every tenth event comes again in its turn, every 37th only two turns
    late, every 41st again one turn later: daily counts of what is taken."""
    rows, _ = _turns(spark, folder)
    own = F.floor((F.dayofmonth("ts") - 1) / 6)
    turns = F.concat(
        F.array(F.when(F.col("event_id") % 37 == 0, F.least(own + 2, F.lit(5))).otherwise(own)),
        F.when(F.col("event_id") % 10 == 0, F.array(own)).otherwise(F.array().cast("array<bigint>")),
        F.when(F.col("event_id") % 41 == 0, F.array(own + 1)).otherwise(F.array().cast("array<bigint>")),
    )
    sent = rows.withColumn("turn", F.explode(turns)).withColumn("copy", F.monotonically_increasing_id())
    taken = live.run_parts(sent, F.col("turn"), 6, lambda stream: live.rate_alerts(
        live.once(stream, ["event_id"], "ts", "1 day"), F.lit(True), "1 day", 0, "ts", None
    ))
    return taken.withColumnRenamed("syns", "taken")


QUERIES = {
    name: globals()[name]
    for name in ("stream_rate", "stream_incidents", "stream_flow_cusum", "stream_byte_alerts", "stream_flow_windows", "stream_capture_gaps",
                 "stream_syn_flood", "stream_recalibration", "stream_late_rows")
}

# A window or session is out once its end is not after the watermark, which counts in milliseconds.
ORACLE = {
    "stream_rate": f"""
WITH {EV},
wm AS (SELECT max(ts_us) // 1000 * 1000 AS w FROM ev WHERE event_type = 'error')
SELECT ts_us // {HOUR_US} * {HOUR_US} AS bucket_us, count(*) AS syns FROM ev, wm WHERE event_type = 'error'
GROUP BY 1, w HAVING count(*) > 4 AND bucket_us + {HOUR_US} <= w""",
    "stream_incidents": f"""
WITH {EV},
al AS (SELECT event_id, ts_us, event_type AS type, value AS score FROM ev WHERE value > 90),
wm AS (SELECT max(ts_us) // 1000 * 1000 AS w FROM al),
lg AS (SELECT *, coalesce(ts_us - lag(ts_us) OVER (PARTITION BY type ORDER BY ts_us, event_id) > {HOUR_US}, true)::INT AS f FROM al),
nb AS (SELECT *, sum(f) OVER (PARTITION BY type ORDER BY ts_us, event_id ROWS UNBOUNDED PRECEDING) AS g FROM lg)
SELECT type, min(ts_us) AS first_us, max(ts_us) AS last_us, count(*) AS raw_alerts, max(score) AS peak_score
FROM nb, wm GROUP BY type, g, w HAVING max(ts_us) + {HOUR_US} <= w""",
    "stream_capture_gaps": f"""
WITH {EV},
wm AS (SELECT max(ts_us) // 1000 * 1000 AS w FROM ev),
g AS (
  SELECT event_type, ts_us, lag(ts_us) OVER (PARTITION BY event_type ORDER BY ts_us) AS p
  FROM ev, wm WHERE (ts_us // {HOUR_US} + 1) * {HOUR_US} <= w)
SELECT event_type, p AS opened_us, ts_us AS closed_us, round_even((ts_us - p) / 1e6, 0)::BIGINT AS gap_seconds
FROM g WHERE ts_us - p > {HOUR_US}""",
    "stream_flow_cusum": f"""
WITH RECURSIVE {EV},
st AS (SELECT user_id AS series, event_id, value - 60.0::DOUBLE AS d,
              row_number() OVER w AS i, coalesce(ts_us - lag(ts_us) OVER w > {2 * DAY_US}, false) AS fresh
       FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts_us, event_id)),
fold AS (
  SELECT series, 0::BIGINT AS i, 0::BIGINT AS event_id, 0.0::DOUBLE AS s, 0.0::DOUBLE AS level FROM (SELECT DISTINCT series FROM st)
  UNION ALL
  SELECT series, i, event_id, CASE WHEN l > 100.0 THEN 0.0 ELSE l END, l
  FROM (SELECT st.series, st.i, st.event_id, greatest(0.0, 0.98::DOUBLE * CASE WHEN fresh THEN 0.0 ELSE f.s END + st.d) AS l
        FROM fold f JOIN st ON st.series = f.series AND st.i = f.i + 1))
SELECT series AS user_id, event_id, round(level, 6) AS level, level > 100.0 AS alarm FROM fold WHERE i > 0""",
    "stream_byte_alerts": f"""
WITH {thresholds._CAL},
g AS (
  SELECT event_id, least(100, len(list_filter(q, lambda x: x < value))) AS score_percentile,
         list_concat(CASE WHEN value > thr THEN ['BYTE'] ELSE [] END,
                     CASE WHEN value > round(thr + 3.0, 4) THEN ['CRITICAL_BYTE'] ELSE [] END) AS t
  FROM ev JOIN calt ON sensor = event_type)
SELECT event_id, score_percentile, unnest(t) AS type FROM g""",
    "stream_flow_windows": byte_streams.ORACLE["flow_windows"],
    "stream_syn_flood": detection.ORACLE["syn_flood_trailing"],
    "stream_recalibration": f"""
WITH RECURSIVE {thresholds._ADAPT}
SELECT sensor, bucket, n, round(psi, 6) AS psi, applied, round(t, 6) AS threshold, round(r, 6) AS reference
FROM f JOIN (SELECT sensor, max(bucket) AS top FROM ck GROUP BY sensor) USING (sensor) WHERE i > 0 AND bucket < top""",
    # A turn drops what is not after the watermark its predecessors have left.
    "stream_late_rows": f"""
WITH {EV},
o AS (SELECT event_id, ts_us, (day(ts) - 1) // 6 AS own FROM (SELECT ev.*, make_timestamp(ts_us) AS ts FROM ev)),
s AS (
  SELECT event_id, ts_us, unnest(list_concat(
    [CASE WHEN event_id % 37 = 0 THEN least(own + 2, 5) ELSE own END],
    CASE WHEN event_id % 10 = 0 THEN [own] ELSE [] END, CASE WHEN event_id % 41 = 0 THEN [own + 1] ELSE [] END)) AS turn
  FROM o),
tops AS (SELECT turn, max(ts_us) AS top FROM s GROUP BY turn),
wm AS (SELECT t.turn, max(p.top) // 1000 * 1000 - {DAY_US} AS mark FROM tops t LEFT JOIN tops p ON p.turn < t.turn GROUP BY t.turn),
k AS (SELECT DISTINCT event_id, ts_us FROM s JOIN wm USING (turn) WHERE ts_us > coalesce(mark, 0)),
fin AS (SELECT max(top) // 1000 * 1000 - {DAY_US} AS mark FROM tops)
SELECT ts_us // {DAY_US} * {DAY_US} AS bucket_us, count(*) AS taken FROM k, fin GROUP BY 1, mark HAVING bucket_us + {DAY_US} <= mark""",
}
