"""The connected capture pipeline over frames built from the events: few hosts and ports, so that flows fill windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetgrain.operators import windows
from packetgrain.plans import frames
from packetgrain.sources.tables import events
from packetgrain.streaming import chain, live

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US
TURNS = 2
# Limits by the entropy of these frames; hours and days in place of the live detector's seconds and minutes.
SETTINGS = chain.Settings(
    threshold=1.85, gold=1.98, reference=1.75, flow_h=0.2, target_h=0.3, width=256, idle_us=DAY_US, ttl_us=DAY_US,
    syn_bucket_us=HOUR_US, syn_limit=5, gap_us=HOUR_US,
)
NAMED = ("Packetgrain Sensor", "Anomaly Detection", "byte_entropy")


def _frames(spark: SparkSession, folder: str) -> DataFrame:
    rows = events(spark, folder).select(
        "event_id", "ts_us", "event_type", (F.col("user_id") % 8).alias("user_id"), (F.col("k") % 3 * 20).alias("k"), F.lit(100.0).alias("value")
    )
    data = F.unhex(F.expr(frames._frame(False)))
    return rows.select(F.lit("tap").alias("capture"), F.col("event_id").alias("packet_index"), "ts_us", data.alias("data"))


def _entropy():
    return windows.byte_entropy("bytes")


def _flat(out: DataFrame) -> DataFrame:
    r = "record."
    return out.select(
        "capture", "type", "state", "first_us", "last_us", "raw_alerts",
        F.col(r + "timestamp"), F.col(r + "src_ip"), F.col(r + "dest_ip"), F.col(r + "dest_port"), F.col(r + "alert.signature_id"),
        F.col(r + "alert.severity"), F.col(r + "alert.metadata.message"), F.round(F.col(r + "alert.metadata.score"), 3).alias("score"),
        F.col(r + "alert.metadata.cusum_level"),
    )


def capture_to_records(spark: SparkSession, folder: str) -> DataFrame:
    """Frames to alert records in one batch plan."""
    return _flat(chain.batch(_frames(spark, folder), SETTINGS, _entropy, NAMED))


def stream_capture_to_records(spark: SparkSession, folder: str) -> DataFrame:
    """The same as one streaming plan, fed in two turns; incidents that may still go on are not out yet."""
    rows = _frames(spark, folder).withColumn("ts", F.timestamp_micros("ts_us"))
    turn = F.least(F.lit(TURNS - 1), F.floor((F.dayofmonth("ts") - 1) / 15))
    out = live.run_parts(rows, turn, TURNS, lambda stream: chain.stream(stream, SETTINGS, _entropy, NAMED, "0 seconds"))
    return _flat(out)


QUERIES = {"capture_to_records": capture_to_records, "stream_capture_to_records": stream_capture_to_records}


def _fold(name: str, key: str, h: float) -> str:
    """Leaky sums over the windows of a pair or target; a pause of over a day starts from zero."""
    return f"""
{name}_st AS (
  SELECT flow, life, win, {key} AS series, score - 1.75::DOUBLE AS d, row_number() OVER w AS i,
         coalesce(done_us - lag(done_us) OVER w > {DAY_US}, false) AS fresh
  FROM sc WHERE {key} IS NOT NULL WINDOW w AS (PARTITION BY {key} ORDER BY done_us, done_id, win)),
{name}_f AS (
  SELECT series, 0::BIGINT AS i, NULL::VARCHAR AS flow, 0::HUGEINT AS life, 0::BIGINT AS win, 0.0::DOUBLE AS s, 0.0::DOUBLE AS level
  FROM (SELECT DISTINCT series FROM {name}_st)
  UNION ALL
  SELECT series, i, flow, life, win, CASE WHEN l > {h} THEN 0.0 ELSE l END, l
  FROM (SELECT t.series, t.i, t.flow, t.life, t.win, greatest(0.0, 0.98::DOUBLE * CASE WHEN fresh THEN 0.0 ELSE f.s END + t.d) AS l
        FROM {name}_f f JOIN {name}_st t ON t.series = f.series AND t.i = f.i + 1))"""


_CHAIN = f"""
ev AS (
  SELECT event_id, epoch_us(ts) AS ts_us, user_id % 8 AS user_id, event_type, 100.0::DOUBLE AS value,
         ((props::JSON->>'k')::INT % 3) * 20 AS k FROM events),
fr AS (
  SELECT event_id, ts_us, {frames._frame(True)} AS h, {frames._SRC} AS src, {frames._DST} AS dst, {frames._DPORT} AS dport,
         event_type IN ('error', 'signup') AS syn FROM ev),
fl AS (
  SELECT event_id, ts_us, h, syn, CASE WHEN src IS NULL THEN 'global' ELSE src || '|1124|' || dst || '|' || dport END AS flow,
         src, dst, CASE WHEN src IS NOT NULL THEN dport END AS dport FROM fr),
li AS (
  SELECT *, sum(fresh) OVER (PARTITION BY flow ORDER BY ts_us, event_id ROWS UNBOUNDED PRECEDING) AS life
  FROM (SELECT *, coalesce(ts_us - lag(ts_us) OVER (PARTITION BY flow ORDER BY ts_us, event_id) > {DAY_US}, false)::INT AS fresh FROM fl)),
o AS (
  SELECT *, length(h) // 2 AS n, coalesce(sum(length(h) // 2) OVER (PARTITION BY flow, life ORDER BY ts_us, event_id
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM li),
st AS (
  SELECT flow, life, any_value(src) AS src, any_value(dst) AS dst, any_value(dport) AS dport,
         string_agg(h, '' ORDER BY ts_us, event_id) AS h, sum(n)::BIGINT AS n FROM o GROUP BY flow, life),
w AS (
  SELECT flow, life, src, dst, dport, win, substr(h, win * 512 + 1, 512) AS hx
  FROM (SELECT *, unnest(generate_series(0, n // 256 - 1)) AS win FROM st WHERE n >= 256)),
bytes AS (
  SELECT flow, life, win, substr(hx, 2 * i + 1, 2) AS b, count(*) / 256 AS p
  FROM (SELECT *, unnest(range(0, 256)) AS i FROM w) GROUP BY ALL),
en AS (SELECT flow, life, win, -sum(p * log2(p + 1e-9)) AS score FROM bytes GROUP BY flow, life, win),
sc AS (
  SELECT w.flow, w.life, w.win, score, w.src, w.dst, w.dport, o.ts_us AS done_us, o.event_id AS done_id,
         CASE WHEN w.src IS NOT NULL THEN 'tap|' || least(w.src, w.dst) || '|' || greatest(w.src, w.dst) END AS pair,
         CASE WHEN w.src IS NOT NULL THEN 'tap|' || w.dst || ':' || w.dport END AS target
  FROM w JOIN en USING (flow, life, win)
  JOIN o ON o.flow = w.flow AND o.life = w.life AND w.win * 256 + 255 >= off AND w.win * 256 + 255 < off + o.n),
{_fold("pr", "pair", 0.2)},
{_fold("tg", "target", 0.3)},
lv AS (
  SELECT sc.*, coalesce(a.level, 0.0) AS pl, coalesce(b.level, 0.0) AS tl
  FROM sc LEFT JOIN pr_f a ON a.i > 0 AND a.flow = sc.flow AND a.life = sc.life AND a.win = sc.win
  LEFT JOIN tg_f b ON b.i > 0 AND b.flow = sc.flow AND b.life = sc.life AND b.win = sc.win),
al AS (
  SELECT 'SLOW' AS type, done_us AS ts_us, done_id AS tie, win AS tie_2, src, dst, dport, pl AS score, pl AS cusum,
         'slow anomaly between ' || substr(pair, 5) AS message FROM lv WHERE pl > 0.2
  UNION ALL
  SELECT 'SLOW_DISTRIBUTED', done_us, done_id, win, src, dst, dport, tl, tl, 'slow anomaly targeting ' || substr(target, 5) FROM lv WHERE tl > 0.3
  UNION ALL
  SELECT 'BYTE', done_us, done_id, win, src, dst, dport, score, NULL, format('payload surprise {{:.2f}} bits', score) FROM lv WHERE score > 1.85::DOUBLE
  UNION ALL
  SELECT 'CRITICAL_BYTE', done_us, done_id, win, src, dst, dport, score, NULL, format('payload surprise {{:.2f}} bits over the ceiling', score)
  FROM lv WHERE score > 1.98::DOUBLE
  UNION ALL
  SELECT 'RATE', (ts_us // {HOUR_US} + 1) * {HOUR_US} - 1, -1, -1, NULL, NULL, NULL, count(*)::DOUBLE, NULL, count(*) || ' connection attempts in a bucket'
  FROM fl WHERE syn GROUP BY ts_us // {HOUR_US} HAVING count(*) > 5),
se AS (
  SELECT *, sum(fresh) OVER (PARTITION BY type ORDER BY ts_us, tie, tie_2 ROWS UNBOUNDED PRECEDING) AS inc
  FROM (SELECT *, coalesce(ts_us - lag(ts_us) OVER (PARTITION BY type ORDER BY ts_us, tie, tie_2) > {HOUR_US}, true)::INT AS fresh FROM al)),
ic AS (
  SELECT type, min(ts_us) AS first_us, max(ts_us) AS last_us, count(*) AS raw_alerts, max(score) AS peak,
         arg_min((src, dst, dport, score, cusum, message), (ts_us, tie, tie_2)) AS a
  FROM se GROUP BY type, inc),
rc AS (
  SELECT *, 'opened' AS state, first_us AS at_us, a[4] AS score, a[6] AS message FROM ic
  UNION ALL
  SELECT *, 'closed', last_us, peak, format('Incident closed: {{}} {{}} alerts over {{}}s (peak score {{:.2f}})', raw_alerts, type,
         round_even(greatest(1.0, (last_us - first_us) / 1e6), 0)::BIGINT, peak)
  FROM ic WHERE raw_alerts > 1)"""
_OUT = """
SELECT 'tap' AS capture, type, state, first_us, last_us, raw_alerts, strftime(make_timestamp(at_us), '%Y-%m-%dT%H:%M:%S.%g') || '+0000' AS timestamp,
       coalesce(a[1], '0.0.0.0') AS src_ip, coalesce(a[2], '0.0.0.0') AS dest_ip, coalesce(a[3], 0) AS dest_port,
       CASE type WHEN 'CRITICAL_BYTE' THEN 900001 WHEN 'BYTE' THEN 900002 WHEN 'SLOW_DISTRIBUTED' THEN 900003 WHEN 'SLOW' THEN 900004 ELSE 900000 END AS signature_id,
       CASE type WHEN 'CRITICAL_BYTE' THEN 1 WHEN 'BYTE' THEN 2 WHEN 'SLOW_DISTRIBUTED' THEN 2 ELSE 3 END AS severity,
       message, round(round(score, 4), 3) AS score, coalesce(round(a[5], 2), 0.0) AS cusum_level FROM rc"""

ORACLE = {
    "capture_to_records": f"WITH RECURSIVE {_CHAIN} {_OUT}",
    "stream_capture_to_records": f"""
WITH RECURSIVE {_CHAIN} {_OUT}
WHERE last_us + {HOUR_US} <= (SELECT max(epoch_us(ts)) // 1000 * 1000 FROM events)""",
}
