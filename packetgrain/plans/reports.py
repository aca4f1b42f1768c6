"""Queries from alerts to incidents, records, bans, digests and leaderboards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetgrain.operators import calibrate, classify, enrich, incidents, leaderboard, scoring, windows
from packetgrain.plans.thresholds import EV
from packetgrain.session import cut
from packetgrain.sources.tables import events, packet_meta, table

HOUR_US = 3_600_000_000
DAY_US = 86_400_000_000
THRESHOLD, GOLD = 90.0, 140.0
PRODUCT = "Packetgrain Sensor"


def _gated(spark: SparkSession, folder: str) -> DataFrame:
    types = incidents.gate_types(F.col("value"), F.lit(THRESHOLD), F.lit(GOLD))
    return events(spark, folder).select("event_id", "ts_us", "user_id", "k", "value", F.explode(types).alias("type"))


def _alerts(spark: SparkSession, folder: str) -> DataFrame:
    """Byte alerts from values, rate alerts from busy hours of errors, as one frame."""
    byte = _gated(spark, folder).select(
        F.col("event_id").alias("alert_id"), "ts_us", "type", F.col("value").alias("score"), "user_id"
    )
    errors = events(spark, folder).where(F.col("event_type") == "error")
    busy = errors.groupBy(F.floor(F.col("ts_us") / HOUR_US).alias("h")).agg(
        F.count(F.lit(1)).alias("n"), F.max("ts_us").alias("ts_us"), F.max("event_id").alias("alert_id")
    ).where(F.col("n") > 4)
    rate = busy.select(
        "alert_id", "ts_us", F.lit("RATE").alias("type"), F.col("n").cast("double").alias("score"),
        F.lit(None).cast("long").alias("user_id"),
    )
    return incidents.union_alerts(byte, rate)


def _incidents(spark: SparkSession, folder: str) -> DataFrame:
    return incidents.incidents(_alerts(spark, folder), ["type"], HOUR_US, ["alert_id", "user_id"])


def alert_gates(spark: SparkSession, folder: str) -> DataFrame:
    return _gated(spark, folder).select("event_id", "type")


def incident_sessions(spark: SparkSession, folder: str) -> DataFrame:
    found = _incidents(spark, folder)
    message = incidents.close_message(
        F.col("type"), F.col("raw_alerts"), F.col("first_us"), F.col("last_us"), F.col("peak_score")
    )
    return found.select(
        "type", "first_us", "last_us", "raw_alerts", "peak_score", F.col("alert_id").alias("opened_by"),
        message.alias("message"),
    )


def _enriched(spark: SparkSession, folder: str) -> DataFrame:
    """Incidents with the packets of the six hours before them, in place of ten seconds."""
    opened = cut(_incidents(spark, folder).withColumn("alert", F.concat_ws("/", "type", "alert_id")))
    asked = opened.select("alert", F.col("first_us").alias("ts_us"))
    return opened.join(enrich.around(asked, packet_meta(spark, folder), [], 6 * HOUR_US, "alert", "event_id"), "alert", "left")


def incident_enrichment(spark: SparkSession, folder: str) -> DataFrame:
    out = _enriched(spark, folder)
    return out.select(
        "alert", "packets", "bytes", "syns",
        F.array_join(F.transform("top_talkers", lambda t: F.concat_ws("=", t["pair"], t["bytes"])), ";").alias("talkers"),
        F.array_join(F.col("top_ports").cast("array<string>"), ",").alias("ports"),
        F.array_join(
            F.transform(F.array_sort(F.map_entries("proto_mix_pct")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";"
        ).alias("mix"),
    )


def context_lines(spark: SparkSession, folder: str) -> DataFrame:
    line = incidents.context_line(
        F.col("packets"), F.col("bytes"), F.get("top_talkers", F.lit(0))["pair"], F.col("top_ports"), F.col("syns")
    )
    return _enriched(spark, folder).select("alert", line.alias("line"))


def _drift(spark: SparkSession, folder: str) -> DataFrame:
    """Daily drift of all values against the first half of the series."""
    rows = events(spark, folder).select("event_id", "ts_us", F.col("value").alias("score"), F.lit(1).alias("sensor"))
    fit = windows.half_split(rows, ["sensor"], [F.col("ts_us"), F.col("event_id")]).where(F.col("part") == "calibration")
    fitted = calibrate.calibration_records(fit, ["sensor"], "value")
    live = rows.withColumn("bucket", F.floor(F.col("ts_us") / DAY_US))
    return calibrate.psi(live, fitted, ["sensor", "bucket"])


def meta_digest(spark: SparkSession, folder: str) -> DataFrame:
    out = incidents.digests(cut(_enriched(spark, folder)), DAY_US, _drift(spark, folder))
    return out.select(
        "bucket", "window_start_us", "window_end_us", "incidents",
        F.array_join(
            F.transform(F.array_sort(F.map_entries("by_type")), lambda e: F.concat_ws(":", e["key"], e["value"])), ","
        ).alias("by_type"),
        F.array_join("top_talkers", ";").alias("top_talkers"),
        F.array_join(F.col("top_ports").cast("array<string>"), ",").alias("top_ports"),
        "drift_psi", "drift_flag", "verdict",
    )


def _messages(spark: SparkSession, folder: str) -> DataFrame:
    rows = _incidents(spark, folder)
    return rows.select(
        F.col("first_us").alias("ts_us"), "type", F.col("peak_score").alias("score"),
        F.concat(F.lit("burst targeting 10.0.0."), F.coalesce(F.col("user_id"), F.lit(0)).cast("string")).alias("message"),
        F.when(F.col("user_id").isNotNull(), F.concat(F.lit("10.0.0."), F.col("user_id").cast("string"), F.lit(" -> 192.168.0.1"))).alias("talker"),
        F.when(F.col("type") == "BYTE", F.lit("udp/53")).when(F.col("type") == "RATE", F.lit("443")).alias("port"),
        F.lit(None).cast("double").alias("cusum_level"), F.lit(None).cast("int").alias("score_percentile"),
    )


def eve_records(spark: SparkSession, folder: str) -> DataFrame:
    out = incidents.eve_records(_messages(spark, folder), PRODUCT, "Anomaly Detection", "ngram_byte_level")
    r = "record."
    return out.select(
        F.col(r + "timestamp"), F.col(r + "event_type"), F.col(r + "src_ip"), F.col(r + "dest_ip"),
        F.col(r + "dest_port"), F.col(r + "proto"),
        F.col(r + "alert.signature_id"),
        F.col(r + "alert.severity"), F.col(r + "alert.signature"),
        F.col(r + "alert.metadata.score"), F.col(r + "alert.metadata.message"),
    )


def syslog_lines(spark: SparkSession, folder: str) -> DataFrame:
    return incidents.syslog_lines(_messages(spark, folder), "sensor-1", "packetgrain").select("line")


def campaign_targets(spark: SparkSession, folder: str) -> DataFrame:
    named = _messages(spark, folder).select(incidents.campaign_target(F.col("message")).alias("target"))
    return named.groupBy("target").agg(F.count(F.lit(1)).alias("incidents"))


def _ban_requests(spark: SparkSession, folder: str) -> DataFrame:
    opened = _incidents(spark, folder).select(
        "type", F.col("first_us").alias("ts_us"), F.col("alert_id").alias("tie"),
        F.when(
            F.col("user_id").isNotNull(),
            F.array(F.struct(F.format_string("10.0.0.%d -> 192.168.0.1", "user_id").alias("pair"), F.lit(1).alias("bytes"))),
        ).alias("top_talkers"),
        F.concat_ws("#", "type", "alert_id").alias("reason"),
    )
    return incidents.ban_candidates(opened)


def ban_list(spark: SparkSession, folder: str) -> DataFrame:
    """Bans of five days, in place of a quarter hour."""
    return incidents.ban_episodes(_ban_requests(spark, folder), 5 * DAY_US)


def active_bans(spark: SparkSession, folder: str) -> DataFrame:
    now = F.lit(1_705_700_000_000_000)
    found = incidents.active_bans(_ban_requests(spark, folder), now, 5 * DAY_US)
    return found.select("ip", "banned_at", "count", "reason", "remaining_secs")


def capture_gaps(spark: SparkSession, folder: str) -> DataFrame:
    out = incidents.capture_gaps(events(spark, folder), ["user_id"], 24 * HOUR_US)
    return out.select("user_id", "opened_us", "closed_us", "type", "gap_seconds")


def incidents_per_day(spark: SparkSession, folder: str) -> DataFrame:
    rows = events(spark, folder)
    out = incidents.incidents_per_day(_incidents(spark, folder), rows, incidents.capture_gaps(rows, [], HOUR_US // 4))
    return out.withColumn("per_day", F.round("per_day", 6))


def feed_counters(spark: SparkSession, folder: str) -> DataFrame:
    return incidents.feed_counters(_alerts(spark, folder))


def newest_alerts(spark: SparkSession, folder: str) -> DataFrame:
    ranked = _alerts(spark, folder).withColumn("alert", F.concat_ws("/", "type", "alert_id"))
    return incidents.newest(ranked, 100, tie="alert").select("alert", "ts_us", "score")


def scan_summary(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.scan_summary(events(spark, folder), THRESHOLD, "value")


def _checkpoints(spark: SparkSession, folder: str) -> DataFrame:
    """One evaluation per event kind and day: step from the day, rates from the values."""
    day = F.floor(F.col("ts_us") / DAY_US)
    per = events(spark, folder).groupBy("event_type", day.alias("day")).agg(
        F.avg("value").alias("mean"), F.avg((F.col("value") > 50).cast("double")).alias("dr"),
        F.avg((F.col("value") > 200).cast("double")).alias("fpr"),
    )
    name = F.format_string("%s_ep0_gs%d_mid", F.col("event_type"), F.col("day"))
    return per.select(
        "event_type", name.alias("checkpoint"), (F.col("mean") / 80).alias("auc"),
        F.col("dr").alias("evt_dr"), F.col("fpr").alias("evt_fpr"), (F.col("mean") / 20).alias("sigma"),
    ).withColumn("step", leaderboard.step_of(F.col("checkpoint")))


def checkpoint_leaderboard(spark: SparkSession, folder: str) -> DataFrame:
    out = leaderboard.judge(_checkpoints(spark, folder), ["event_type"], [F.col("step")])
    return out.select(
        "event_type", "step", "status", "note", F.round("metric", 9).alias("metric"),
        F.round("best_before", 9).alias("best_before"), "verdict", "collapse_streak", "abort",
        leaderboard.beats_benchmark(F.col("metric"), 0.3255).alias("benchmark"),
    )


def file_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as a file: its hash and the number of windows cut from it."""
    docs = table(spark, folder, "documents").select("doc_id", F.encode("text", "UTF-8").alias("data"))
    size = F.length("data")
    return docs.select("doc_id", F.sha2("data", 256).alias("file_hash"), F.ceil(size / 512).alias("windows"))


def class_report(spark: SparkSession, folder: str) -> DataFrame:
    """Random forest on the supplied vectors, with the per-class report on the test share."""
    rows = classify.stratified_split(table(spark, folder, "embeddings"), "label")
    model = classify.fit_forest(rows.where(~F.col("test")), "embedding", "label")
    return classify.report(classify.predict(model, rows.where(F.col("test")), "embedding"))


def label_report(spark: SparkSession, folder: str) -> DataFrame:
    """The report on a rule whose answer SQL can repeat: quality guessed from toxicity."""
    guess = table(spark, folder, "labels").select(
        F.col("quality").alias("label"), (1 - F.col("toxic")).alias("prediction")
    )
    out = classify.report(guess)
    return out.select(F.col("class").cast("int").alias("class"), "support", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


QUERIES = {
    name: globals()[name]
    for name in (
        "alert_gates", "incident_sessions", "incident_enrichment", "context_lines", "meta_digest", "eve_records",
        "syslog_lines", "campaign_targets", "ban_list", "active_bans", "capture_gaps", "incidents_per_day",
        "feed_counters", "newest_alerts", "scan_summary", "checkpoint_leaderboard", "file_manifest",
        "class_report", "label_report",
    )
}

_GATES = EV + """,
gt AS (
  SELECT event_id, ts_us, user_id, value, unnest(list_concat(
    CASE WHEN value > 90 THEN ['BYTE'] ELSE [] END, CASE WHEN value > 140 THEN ['CRITICAL_BYTE'] ELSE [] END)) AS type
  FROM ev)"""
_ALERTS = _GATES + f""",
al AS (
  SELECT event_id AS alert_id, ts_us, type, value AS score, user_id FROM gt
  UNION ALL
  SELECT max(event_id), max(ts_us), 'RATE', count(*)::DOUBLE, NULL
  FROM ev WHERE event_type = 'error' GROUP BY ts_us // {HOUR_US} HAVING count(*) > 4)"""
_INC = _ALERTS + f""",
lg AS (
  SELECT *, coalesce(ts_us - lag(ts_us) OVER (PARTITION BY type ORDER BY ts_us, alert_id) > {HOUR_US}, true)::INT AS fresh
  FROM al),
nb AS (SELECT *, sum(fresh) OVER (PARTITION BY type ORDER BY ts_us, alert_id ROWS UNBOUNDED PRECEDING) AS inc FROM lg),
inc AS (
  SELECT type, inc, min(ts_us) AS first_us, max(ts_us) AS last_us, count(*) AS raw_alerts, max(score) AS peak_score,
         arg_min(alert_id, (ts_us, alert_id)) AS alert_id, arg_min_null(user_id, (ts_us, alert_id)) AS user_id
  FROM nb GROUP BY type, inc)"""
_PACKETS = f""",
pm AS (
  SELECT event_id, ts_us, '10.0.' || (user_id // 256) || '.' || (user_id % 256) AS src, '192.168.0.' || k AS dst,
         k AS dport, event_type AS proto, floor(value)::BIGINT AS size, event_type = 'error' AS is_syn FROM ev),
cx AS (
  SELECT i.type || '/' || i.alert_id AS alert, i.first_us AS opened, p.* FROM inc i
  JOIN pm p ON p.ts_us <= i.first_us AND p.ts_us >= i.first_us - {6 * HOUR_US})"""
_ENR = _INC + _PACKETS + """,
vol AS (SELECT alert, any_value(opened) AS opened, count(*) AS packets, sum(size)::BIGINT AS bytes,
               count(*) FILTER (is_syn) AS syns FROM cx GROUP BY alert),
tk AS (
  SELECT alert, src || ' -> ' || dst AS pair, sum(size)::BIGINT AS b, min((ts_us, event_id)) AS f FROM cx GROUP BY ALL),
tk3 AS (
  SELECT *, row_number() OVER (PARTITION BY alert ORDER BY b DESC, f) AS r FROM tk QUALIFY r <= 3),
po AS (SELECT alert, dport, count(*) AS n, min((ts_us, event_id)) AS f FROM cx WHERE dport <> 0 GROUP BY ALL),
po5 AS (SELECT *, row_number() OVER (PARTITION BY alert ORDER BY n DESC, f) AS r FROM po QUALIFY r <= 5),
mx AS (SELECT alert, proto, round_even(count(*) * 100.0 / any_value(packets), 0)::BIGINT AS pct
       FROM cx JOIN vol USING (alert) GROUP BY ALL)"""
_MSG = _INC + """,
ms AS (
  SELECT first_us AS ts_us, type, peak_score AS score,
         'burst targeting 10.0.0.' || coalesce(user_id, 0) AS message,
         CASE WHEN user_id IS NOT NULL THEN '10.0.0.' || user_id END AS src,
         strftime(make_timestamp(first_us), '%Y-%m-%dT%H:%M:%S.%g') AS iso
  FROM inc)"""


def _bans(where: str = "true") -> str:
    return _INC + f""",
rq AS (
  SELECT '10.0.0.' || user_id AS ip, first_us AS ts_us, alert_id AS tie, type || '#' || alert_id AS reason, type,
         row_number() OVER (PARTITION BY user_id ORDER BY first_us, alert_id, type || '#' || alert_id) AS i
  FROM inc WHERE user_id IS NOT NULL AND {where}),
bn AS (
  SELECT ip, i, ts_us AS banned_at, 1::BIGINT AS count, ts_us AS last_seen, reason, type AS incident_type, 1 AS ep
  FROM rq WHERE i = 1
  UNION ALL
  SELECT b.ip, r.i, CASE WHEN a THEN b.banned_at ELSE r.ts_us END, CASE WHEN a THEN b.count + 1 ELSE 1 END, r.ts_us, r.reason,
         CASE WHEN a THEN b.incident_type ELSE r.type END, CASE WHEN a THEN b.ep ELSE b.ep + 1 END
  FROM (SELECT bn.*, r2.ts_us - bn.banned_at < {5 * DAY_US} AS a, r2.i AS ri FROM bn JOIN rq r2 ON r2.ip = bn.ip AND r2.i = bn.i + 1) b
  JOIN rq r ON r.ip = b.ip AND r.i = b.ri),
be AS (
  SELECT ip, ep, any_value(banned_at) AS banned_at, {5 * DAY_US}::BIGINT AS ttl, max(count) AS count,
         max(last_seen) AS last_seen, arg_max(reason, i) AS reason, any_value(incident_type) AS incident_type
  FROM bn GROUP BY ip, ep)"""


ORACLE = {
    "alert_gates": f"WITH {_GATES} SELECT event_id, type FROM gt",
    "incident_sessions": f"""
WITH {_INC}
SELECT type, first_us, last_us, raw_alerts, peak_score, alert_id AS opened_by,
       CASE WHEN raw_alerts > 1 THEN format('Incident closed: {{}} {{}} alerts over {{}}s (peak score {{:.2f}})',
            raw_alerts, type, round_even(greatest(1.0, (last_us - first_us) / 1e6), 0)::BIGINT, peak_score) END AS message
FROM inc""",
    "incident_enrichment": f"""
WITH {_ENR}
SELECT i.type || '/' || i.alert_id AS alert, packets, bytes, syns, talkers, ports, mix
FROM inc i LEFT JOIN vol v ON v.alert = i.type || '/' || i.alert_id
LEFT JOIN (SELECT alert, string_agg(pair || '=' || b, ';' ORDER BY r) AS talkers FROM tk3 GROUP BY alert) t ON t.alert = v.alert
LEFT JOIN (SELECT alert, string_agg(dport::VARCHAR, ',' ORDER BY r) AS ports FROM po5 GROUP BY alert) p ON p.alert = v.alert
LEFT JOIN (SELECT alert, string_agg(proto || '=' || pct, ';' ORDER BY proto) AS mix FROM mx GROUP BY alert) m ON m.alert = v.alert""",
    "context_lines": f"""
WITH {_ENR}
SELECT v.alert, concat_ws(' | ', packets || ' pkts / ' || bytes || ' B', pair, 'ports ' || ports,
       CASE WHEN syns > 0 THEN syns || ' SYN' END) AS line
FROM vol v LEFT JOIN (SELECT alert, pair FROM tk3 WHERE r = 1) t USING (alert)
LEFT JOIN (SELECT alert, string_agg(dport::VARCHAR, ',' ORDER BY r) AS ports FROM po5 GROUP BY alert) p USING (alert)""",
    "meta_digest": f"""
WITH {_ENR},
ib AS (SELECT *, type || '/' || alert_id AS alert, first_us // {DAY_US} AS bucket FROM inc),
kc AS (SELECT bucket, type, count(*) AS n, min(first_us) AS f FROM ib GROUP BY ALL),
kk AS (SELECT bucket, sum(n)::BIGINT AS n, string_agg(type || ':' || n, ',' ORDER BY type) AS by_type,
              string_agg(type || ':' || n, ', ' ORDER BY f, type, n) AS listed FROM kc GROUP BY bucket),
dt AS (
  SELECT bucket, pair, sum(b) AS v, min((first_us, r)) AS f FROM tk3 JOIN ib USING (alert) GROUP BY ALL),
dt3 AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY v DESC, f) AS r FROM dt QUALIFY r <= 3),
dp AS (SELECT bucket, dport, count(*) AS v, min((first_us, r)) AS f FROM po5 JOIN ib USING (alert) GROUP BY ALL),
dp5 AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY v DESC, f) AS r FROM dp QUALIFY r <= 5),
hf AS (SELECT *, row_number() OVER (ORDER BY ts_us, event_id) <= count(*) OVER () // 2 AS first_half FROM ev),
qs AS (SELECT quantile_cont(value, [0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1]) AS q FROM hf WHERE first_half),
bb AS (SELECT ts_us // {DAY_US} AS bucket, least(9, greatest(0, len(list_filter(q, lambda x: x <= value)) - 1)) AS bin FROM ev, qs),
bg AS (SELECT bucket, count(*) AS n FROM bb GROUP BY bucket),
bc AS (SELECT g.bucket, g.n, i, count(bin) AS c FROM (SELECT *, unnest(range(0, 10)) AS i FROM bg) g
       LEFT JOIN bb ON bb.bucket = g.bucket AND bin = i GROUP BY ALL),
dr AS (SELECT bucket, CASE WHEN n >= 100 THEN sum((greatest(c / n, 1e-4) - 0.1) * ln(greatest(c / n, 1e-4) / 0.1)) END AS psi
       FROM bc GROUP BY bucket, n)
SELECT bucket, bucket * {DAY_US} AS window_start_us, (bucket + 1) * {DAY_US} AS window_end_us, coalesce(n, 0) AS incidents,
       by_type, top_talkers, top_ports, round(psi, 3) AS drift_psi, coalesce(psi > 0.25, false) AS drift_flag,
       CASE WHEN psi > 0.25 THEN format('DRIFT: baseline may be stale (PSI {{:.2f}}) - consider recalibrating', psi)
            WHEN coalesce(n, 0) = 0 THEN 'quiet hour - no incidents' ELSE n || ' incident(s), ' || listed END AS verdict
FROM kk FULL JOIN dr USING (bucket)
LEFT JOIN (SELECT bucket, string_agg(pair, ';' ORDER BY r) AS top_talkers FROM dt3 GROUP BY bucket) USING (bucket)
LEFT JOIN (SELECT bucket, string_agg(dport::VARCHAR, ',' ORDER BY r) AS top_ports FROM dp5 GROUP BY bucket) USING (bucket)""",
    "eve_records": f"""
WITH {_MSG}
SELECT iso || '+0000' AS timestamp, 'alert' AS event_type, coalesce(src, '0.0.0.0') AS src_ip,
       CASE WHEN src IS NULL THEN '0.0.0.0' ELSE '192.168.0.1' END AS dest_ip,
       CASE type WHEN 'BYTE' THEN 53 WHEN 'RATE' THEN 443 ELSE 0 END AS dest_port,
       CASE type WHEN 'BYTE' THEN 'UDP' ELSE 'TCP' END AS proto,
       CASE type WHEN 'CRITICAL_BYTE' THEN 900001 WHEN 'BYTE' THEN 900002 ELSE 900000 END AS signature_id,
       CASE type WHEN 'CRITICAL_BYTE' THEN 1 WHEN 'BYTE' THEN 2 ELSE 3 END AS severity,
       '{PRODUCT} - ' || type AS signature, round(score, 4) AS score, message
FROM ms""",
    "syslog_lines": f"""
WITH {_MSG}
SELECT format('<{{}}>1 {{}}Z sensor-1 packetgrain - - - [{{}} score={{:.2f}}] {{}}',
       128 + CASE type WHEN 'CRITICAL_BYTE' THEN 3 WHEN 'BYTE' THEN 4 ELSE 6 END, iso, type, score, message) AS line
FROM ms""",
    "campaign_targets": f"""
WITH {_MSG} SELECT regexp_extract(message, 'targeting (\\S+)', 1) AS target, count(*) AS incidents FROM ms GROUP BY 1""",
    "ban_list": f"""
WITH RECURSIVE {_bans()}
SELECT ip, banned_at, ttl, count, last_seen, reason, incident_type FROM be""",
    "active_bans": f"""
WITH RECURSIVE {_bans("first_us <= 1705700000000000")}
SELECT ip, banned_at, count, reason, round((banned_at + ttl - 1705700000000000) / 1e6, 1) AS remaining_secs
FROM be WHERE 1705700000000000 - banned_at < ttl""",
    "capture_gaps": f"""
WITH {EV},
g AS (SELECT user_id, ts_us, lag(ts_us) OVER (PARTITION BY user_id ORDER BY ts_us) AS p FROM ev)
SELECT user_id, p AS opened_us, ts_us AS closed_us, 'CAPTURE_GAP' AS type, round_even((ts_us - p) / 1e6, 0)::BIGINT AS gap_seconds
FROM g WHERE ts_us - p > {24 * HOUR_US}""",
    "incidents_per_day": f"""
WITH {_INC},
g AS (SELECT ts_us - lag(ts_us) OVER (ORDER BY ts_us) AS d FROM ev),
s AS (SELECT (SELECT count(*) FROM inc) AS incidents, (SELECT max(ts_us) - min(ts_us) FROM ev) AS span_us,
             (SELECT coalesce(sum(d), 0)::BIGINT FROM g WHERE d > {HOUR_US // 4}) AS gap_us)
SELECT *, round(incidents * {float(DAY_US)}::DOUBLE / nullif(span_us - gap_us, 0), 6) AS per_day FROM s""",
    "feed_counters": f"""
WITH {_ALERTS}
SELECT count(*) FILTER (type = 'BYTE') AS byte_alerts, count(*) FILTER (type = 'RATE') AS rate_alerts,
       max(score) FILTER (type = 'BYTE') AS max_byte_score FROM al""",
    "newest_alerts": f"""
WITH {_ALERTS}
SELECT type || '/' || alert_id AS alert, ts_us, score FROM al ORDER BY ts_us DESC, type || '/' || alert_id DESC LIMIT 100""",
    "scan_summary": "SELECT count(*) AS packets, count(*) FILTER (value >= 90) AS anomalies FROM events",
    "checkpoint_leaderboard": f"""
WITH {EV},
c AS (
  SELECT event_type, ts_us // {DAY_US} AS step, avg(value) / 80 AS auc, avg((value > 50)::INT) AS dr,
         avg((value > 200)::INT) AS fpr, avg(value) / 20 AS sigma FROM ev GROUP BY ALL),
p AS (SELECT *, min(sigma) OVER (PARTITION BY event_type ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS smin FROM c),
s AS (
  SELECT *, CASE WHEN fpr > 0.5 THEN 'false alarms' WHEN auc <= 0.55 THEN 'chance level'
                 WHEN sigma - smin > 1.0 THEN 'baseline drift' ELSE '' END AS note FROM p),
m AS (SELECT *, CASE WHEN note = '' THEN 'OK' ELSE 'COLLAPSED' END AS status,
             CASE WHEN note = '' AND fpr <= 0.01 THEN dr END AS metric FROM s),
b AS (SELECT *, max(metric) OVER (PARTITION BY event_type ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best,
             sum((status = 'OK')::INT) OVER (PARTITION BY event_type ORDER BY step) AS isl FROM m),
k AS (SELECT *, sum((status <> 'OK')::INT) OVER (PARTITION BY event_type, isl ORDER BY step)::BIGINT AS streak FROM b)
SELECT event_type, step, status, note, round(metric, 9) AS metric, round(best, 9) AS best_before,
       CASE WHEN status <> 'OK' THEN 'COLLAPSED' WHEN metric IS NULL THEN 'NOT ELIGIBLE'
            WHEN best IS NULL OR metric > best THEN 'NEW BEST' ELSE 'KEPT' END AS verdict,
       streak AS collapse_streak, streak >= 3 AS abort,
       CASE WHEN metric IS NULL THEN 'UNKNOWN' WHEN metric > 0.3255 THEN 'BEATS' ELSE 'BELOW' END AS benchmark
FROM k""",
    "file_manifest": """
SELECT doc_id, sha256(encode(text)) AS file_hash, ceil(octet_length(encode(text)) / 512)::BIGINT AS windows FROM documents""",
    "label_report": """
WITH g AS (SELECT quality AS t, 1 - toxic AS p FROM labels),
c AS (SELECT DISTINCT t AS class FROM g),
m AS (
  SELECT class, (SELECT count(*) FROM g WHERE t = class) AS support,
         (SELECT count(*) FROM g WHERE p = class) AS named, (SELECT count(*) FROM g WHERE t = class AND p = class) AS hit
  FROM c),
r AS (SELECT *, CASE WHEN named > 0 THEN hit / named ELSE 0.0 END AS pr, hit / support AS re FROM m)
SELECT class, support, round(pr, 9) AS precision, round(re, 9) AS recall,
       round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0.0 END, 9) AS f1,
       round((SELECT avg((t = p)::INT) FROM g), 9) AS accuracy
FROM r""",
}
