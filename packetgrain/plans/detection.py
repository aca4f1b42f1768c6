"""Queries that raise alarms from scores and rates and match them to ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetgrain.functions.text import fixed_all
from packetgrain.operators import calibrate, cusum, match, ordering, rate
from packetgrain.plans.thresholds import EV
from packetgrain.sources.schedules import schedule
from packetgrain.sources.tables import events, packet_meta, scores

HOUR_US = 3_600_000_000
DAY_US = 86_400_000_000
ORDER = ["ts_us", "event_id"]
GRID = cusum.geometric_grid(1.0, 50.0, 60)
TRACE_H = 4.0


def _order() -> list:
    return [F.col(c) for c in ORDER]


def _standardised(spark: SparkSession, folder: str) -> DataFrame:
    """Scores in units of their own series' population deviation, less the slack."""
    rows = scores(spark, folder)
    base = rows.groupBy("series").agg(F.avg("score").alias("mu"), F.stddev_pop("score").alias("sigma"))
    step = (F.col("score") - F.col("mu")) / F.greatest(F.col("sigma"), F.lit(1e-9)) - 0.5
    return rows.join(base, "series").select("series", "event_id", "ts_us", step.alias("step"))


def cusum_path(spark: SparkSession, folder: str) -> DataFrame:
    out = cusum.path(_standardised(spark, folder), ["series"], _order(), F.col("step"))
    return out.select("series", "event_id", F.round("level", 6).alias("level"))


def cusum_alarms(spark: SparkSession, folder: str) -> DataFrame:
    out = cusum.levels(
        _standardised(spark, folder), ["series"], _order(), F.col("step"), 2.0, payload=["event_id"]
    )
    return out.select("series", "event_id", F.round("level", 6).alias("level"), "alarm")


def cusum_bounds(spark: SparkSession, folder: str) -> DataFrame:
    out = cusum.bounds(_standardised(spark, folder), ["series"], _order(), F.col("step"), 300.0, GRID)
    return out.select("series", "n", F.round("h", 6).alias("h"))


def trace_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    flagged = cusum.levels(_standardised(spark, folder), ["series"], _order(), F.col("step"), 4.0)
    out = cusum.trace_verdicts(flagged, ["series"])
    return out.select(
        "series", "windows", "alarms", F.round("first_alarm_at", 6).alias("first_alarm_at"),
        F.array_join(fixed_all("alarm_positions", 4), ",").alias("positions"),
        F.round("alarms_per_10k", 6).alias("alarms_per_10k"), "detected",
    )


def trace_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Users of every third number are benign traces, the others attack traces but for those already in use."""
    flagged = cusum.levels(_standardised(spark, folder), ["series"], _order(), F.col("step"), TRACE_H)
    traces = cusum.trace_verdicts(flagged, ["series"]).withColumn("kind", F.when(F.col("series") % 3 == 0, "benign").otherwise("attack"))
    used = traces.where(F.col("series") % 10 == 1).select("series")
    out = cusum.trace_rates(match.exclude_files(traces, used, "series"), ["kind"])
    return out.select("kind", "traces", "detected", F.round("detection_rate", 6).alias("detection_rate"), "alarms", "windows",
                      F.round("alarms_per_10k", 6).alias("alarms_per_10k"))


def _leaky(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """Leaky sums against the 60th percentile of all values, so the small tables alarm too."""
    rows = events(spark, folder).select("event_id", "ts_us", key, "value", F.lit(1).alias("sensor"))
    fitted = ordering.quantiles(rows, ["sensor"], "value", [i / 100 for i in range(101)], "score_quantiles")
    ref = calibrate.cusum_reference(F.col("score_quantiles"), F.lit(0.0), F.lit(0.0), 60)
    step = rows.join(F.broadcast(fitted), "sensor").withColumn("step", F.col("value") - ref)
    out = cusum.levels(step, [key], _order(), F.col("step"), 100.0, 0.98, ["event_id"])
    return out.select(key, "event_id", F.round("level", 6).alias("level"), "alarm")


def flow_cusum_leaky(spark: SparkSession, folder: str) -> DataFrame:
    return _leaky(spark, folder, "user_id")


def target_cusum(spark: SparkSession, folder: str) -> DataFrame:
    return _leaky(spark, folder, "k").withColumn("k", F.col("k").cast("long"))


def syn_flood_trailing(spark: SparkSession, folder: str) -> DataFrame:
    """Errors are SYNs; the span is a day and the limit two, in place of a second and fifty."""
    syns = events(spark, folder).where(F.col("event_type") == "error").select("user_id", "event_id", "ts_us")
    return rate.syn_floods(syns, ["user_id"], 2, DAY_US, tie="event_id").select(
        "user_id", "event_id", "syns", "flood"
    )


def _buckets(spark: SparkSession, folder: str, whole: bool = False) -> DataFrame:
    rows = events(spark, folder).withColumn("capture", F.lit("events"))
    return rate.bucket_rates(rows, ["capture"], "user_id", F.col("event_type") == "error", HOUR_US, whole)


def rate_buckets(spark: SparkSession, folder: str) -> DataFrame:
    return _buckets(spark, folder).select("bucket", "bucket_us", "score")


def rate_buckets_whole_seconds(spark: SparkSession, folder: str) -> DataFrame:
    return _buckets(spark, folder, True).select("bucket", "score")


def _rate_threshold(buckets: DataFrame, intervals: DataFrame) -> DataFrame:
    fit = match.fit_slice(buckets, intervals, "bucket_us")
    return rate.rate_threshold(fit, buckets, ["capture"], 3000.0)


def rate_threshold(spark: SparkSession, folder: str) -> DataFrame:
    buckets = _buckets(spark, folder)
    return _rate_threshold(buckets, _intervals(spark, folder)).select("threshold")


def rate_tumbling_alerts(spark: SparkSession, folder: str) -> DataFrame:
    out = rate.live_rate_alerts(events(spark, folder), [], F.col("event_type") == "error", HOUR_US, 4)
    return out.select("bucket", "syns")


def _intervals(spark: SparkSession, folder: str) -> DataFrame:
    """The built-in day schedules, one day each, a week apart from the twelfth day of the events; the last one comes after
    their end."""
    first = events(spark, folder).agg(F.min("ts_us").alias("t0_us"))
    days = schedule(spark)
    rows = match.schedule_epochs(days, first, -3.0)
    shift = F.dense_rank().over(_by_day()) * 7 + 4
    moved = rows.join(days.select("name", "day"), "name").withColumn("_shift", shift * DAY_US)
    moved = moved.select("name", (F.col("start_us") + F.col("_shift")).alias("start_us"), (F.col("end_us") + F.col("_shift")).alias("end_us"))
    return match.padded(moved, 2 * match.MINUTE_US)


def _by_day():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0)).orderBy("day")


def _span_end(spark: SparkSession, folder: str) -> DataFrame:
    return events(spark, folder).agg(F.max("ts_us").alias("span_end_us"))


def _byte_alarms(spark: SparkSession, folder: str) -> DataFrame:
    """The times at which the cumulative sum of a series' scores alarms."""
    flagged = cusum.levels(
        _standardised(spark, folder), ["series"], _order(), F.col("step"), TRACE_H, payload=["event_id", "ts_us"]
    )
    return flagged.where("alarm").select("event_id", "ts_us")


def _rate_alarms(spark: SparkSession, folder: str) -> DataFrame:
    buckets = _buckets(spark, folder)
    limit = _rate_threshold(buckets, _intervals(spark, folder))
    # One threshold row per capture.
    return buckets.join(F.broadcast(limit), "capture").where(F.col("score") > F.col("threshold")).select(
        F.col("bucket_us").alias("ts_us")
    )


def schedule_intervals(spark: SparkSession, folder: str) -> DataFrame:
    return _intervals(spark, folder)


def attack_interval_join(spark: SparkSession, folder: str) -> DataFrame:
    out = match.attack_hits(_byte_alarms(spark, folder), _intervals(spark, folder), _span_end(spark, folder))
    return out.withColumn("delay_sec", F.round("delay_sec", 6))


def attack_fusion(spark: SparkSession, folder: str) -> DataFrame:
    spans, end = _intervals(spark, folder), _span_end(spark, folder)
    byte = match.attack_hits(_byte_alarms(spark, folder), spans, end)
    rates = match.attack_hits(_rate_alarms(spark, folder), spans, end)
    return match.fuse_attacks(byte, rates)


def false_alarms_per_hour(spark: SparkSession, folder: str) -> DataFrame:
    """Both definitions: all alarms outside attacks, and the fused union after the fit period."""
    spans, end = _intervals(spark, folder), _span_end(spark, folder)
    after = match.fit_end(spans)
    byte, rates = _byte_alarms(spark, folder), _rate_alarms(spark, folder)
    single = match.false_alarms(byte, spans).agg(F.count(F.lit(1)).alias("single"))
    byte_out = match.false_alarms(byte.select("ts_us"), spans, after=after)
    rate_out = match.false_alarms(rates, spans, after=after)
    union = byte_out.union(rate_out).distinct().agg(F.count(F.lit(1)).alias("fused"))
    hours = match.benign_hours(spans, end)
    one = F.lit(1).alias("_one")
    # Three aggregate rows side by side.
    joined = single.select("*", one).join(union.select("*", one), "_one").join(hours.select("*", one), "_one")
    return joined.select(
        "single", "fused", F.round("benign_hours", 6).alias("benign_hours"),
        F.round(F.col("fused") / F.col("benign_hours"), 6).alias("fused_per_hour"),
    )


def _file_scores(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """Users stand for files; the byte detector has not seen those of every seventh number."""
    rows = events(spark, folder).where((F.col("event_type") == kind) & ((F.lit(kind) != "view") | (F.col("user_id") % 7 != 0)))
    return rows.groupBy(F.col("user_id").alias("file")).agg(F.avg("value").alias("score"))


def detector_fusion_files(spark: SparkSession, folder: str) -> DataFrame:
    out = match.fuse_files(
        _file_scores(spark, folder, "view"), _file_scores(spark, folder, "error"), F.lit(50.0), F.lit(55.0)
    )
    return out.withColumn("byte_score", F.round("byte_score", 6)).withColumn("rate_score", F.round("rate_score", 6))


def fusion_summary(spark: SparkSession, folder: str) -> DataFrame:
    files = detector_fusion_files(spark, folder)
    rates = files.agg(
        F.count(F.lit(1)).alias("files"), F.count_if("fused").alias("fused"),
        F.count_if("rate_only").alias("rate_only"), F.count_if("byte_only").alias("byte_only"),
        F.avg(F.col("byte_hit").cast("double")).alias("a"), F.avg(F.col("rate_hit").cast("double")).alias("b"),
    )
    return rates.select(
        "files", "fused", "rate_only", "byte_only",
        F.round(match.combined_fpr(F.col("a"), F.col("b")), 9).alias("combined"),
    )


def _flow_rows(spark: SparkSession, folder: str) -> DataFrame:
    return packet_meta(spark, folder).select(
        F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM-dd").alias("capture"),
        "event_id", F.col("src").alias("srcip"), (F.col("size") + 1024).alias("sport"),
        F.col("dst").alias("dstip"), F.col("dport").alias("dsport"), "proto",
        F.floor(F.col("ts_us") / 1_000_000).alias("t"),
    )


def _truth(spark: SparkSession, folder: str) -> DataFrame:
    """Large sign-ups and errors are the labelled attack flows, thirty days long each, so that other packets of their host
    pairs fall inside."""
    rows = _flow_rows(spark, folder).where(F.col("proto").isin("signup", "error") & (F.col("sport") > 1024 + 200))
    return rows.select(
        "srcip", "sport", "dstip", "dsport", "proto", F.col("t").alias("stime"), (F.col("t") + 30 * 86400).alias("ltime"),
        F.concat(F.lit("cat_"), F.col("proto"), F.col("dsport") % 3).alias("cat"), F.col("event_id").alias("ordinal"),
    )


def _labelled(spark: SparkSession, folder: str, mode: str) -> DataFrame:
    return match.label_packets(_flow_rows(spark, folder), _truth(spark, folder), ["capture"], mode)


def flow_label_cascade(spark: SparkSession, folder: str) -> DataFrame:
    return _labelled(spark, folder, "auto").select("event_id", "use_time", "tier", "cat")


def flow_label_strict(spark: SparkSession, folder: str) -> DataFrame:
    return _labelled(spark, folder, "strict").select("event_id", "tier", "cat")


def routing_stats(spark: SparkSession, folder: str) -> DataFrame:
    return match.routing_stats(_labelled(spark, folder, "strict"))


def match_diagnostics(spark: SparkSession, folder: str) -> DataFrame:
    """Per day; packets of purchases stand for frames that did not parse."""
    rows = _flow_rows(spark, folder)
    unread = F.col("proto") == "purchase"
    sent = rows.select("capture", "event_id", "t", *[F.when(~unread, F.col(c)).alias(c) for c in ("srcip", "sport", "dstip", "dsport", "proto")])
    return match.diagnostics(match.label_packets(sent, _truth(spark, folder), ["capture"], "auto", hits=True), ["capture"])


def source_census(spark: SparkSession, folder: str) -> DataFrame:
    return match.source_census(_flow_rows(spark, folder))


def latest_reference(spark: SparkSession, folder: str) -> DataFrame:
    """As-of join: the latest purchase value of the same target before each error."""
    rows = events(spark, folder).select("event_id", "ts_us", "k", "event_type", "value")
    left = rows.where(F.col("event_type") == "error").select("event_id", "ts_us", "k")
    right = rows.where(F.col("event_type") == "purchase").select("ts_us", "k", "value")
    return match.as_of(left, right, ["k"], "ts_us", "value", "latest").select("event_id", "latest")


QUERIES = {
    name: globals()[name]
    for name in (
        "cusum_path", "cusum_alarms", "cusum_bounds", "trace_verdicts", "trace_rates", "match_diagnostics", "flow_cusum_leaky", "target_cusum",
        "syn_flood_trailing", "rate_buckets", "rate_buckets_whole_seconds", "rate_threshold",
        "rate_tumbling_alerts", "schedule_intervals", "attack_interval_join", "attack_fusion",
        "false_alarms_per_hour", "detector_fusion_files", "fusion_summary", "flow_label_cascade",
        "flow_label_strict", "routing_stats", "source_census", "latest_reference",
    )
}

_STD = EV + """,
mu AS (SELECT user_id AS series, avg(value) AS mu, greatest(stddev_pop(value), 1e-9) AS sigma FROM ev GROUP BY user_id),
st AS (
  SELECT user_id AS series, event_id, ts_us, (value - mu) / sigma - 0.5 AS d,
         row_number() OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS i
  FROM ev JOIN mu ON series = user_id)"""


def _fold_sql(h: str, leak: str = "1.0::DOUBLE") -> str:
    """Recursion over the position; all series advance together."""
    return f""",
fold AS (
  SELECT series, 0::BIGINT AS i, 0::BIGINT AS event_id, 0.0::DOUBLE AS s, 0.0::DOUBLE AS level FROM (SELECT DISTINCT series FROM st)
  UNION ALL
  SELECT series, i, event_id, CASE WHEN l > {h} THEN 0.0 ELSE l END, l
  FROM (SELECT st.series, st.i, st.event_id, greatest(0.0, {leak} * f.s + st.d) AS l
        FROM fold f JOIN st ON st.series = f.series AND st.i = f.i + 1))"""


def _leaky_sql(key: str) -> str:
    return f"""
WITH RECURSIVE {EV},
ref AS (SELECT quantile_cont(value, 0.6) AS r FROM ev),
st AS (
  SELECT {key} AS series, event_id, value - r AS d,
         row_number() OVER (PARTITION BY {key} ORDER BY ts_us, event_id) AS i
  FROM ev, ref){_fold_sql("100.0", "0.98::DOUBLE")}
SELECT series::BIGINT AS {key}, event_id, round(level, 6) AS level, level > 100.0 AS alarm FROM fold WHERE i > 0"""


_BUCKETS = EV + f""",
f AS (SELECT min(ts_us) AS t0 FROM ev),
c AS (
  SELECT (ts_us - t0) // {HOUR_US} AS bucket, user_id, count(*) AS n, any_value(t0) AS t0
  FROM ev, f WHERE event_type = 'error' GROUP BY ALL),
bk AS (SELECT bucket, any_value(t0) + bucket * {HOUR_US} AS bucket_us, max(n) AS score FROM c GROUP BY bucket)"""
_SCHEDULE = f"""
sch(day, name, s, e) AS (VALUES
  ('tuesday','FTP-Patator','09:20','10:20'),('tuesday','SSH-Patator','14:00','15:00'),
  ('wednesday','DoS-slowloris','09:47','10:10'),('wednesday','DoS-Slowhttptest','10:14','10:35'),
  ('wednesday','DoS-Hulk','10:43','11:00'),('wednesday','DoS-GoldenEye','11:10','11:23'),
  ('wednesday','Heartbleed','15:12','15:32'),
  ('thursday','Web-BruteForce','09:20','10:00'),('thursday','Web-XSS','10:15','10:35'),
  ('thursday','Web-SQLi','10:40','10:42'),('thursday','Infiltration','14:19','15:45'),
  ('friday','Botnet-ARES','10:02','11:02'),('friday','PortScan','13:55','15:29'),
  ('friday','DDoS-LOIT','15:56','16:16')),
mid AS (
  SELECT min(epoch_us(ts)) - ((min(epoch_us(ts)) - 3 * {HOUR_US}) // 1000000 % 86400) * 1000000 AS m FROM events),
iv0 AS (
  SELECT name,
         m + (split_part(s, ':', 1)::BIGINT * 60 + split_part(s, ':', 2)::BIGINT) * 60000000
           + (dense_rank() OVER (ORDER BY day) * 7 + 4) * {DAY_US} AS start_us,
         m + (split_part(e, ':', 1)::BIGINT * 60 + split_part(e, ':', 2)::BIGINT) * 60000000
           + (dense_rank() OVER (ORDER BY day) * 7 + 4) * {DAY_US} AS end_us
  FROM sch, mid),
iv AS (SELECT *, start_us - 120000000 AS lo_us, end_us + 120000000 AS hi_us FROM iv0),
fe AS (SELECT min(lo_us) - 300000000 AS fit_end FROM iv),
se AS (SELECT max(epoch_us(ts)) AS span_end FROM events)"""
_RATE = _BUCKETS + "," + _SCHEDULE + """,
fit AS (SELECT * FROM bk, fe WHERE bucket_us < fit_end),
cand AS (
  SELECT c, (SELECT count(*) FROM fit WHERE score > c) AS over_, (SELECT count(*) FROM fit) AS n
  FROM (SELECT unnest(generate_series(1, (SELECT max(score) + 1 FROM bk))) AS c)),
rt AS (
  SELECT coalesce(min(c) FILTER (over_ <= 3000.0 * n / 10000), (SELECT max(score) + 1 FROM bk))::DOUBLE AS threshold
  FROM cand),
ra AS (SELECT bucket_us AS ts_us FROM bk, rt WHERE score > threshold),
mu AS (SELECT user_id AS series, avg(value) AS mu, greatest(stddev_pop(value), 1e-9) AS sigma FROM ev GROUP BY user_id),
st AS (
  SELECT user_id AS series, event_id, ts_us, (value - mu) / sigma - 0.5 AS d,
         row_number() OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS i
  FROM ev JOIN mu ON series = user_id)""" + _fold_sql("4.0") + """,
ba AS (SELECT st.event_id, st.ts_us FROM fold JOIN st ON st.series = fold.series AND st.i = fold.i WHERE level > 4.0)"""


def _hits_sql(alarms: str) -> str:
    return f"""
SELECT iv.name, lo_us > span_end AS outside_captured_range,
       CASE WHEN lo_us <= span_end THEN count(a.ts_us) > 0 END AS detected,
       CASE WHEN lo_us <= span_end THEN count(a.ts_us) ELSE 0 END AS alarms,
       CASE WHEN lo_us <= span_end THEN round((min(a.ts_us) - start_us) / 1e6, 6) END AS delay_sec
FROM iv JOIN se ON true LEFT JOIN {alarms} a ON a.ts_us BETWEEN lo_us AND hi_us
GROUP BY iv.name, lo_us, hi_us, start_us, span_end"""


_FLOW = EV + """,
fl AS (
  SELECT strftime(make_timestamp(ts_us), '%Y-%m-%d') AS capture, event_id,
         '10.0.' || (user_id // 256) || '.' || (user_id % 256) AS srcip, floor(value)::BIGINT + 1024 AS sport,
         '192.168.0.' || k AS dstip, k AS dsport, event_type AS proto, ts_us // 1000000 AS t FROM ev),
tr AS (
  SELECT *, t - 1 AS st, t + 2592001 AS lt, 'cat_' || proto || (dsport % 3) AS cat, event_id AS ordinal
  FROM fl WHERE proto IN ('signup', 'error') AND sport > 1224),
bi AS (
  SELECT srcip, sport, dstip, dsport, proto, st, lt, cat, ordinal FROM tr
  UNION ALL SELECT dstip, dsport, srcip, sport, proto, st, lt, cat, ordinal FROM tr),
f5 AS (SELECT srcip, sport, dstip, dsport, proto, arg_min(cat, ordinal) AS f5 FROM bi GROUP BY ALL),
t5 AS (
  SELECT p.event_id, arg_min(b.cat, b.ordinal) AS t5 FROM fl p
  JOIN bi b USING (srcip, sport, dstip, dsport, proto) WHERE p.t BETWEEN b.st AND b.lt GROUP BY p.event_id),
pr AS (SELECT least(srcip, dstip) || '|' || greatest(srcip, dstip) AS pair, * FROM tr),
fp AS (SELECT pair, arg_min(cat, ordinal) AS fp, arg_min(srcip, ordinal) AS a, arg_min(dstip, ordinal) AS b, min(ordinal) AS o
       FROM pr GROUP BY pair),
pk AS (SELECT least(srcip, dstip) || '|' || greatest(srcip, dstip) AS pair, * FROM fl),
tp AS (
  SELECT p.event_id, arg_min(b.cat, b.ordinal) AS tp FROM pk p
  JOIN pr b USING (pair) WHERE p.t BETWEEN b.st AND b.lt GROUP BY p.event_id),
ends AS (SELECT a AS ip, fp AS cat, o FROM fp UNION ALL SELECT b, fp, o FROM fp),
ip AS (SELECT ip, arg_min(cat, o) AS c FROM ends WHERE ip IN (SELECT srcip FROM tr) GROUP BY ip),
j AS (
  SELECT p.*, f5, t5, fp, tp, s.c AS sc, d.c AS dc
  FROM pk p LEFT JOIN f5 USING (srcip, sport, dstip, dsport, proto) LEFT JOIN t5 USING (event_id)
  LEFT JOIN fp USING (pair) LEFT JOIN tp USING (event_id)
  LEFT JOIN ip s ON s.ip = p.srcip LEFT JOIN ip d ON d.ip = p.dstip)"""
_CASCADE = _FLOW + """,
v AS (SELECT capture, count(t5) >= 5 AS use_time FROM j GROUP BY capture),
out AS (
  SELECT event_id, use_time, CASE WHEN use_time THEN t5 ELSE f5 END AS x5, CASE WHEN use_time THEN tp ELSE fp END AS xp, sc, dc
  FROM j JOIN v USING (capture))"""
_TIER = """CASE WHEN x5 IS NOT NULL THEN '5tuple' WHEN xp IS NOT NULL THEN 'pair'
            WHEN sc IS NOT NULL OR dc IS NOT NULL THEN 'ip' ELSE 'none' END AS tier,
       coalesce(x5, xp, sc, dc) AS cat"""

ORACLE = {
    "cusum_path": f"""
WITH {_STD},
p AS (SELECT series, event_id, i, sum(d) OVER w AS p FROM st
      WINDOW w AS (PARTITION BY series ORDER BY i ROWS UNBOUNDED PRECEDING))
SELECT series, event_id,
       round(p - least(0.0, min(p) OVER (PARTITION BY series ORDER BY i ROWS UNBOUNDED PRECEDING)), 6) + 0.0 AS level
FROM p""",
    "cusum_alarms": f"""
WITH RECURSIVE {_STD}{_fold_sql("2.0")}
SELECT series, event_id, round(level, 6) AS level, level > 2.0 AS alarm FROM fold WHERE i > 0""",
    "cusum_bounds": f"""
WITH RECURSIVE {_STD},
grid AS (SELECT unnest([{", ".join(repr(g) for g in GRID)}]::DOUBLE[]) AS h),
fold AS (
  SELECT series, h, 0::BIGINT AS i, 0.0::DOUBLE AS s, 0 AS alarms FROM (SELECT DISTINCT series FROM st), grid
  UNION ALL
  SELECT series, h, i, CASE WHEN l > h THEN 0.0 ELSE l END, alarms + (l > h)::INT
  FROM (SELECT st.series, f.h, st.i, f.alarms, greatest(0.0, f.s + st.d) AS l
        FROM fold f JOIN st ON st.series = f.series AND st.i = f.i + 1)),
n AS (SELECT series, count(*) AS n FROM st GROUP BY series),
done AS (SELECT f.series, f.h, f.alarms, n.n FROM fold f JOIN n ON n.series = f.series AND f.i = n.n)
SELECT series, n, round(coalesce(min(h) FILTER (alarms <= 300.0 * n / 10000), max(h)), 6) AS h
FROM done GROUP BY series, n""",
    "trace_verdicts": f"""
WITH RECURSIVE {_STD}{_fold_sql("4.0")},
a AS (SELECT series, i, level > 4.0 AS alarm, count(*) OVER (PARTITION BY series) AS n FROM fold WHERE i > 0)
SELECT series, count(*) AS windows, count(*) FILTER (alarm) AS alarms,
       round(min(i - 1) FILTER (alarm) / count(*), 6) AS first_alarm_at,
       coalesce(string_agg(CASE WHEN alarm THEN format('{{:.4f}}', (i - 1) / n) END, ',' ORDER BY i), '') AS positions,
       round(count(*) FILTER (alarm) * 10000.0::DOUBLE / count(*), 6) AS alarms_per_10k,
       count(*) FILTER (alarm) > 0 AS detected
FROM a GROUP BY series""",
    "trace_rates": f"""
WITH RECURSIVE {_STD}{_fold_sql("4.0")},
t AS (SELECT series, count(*) AS n, count(*) FILTER (level > 4.0) AS a FROM fold WHERE i > 0 GROUP BY series)
SELECT CASE WHEN series % 3 = 0 THEN 'benign' ELSE 'attack' END AS kind, count(*) AS traces, count(*) FILTER (a > 0) AS detected,
       round(count(*) FILTER (a > 0) / count(*), 6) AS detection_rate, sum(a)::BIGINT AS alarms, sum(n)::BIGINT AS windows,
       round(sum(a) * 10000.0::DOUBLE / sum(n), 6) AS alarms_per_10k
FROM t WHERE series % 10 <> 1 GROUP BY 1""",
    "flow_cusum_leaky": _leaky_sql("user_id"),
    "target_cusum": _leaky_sql("k"),
    "syn_flood_trailing": f"""
WITH {EV},
s AS (SELECT user_id, event_id, ts_us FROM ev WHERE event_type = 'error'),
c AS (
  SELECT a.user_id, a.event_id, count(*) AS syns FROM s a JOIN s b ON a.user_id = b.user_id
   AND b.ts_us >= a.ts_us - {DAY_US} AND (b.ts_us < a.ts_us OR (b.ts_us = a.ts_us AND b.event_id <= a.event_id))
  GROUP BY ALL)
SELECT user_id, event_id, syns, syns > 2 AS flood FROM c""",
    "rate_buckets": f"WITH {_BUCKETS} SELECT bucket, bucket_us, score FROM bk",
    "rate_buckets_whole_seconds": f"""
WITH {EV},
c AS (
  SELECT (ts_us // 1000000 - (SELECT min(ts_us) // 1000000 FROM ev)) // 3600 AS bucket, user_id, count(*) AS n
  FROM ev WHERE event_type = 'error' GROUP BY ALL)
SELECT bucket, max(n) AS score FROM c GROUP BY bucket""",
    "rate_threshold": f"WITH RECURSIVE {_RATE} SELECT threshold FROM rt",
    "rate_tumbling_alerts": f"""
WITH {EV}
SELECT ts_us // {HOUR_US} AS bucket, count(*) AS syns FROM ev WHERE event_type = 'error'
GROUP BY 1 HAVING count(*) > 4""",
    "schedule_intervals": f"WITH {_SCHEDULE} SELECT name, start_us, end_us, lo_us, hi_us FROM iv",
    "attack_interval_join": f"WITH RECURSIVE {_RATE} {_hits_sql('ba')}",
    "attack_fusion": f"""
WITH RECURSIVE {_RATE},
b AS ({_hits_sql('ba')}), r AS ({_hits_sql('ra')})
SELECT b.name, b.outside_captured_range, b.detected AS byte, r.detected AS rate,
       b.detected OR r.detected AS detected,
       CASE WHEN b.outside_captured_range THEN NULL WHEN b.detected AND r.detected THEN 'byte,rate'
            WHEN b.detected THEN 'byte' WHEN r.detected THEN 'rate' ELSE 'none' END AS "by"
FROM b JOIN r USING (name)""",
    "false_alarms_per_hour": f"""
WITH RECURSIVE {_RATE},
fa AS (SELECT * FROM ba WHERE NOT EXISTS (SELECT 1 FROM iv WHERE ts_us BETWEEN lo_us AND hi_us)),
fr AS (SELECT * FROM ra WHERE NOT EXISTS (SELECT 1 FROM iv WHERE ts_us BETWEEN lo_us AND hi_us)),
u AS (SELECT ts_us FROM fa, fe WHERE ts_us >= fit_end UNION SELECT ts_us FROM fr, fe WHERE ts_us >= fit_end),
hr AS (
  SELECT greatest(1e-9, (any_value(span_end) - any_value(fit_end)
         - sum(greatest(0, least(hi_us, span_end) - greatest(lo_us, fit_end))) FILTER (lo_us <= span_end)) / 3.6e9::DOUBLE) AS h
  FROM iv, fe, se)
SELECT (SELECT count(*) FROM fa) AS single, (SELECT count(*) FROM u) AS fused, round(h, 6) AS benign_hours,
       round((SELECT count(*) FROM u) / h, 6) AS fused_per_hour FROM hr""",
    "detector_fusion_files": f"""
WITH {EV},
b AS (SELECT user_id AS file, avg(value) AS s FROM ev WHERE event_type = 'view' AND user_id % 7 <> 0 GROUP BY 1),
r AS (SELECT user_id AS file, avg(value) AS s FROM ev WHERE event_type = 'error' GROUP BY 1),
j AS (SELECT file, b.s AS bs, r.s AS rs, coalesce(b.s > 50, false) AS bh, coalesce(r.s > 55, false) AS rh
      FROM b FULL JOIN r USING (file))
SELECT file, round(bs, 6) AS byte_score, round(rs, 6) AS rate_score, bh AS byte_hit, rh AS rate_hit,
       bh OR rh AS fused, rh AND NOT bh AS rate_only, bh AND NOT rh AS byte_only FROM j""",
    "fusion_summary": f"""
WITH {EV},
b AS (SELECT user_id AS file, avg(value) AS s FROM ev WHERE event_type = 'view' AND user_id % 7 <> 0 GROUP BY 1),
r AS (SELECT user_id AS file, avg(value) AS s FROM ev WHERE event_type = 'error' GROUP BY 1),
j AS (SELECT coalesce(b.s > 50, false) AS bh, coalesce(r.s > 55, false) AS rh FROM b FULL JOIN r USING (file))
SELECT count(*) AS files, count(*) FILTER (bh OR rh) AS fused, count(*) FILTER (rh AND NOT bh) AS rate_only,
       count(*) FILTER (bh AND NOT rh) AS byte_only,
       round(1 - (1 - avg(bh::INT)) * (1 - avg(rh::INT)), 9) AS combined FROM j""",
    "flow_label_cascade": f"WITH {_CASCADE} SELECT event_id, use_time, {_TIER} FROM out",
    "flow_label_strict": f"""
WITH {_FLOW}, out AS (SELECT event_id, t5 AS x5, tp AS xp, sc, dc FROM j) SELECT event_id, {_TIER} FROM out""",
    "routing_stats": f"""
WITH {_FLOW}, out AS (SELECT event_id, t5 AS x5, tp AS xp, sc, dc FROM j),
o AS (SELECT {_TIER} FROM out)
SELECT coalesce(cat, 'benign') AS class, tier, count(*) AS packets FROM o GROUP BY ALL""",
    "match_diagnostics": f"""
WITH {_CASCADE}
SELECT j.capture, any_value(v.use_time) AS use_time, count(*) AS packets, count(*) FILTER (proto <> 'purchase') AS parseable,
       min(t) AS first_t, max(t) AS last_t, count(f5) FILTER (proto <> 'purchase') AS five_hits, count(t5) FILTER (proto <> 'purchase') AS five_time_hits,
       count(fp) FILTER (proto <> 'purchase') AS pair_hits, count(tp) FILTER (proto <> 'purchase') AS pair_time_hits,
       count(*) FILTER (proto <> 'purchase' AND (sc IS NOT NULL OR dc IS NOT NULL)) AS attacker_packets
FROM j JOIN v USING (capture) GROUP BY j.capture""",
    "source_census": f"""
WITH {_FLOW} SELECT srcip, count(*) AS packets FROM fl GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
    "latest_reference": f"""
WITH {EV},
l AS (SELECT event_id, ts_us, k FROM ev WHERE event_type = 'error'),
r AS (SELECT ts_us, k, value FROM ev WHERE event_type = 'purchase')
SELECT event_id, r.value AS latest FROM l ASOF LEFT JOIN r ON l.k = r.k AND l.ts_us >= r.ts_us""",
}
