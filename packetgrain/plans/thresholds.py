"""Queries that calibrate thresholds and measure detection on event scores."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetgrain.operators import calibrate, evaluation, leaderboard, windows
from packetgrain.session import cut, shared_folder
from packetgrain.sinks import writers
from packetgrain.sources import documents
from packetgrain.sources.tables import events, scores

SENSOR = ["sensor"]
DAY_US = 86_400_000_000


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    """Event kinds are sensors, event values scores; large errors and purchases are attacks."""
    return events(spark, folder).select(
        F.col("event_type").alias("sensor"), "event_id", "ts_us", F.col("value").alias("score"),
        F.col("user_id"), (F.col("event_type") == "error").cast("int").alias("label"),
    )


def _halves(spark: SparkSession, folder: str) -> DataFrame:
    return windows.half_split(_scores(spark, folder), SENSOR, [F.col("ts_us"), F.col("event_id")])


def _calibration(spark: SparkSession, folder: str, per_hour: float = 0.0) -> DataFrame:
    fit = _halves(spark, folder).where(F.col("part") == "calibration")
    # A stored table of one row per sensor, as every reader of a calibration has it.
    return cut(calibrate.calibration_records(fit, SENSOR, "value", per_hour))


def _rounded(df: DataFrame, names: list[str]) -> list:
    return [F.round(n, 6).alias(n) if n in names else F.col(n) for n in df.columns]


def half_split(spark: SparkSession, folder: str) -> DataFrame:
    parts = windows.half_split(scores(spark, folder), ["series"], [F.col("ts_us"), F.col("event_id")])
    return parts.select("series", "event_id", "part")


def calibration_table(spark: SparkSession, folder: str) -> DataFrame:
    doubles = [
        "mean", "std", "byte_threshold", "anchor_threshold", "gold_threshold", "quantile_999", "mean_plus_3sigma",
    ]
    out = _calibration(spark, folder).select(
        "sensor", "num_windows", "window_rate_per_sec", "elapsed_seconds", "threshold_method", "score_metric", *doubles
    )
    return out.select(*_rounded(out, [d for d in doubles if d != "gold_threshold"]))


def calibration_budget(spark: SparkSession, folder: str) -> DataFrame:
    """Records by an alert budget of one in two days; a user with a single window has no rate."""
    fitted = calibrate.calibration_records(
        _scores(spark, folder).withColumn("sensor", F.col("user_id")), SENSOR, "value", 0.02, calibrated_at=F.lit("2024-02-01T00:00:00")
    )
    explicit = F.when(F.col("sensor") % 10 == 0, F.lit(77.5))
    return fitted.select(
        "sensor", "num_windows", "threshold_method", "target_incidents_per_hour", F.round("budget_quantile", 9).alias("budget_quantile"),
        F.round("byte_threshold", 6).alias("byte_threshold"), F.round("anchor_threshold", 6).alias("anchor_threshold"),
        "gold_threshold", "calibrated_at",
        F.round(calibrate.resolve_threshold(explicit, F.when(F.col("sensor") % 10 != 1, F.col("byte_threshold"))), 6).alias("in_use"),
    )


def calibration_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    return _calibration(spark, folder).select(
        "sensor", F.posexplode("score_quantiles").alias("pct", "value")
    ).select("sensor", F.col("pct").cast("long").alias("pct"), F.round("value", 6).alias("value"))


def budget_thresholds(spark: SparkSession, folder: str) -> DataFrame:
    out = calibrate.budget_thresholds(scores(spark, folder), ["series"], 0.02)
    return out.select(
        "series", F.round("budget_quantile", 9).alias("budget_quantile"),
        F.round("budget_threshold", 6).alias("budget_threshold"),
    )


def score_percentile(spark: SparkSession, folder: str) -> DataFrame:
    fitted = _calibration(spark, folder).select("sensor", "score_quantiles")
    joined = _scores(spark, folder).join(fitted, "sensor")
    pct = calibrate.score_percentile(F.col("score"), F.col("score_quantiles"))
    return joined.select("event_id", pct.cast("long").alias("percentile"))


def psi_drift(spark: SparkSession, folder: str) -> DataFrame:
    live = _halves(spark, folder).where(F.col("part") == "holdout").withColumn("bucket", F.floor(F.col("ts_us") / (5 * DAY_US)))
    # Every other interval sees other traffic.
    live = live.withColumn("score", F.when(F.col("bucket") % 2 == 0, F.col("score")).otherwise(F.col("score") * 3))
    out = calibrate.psi(live, _calibration(spark, folder), ["sensor", "bucket"])
    return out.select("sensor", "bucket", "n", F.round("psi", 6).alias("psi"), "drift_flag")


def roc_points(spark: SparkSession, folder: str) -> DataFrame:
    points = calibrate.roc_points(_scores(spark, folder).withColumn("all", F.lit(1)), ["all"])
    return points.select(
        "threshold", "tp", "fp", F.round("tpr", 9).alias("tpr"), F.round("fpr", 9).alias("fpr")
    )


def roc_auc(spark: SparkSession, folder: str) -> DataFrame:
    out = calibrate.auc(_scores(spark, folder), ["user_id"])
    return out.select("user_id", "attack", "benign", F.round("auc", 9).alias("auc"))


def operating_thresholds(spark: SparkSession, folder: str) -> DataFrame:
    points = calibrate.roc_points(_scores(spark, folder), ["user_id"])
    out = calibrate.pick_thresholds(points, ["user_id"], 0.1)
    return out.select("user_id", *[F.round(c, 9).alias(c) for c in out.columns if c != "user_id"])


def threshold_at_fpr(spark: SparkSession, folder: str) -> DataFrame:
    return calibrate.threshold_at_fpr(_scores(spark, folder).where(F.col("label") == 0), ["user_id"], 0.05)


def nearest_rank(spark: SparkSession, folder: str) -> DataFrame:
    return calibrate.nearest_rank(scores(spark, folder), ["series"], 0.75)


def holdout_rates(spark: SparkSession, folder: str) -> DataFrame:
    fitted = _calibration(spark, folder).select("sensor", "byte_threshold", "gold_threshold")
    held = _halves(spark, folder).where(F.col("part") == "holdout").join(fitted, "sensor")
    over = calibrate.exceedance_rate(held, SENSOR, F.col("byte_threshold"))
    return over.select("sensor", F.round("rate", 9).alias("rate"))


# Daily instead of quarter-hourly, as the small tables have few scores: a day alone is below min_samples.
RECALIBRATION = calibrate.Recalibration(
    ref_pct=95.0, interval_us=DAY_US, min_samples=150, trailing=300, digest_us=4 * DAY_US, recent=120, max_psi=0.10
)


def _recalibrated(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Scores with the flags of a live run, and the calibration with its alert budget."""
    rows = _scores(spark, folder).withColumn("flagged", F.col("score") > 250)
    return rows, _calibration(spark, folder).withColumn("budget_quantile", F.lit(0.98))


def adaptive_thresholds(spark: SparkSession, folder: str) -> DataFrame:
    rows, fitted = _recalibrated(spark, folder)
    out = calibrate.adaptive_thresholds(rows, fitted, SENSOR, ["ts_us", "event_id"], RECALIBRATION)
    return out.select(*_rounded(out, ["psi", "threshold", "reference"]))


def evt_tail(spark: SparkSession, folder: str) -> DataFrame:
    rows = _scores(spark, folder)
    return calibrate.evt_thresholds(rows, SENSOR, 0.001).select(
        "sensor", "n", "num_tail_points", F.round("t0", 6).alias("t0")
    )


def evt_threshold(spark: SparkSession, folder: str) -> DataFrame:
    """Tail fits by event kind, and by port where there are enough scores."""
    rows = _scores(spark, folder)
    out = calibrate.evt_thresholds(rows, SENSOR, 0.001)
    return out.select(
        "sensor", "n", "num_tail_points", *[F.round(c, 4).alias(c) for c in ("t0", "gpd_shape", "gpd_scale", "threshold")]
    )


RUNS, TARGET_FPR = 5, 0.005


def _evaluations(spark: SparkSession, folder: str) -> DataFrame:
    """Five evaluations by port. Large values are attacks, beside errors, but in the first one errors alone."""
    run = F.col("k") % RUNS
    attack = (F.col("event_type") == "error") & (F.col("value") > 40) | (F.col("value") > 100 + 20 * run) & (run > 0)
    rows = events(spark, folder).select(
        run.alias("run"), "event_id", "ts_us", (F.col("value") / 20).alias("score"), attack.cast("int").alias("label"),
        F.col("event_type").alias("file"),
    )
    parts = windows.half_split(rows, ["run"], [F.col("ts_us"), F.col("event_id")])
    return parts.withColumnRenamed("part", "role")


def metrics_report(spark: SparkSession, folder: str) -> DataFrame:
    """Three rules per evaluation, with what the document says of its calibration."""
    docs = evaluation.metrics_documents(_evaluations(spark, folder), TARGET_FPR)
    c, h = "calibration.", "holdout."
    point = F.coalesce(*[F.when(F.col("rule") == r, F.col(f"{c}{r}.fpr")) for r in ("youden", "target_fpr")])
    return docs.select("*", F.explode("holdout.results").alias("rule", "r")).select(
        "run", F.array_join("caveats", ";").alias("caveats"), F.col(c + "num_benign_windows").alias("benign"),
        F.col(c + "num_attack_windows").alias("attack"), F.round(c + "auc", 9).alias("auc"),
        F.col(h + "num_benign_windows").alias("held_benign"), F.col(h + "num_attack_windows").alias("held_attack"),
        F.size(c + "per_file_mean_score").alias("files"), F.round(F.col(c + "per_file_mean_score")["benign_calibration"], 9).alias("benign_mean"),
        F.round(F.col(c + "per_file_mean_score")["error"], 9).alias("error_mean"), F.col(c + "evt.num_tail_points").alias("tail_points"),
        "rule", F.round("r.threshold", 4).alias("threshold"), F.round(point, 9).alias("calibration_fpr"),
        F.round("r.holdout_benign_false_positive_rate", 9).alias("fpr"), F.round("r.holdout_attack_detection_rate", 9).alias("dr"),
    )


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics documents written as JSON, read back, and judged in training order."""
    docs = evaluation.metrics_documents(_evaluations(spark, folder), TARGET_FPR).withColumn(
        "checkpoint", F.format_string("run_ep0_gs%d_mid", F.col("run") * 1000)
    )
    path = f"{shared_folder(spark)}/metrics-{uuid.uuid4().hex}"
    writers.write_json(docs, path)
    points = leaderboard.operating_points(documents.metrics(spark, path, docs.schema, lines=True))
    staged = points.withColumn("step", leaderboard.step_of(F.col("checkpoint"))).withColumn("board", F.lit(1))
    return leaderboard.judge(staged, ["board"], [F.col("step")], drift=0.05)


def leaderboard_rows(spark: SparkSession, folder: str) -> DataFrame:
    out = leaderboard.rows(_judged(spark, folder), F.lit("2024-02-01T00:00:00"))
    return out.select(*[F.round(c, 5).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


def best_checkpoint(spark: SparkSession, folder: str) -> DataFrame:
    out = leaderboard.best_record(_judged(spark, folder), ["board"], F.col("step"), F.lit("2024-02-01T00:00:00"))
    return out.select(*[F.round(c, 5).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


QUERIES = {
    "metrics_report": metrics_report,
    "leaderboard_rows": leaderboard_rows,
    "best_checkpoint": best_checkpoint,
    "half_split": half_split,
    "calibration_table": calibration_table,
    "calibration_budget": calibration_budget,
    "calibration_quantiles": calibration_quantiles,
    "budget_thresholds": budget_thresholds,
    "score_percentile": score_percentile,
    "psi_drift": psi_drift,
    "roc_points": roc_points,
    "roc_auc": roc_auc,
    "operating_thresholds": operating_thresholds,
    "threshold_at_fpr": threshold_at_fpr,
    "nearest_rank": nearest_rank,
    "holdout_rates": holdout_rates,
    "adaptive_thresholds": adaptive_thresholds,
    "evt_tail": evt_tail,
    "evt_threshold": evt_threshold,
}

EV = """
ev AS (
  SELECT event_id, epoch_us(ts) AS ts_us, user_id, event_type, value,
         (props::JSON->>'k')::INT AS k
  FROM events)"""
_HALF = EV + """,
half AS (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY event_type ORDER BY ts_us, event_id)
                 <= count(*) OVER (PARTITION BY event_type) // 2
            THEN 'calibration' ELSE 'holdout' END AS part
  FROM ev)"""
_CAL = _HALF + """,
cal AS (
  SELECT event_type AS sensor, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS std,
         quantile_cont(value, 0.999) AS q999,
         list_transform(range(0, 101), lambda i: i / 100.0) AS fr,
         quantile_cont(value, [0,0.01,0.02,0.03,0.04,0.05,0.06,0.07,0.08,0.09,0.1,0.11,0.12,0.13,0.14,0.15,0.16,0.17,0.18,0.19,
           0.2,0.21,0.22,0.23,0.24,0.25,0.26,0.27,0.28,0.29,0.3,0.31,0.32,0.33,0.34,0.35,0.36,0.37,0.38,0.39,
           0.4,0.41,0.42,0.43,0.44,0.45,0.46,0.47,0.48,0.49,0.5,0.51,0.52,0.53,0.54,0.55,0.56,0.57,0.58,0.59,
           0.6,0.61,0.62,0.63,0.64,0.65,0.66,0.67,0.68,0.69,0.7,0.71,0.72,0.73,0.74,0.75,0.76,0.77,0.78,0.79,
           0.8,0.81,0.82,0.83,0.84,0.85,0.86,0.87,0.88,0.89,0.9,0.91,0.92,0.93,0.94,0.95,0.96,0.97,0.98,0.99,1]) AS q,
         (max(ts_us) - min(ts_us)) / 1e6 AS secs
  FROM half WHERE part = 'calibration' GROUP BY event_type),
calt AS (SELECT *, greatest(q999, mean + 3 * std) AS thr FROM cal)"""
_ADAPT = _CAL + f""",
live AS (
  SELECT event_type AS sensor, value, ts_us // {DAY_US} AS bucket, ts_us // {4 * DAY_US} AS digest, ts_us, event_id,
         least(9, greatest(0, len(list_filter([q[1],q[11],q[21],q[31],q[41],q[51],q[61],q[71],q[81],q[91],q[101]],
               lambda x: x <= value)) - 1)) AS bin,
         row_number() OVER (PARTITION BY event_type, ts_us // {4 * DAY_US} ORDER BY ts_us, event_id) - 1 AS li
  FROM ev JOIN cal ON sensor = event_type),
clean AS (
  SELECT sensor, value, row_number() OVER (PARTITION BY sensor ORDER BY ts_us, event_id) - 1 AS ci
  FROM live WHERE NOT value > 250),
per AS (SELECT sensor, digest, bucket, count(*) FILTER (NOT value > 250) AS c, count(*) AS a FROM live GROUP BY ALL),
ck AS (
  SELECT sensor, digest, bucket, sum(c) OVER (PARTITION BY sensor ORDER BY bucket)::BIGINT AS upto,
         sum(a) OVER (PARTITION BY sensor, digest ORDER BY bucket)::BIGINT AS seen,
         row_number() OVER (PARTITION BY sensor ORDER BY bucket) AS i
  FROM per),
smp AS (
  SELECT ck.sensor, ck.i, list(value ORDER BY value) AS v, count(value) AS n
  FROM ck LEFT JOIN clean ON clean.sensor = ck.sensor AND ci >= upto - 300 AND ci < upto GROUP BY ALL),
bc AS (
  SELECT ck.sensor, ck.i, b, count(*) FILTER (bin = b) AS c, count(*) AS n
  FROM ck JOIN live ON live.sensor = ck.sensor AND live.digest = ck.digest AND li >= seen - 120 AND li < seen,
       (SELECT unnest(range(0, 10)) AS b)
  WHERE (ck.bucket + 1) % 4 <> 0 GROUP BY ALL),
ps AS (
  SELECT sensor, i, CASE WHEN any_value(n) >= 100 THEN sum((greatest(c / n, 1e-4) - 0.1) * ln(greatest(c / n, 1e-4) / 0.1)) END AS psi
  FROM bc GROUP BY sensor, i),
st AS (
  SELECT ck.sensor, ck.bucket, ck.i, smp.n, psi, v[round_even(0.98::DOUBLE * (smp.n - 1), 0)::INT + 1] AS ct,
         v[round_even(0.95::DOUBLE * (smp.n - 1), 0)::INT + 1] AS cr, smp.n >= 150 AND coalesce(psi <= 0.10, true) AS use
  FROM ck JOIN smp ON smp.sensor = ck.sensor AND smp.i = ck.i LEFT JOIN ps ON ps.sensor = ck.sensor AND ps.i = ck.i),
f AS (
  SELECT sensor, 0::BIGINT AS i, NULL::BIGINT AS bucket, 0::BIGINT AS n, NULL::DOUBLE AS psi, false AS applied,
         thr AS t, q[96] AS r, thr AS at_, q[96] AS ar FROM calt
  UNION ALL
  SELECT f.sensor, st.i, st.bucket, st.n, st.psi, st.use,
         CASE WHEN use THEN least(at_ + 3, greatest(at_ - 3, least(t + 1, greatest(t - 1, ct)))) ELSE t END,
         CASE WHEN use THEN least(ar + 3, greatest(ar - 3, least(r + 1, greatest(r - 1, cr)))) ELSE r END, at_, ar
  FROM f JOIN st ON st.sensor = f.sensor AND st.i = f.i + 1)"""
def _evt_sql(series: str, value: str, source: str, fpr: float) -> str:
    """The tail fit over ``source``: five passes over a grid of 65 thetas."""
    parts = [f"""
q0 AS (SELECT {series} AS s, quantile_cont({value}, 0.98) AS t0, count({value}) AS n FROM {source} GROUP BY 1),
tail AS (SELECT s, {value} - t0 AS x FROM {source} JOIN q0 ON s = {series} WHERE {value} > t0),
g0 AS (
  SELECT s, count(*) AS c, avg(x) AS m, -0.999::DOUBLE / max(x) AS lo, 5.0::DOUBLE / avg(x) AS hi, NULL::DOUBLE AS shape, NULL::DOUBLE AS scale
  FROM tail GROUP BY s HAVING count(*) >= 10)"""]
    for i in range(5):
        parts.append(f"""
a{i} AS (
  SELECT s, c, m, lo, hi, i, lo + (hi - lo) * i / 64 AS theta, avg(ln(1 + (lo + (hi - lo) * i / 64) * x)) AS shape
  FROM g{i} JOIN tail USING (s), (SELECT unnest(range(0, 65)) AS i) GROUP BY ALL),
b{i} AS (SELECT *, CASE WHEN abs(theta) < 1e-9 THEN m ELSE shape / theta END AS scale FROM a{i}),
g{i + 1} AS (
  SELECT s, c, m, greatest(lo, theta - (hi - lo) * 2 / 64) AS lo, least(hi, theta + (hi - lo) * 2 / 64) AS hi, shape, scale FROM b{i}
  QUALIFY row_number() OVER (PARTITION BY s ORDER BY -ln(scale) - CASE WHEN abs(theta) < 1e-9 THEN 0 ELSE shape END DESC, theta DESC) = 1)""")
    parts.append(f"""
evt AS (
  SELECT s, n, c, t0, shape, scale,
         CASE WHEN abs(shape) < 1e-6 THEN t0 - scale * ln(n / c * {fpr}::DOUBLE)
              ELSE t0 + scale / shape * (pow(n / c * {fpr}::DOUBLE, -shape) - 1) END AS thr
  FROM g5 JOIN q0 USING (s) WHERE n >= 30)""")
    return ",".join(parts)


_ROC = EV + """,
roc AS (
  SELECT user_id, value, sum(sum((event_type = 'error')::INT)) OVER w AS tp,
         sum(sum((event_type <> 'error')::INT)) OVER w AS fp
  FROM ev GROUP BY user_id, value WINDOW w AS (PARTITION BY user_id ORDER BY value DESC)),
tot AS (
  SELECT user_id, count(*) FILTER (event_type = 'error') AS p, count(*) FILTER (event_type <> 'error') AS n
  FROM ev GROUP BY user_id),
pts AS (SELECT *, tp / p AS tpr, fp / n AS fpr FROM roc JOIN tot USING (user_id))"""

_METRICS = EV + f""",
h AS (
  SELECT k % 5 AS run, event_id, event_type AS file, value / 20 AS value,
         (event_type = 'error' AND value > 40 OR value > 100 + 20 * (k % 5) AND k % 5 > 0)::INT AS y,
         row_number() OVER (PARTITION BY k % 5 ORDER BY ts_us, event_id) <= count(*) OVER (PARTITION BY k % 5) // 2 AS cal
  FROM ev),
c AS (SELECT * FROM h WHERE cal),
cb AS (SELECT run, value FROM c WHERE y = 0),
pn AS (SELECT run, sum(y)::BIGINT AS p, (count(*) - sum(y))::BIGINT AS n FROM c GROUP BY run),
hc AS (SELECT run, count(*) FILTER (y = 0) AS hn, count(*) FILTER (y = 1) AS hp FROM h WHERE NOT cal GROUP BY run),
ff AS (SELECT run, CASE WHEN y = 0 THEN 'benign_calibration' ELSE file END AS f, avg(value) AS m FROM c GROUP BY ALL),
fm AS (SELECT run, count(*)::INT AS files, max(m) FILTER (f = 'benign_calibration') AS bm, max(m) FILTER (f = 'error') AS em FROM ff GROUP BY run),
r AS (SELECT run, value, sum(sum(y)) OVER w AS tp, sum(count(*) - sum(y)) OVER w AS fp FROM c GROUP BY run, value
      WINDOW w AS (PARTITION BY run ORDER BY value DESC)),
t AS (
  SELECT run, arg_max((value, fp / n), (tp * n - fp * p, value)) AS youden,
         arg_min((value, fp / n), (abs(fp / n - 0.005::DOUBLE), -value)) AS target_fpr
  FROM r JOIN pn USING (run) GROUP BY run),
rk AS (SELECT run, y, rank() OVER (PARTITION BY run ORDER BY value) + (count(*) OVER (PARTITION BY run, value) - 1) / 2.0 AS q FROM c),
au AS (SELECT run, CASE WHEN any_value(p) > 0 AND any_value(n) > 0 THEN
         ((sum(q) FILTER (y = 1) - any_value(p) * (any_value(p) + 1) / 2.0) / (any_value(p) * any_value(n)))::DOUBLE END AS auc
       FROM rk JOIN pn USING (run) GROUP BY run),
{_evt_sql("run", "value", "cb", 0.005)},
u AS (SELECT run, 'youden' AS rule, youden[1] AS threshold, youden[2] AS cfpr FROM t
      UNION ALL SELECT run, 'target_fpr', target_fpr[1], target_fpr[2] FROM t UNION ALL SELECT s, 'evt', thr, NULL FROM evt),
rr AS (
  SELECT run, rule, any_value(threshold) AS threshold, any_value(cfpr) AS cfpr,
         avg((value > threshold)::INT) FILTER (y = 0) AS fpr, avg((value > threshold)::INT) FILTER (y = 1) AS dr
  FROM u JOIN h USING (run) WHERE NOT cal GROUP BY run, rule)"""
_JUDGED = """
pt AS (
  SELECT run, run * 1000 AS step, 'run_ep0_gs' || run * 1000 || '_mid' AS checkpoint, any_value(auc) AS auc, any_value(bm) AS bm,
         max(dr) FILTER (rule = 'evt') AS evt_dr, max(fpr) FILTER (rule = 'evt') AS evt_fpr, max(dr) FILTER (rule = 'target_fpr') AS target_dr,
         max(fpr) FILTER (rule = 'target_fpr') AS target_fpr, max(dr) FILTER (rule = 'youden') AS youden_dr, max(fpr) FILTER (rule = 'youden') AS youden_fpr
  FROM rr JOIN au USING (run) JOIN fm USING (run) GROUP BY run),
pm AS (SELECT *, min(bm) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS smin FROM pt),
pj AS (SELECT *, CASE WHEN evt_fpr > 0.5 THEN 'false alarms' WHEN auc <= 0.55 THEN 'chance level' WHEN bm - smin > 0.05 THEN 'baseline drift' ELSE '' END AS note FROM pm),
pe AS (SELECT *, CASE WHEN note = '' THEN 'OK' ELSE 'COLLAPSED' END AS status, CASE WHEN note = '' AND evt_fpr <= 0.01 THEN evt_dr END AS metric FROM pj),
bj AS (SELECT *, max(metric) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM pe)"""

ORACLE = {
    "metrics_report": f"""
WITH {_METRICS}
SELECT run, concat_ws(';', CASE WHEN pn.n < 30 THEN 'few benign windows' END, CASE WHEN p < 30 THEN 'few attack windows' END,
         CASE WHEN pn.n = 0 OR p = 0 THEN 'empty set' END) AS caveats,
       pn.n AS benign, p AS attack, round(auc, 9) AS auc, hn AS held_benign, hp AS held_attack, files, round(bm, 9) AS benign_mean,
       round(em, 9) AS error_mean, c AS tail_points, rule, round(threshold, 4) AS threshold, round(cfpr, 9) AS calibration_fpr,
       round(fpr, 9) AS fpr, round(dr, 9) AS dr
FROM rr JOIN pn USING (run) JOIN au USING (run) JOIN hc USING (run) JOIN fm USING (run) LEFT JOIN evt ON s = run""",
    "leaderboard_rows": f"""
WITH {_METRICS}, {_JUDGED}
SELECT '2024-02-01T00:00:00' AS timestamp, checkpoint, status, CASE WHEN metric IS NULL THEN 'no' ELSE 'yes' END AS eligible,
       round(round(auc, 6), 5) AS calib_auc, round(round(evt_dr, 6), 5) AS evt_detection, round(round(evt_fpr, 6), 5) AS evt_fpr,
       round(round(target_dr, 6), 5) AS target_fpr_detection, round(round(target_fpr, 6), 5) AS target_fpr_fpr,
       round(round(youden_dr, 6), 5) AS youden_detection, round(round(youden_fpr, 6), 5) AS youden_fpr,
       round(round(bm, 3), 5) AS benign_sigma_proxy, note FROM bj""",
    "best_checkpoint": f"""
WITH {_METRICS}, {_JUDGED}
SELECT 1 AS board, checkpoint, round(metric, 5) AS evt_detection, round(evt_fpr, 5) AS evt_fpr, round(auc, 5) AS calib_auc,
       round(bm, 5) AS benign_sigma_proxy, '2024-02-01T00:00:00' AS selected_at,
       'max held-out EVT detection s.t. held-out FPR <= 0.01' AS criterion
FROM bj WHERE metric IS NOT NULL AND (best IS NULL OR metric > best) ORDER BY step DESC LIMIT 1""",
    "half_split": f"""
WITH {EV}
SELECT user_id AS series, event_id,
       CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts_us, event_id)
                 <= count(*) OVER (PARTITION BY user_id) // 2 THEN 'calibration' ELSE 'holdout' END AS part
FROM ev""",
    "calibration_table": f"""
WITH {_CAL}
SELECT sensor, n AS num_windows, round(n / secs, 3) AS window_rate_per_sec, round(secs, 1) AS elapsed_seconds,
       'max(q99.9, mean+3sigma)' AS threshold_method, 'value' AS score_metric,
       round(mean, 6) AS mean, round(std, 6) AS std, round(thr, 6) AS byte_threshold,
       round(thr, 6) AS anchor_threshold, round(thr + 3.0, 4) AS gold_threshold,
       round(q999, 6) AS quantile_999, round(mean + 3 * std, 6) AS mean_plus_3sigma
FROM calt""",
    "calibration_budget": f"""
WITH {EV},
s AS (
  SELECT user_id, list(value ORDER BY value) AS v, count(*) AS n, avg(value) + 3 * coalesce(stddev_samp(value), 0) AS m3,
         quantile_cont(value, 0.999) AS q999, (max(ts_us) - min(ts_us)) / 1e6 AS secs FROM ev GROUP BY user_id),
a AS (SELECT *, CASE WHEN secs > 0 THEN 1 - least(greatest(0.02 / (n / secs * 3600), 1e-6), 0.5) END AS q FROM s),
b AS (
  SELECT *, CASE WHEN q IS NULL THEN greatest(q999, m3)
              ELSE v[floor(q * (n - 1))::INT + 1] + (v[ceil(q * (n - 1))::INT + 1] - v[floor(q * (n - 1))::INT + 1]) * (q * (n - 1) - floor(q * (n - 1))) END AS thr
  FROM a)
SELECT user_id AS sensor, n AS num_windows,
       CASE WHEN q IS NULL THEN 'max(q99.9, mean+3sigma)' ELSE format('alert-budget (0.02/hr -> q{{:.5f}})', q) END AS threshold_method,
       0.02 AS target_incidents_per_hour, round(q, 9) AS budget_quantile, round(thr, 6) AS byte_threshold, round(thr, 6) AS anchor_threshold,
       round(thr + 3.0, 4) AS gold_threshold, '2024-02-01T00:00:00' AS calibrated_at,
       round(CASE WHEN user_id % 10 = 0 THEN 77.5 WHEN user_id % 10 = 1 THEN 12.0 ELSE thr END, 6) AS in_use
FROM b""",
    "calibration_quantiles": f"""
WITH {_CAL}
SELECT sensor, unnest(range(0, 101)) AS pct, round(unnest(q), 6) AS value FROM cal""",
    "budget_thresholds": f"""
WITH {EV},
s AS (
  SELECT user_id, list(value ORDER BY value) AS v, count(*) AS n,
         1 - least(greatest(0.02 / (count(*) / ((max(ts_us) - min(ts_us)) / 1e6) * 3600), 1e-6), 0.5) AS q
  FROM ev GROUP BY user_id),
a AS (SELECT *, q * (n - 1) AS x FROM s)
SELECT user_id AS series, round(q, 9) AS budget_quantile,
       round(v[floor(x)::INT + 1] + (v[ceil(x)::INT + 1] - v[floor(x)::INT + 1]) * (x - floor(x)), 6) AS budget_threshold
FROM a""",
    "score_percentile": f"""
WITH {_CAL}
SELECT event_id, least(100, len(list_filter(q, lambda x: x < value))) AS percentile
FROM ev JOIN cal ON sensor = event_type""",
    "psi_drift": f"""
WITH {_CAL},
b AS (
  SELECT sensor, ts_us // {5 * DAY_US} AS bucket,
         least(9, greatest(0, len(list_filter([q[1],q[11],q[21],q[31],q[41],q[51],q[61],q[71],q[81],q[91],q[101]],
               lambda x: x <= value * CASE WHEN ts_us // {5 * DAY_US} % 2 = 0 THEN 1 ELSE 3 END)) - 1)) AS bin
  FROM half JOIN cal ON sensor = event_type WHERE part = 'holdout'),
g AS (SELECT sensor, bucket, count(*) AS n FROM b GROUP BY ALL),
c AS (
  SELECT g.sensor, g.bucket, g.n, i, count(b.bin) AS c
  FROM (SELECT *, unnest(range(0, 10)) AS i FROM g) g
  LEFT JOIN b ON b.sensor = g.sensor AND b.bucket = g.bucket AND b.bin = i GROUP BY ALL),
p AS (
  SELECT sensor, bucket, n,
         CASE WHEN n >= 100 THEN sum((greatest(c / n, 1e-4) - 0.1) * ln(greatest(c / n, 1e-4) / 0.1)) END AS psi
  FROM c GROUP BY sensor, bucket, n)
SELECT sensor, bucket, n, round(psi, 6) AS psi, coalesce(psi > 0.25, false) AS drift_flag FROM p""",
    "roc_points": f"""
WITH {EV},
r AS (
  SELECT value, sum(sum((event_type = 'error')::INT)) OVER (ORDER BY value DESC) AS tp,
         sum(sum((event_type <> 'error')::INT)) OVER (ORDER BY value DESC) AS fp FROM ev GROUP BY value)
SELECT value AS threshold, tp::BIGINT AS tp, fp::BIGINT AS fp,
       round(tp / (SELECT count(*) FROM ev WHERE event_type = 'error'), 9) AS tpr,
       round(fp / (SELECT count(*) FROM ev WHERE event_type <> 'error'), 9) AS fpr
FROM r""",
    "roc_auc": f"""
WITH {EV},
rk AS (
  SELECT user_id, event_type = 'error' AS pos,
         rank() OVER (PARTITION BY user_id ORDER BY value)
         + (count(*) OVER (PARTITION BY user_id, value) - 1) / 2.0 AS r
  FROM ev),
s AS (
  SELECT user_id, count(*) FILTER (pos) AS a, count(*) FILTER (NOT pos) AS b, sum(r) FILTER (pos) AS rs
  FROM rk GROUP BY user_id)
SELECT user_id, a AS attack, b AS benign,
       CASE WHEN a > 0 AND b > 0 THEN round((rs - a * (a + 1) / 2.0)::DOUBLE / (a * b), 9) END AS auc
FROM s""",
    "operating_thresholds": f"""
WITH {_ROC},
y AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY tp * n - fp * p DESC, value DESC) AS ry,
         row_number() OVER (PARTITION BY user_id ORDER BY abs(fpr - 0.1::DOUBLE), value DESC) AS rt
  FROM pts)
SELECT a.user_id, a.value AS youden_threshold, round(a.tpr, 9) AS youden_tpr, round(a.fpr, 9) AS youden_fpr,
       b.value AS target_threshold, round(b.tpr, 9) AS target_tpr, round(b.fpr, 9) AS target_fpr
FROM y a JOIN y b ON a.user_id = b.user_id AND a.ry = 1 AND b.rt = 1""",
    "threshold_at_fpr": f"""
WITH {EV},
r AS (
  SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) - 1 AS i,
         count(*) OVER (PARTITION BY user_id) AS n
  FROM ev WHERE event_type <> 'error')
SELECT user_id, value AS threshold FROM r
WHERE i = greatest(0, least(ceil((1.0::DOUBLE - 0.05::DOUBLE) * n) - 1, n - 1))""",
    "nearest_rank": f"""
WITH {EV},
r AS (
  SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) - 1 AS i,
         count(*) OVER (PARTITION BY user_id) AS n FROM ev)
SELECT user_id AS series, value FROM r WHERE i = round_even(0.75::DOUBLE * (n - 1), 0)""",
    "holdout_rates": f"""
WITH {_CAL}
SELECT sensor, round(avg((value > thr)::INT), 9) AS rate
FROM half JOIN calt ON sensor = event_type WHERE part = 'holdout' GROUP BY sensor""",
    "adaptive_thresholds": f"""
WITH RECURSIVE {_ADAPT}
SELECT sensor, bucket, n, round(psi, 6) AS psi, applied, round(t, 6) AS threshold, round(r, 6) AS reference FROM f WHERE i > 0""",
    "evt_tail": f"""
WITH {EV},
t AS (SELECT event_type, quantile_cont(value, 0.98) AS t0, count(*) AS n FROM ev GROUP BY event_type)
SELECT event_type AS sensor, n, count(*) FILTER (value > t0) AS num_tail_points, round(t0, 6) AS t0
FROM ev JOIN t USING (event_type) GROUP BY ALL
HAVING n >= 30 AND count(*) FILTER (value > t0) >= 10""",
    "evt_threshold": f"""
WITH {EV}, {_evt_sql("event_type", "value", "ev", 0.001)}
SELECT s AS sensor, n, c AS num_tail_points, round(t0, 4) AS t0, round(shape, 4) AS gpd_shape, round(scale, 4) AS gpd_scale, round(thr, 4) AS threshold
FROM evt""",
}
