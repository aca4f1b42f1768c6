"""Queries over document texts as byte streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetgrain.operators import calibrate, classify, ngram, scoring, windows
from packetgrain.session import cut
from packetgrain.sources.tables import byte_streams, spread, table

WIDTH = 512
ORDER = 3
KEYS = ["doc_id", "win_idx"]


def _windows(spark: SparkSession, folder: str) -> DataFrame:
    return windows.stream_windows(byte_streams(spark, folder), WIDTH).select(
        "doc_id", "source", "label", "win_idx", "bytes", "n_valid"
    )


def _model(pieces: DataFrame) -> DataFrame:
    return ngram.train(pieces.where(F.col("label") == 0), ORDER)


def scored_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of all documents with their n-gram surprise; labels as given."""
    pieces = _windows(spark, folder)
    return ngram.score_windows(pieces.drop("n_valid"), _model(pieces), ORDER)


def byte_entropy_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Every 13th document is one byte over and over, every 17th a kilobyte of hashes, every 19th part of a flood."""
    hashes = F.array_join(F.transform(
        F.sequence(F.lit(0), F.lit(31)), lambda i: F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit("/"), i.cast("string")), 256)
    ), "")
    docs = byte_streams(spark, folder).withColumn(
        "data",
        F.when(F.col("doc_id") % 13 == 0, F.encode(F.repeat(F.lit("a"), 120), "UTF-8"))
        .when(F.col("doc_id") % 17 == 0, F.unhex(hashes)).otherwise(F.col("data")),
    )
    placed = windows.byte_offsets(docs, ["source"], [F.col("doc_id")])
    labelled = windows.anomaly_labels(placed, F.col("doc_id") % 19 == 0)
    return labelled.select(
        "source", "doc_id", "byte_offset", F.round("entropy", 6).alias("entropy"), "anomaly_type"
    )


def byte_windows_512(spark: SparkSession, folder: str) -> DataFrame:
    return _windows(spark, folder).select(
        *KEYS, F.col("n_valid").cast("long").alias("n_valid"), F.md5(F.hex("bytes")).alias("digest")
    )


def strided_windows(spark: SparkSession, folder: str) -> DataFrame:
    pieces = windows.stream_windows(byte_streams(spark, folder), WIDTH, 256, tail="drop")
    return pieces.select(*KEYS, "n_valid", F.md5(F.hex("bytes")).alias("digest"))


def flow_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Turns of a conversation are packets of a flow; windows run across turns."""
    turns = table(spark, folder, "conversations").select(
        "conv_id", "turn", F.encode("text", "UTF-8").alias("data")
    )
    pieces = windows.packet_windows(turns, ["conv_id"], [F.col("turn")], 128, tail="drop", ts="turn")
    return pieces.select("conv_id", "win_idx", F.col("turn").alias("first_turn"), F.md5(F.hex("bytes")).alias("digest"))


def ngram_model(spark: SparkSession, folder: str) -> DataFrame:
    return _model(_windows(spark, folder)).select("ctx", F.col("byte").cast("long").alias("byte"), "n")


def ngram_contexts(spark: SparkSession, folder: str) -> DataFrame:
    return ngram.totals(_model(_windows(spark, folder))).agg(
        F.count(F.lit(1)).alias("contexts"), F.sum("total").alias("positions")
    )


def ngram_window_scores(spark: SparkSession, folder: str) -> DataFrame:
    return scored_windows(spark, folder).select(
        *KEYS,
        *[F.round(c, 6).alias(c) for c in ("mean_bits", "max_bits", "topk_bits")],
    )


def flagged_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Windows above max(99.9 % quantile, mean + 3 sigma) of the benign ones."""
    # Scored once; calibration and gating read the kept scores.
    scored = cut(scored_windows(spark, folder))
    benign = scored.where(F.col("label") == 0).withColumn("sensor", F.lit("byte"))
    fitted = calibrate.calibration_records(
        benign.withColumn("ts_us", F.col("win_idx")), ["sensor"], "topk", score="topk_bits"
    ).select("sensor", "byte_threshold")
    return scored.withColumn("sensor", F.lit("byte")).join(F.broadcast(fitted), "sensor").select(
        *KEYS, F.round("topk_bits", 6).alias("score"),
        F.round("byte_threshold", 6).alias("threshold"),
        (F.col("topk_bits") > F.col("byte_threshold")).alias("flagged"),
    )


def window_aggregates(spark: SparkSession, folder: str) -> DataFrame:
    """The three window scores over the model's bits per byte, k taken of the whole width."""
    pieces = _windows(spark, folder)
    scored = ngram.width_scores(pieces, _model(pieces), WIDTH, KEYS, ORDER)
    return scored.select(*KEYS, *[F.round(how, 6).alias(how) for how in ("mean", "max", "topk")])


def complexity_scores(spark: SparkSession, folder: str) -> DataFrame:
    pieces = _windows(spark, folder)
    sized = pieces.withColumn("complexity", scoring.code_length("bytes")).drop("n_valid")
    scored = cut(ngram.score_windows(sized, _model(pieces), ORDER))
    fixed = scoring.corrected(scored, "topk_bits")
    typical = scoring.typicality(fixed, F.col("label") == 0, "topk_bits")
    return typical.select(
        *KEYS, *[F.round(c, 6).alias(c) for c in ("complexity", "corrected", "typicality")]
    )


def patch_segments(spark: SparkSession, folder: str) -> DataFrame:
    pieces = _windows(spark, folder)
    marked = ngram.spikes(pieces.select(*KEYS, "bytes"), _model(pieces), KEYS, 5.0, ORDER)
    cut_at = marked.select(*KEYS, scoring.patch_lengths("spikes").alias("lengths"))
    return cut_at.select(*KEYS, scoring.patch_statistics(F.col("lengths")).alias("s")).select(
        *KEYS, F.col("s.patches").cast("long").alias("patches"), F.round("s.mean_len", 6).alias("mean_len"),
        F.col("s.min_len").cast("long").alias("min_len"), F.col("s.max_len").cast("long").alias("max_len"),
        F.md5(F.array_join(F.col("s.ends").cast("array<string>"), ",")).alias("boundaries"),
    )


def heatmap_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Mean surprise intensity per heatmap cell over all windows."""
    pieces = _windows(spark, folder)
    return ngram.heatmap_sums(pieces, _model(pieces), order=ORDER).select(
        F.col("row").alias("grid_row"), F.col("column").alias("grid_column"), "cells",
        F.round("intensity", 6).alias("intensity"), "byte_sum",
    )


def model_loss(spark: SparkSession, folder: str) -> DataFrame:
    """Focal and plain loss of the n-gram model on training and held-out windows.

    The surprise of a byte is -log2 of its probability, so both come from the bits.
    """
    pieces = _windows(spark, folder)
    sets = pieces.withColumn(
        "split", F.when(F.col("label") == 0, "train").when(F.col("label").isNull(), "validation").otherwise("attack")
    )
    model = _model(pieces)
    bits = ngram.position_bits(sets.select("split", "bytes"), model, ["split"], ORDER)
    p = F.pow(F.lit(2.0), -F.col("bits"))
    return bits.withColumn("p", p).groupBy("split").agg(
        F.sum("n").alias("positions"),
        F.round(F.sum(scoring.focal_loss(F.col("p"), 0.0) * F.col("n")) / F.sum("n"), 6).alias("cross_entropy"),
        F.round(F.sum(scoring.focal_loss(F.col("p"), 2.0) * F.col("n")) / F.sum("n"), 6).alias("focal"),
    )


def loss_gap(spark: SparkSession, folder: str) -> DataFrame:
    """Cross entropy of the held-out windows less that of the training windows."""
    losses = model_loss(spark, folder).select("split", F.col("cross_entropy").alias("loss"))
    return scoring.generalisation_gap(losses).select(F.round("gap", 5).alias("gap"))


def byte_class_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Byte shares of the windows of each class; a class without a source leaves no hole in the labels."""
    pieces = _windows(spark, folder).select("label", "bytes")
    sources = {name: pieces.where(F.col("label") == value).select("bytes") for name, value in (("attack", 1), ("benign", 0))}
    rows = classify.assemble({"attack": sources["attack"], "probe": None, "benign": sources["benign"]})
    shares = rows.select("class", "label", classify.byte_histogram("bytes").alias("h"))
    return shares.groupBy("class", "label").agg(
        F.count(F.lit(1)).alias("windows"),
        *[F.round(F.avg(F.get("h", F.lit(b))), 9).alias(f"share_{b}") for b in (32, 101, 110, 195)],
    )


def page_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Cross-corpus check: web pages scored by the model of benign documents."""
    pages = spread(table(spark, folder, "pages")).select("page_id", F.encode("html", "UTF-8").alias("data"))
    pieces = windows.stream_windows(pages, WIDTH)
    scored = ngram.score_windows(pieces.select("page_id", "win_idx", "bytes"), _model(_windows(spark, folder)), ORDER)
    return scored.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("windows"), F.round(F.avg("topk_bits"), 6).alias("mean_score")
    )


QUERIES = {
    "flagged_windows": flagged_windows,
    "byte_entropy_labels": byte_entropy_labels,
    "byte_windows_512": byte_windows_512,
    "strided_windows": strided_windows,
    "flow_windows": flow_windows,
    "ngram_model": ngram_model,
    "ngram_contexts": ngram_contexts,
    "ngram_window_scores": ngram_window_scores,
    "window_aggregates": window_aggregates,
    "complexity_scores": complexity_scores,
    "patch_segments": patch_segments,
    "heatmap_cells": heatmap_cells,
    "model_loss": model_loss,
    "loss_gap": loss_gap,
    "byte_class_profile": byte_class_profile,
    "page_scores": page_scores,
}

_DOCS = """
docs AS (
  SELECT d.doc_id, d.source, l.toxic AS label, hex(encode(d.text)) AS h,
         octet_length(encode(d.text)) AS n
  FROM documents d LEFT JOIN labels l USING (doc_id))"""
_WINS = _DOCS + """,
wins AS (
  SELECT doc_id, source, label, w AS win_idx, substr(h, w * 1024 + 1, 1024) AS hx,
         least(512, n - w * 512) AS n_valid
  FROM (SELECT *, unnest(generate_series(0, (n - 1) // 512)) AS w FROM docs WHERE n > 0))"""
_POS = _WINS + """,
pos AS (
  SELECT doc_id, source, label, win_idx, p,
         ('0x' || substr(hx, 2 * (p - 3) + 1, 6))::BIGINT AS ctx,
         ('0x' || substr(hx, 2 * p + 1, 2))::BIGINT AS byte
  FROM (SELECT *, unnest(generate_series(3, n_valid - 1)) AS p FROM wins WHERE n_valid > 3))"""
_MODEL = _POS + """,
model AS (SELECT ctx, byte, count(*) AS n FROM pos WHERE label = 0 GROUP BY ALL),
totals AS (SELECT ctx, sum(n)::BIGINT AS total FROM model GROUP BY ctx)"""
_BITS = _MODEL + """,
bits AS (
  SELECT p.doc_id, p.source, p.label, p.win_idx, p.p, p.byte,
         CASE WHEN t.ctx IS NULL THEN 8.0::DOUBLE
              ELSE -log2((coalesce(m.n, 0) + 0.1::DOUBLE) / (t.total + 25.6::DOUBLE)) END AS bits
  FROM pos p LEFT JOIN totals t USING (ctx)
  LEFT JOIN model m ON m.ctx = p.ctx AND m.byte = p.byte)"""


def score_sql(ctes: str = _BITS) -> str:
    """Window scores as a CTE named ``sc``; k follows half-even rounding."""
    return ctes + """,
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, win_idx ORDER BY bits DESC) AS r,
         count(*) OVER (PARTITION BY doc_id, win_idx) AS c
  FROM bits),
sc AS (
  SELECT doc_id, any_value(source) AS source, any_value(label) AS label, win_idx,
         avg(bits) AS mean_bits, max(bits) AS max_bits,
         avg(bits) FILTER (r <= greatest(1, round_even(0.1::DOUBLE * c, 0))) AS topk_bits,
         avg(bits) FILTER (r <= 51) AS top51
  FROM ranked GROUP BY doc_id, win_idx)"""


SCORES_SQL = "WITH " + score_sql()

ORACLE = {
    "byte_entropy_labels": f"""
WITH raw AS (
  SELECT doc_id, source, CASE WHEN doc_id % 13 = 0 THEN repeat('61', 120)
         WHEN doc_id % 17 = 0 THEN upper(array_to_string(list_transform(range(0, 32), lambda i: sha256(doc_id || '/' || i)), ''))
         ELSE hex(encode(text)) END AS h FROM documents),
docs AS (SELECT *, length(h) // 2 AS n FROM raw),
counts AS (
  SELECT doc_id, n, substr(h, 2 * i + 1, 2) AS b, count(*) AS c
  FROM (SELECT doc_id, n, h, unnest(generate_series(0, n - 1)) AS i FROM docs WHERE n > 0)
  GROUP BY ALL),
ent AS (SELECT doc_id, -sum(c / n * log2(c / n + 1e-9)) AS e FROM counts GROUP BY doc_id)
SELECT source, doc_id,
       coalesce(sum(n) OVER (PARTITION BY source ORDER BY doc_id
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS byte_offset,
       round(coalesce(e, 0.0), 6) AS entropy,
       CASE WHEN doc_id % 19 = 0 THEN 'TCP_SYN_Flood' WHEN coalesce(e, 0.0) < 1.0 OR (e > 7.7 AND n > 100) THEN 'Abnormal_Entropy' END AS anomaly_type
FROM docs LEFT JOIN ent USING (doc_id)""",
    "byte_windows_512": f"""
WITH {_WINS}
SELECT doc_id, win_idx, n_valid, md5(hx) AS digest FROM wins""",
    "strided_windows": f"""
WITH {_DOCS}
SELECT doc_id, w AS win_idx, 512 AS n_valid, md5(substr(h, w * 512 + 1, 1024)) AS digest
FROM (SELECT *, unnest(generate_series(0, (n - 512) // 256)) AS w FROM docs WHERE n >= 512)""",
    "flow_windows": """
WITH t AS (
  SELECT conv_id, turn, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM conversations),
o AS (
  SELECT *, coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM t),
f AS (SELECT conv_id, string_agg(h, '' ORDER BY turn) AS h, sum(n)::BIGINT AS n FROM t GROUP BY conv_id),
w AS (
  SELECT conv_id, w AS win_idx, substr(h, w * 256 + 1, 256) AS hx
  FROM (SELECT *, unnest(generate_series(0, n // 128 - 1)) AS w FROM f WHERE n >= 128))
SELECT w.conv_id, w.win_idx, o.turn AS first_turn, md5(hx) AS digest
FROM w JOIN o ON o.conv_id = w.conv_id AND w.win_idx * 128 >= off AND w.win_idx * 128 < off + o.n""",
    "ngram_model": f"WITH {_MODEL} SELECT ctx, byte, n FROM model",
    "ngram_contexts": f"""
WITH {_MODEL} SELECT count(*) AS contexts, sum(total)::BIGINT AS positions FROM totals""",
    "ngram_window_scores": f"""
{SCORES_SQL}
SELECT doc_id, win_idx, round(mean_bits, 6) AS mean_bits, round(max_bits, 6) AS max_bits,
       round(topk_bits, 6) AS topk_bits FROM sc""",
    "flagged_windows": f"""
{SCORES_SQL},
thr AS (
  SELECT greatest(quantile_cont(topk_bits, 0.999), avg(topk_bits) + 3 * stddev_samp(topk_bits)) AS t
  FROM sc WHERE label = 0)
SELECT doc_id, win_idx, round(topk_bits, 6) AS score, round(t, 6) AS threshold, topk_bits > t AS flagged
FROM sc, thr""",
    "window_aggregates": f"""
{SCORES_SQL}
SELECT doc_id, win_idx, round(mean_bits, 6) AS mean, round(max_bits, 6) AS max,
       round(top51, 6) AS topk FROM sc""",
    "complexity_scores": f"""
{SCORES_SQL},
pairs AS (
  SELECT doc_id, win_idx, n_valid, substr(hx, 2 * i + 1, 2) AS a, substr(hx, 2 * i + 3, 2) AS b, count(*) AS n
  FROM (SELECT *, unnest(generate_series(0, n_valid - 2)) AS i FROM wins WHERE n_valid > 1)
  GROUP BY ALL),
tot AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, win_idx, a) AS t FROM pairs),
code AS (
  SELECT doc_id, win_idx, -sum(n * log2(n / t)) / any_value(n_valid) AS complexity
  FROM tot GROUP BY doc_id, win_idx),
mu AS (SELECT avg(topk_bits) AS m FROM sc WHERE label = 0)
SELECT doc_id, win_idx, round(complexity, 6) + 0.0 AS complexity,
       round(topk_bits - complexity, 6) AS corrected, round(abs(topk_bits - m), 6) AS typicality
FROM sc JOIN code USING (doc_id, win_idx), mu""",
    "patch_segments": f"""
WITH {_MODEL},
ent AS (
  SELECT ctx, -sum(p * log2(p + 1e-9)) - (256 - count(*)) * max(rest) * log2(max(rest) + 1e-9) AS e
  FROM (SELECT ctx, (n + 0.1::DOUBLE) / (total + 25.6::DOUBLE) AS p, 0.1::DOUBLE / (total + 25.6::DOUBLE) AS rest
        FROM model JOIN totals USING (ctx)) GROUP BY ctx),
chain AS (
  SELECT doc_id, win_idx, i, CASE WHEN i >= 2 THEN ('0x' || substr(hx, 2 * (i - 2) + 1, 6))::BIGINT END AS ctx
  FROM (SELECT *, unnest(generate_series(0, n_valid - 1)) AS i FROM wins)),
spk AS (
  SELECT doc_id, win_idx, i, (i >= 2 AND (e IS NULL OR e > 5.0))::INT AS s
  FROM chain LEFT JOIN ent USING (ctx)),
seg AS (
  SELECT *, coalesce(sum(s) OVER (PARTITION BY doc_id, win_idx ORDER BY i
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM spk),
sub AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, win_idx, g ORDER BY i) - 1) // 64 AS q FROM seg),
len AS (SELECT doc_id, win_idx, g, q, count(*) AS n FROM sub GROUP BY ALL),
run AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, win_idx ORDER BY g, q) AS upto FROM len)
SELECT doc_id, win_idx, count(*) AS patches, round(avg(n), 6) AS mean_len, min(n) AS min_len, max(n) AS max_len,
       md5(string_agg(upto::VARCHAR, ',' ORDER BY upto)) AS boundaries
FROM run GROUP BY doc_id, win_idx""",
    "heatmap_cells": f"""
WITH {_BITS}
SELECT (p - 3) // 32 AS grid_row, (p - 3) % 32 AS grid_column, count(*) AS cells,
       round(avg(least(1.0, greatest(0.0, bits / 8.0))), 6) AS intensity, sum(byte)::BIGINT AS byte_sum
FROM bits GROUP BY ALL""",
    "loss_gap": f"""
WITH {_BITS},
s AS (SELECT label, -ln(pow(2.0::DOUBLE, -bits)) AS l FROM bits)
SELECT round(round(avg(l) FILTER (label IS NULL), 6) - round(avg(l) FILTER (label = 0), 6), 5) AS gap FROM s""",
    "byte_class_profile": f"""
WITH {_WINS},
c AS (
  SELECT CASE WHEN label = 1 THEN 'attack' ELSE 'benign' END AS class, n_valid,
         list_transform(range(0, n_valid), lambda i: substr(hx, 2 * i + 1, 2)) AS b FROM wins WHERE label IS NOT NULL)
SELECT class, CASE WHEN class = 'attack' THEN 0 ELSE 1 END AS label, count(*) AS windows,
       round(avg(len(list_filter(b, lambda x: x = '20')) / n_valid), 9) AS share_32, round(avg(len(list_filter(b, lambda x: x = '65')) / n_valid), 9) AS share_101,
       round(avg(len(list_filter(b, lambda x: x = '6E')) / n_valid), 9) AS share_110, round(avg(len(list_filter(b, lambda x: x = 'C3')) / n_valid), 9) AS share_195
FROM c GROUP BY class""",
    "model_loss": f"""
WITH {_BITS},
s AS (
  SELECT CASE WHEN label = 0 THEN 'train' WHEN label IS NULL THEN 'validation' ELSE 'attack' END AS split,
         bits, pow(2.0::DOUBLE, -bits) AS p FROM bits)
SELECT split, count(*) AS positions, round(avg(-ln(p)), 6) AS cross_entropy,
       round(avg(-pow(1 - p, 2) * ln(p)), 6) AS focal
FROM s GROUP BY split""",
    "page_scores": "WITH " + _MODEL + """,
pw AS (
  SELECT page_id, w AS win_idx, substr(h, w * 1024 + 1, 1024) AS hx, least(512, n - w * 512) AS n_valid
  FROM (SELECT *, unnest(generate_series(0, (n - 1) // 512)) AS w
        FROM (SELECT page_id, hex(encode(html)) AS h, octet_length(encode(html)) AS n FROM pages) WHERE n > 0)),
pp AS (
  SELECT page_id, win_idx, ('0x' || substr(hx, 2 * (p - 3) + 1, 6))::BIGINT AS ctx,
         ('0x' || substr(hx, 2 * p + 1, 2))::BIGINT AS byte
  FROM (SELECT *, unnest(generate_series(3, n_valid - 1)) AS p FROM pw WHERE n_valid > 3)),
pb AS (
  SELECT page_id, win_idx,
         CASE WHEN t.ctx IS NULL THEN 8.0::DOUBLE
              ELSE -log2((coalesce(m.n, 0) + 0.1::DOUBLE) / (t.total + 25.6::DOUBLE)) END AS bits
  FROM pp p LEFT JOIN totals t USING (ctx) LEFT JOIN model m ON m.ctx = p.ctx AND m.byte = p.byte),
rk AS (
  SELECT *, row_number() OVER (PARTITION BY page_id, win_idx ORDER BY bits DESC) AS r,
         count(*) OVER (PARTITION BY page_id, win_idx) AS c FROM pb),
ps AS (
  SELECT page_id, win_idx, avg(bits) FILTER (r <= greatest(1, round_even(0.1::DOUBLE * c, 0))) AS s
  FROM rk GROUP BY page_id, win_idx)
SELECT page_id, count(*) AS windows, round(avg(s), 6) AS mean_score FROM ps GROUP BY page_id""",
}
