"""The registered queries of the text operators, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetgrain.llm import (
    decontaminate,
    features,
    language,
    license_scan,
    main_text,
    merkle,
    merkle_sql,
    packing,
    periodic_runs,
    quality,
    simhash,
    suffix_dedup,
    syncmers,
    token_store,
    url_filter,
    url_sql,
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.deduplicate(table(spark, folder, "documents"))


def op2_token_orc(spark: SparkSession, folder: str) -> DataFrame:
    path = token_store.folder(spark)
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    schema = token_store.write(table(spark, folder, "documents"), path, tokenizer, "byte_level", end_id=0)
    return token_store.digests(token_store.read(spark, path, schema))


def op5_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return packing.sequences(table(spark, folder, "documents"), tokenizer, "word_end", end_id=1, capacity=4096)


def op6_winnowing(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.occurrences(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return decontaminate.contaminated(found).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)

OP6_SQL = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), 13) AS n
      FROM (SELECT CAST(item_id AS VARCHAR) AS item_id, {WORDS} AS w FROM benchmark) WHERE len(w) > 0),
held AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS t
         FROM (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
kinds AS (SELECT DISTINCT n FROM b),
places AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, kinds WHERE len(w) >= n),
hits AS (SELECT doc_id, item_id, i, n
         FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS t FROM places) JOIN held USING (n, t)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit
          FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
          FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op9_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.labels(license_scan.scan(table(spark, folder, "documents")))


def op3_simhash_vp_tree(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.classes(table(spark, folder, "documents"), size=4, radius=4)


def op4_page_tree(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return main_text.extract(pages, main_text.fit(pages)).select(
        "page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars")
    )


def op7_closed_syncmers(spark: SparkSession, folder: str) -> DataFrame:
    return syncmers.edited_pairs(table(spark, folder, "documents"))


def op8_string_kernel(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    return language.identify(docs.select("doc_id", "text"), language.fit(docs)).select(
        "doc_id",
        (features.remainder(3) == 1).alias("held_out"),
        "lang_pred",
        F.col("lang_score").alias("score"),
    )


def op10_subword_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, folder, "labels"))
    return quality.score(docs, model).select(
        "doc_id",
        (features.remainder(5) == 0).alias("held_out"),
        F.col("quality_score").alias("score"),
        F.col("quality_kept").cast("int").alias("predicted"),
    )


def op11_merkle_veb(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaf = merkle.leaf_of(*fields, F.col("text"))
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # Tampered with: the texts of a third of the ids.
    claim = F.when(features.remainder(3) == 0, merkle.leaf_of(*fields, low)).otherwise(leaf)
    rows = docs.select(F.col("lang").alias("key"), "doc_id", leaf.alias("leaf"), claim.alias("claim"))
    return merkle.audit(merkle.manifest(rows), "claim")


URL_RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)


def op12_redirect_classes(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(table(spark, folder, "pages").select("page_id", "url", "html"), URL_RULES)


def planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; the words of a tenth of the ids repeat with one period from some word to the end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    found = F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), 0)
    some = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, found).alias("w")).withColumn("n", F.size("w"))
    g = F.floor(F.col("h") / 10)
    some = some.withColumn("a", F.when(F.col("n") > 0, g % F.col("n")))
    some = some.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8)))
    other = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1),
        lambda i: F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")),
    )
    return some.select("doc_id", F.when(F.col("n") > 0, F.array_join(other, " ")).otherwise(F.col("text")).alias("text"))


def op13_lcp_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs.scan(planted_runs(table(spark, folder, "documents")))
    # The greatest exact length / period; the least start and period among equals.
    best = F.reduce(
        "runs",
        F.get("runs", F.lit(0)),
        lambda a, b: F.when(b["length"] * a["period"] > a["length"] * b["period"], b).otherwise(a),
    )
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda line: F.concat(line, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_dedup,
        op2_token_orc,
        op3_simhash_vp_tree,
        op4_page_tree,
        op5_best_fit_packing,
        op6_winnowing,
        op7_closed_syncmers,
        op8_string_kernel,
        op9_license_scan,
        op10_subword_quality,
        op11_merkle_veb,
        op12_redirect_classes,
        op13_lcp_runs,
    )
}
ORACLE: dict[str, str] = {
    "op6_winnowing": OP6_SQL,
    "op11_merkle_veb": merkle_sql.sql(),
    "op12_redirect_classes": url_sql.sql(URL_RULES),
}
