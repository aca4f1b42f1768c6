"""From raw documents to packed training sequences: five stages, each over all that its predecessor kept.

Defined results: the near-duplicate stage and decontamination judge every row by its text, also where ids are null or
repeated; a text of which the suffix stage removed all bytes stays as an empty document; an empty table passes through
all stages; columns besides doc_id, text and n_chars pass unchanged, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetgrain.llm import decontaminate, packing, quality, simhash, suffix_dedup
from packetgrain.session import cut


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held(docs: DataFrame) -> DataFrame:
    """doc_id and text, and all other columns as ``row``, so that no name of theirs meets one of a stage."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*(others or [F.lit(0).alias("none")])).alias("row"))


def _released(held: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs`` again, some of them changed."""
    own = {c: F.col(c) if c in ("doc_id", "text") else F.col("row").getField(c) for c in docs.columns}
    return held.select(*[changed.get(c, column).alias(c) for c, column in own.items()])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier accepts. It learns from the labelled rows of the raw documents."""
    model = quality.fit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return _released(quality.score(_held(docs), model).where("quality_kept"), docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each class of near duplicates."""
    return _released(simhash.first_of_classes(_held(docs)), docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 200 bytes that repeat; characters cut by that go as a whole."""
    found = suffix_dedup.distinct_texts(docs.select("text"), with_text=True).where("n_removed > 0")
    out = _held(docs).withColumn("digest", suffix_dedup.digest()).join(found.select("digest", "kept"), "digest", "left")
    changed = {"text": F.coalesce("kept", "text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        count = F.char_length("kept").cast(kind)
        changed["n_chars"] = F.when(F.col("kept").isNull(), F.col("row").getField("n_chars")).otherwise(count)
    return _released(out, docs, **changed)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items."""
    # What is found depends on the text alone, so every row is judged by its own text, whatever its id.
    named = _held(docs).withColumn("digest", suffix_dedup.digest())
    texts = named.select(F.col("digest").alias("doc_id"), "text")
    found = decontaminate.contaminated(decontaminate.occurrences(texts, _table(spark, sf_dir, "benchmark")))
    bad = cut(found.where("contaminated").select(F.col("doc_id").alias("digest")).distinct())
    return _released(named.join(bad, "digest", "left_anti"), docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token piece of the kept documents with its sequence and place."""
    return packing.sequences(docs, public_tokenizers.path("word_bpe_49k.json"), "word_end", end_id=1, capacity=4096)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs


# A trained classifier is not to be written in SQL.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
