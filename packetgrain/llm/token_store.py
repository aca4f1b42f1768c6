"""Token ids of documents as ORC files in document order.

``write`` deals the texts by ranges of the document id, so that files follow each other in that order, and encodes
after the shuffle: ids never move. Each file has integer run-length encoded ids in stripes of bounded size, a row
index every ``STRIDE`` rows and a Bloom filter on the document id, so ``read`` with ids or a range of ids skips
stripes and row groups by their metadata, and stripes of one file can be read by several tasks.

Defined results: a null text is empty and has the end id alone; rows with equal ids stand next to each other in the
order of their text's hash; a null document id comes first; an empty table gives files without rows. Other columns
are not stored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetgrain.llm import arrow, tokens
from packetgrain.session import shared_folder

STRIPE_BYTES = 16 << 20
STRIDE = 1_000
BLOOM_FPP = 0.01


def _stored(kind: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("doc_id", kind),
            # The task that wrote the row; tasks follow the order of the ids.
            T.StructField("part", T.IntegerType()),
            # Ids before the document among those of its part.
            T.StructField("part_start", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
        ]
    )


def write(docs: DataFrame, path: str, tokenizer: str, kind: str = "byte_level", end_id: int = 0) -> T.StructType:
    """Encode ``docs(doc_id, text)`` into ORC files below ``path``; returns the schema to read them with."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(tokenizer, kind)
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows, data, offsets in arrow.pieces(batch, "text"):
                ids, places = encoder.encode(data, offsets)
                n = len(rows)
                out = np.insert(ids, places[1:], end_id).astype(np.int32)
                places = places + np.arange(n + 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(rows.schema.get_field_index("doc_id")),
                        pa.array(np.full(n, part, np.int32)),
                        pa.array(places[:-1] + before),
                        pa.array(np.diff(places)),
                        pa.ListArray.from_arrays(pa.array(places.astype(np.int32)), pa.array(out)),
                    ],
                    ["doc_id", "part", "part_start", "n_tokens", "ids"],
                )
                before += int(places[-1])

    schema = _stored(docs.schema["doc_id"].dataType)
    dealt = docs.select("doc_id", "text").repartitionByRange("doc_id")
    ordered = dealt.sortWithinPartitions("doc_id", F.xxhash64("text"))
    (
        ordered.mapInArrow(encode, schema)
        .write.option("compression", "zstd")
        .option("orc.stripe.size", STRIPE_BYTES)
        .option("orc.row.index.stride", STRIDE)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", BLOOM_FPP)
        .orc(path)
    )
    return schema


def read(spark: SparkSession, path: str, schema: T.StructType, ids: list | None = None, between=None) -> DataFrame:
    """The stored rows, or those of some document ids; the filter reaches the files' indexes."""
    rows = spark.read.schema(schema).orc(path)
    if ids is not None:
        rows = rows.where(F.col("doc_id").isin(ids))
    if between is not None:
        rows = rows.where(F.col("doc_id").between(*between))
    return rows


def digests(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of stored rows, from the ids read back."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(4)
            places = ids.offsets.to_numpy()
            raw = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<i4")).view(np.uint8))
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(places[:-1], places[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i) for i in range(3)),
                    pa.array(np.diff(places).astype(np.int64)),
                    pa.array(crc, pa.int64()),
                ],
                ["doc_id", "part", "part_start", "n_tokens", "ids_crc32"],
            )

    kinds = {f.name: f.dataType for f in rows.schema}
    schema = T.StructType(
        [T.StructField(c, kinds[c]) for c in ("doc_id", "part", "part_start", "n_tokens")]
        + [T.StructField("ids_crc32", T.LongType())]
    )
    found = rows.select("doc_id", "part", "part_start", "n_tokens", "ids").mapInArrow(check, schema)
    # One row per written file part, so the running sum and the broadcast are as small as the file list.
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.select("part", F.coalesce(before, F.lit(0)).alias("_before"))
    return found.join(F.broadcast(starts), "part").select(
        "doc_id", (F.col("_before") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32"
    )


def folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
