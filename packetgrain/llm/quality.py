"""Document quality by supervised subword embeddings.

Words and byte n-grams (2 to 4) of a whole text are hashed to ``2 ** BITS`` buckets. A bucket has a learned vector, a
document the average of its buckets' vectors, and a softmax layer on that gives the class. Training is stochastic
gradient descent in numpy over at most ``FIT_ROWS`` labelled rows, which reach the driver as bucket counts only
(``2 ** BITS`` numbers a row at most). As average and output layer are linear, a fitted model is one weight per
bucket: scoring is a map over Arrow batches without a shuffle.

Defined results: a null or empty text has the score of a text without features (the output bias); ties and repeated
rows each have their own result; without labels of both classes every score is the share of label 1, or 0.5 without
labels; an empty table gives no rows. Other columns are passed on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetgrain.llm import arrow, features

BITS = 14
DIM = 16
FIT_ROWS = 6_000
EPOCHS = 12
RATE = 0.5
THRESHOLD = 0.3


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Share of every bucket among a text's features, one row per text; words weigh as much as the byte n-grams."""
    n, width = len(offsets) - 1, 1 << BITS
    out = np.zeros((n, width), np.float32)
    parts = [features.word_grams(data, offsets, BITS)]
    parts += [features.byte_grams(data, offsets, k, BITS) for k in (2, 3, 4)]
    for row, bucket in parts:
        found = np.bincount(row * width + bucket, minlength=n * width).reshape(n, width)
        out += found / np.maximum(found.sum(axis=1, keepdims=True), 1) / len(parts)
    return out


def _batches(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """First row and feature matrix of slices of at most 64 texts."""
    data, offsets = arrow.octets(batch.column(batch.schema.get_field_index("text")))
    for lo, hi in arrow.slices(offsets):
        for a in range(lo, hi, 64):
            b = min(a + 64, hi)
            yield a, counts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scores(self, shares: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(shares @ self.weights + self.bias, -30, 30)))


def sgd(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, rate: float = RATE) -> Model:
    """Fit vectors and output layer on (buckets, shares, label) rows, one row a step, the rate falling to zero."""
    width = 1 << BITS
    label = np.array([r[2] for r in rows], np.int64)
    share = float(label.mean()) if len(label) else 0.5
    if not len(label) or share in (0.0, 1.0):
        p = min(max(share, 0.01), 0.99)
        return Model(np.zeros(width, np.float32), float(np.log(p / (1 - p))))
    rng = np.random.default_rng(7)
    vectors = rng.uniform(-0.5, 0.5, (width, DIM)).astype(np.float32)
    layer, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    step, steps = 0, epochs * len(rows)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            bucket, part, y = rows[i]
            now = rate * (1 - step / steps)
            step += 1
            v = vectors[bucket]
            mean = part @ v
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            error = p / p.sum()
            error[y] -= 1
            back = layer @ error
            layer -= now * np.outer(mean, error)
            bias -= now * error
            # Shares are below one, so the vectors take larger steps than the layer.
            vectors[bucket] = v - 20 * now * np.outer(part, back)
    return Model((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> Model:
    """Learn from labelled rows whose crc32(doc_id) mod 5 is not 0, at most ``most`` of them; equal rows count once.

    The bound holds on the executors: the driver gets the features of at most ``most`` rows, whatever repeats.
    """
    marked = labels.where(F.col("quality").isin(0, 1) & (features.remainder(5) != 0))
    chosen = features.bounded(marked.groupBy("doc_id").agg(F.max("quality").alias("quality")), most)
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("key")).join(F.broadcast(chosen), "doc_id")
    # One id may have many texts: the rows themselves are chosen by their keys alone.
    picked = features.bounded(keyed.select("doc_id", "key").distinct(), most, "key")
    rows = keyed.join(F.broadcast(picked), ["doc_id", "key"])

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, shares in _batches(batch):
                row, bucket = np.nonzero(shares)
                cuts = np.searchsorted(row, np.arange(len(shares) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(shares)),
                        batch.column(2).slice(first, len(shares)),
                        batch.column(3).slice(first, len(shares)),
                        pa.ListArray.from_arrays(pa.array(cuts), pa.array(bucket.astype(np.int16))),
                        pa.ListArray.from_arrays(pa.array(cuts), pa.array(shares[row, bucket])),
                    ],
                    ["doc_id", "quality", "key", "bucket", "share"],
                )

    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("quality", chosen.schema["quality"].dataType),
            T.StructField("key", T.LongType()),
            T.StructField("bucket", T.ArrayType(T.ShortType())),
            T.StructField("share", T.ArrayType(T.FloatType())),
        ]
    )
    made = rows.select("doc_id", "text", "quality", "key").mapInArrow(sparse, schema)
    table = made.dropDuplicates(["doc_id", "key"]).toArrow()
    # The order of arrival must not matter.
    table = table.sort_by([("doc_id", "ascending"), ("key", "ascending")])
    column = {c: table[c].combine_chunks() for c in ("bucket", "share")}
    return sgd(
        [
            (column["bucket"][i].values.to_numpy(), column["share"][i].values.to_numpy(), y)
            for i, y in enumerate(table["quality"].to_pylist())
        ]
    )


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``quality_score`` and ``quality_kept`` (score of at least ``threshold``) in place of columns of these names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros(batch.num_rows)
            for first, shares in _batches(batch):
                found[first : first + len(shares)] = model.scores(shares)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found), pa.array(found >= threshold)],
                [*batch.schema.names, "quality_score", "quality_kept"],
            )

    docs = docs.drop("quality_score", "quality_kept")
    schema = T.StructType(
        [*docs.schema, T.StructField("quality_score", T.DoubleType()), T.StructField("quality_kept", T.BooleanType())]
    )
    return docs.mapInArrow(run, schema)
