"""Language identification with string kernels.

The kernel of two texts is the number of byte n-grams (1 to 3, blended spectrum) present in both, over the geometric
mean of the numbers each has. Presence is kept in ``2 ** BITS`` hashed places. Landmark texts give the Nyström map of
the kernel; one ridge regression per language (one against the rest) is fitted in it. Scoring multiplies batches of
presence rows with the landmarks' rows and the coefficients: a map without a shuffle.

The model is fitted on at most ``FIT_ROWS`` learning rows, which reach the driver as ``2 ** BITS / 8`` bytes each.

Defined results: a null text and one without a letter are ``und`` with score 0, as is every text when no language
was learned; ties go to the first language in order of name; repeated rows have equal results; an empty table gives
no rows. Other columns are passed on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetgrain.llm import arrow, features, words

BITS = 14
SIZES = (1, 2, 3)
FIT_ROWS = 4_000
LANDMARKS = 256
RIDGE = 1e-2
UNKNOWN = "und"
# Texts of one matrix product.
BLOCK = 64


def presence(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row per text: 1 where some n-gram of it falls."""
    n, width = len(offsets) - 1, 1 << BITS
    out = np.zeros((n, width), np.float32)
    low = words.LOWER[data]
    for size in SIZES:
        row, bucket = features.byte_grams(low, offsets, size, BITS)
        out[row, bucket] = 1
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1))


def has_letter(text: bytes) -> bool:
    # ASCII letters are found without decoding.
    return text.upper() != text.lower() or any(c.isalpha() for c in text.decode())


def _blocks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    data, offsets = arrow.octets(column)
    for lo, hi in arrow.slices(offsets):
        for a in range(lo, hi, BLOCK):
            b = min(a + BLOCK, hi)
            yield a, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # unit rows
    coefficients: np.ndarray
    bias: np.ndarray

    def decisions(self, rows: np.ndarray) -> np.ndarray:
        return unit(rows) @ self.landmarks.T @ self.coefficients + self.bias


def ridge(rows: np.ndarray, lang: list[str]) -> Model:
    """Fit on presence rows; landmarks are taken from the languages in turn, so that small ones have theirs."""
    languages = sorted(set(lang))
    if not languages:
        return Model([], np.zeros((0, 1 << BITS), np.float32), np.zeros((0, 0), np.float32), np.zeros(0, np.float32))
    kind = np.array([languages.index(x) for x in lang])
    turn = np.empty(len(kind), np.int64)
    for c in range(len(languages)):
        turn[kind == c] = np.arange(int((kind == c).sum()))
    x = unit(rows)
    marks = x[np.lexsort((kind, turn))[:LANDMARKS]]
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = values > 1e-6 * values[-1]
    into = vectors[:, good] / np.sqrt(values[good])
    mapped = (x @ marks.T).astype(np.float64) @ into
    target = np.where(kind[:, None] == np.arange(len(languages)), 1.0, -1.0)
    weight = 1 / np.bincount(kind)[kind]
    weight /= weight.sum()
    mean, level = weight @ mapped, weight @ target
    centred = mapped - mean
    gram = (centred * weight[:, None]).T @ centred
    gram += RIDGE * np.trace(gram) / len(gram) * np.eye(len(gram)) + 1e-12 * np.eye(len(gram))
    solved = np.linalg.solve(gram, (centred * weight[:, None]).T @ (target - level))
    return Model(languages, marks, (into @ solved).astype(np.float32), (level - mean @ solved).astype(np.float32))


def fit(docs: DataFrame, most: int = FIT_ROWS) -> Model:
    """Learn from rows with a language whose crc32(doc_id) mod 3 is not 1, at most ``most`` of them; equal rows count once.

    The bound holds on the executors: the driver gets the features of at most ``most`` rows, whatever repeats.
    """
    chosen = features.bounded(
        docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (features.remainder(3) != 1)).select(
            "doc_id", "lang"
        ),
        most,
    ).distinct()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in _blocks(batch.column(2)):
                bits = np.packbits(presence(data, offsets) > 0, axis=1)
                n = len(offsets) - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, n),
                        batch.column(1).slice(first, n),
                        pa.array([r.tobytes() for r in bits], pa.binary()),
                        batch.column(3).slice(first, n),
                    ],
                    ["doc_id", "lang", "bits", "key"],
                )

    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("lang", T.StringType()),
            T.StructField("bits", T.BinaryType()),
            T.StructField("key", T.LongType()),
        ]
    )
    rows = docs.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"])
    made = rows.select("doc_id", "lang", "text", F.xxhash64("text").alias("key")).mapInArrow(pack, schema)
    table = features.bounded(made.dropDuplicates(["doc_id", "lang", "key"]), most, "lang", "key").toArrow()
    table = table.sort_by([("doc_id", "ascending"), ("bits", "ascending"), ("lang", "ascending")])
    raw = np.frombuffer(b"".join(table["bits"].to_pylist()), np.uint8).reshape(-1, (1 << BITS) // 8)
    return ridge(np.unpackbits(raw, axis=1).astype(np.float32), table["lang"].to_pylist())


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score`` (0 to 1) of the strongest language in place of columns of these names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            best = np.full(batch.num_rows, len(model.languages))
            score = np.zeros(batch.num_rows)
            for first, data, offsets in _blocks(batch.column(batch.schema.get_field_index("text"))):
                raw = data.tobytes()
                known = np.array([has_letter(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
                if not known.any() or not model.languages:
                    continue
                found = model.decisions(presence(data, offsets))
                top = found.argmax(axis=1)
                part = slice(first, first + len(known))
                best[part] = np.where(known, top, len(model.languages))
                sure = np.clip((1 + found[np.arange(len(top)), top]) / 2, 0, 1)
                score[part] = np.where(known, sure, 0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names[best], pa.string()), pa.array(score)],
                [*batch.schema.names, "lang_pred", "lang_score"],
            )

    docs = docs.drop("lang_pred", "lang_score")
    schema = T.StructType(
        [*docs.schema, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())]
    )
    return docs.mapInArrow(run, schema)
