"""Hashed word and byte n-gram features of many texts at once, and bounded samples of labelled rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetgrain.llm import hashing, words


def byte_grams(data: np.ndarray, offsets: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and bucket of every run of ``n`` bytes that lies in one text."""
    count = np.maximum(np.diff(offsets) - n + 1, 0)
    if len(data) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = np.full(len(data) - n + 1, n, np.uint32)
    for j in range(n):
        code = (code ^ data[j : len(data) - n + 1 + j]) * np.uint32(0x01000193)
        code ^= code >> np.uint32(15)
    code *= np.uint32(0x9E3779B1)
    row = np.repeat(np.arange(len(count)), count)
    at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(offsets[:-1], count)
    return row, (code[at] >> np.uint32(32 - bits)).astype(np.int64)


def word_grams(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and bucket of every word between white space, A-Z lower-cased."""
    found = words.find(data, offsets, words.VISIBLE)
    return found.doc, (hashing.mix(found.hashes) >> np.uint64(64 - bits)).astype(np.int64)


def bounded(rows: DataFrame, most: int, *ties: str) -> DataFrame:
    """At most ``most`` rows of the smallest hashes of the id: one top-k per task, then one over those."""
    return rows.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id", *ties).limit(most)


def remainder(divisor: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor
