"""Benchmark passages in documents by winnowed k-gram fingerprints.

Every window of ``width`` words keeps the smallest hash of its k-grams, on both sides. A document and a benchmark
item that share such a window share its smallest hash, so joining fingerprints misses no window. Each hit is
extended to all windows that hold the k-gram, and the windows' words are compared. Items with fewer words than
``width`` are one window each and are looked up at every word. Items without words match nothing.

The benchmark is read in blocks of about ``BLOCK_BYTES`` of text; each block's index is broadcast and all documents
pass by it in a map. With one block nothing is shuffled; with several, the spans of a document are merged.

Defined results: a null or empty text has no words and no hits; every row of a repeated document has its own result;
repeated items count once by their id; a null item id counts as the empty id; an empty table on either side gives
no hits. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetgrain.llm import arrow, hashing, words
from packetgrain.session import cut

WIDTH = 13
GRAM = 5
BLOCK_BYTES = 4 << 20


@dataclass
class Windows:
    """The distinct windows of one length: sorted hashes, their words, and the items that hold them."""

    hashes: np.ndarray
    text: list[bytes]
    items: list[tuple[str, ...]]


@dataclass
class Index:
    fingerprints: np.ndarray
    windows: dict[int, list[Windows]]


def winnow(hashes: np.ndarray, width: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """K-gram hashes, and which of them are the smallest of some window of ``width`` words."""
    grams = hashing.grams(hashes, k)
    span = width - k + 1
    least = words.sliding(grams, span, np.minimum)
    if not len(least):
        return grams, np.zeros(len(grams), bool)
    edge = np.zeros(span - 1, np.uint64)
    return grams, words.sliding(np.concatenate([edge, least, edge]), span, np.maximum) == grams


def index(rows: list[tuple[str, str]], width: int = WIDTH, k: int = GRAM) -> Index:
    """Index of benchmark items ``(item_id, text)``."""
    prints: list[np.ndarray] = []
    found: dict[int, dict[bytes, tuple[int, set[str]]]] = {}
    for item, text in rows:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        w = words.find(raw, np.array([0, len(raw)]))
        n = min(width, len(w.hashes))
        if not n:
            continue
        if n == width:
            grams, kept = winnow(w.hashes, width, k)
            prints.append(grams[kept])
        joined, at, end = w.joined()
        for i, h in enumerate(hashing.grams(w.hashes, n)):
            window = joined[at[i] : end[i + n - 1]]
            found.setdefault(n, {}).setdefault(window, (int(h), set()))[1].add(item or "")
    windows = {}
    for n, by_text in found.items():
        # Different windows of one hash go to different lists, so a list has each hash once.
        layers: list[dict[int, tuple[bytes, tuple[str, ...]]]] = []
        for window, (h, items) in sorted(by_text.items()):
            layer = next((x for x in layers if h not in x), None)
            if layer is None:
                layers.append(layer := {})
            layer[h] = (window, tuple(sorted(items)))
        windows[n] = [
            Windows(np.array(sorted(x), np.uint64), [x[h][0] for h in sorted(x)], [x[h][1] for h in sorted(x)])
            for x in layers
        ]
    return Index(np.unique(np.concatenate([np.zeros(0, np.uint64), *prints])), windows)


def _occurrences(w: words.Words, against: Index, width: int, k: int) -> Iterator[tuple[int, int, tuple[str, ...]]]:
    """First word, length and items of every benchmark window in the texts."""
    joined = None
    room = np.repeat(w.first[1:], w.counts) - np.arange(len(w.hashes))  # words up to the end of the text
    for n, layers in against.windows.items():
        if n == width:
            grams, kept = winnow(w.hashes, width, k)
            hits = np.flatnonzero(kept)
            hits = hits[words.among(grams[hits], against.fingerprints) >= 0]
            starts = np.unique((hits[:, None] - np.arange(width - k + 1)).ravel())
        else:
            starts = np.arange(len(w.hashes))
        starts = starts[starts >= 0]
        starts = starts[room[starts] >= n]
        if not len(starts):
            continue
        if n == width:
            run = hashing.grams(w.hashes[(starts[:, None] + np.arange(n)).ravel()], n)[::n]
        else:
            run = hashing.grams(w.hashes, n)[starts]
        for layer in layers:
            at = words.among(run, layer.hashes)
            for i, place in zip(starts[at >= 0].tolist(), at[at >= 0].tolist(), strict=True):
                joined = joined or w.joined()
                if joined[0][joined[1][i] : joined[2][i + n - 1]] == layer.text[place]:
                    yield i, n, layer.items[place]


def _scan(docs: DataFrame, against: Index, width: int, k: int, key: str) -> DataFrame:
    """The key, n_words, the maximal hit runs of words and the items of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(against)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in arrow.pieces(batch, "text"):
                w = words.find(data, offsets)
                doc, change = w.doc, np.zeros(len(w.hashes) + 1, np.int64)
                items: list[set[str]] = [set() for _ in range(len(rows))]
                for start, n, held in _occurrences(w, shared.value, width, k):
                    change[start] += 1
                    change[start + n] -= 1
                    items[doc[start]].update(held)
                hit = np.concatenate([[False], np.cumsum(change)[:-1] > 0, [False]])
                begin, end = hit[1:-1] & ~hit[:-2], hit[1:-1] & ~hit[2:]
                first = w.first[:-1][w.counts > 0]
                begin[first] = hit[1:-1][first]
                end[first[1:] - 1] = hit[1:-1][first[1:] - 1]
                lo, hi = np.flatnonzero(begin), np.flatnonzero(end) + 1
                place = np.searchsorted(lo, w.first).astype(np.int32)
                base = w.first[doc[lo]] if len(lo) else lo
                runs = pa.StructArray.from_arrays([pa.array(lo - base), pa.array(hi - base)], ["start", "end"])
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(rows.schema.get_field_index(key)),
                        pa.array(w.counts),
                        pa.ListArray.from_arrays(pa.array(place), runs),
                        pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                    ],
                    [key, "n_words", "spans", "items"],
                )

    run = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType(
        [
            T.StructField(key, docs.schema[key].dataType),
            T.StructField("n_words", T.LongType()),
            T.StructField("spans", T.ArrayType(run)),
            T.StructField("items", T.ArrayType(T.StringType())),
        ]
    )
    return docs.select(key, "text").mapInArrow(scan, schema)


def _merged(spans):
    """Overlapping and touching runs of a sorted array joined."""
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def add(done, run):
        last = F.element_at(done, -1)
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], run["end"]).alias("end"))
        joins = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= run["start"])
        return F.when(joins, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(wider))).otherwise(
            F.concat(done, F.array(run))
        )

    return F.aggregate(F.array_sort(spans), empty, add)


def occurrences(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, k: int = GRAM, block: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, spans (start and end word of hit runs) and items of every document."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-size // block))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    if blocks == 1:
        found = _scan(docs, index([tuple(r) for r in items.collect()], width, k), width, k, "doc_id")
    else:
        kept = cut(docs.select("doc_id", "text").withColumn("_row", F.monotonically_increasing_id()))
        scans = []
        for b in range(blocks):
            rows = [tuple(r) for r in items.where(part == b).collect()]
            scans.append(cut(_scan(kept, index(rows, width, k), width, k, "_row")))
        every = scans[0]
        for s in scans[1:]:
            every = every.unionByName(s)
        merged = every.groupBy("_row").agg(
            F.first("n_words").alias("n_words"),
            _merged(F.flatten(F.collect_list("spans"))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )
        found = merged.join(kept.select("_row", "doc_id"), "_row").drop("_row")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), "spans", "items")


def contaminated(rows: DataFrame) -> DataFrame:
    """Adds the flag: some word is hit, and at least a twentieth of all words."""
    return rows.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
