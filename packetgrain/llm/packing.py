"""Best-fit packing of documents into sequences of a fixed number of tokens, in rounds that merge as a tree.

Documents are encoded where they lie and cut in pieces of at most ``capacity`` tokens; only a piece's length moves.
Round 0 deals the pieces to cells of about ``CELL_ROWS`` and packs each cell alone: longest first, each into the
fullest bin that still takes it. Bins with less than ``slack`` tokens left are done. The others become items of
the next round, in fewer cells, until one cell is left or no two bins fit together. A cell never has more than
about ``CELL_ROWS`` items, whatever the number of underfull bins.

Defined results: a null or empty text is one piece with the end id alone; rows with equal ids are packed each for
itself; an empty table gives no rows. Other columns are not carried.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetgrain.llm import arrow, tokens
from packetgrain.session import cut

CELL_ROWS = 16_384
FAN_IN = 8


def token_pieces(docs: DataFrame, tokenizer: str, kind: str, end_id: int, capacity: int, ids: bool = False) -> DataFrame:
    """item, doc_id, piece, start, length, ids_crc32 of every piece, and the ids where asked for."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(tokenizer, kind)
        item = TaskContext.get().partitionId() << 33
        for batch in batches:
            for rows, data, offsets in arrow.pieces(batch, "text"):
                found, places = encoder.encode(data, offsets)
                found = np.insert(found, places[1:], end_id).astype("<u4")
                places = places + np.arange(len(places))
                count = -(-np.diff(places) // capacity)
                row = np.repeat(np.arange(len(rows)), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(capacity, np.diff(places)[row] - start)
                at = places[:-1][row] + start
                raw = memoryview(found.view(np.uint8))
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at, at + length, strict=True)]
                columns = {
                    "item": pa.array(item + np.arange(len(row))),
                    "doc_id": rows.column(rows.schema.get_field_index("doc_id")).take(pa.array(row)),
                    "piece": pa.array(piece.astype(np.int32)),
                    "start": pa.array(start),
                    "length": pa.array(length),
                    "ids_crc32": pa.array(crc, pa.int64()),
                }
                if ids:
                    # Pieces lie one after the other, so the cuts are the places themselves.
                    cuts = np.append(at, places[-1]).astype(np.int32)
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(cuts), pa.array(found.astype(np.int32)))
                item += len(row)
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    schema = T.StructType(
        [
            T.StructField("item", T.LongType()),
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
        ]
        + ([T.StructField("ids", T.ArrayType(T.IntegerType(), False))] if ids else [])
    )
    return docs.select("doc_id", "text").mapInArrow(encode, schema)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of every item, and the fill of every bin; longest items first, fullest bin that takes it."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    fills: list[int] = []
    open_ = 0  # bit r is set when a bin has r tokens left
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        fitting = open_ >> size
        if fitting:
            left = size + (fitting & -fitting).bit_length() - 1
            b = free[left].pop()
            if not free[left]:
                open_ ^= 1 << left
        else:
            left, b = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += size
        if left > size:
            free[left - size].append(b)
            open_ |= 1 << (left - size)
    return bins, offsets, np.array(fills, np.int64)


def _round(items: DataFrame, cells: int, capacity: int, number: int) -> DataFrame:
    """item, bin, offset and the bin's fill; a bin is named by its first item."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("item", ignore_index=True)
        bins, offsets, fills = best_fit(rows["length"].to_numpy(), capacity)
        item = rows["item"].to_numpy()
        name = np.empty(len(fills), np.int64)
        first = offsets == 0
        name[bins[first]] = item[first]
        return pd.DataFrame({"item": item, "bin": name[bins], "offset": offsets, "fill": fills[bins]})

    cell = F.pmod(F.xxhash64("item", F.lit(number)), F.lit(cells))
    dealt = items.select("item", "length", cell.alias("_cell"))
    return dealt.groupBy("_cell").applyInPandas(pack, "item long, bin long, offset long, fill long")


def pack(items: DataFrame, capacity: int, slack: int = 16) -> DataFrame:
    """item, sequence_id, offset for ``items(item, length)`` with unique items and lengths of 1 to ``capacity``."""
    items = items.select("item", "length")
    full = items.where(F.col("length") == capacity)
    rest = items.where(F.col("length") < capacity)
    n = rest.count()
    cells = max(1, -(-n // CELL_ROWS))
    placed = cut(_round(rest, cells, capacity, 0))
    rounds = []
    held = _underfull(placed, capacity, slack)
    while (left := held.count()) > 1 and (cells > 1 or rounds == []):
        fewer = max(1, -(-left // CELL_ROWS), -(-cells // FAN_IN))
        if fewer == 1 and cells == 1:
            break  # one cell has packed all of them already
        cells = fewer
        merged = cut(_round(held, cells, capacity, len(rounds) + 1))
        rounds.append(merged)
        held = _underfull(merged, capacity, slack)
        if held.count() == left:
            break  # no two of them fit together
    out = placed.select("item", F.col("bin").alias("sequence_id"), "offset")
    for merged in rounds:
        up = merged.select(F.col("item").alias("sequence_id"), "bin", F.col("offset").alias("_up"))
        out = out.join(up, "sequence_id", "left").select(
            "item",
            F.coalesce("bin", "sequence_id").alias("sequence_id"),
            (F.col("offset") + F.coalesce("_up", F.lit(0))).alias("offset"),
        )
    return out.unionByName(full.select("item", F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset")))


def _underfull(placed: DataFrame, capacity: int, slack: int) -> DataFrame:
    """Bins that go to the next round, one row each: the row of the first item."""
    return placed.where((F.col("offset") == 0) & (F.col("fill") < capacity - slack)).select(
        F.col("bin").alias("item"), F.col("fill").alias("length")
    )


def sequences(docs: DataFrame, tokenizer: str, kind: str, end_id: int, capacity: int = 4096) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    found = cut(token_pieces(docs, tokenizer, kind, end_id, capacity))
    return found.join(pack(found, capacity), "item").drop("item")


def token_sequences(docs: DataFrame, tokenizer: str, kind: str, end_id: int, capacity: int = 4096) -> DataFrame:
    """sequence_id and its token ids, at most ``capacity`` of them."""
    found = cut(token_pieces(docs, tokenizer, kind, end_id, capacity, ids=True))
    rows = found.join(pack(found, capacity), "item")
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return rows.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
