"""Blanking of TLS application data across the packets of a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetgrain.operators.masking import mask_headers, pieces
from packetgrain.operators.ordering import fits, row_index
from packetgrain.session import cut, limit

STREAM = ["capture", "_src", "_dst", "_sp", "_dp"]
APPLICATION_DATA = 0x17
RECORD_TYPES = (0x14, 0x15, 0x16, 0x17)
CHUNK_PACKETS = ("packetgrain.tlsChunk", 100_000)
STATE = ["owed", "hide", "known"]


def walk(payload: bytearray, owed: int, hide: bool, known: bool) -> tuple[int, bool, bool]:
    """Blank one packet's payload in place; the stream's state goes in and comes out.

    ``owed`` bytes of an earlier record come first and are hidden with it. Then records
    follow each other; of application data only the 5-byte header stays. Bytes that are
    no record are hidden only on a stream that has shown a valid record.
    """
    at, end = 0, len(payload)
    if known and owed > 0 and end:
        used = min(owed, end)
        if hide:
            payload[:used] = bytes(used)
        at, owed = used, owed - used
    while end - at >= 5:
        if payload[at] not in RECORD_TYPES or payload[at + 1] != 3:
            if known:
                payload[at:] = bytes(end - at)
            break
        hide = payload[at] == APPLICATION_DATA
        size = int.from_bytes(payload[at + 3 : at + 5], "big")
        at += 5
        here = min(size, end - at)
        if hide:
            payload[at : at + here] = bytes(here)
        owed, known = size - here, True
        at += here
    return owed, hide, known


def _mask_chunk(pdf: pd.DataFrame) -> tuple[list[bytes], tuple[int, bool, bool]]:
    state = tuple(pdf[c].iloc[0] for c in STATE)
    state = (int(state[0]), bool(state[1]), bool(state[2]))
    out = []
    for raw, start in zip(pdf["data"], pdf["_pay"]):
        start = min(int(start), len(raw))
        payload = bytearray(raw[start:])
        state = walk(payload, *state)
        out.append(raw[:start] + bytes(payload))
    return out, state


def mask_records(packets: DataFrame) -> DataFrame:
    """P10 on the output of ``mask_headers``, which must carry capture and packet_index.

    A stream is walked in chunks of bounded size, each from the state its predecessor
    left. Streams of several chunks first settle those states: all chunks run from a
    fresh state, and a chunk whose entry then differs runs again until none changes.
    """
    spark = packets.sparkSession
    size = limit(spark, CHUNK_PACKETS)
    names = packets.columns
    plain = packets.where(~F.col("_tls"))
    walked = packets.where(F.col("_tls"))
    by = [*STREAM, "_chunk"]
    fresh = [F.lit(0).cast("long").alias("owed"), F.lit(False).alias("hide"), F.lit(False).alias("known")]
    entries = None
    if fits(walked, STREAM, size):
        chunks = walked.withColumn("_chunk", F.lit(0).cast("long"))
    else:
        placed = row_index(walked, STREAM, [F.col("packet_index")], "_at")
        chunks = placed.withColumn("_chunk", F.floor(F.col("_at") / size)).drop("_at")
        several = chunks.where(F.col("_chunk") > 0).select(*STREAM).distinct()
        entries = _settle(cut(chunks.join(several, STREAM, "left_semi")), by, fresh)
    if entries is None:
        ready = chunks.select("*", *fresh)
    else:
        ready = chunks.join(entries, by, "left")
        ready = ready.withColumn("owed", F.coalesce("owed", F.lit(0).cast("long")))
        for c in ("hide", "known"):
            ready = ready.withColumn(c, F.coalesce(c, F.lit(False)))
    at = ready.columns.index

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Streams are contiguous and ordered inside a partition; the state is carried
        # from row to row and starts anew from the chunk's entry at each new key.
        keys = [at(c) for c in by]
        entry, start, data = [at(c) for c in STATE], at("_pay"), at("data")
        last, state = None, (0, False, False)
        for pdf in (batch.iloc[s] for batch in batches for s in pieces(map(len, batch["data"]))):
            masked = []
            for row in pdf.itertuples(index=False, name=None):
                key = tuple(row[i] for i in keys)
                if key != last:
                    last, state = key, (int(row[entry[0]]), bool(row[entry[1]]), bool(row[entry[2]]))
                raw = row[data]
                begin = min(int(row[start]), len(raw))
                payload = bytearray(raw[begin:])
                state = walk(payload, *state)
                masked.append(raw[:begin] + bytes(payload))
            yield pdf.assign(data=masked)[names]

    placed = ready.repartition(*by).sortWithinPartitions(*by, "packet_index")
    return plain.unionByName(placed.mapInPandas(run, packets.schema))


def _settle(chunks: DataFrame, by: list[str], fresh: list) -> DataFrame:
    """Entry state of every chunk, found by repeating only chunks whose entry changed."""
    exit_schema = T.StructType(
        [chunks.schema[c] for c in by]
        + [T.StructField("owed", T.LongType()), T.StructField("hide", T.BooleanType()), T.StructField("known", T.BooleanType())]
    )

    def leave(pdf: pd.DataFrame) -> pd.DataFrame:
        _, (owed, hide, known) = _mask_chunk(pdf.sort_values("packet_index"))
        return pdf[by].head(1).assign(owed=owed, hide=hide, known=known)

    keys = chunks.select(*by).distinct()
    entries = cut(keys.select("*", *fresh))
    exits = cut(chunks.join(entries, by).groupBy(*by).applyInPandas(leave, exit_schema))
    while True:
        following = exits.withColumn("_chunk", F.col("_chunk") + 1)
        wanted = keys.join(following, by, "left").select(
            *by, F.coalesce("owed", F.lit(0).cast("long")).alias("owed"),
            F.coalesce("hide", F.lit(False)).alias("hide"), F.coalesce("known", F.lit(False)).alias("known"),
        )
        changed = cut(wanted.join(entries, [*by, *STATE], "left_anti"))
        if changed.isEmpty():
            return entries
        kept = entries.join(changed.select(*by), by, "left_anti")
        entries = cut(kept.unionByName(changed))
        again = chunks.join(changed, by).groupBy(*by).applyInPandas(leave, exit_schema)
        exits = cut(exits.join(changed.select(*by), by, "left_anti").unionByName(again))


def mask(packets: DataFrame) -> DataFrame:
    """The full masking profile for ``packets(capture, packet_index, …, data)``."""
    return mask_records(mask_headers(packets)).select(*packets.columns)
