"""Byte offsets, entropy labels and fixed-length byte windows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetgrain.functions.octets import cut_bytes
from packetgrain.operators.ordering import fits, running
from packetgrain.session import cut, small

PAD = -1


def byte_offsets(
    packets: DataFrame, keys: list[str], order: list[Column], data: str = "data", within: bool | None = None
) -> DataFrame:
    """Bytes of the same stream that precede each packet."""
    out = running(
        packets, keys, order, {"byte_offset": ("sum", F.length(data).cast("long"))}, inclusive=False, within=within
    )
    return out.withColumn("byte_offset", F.coalesce("byte_offset", F.lit(0)).cast("long"))


def stream_windows(
    streams: DataFrame, width: int, stride: int | None = None, tail: str = "pad", data: str = "data"
) -> DataFrame:
    """W4/W5 for streams held whole in one row: windows without any shuffle.

    ``tail='pad'`` keeps a last shorter window, ``'drop'`` does not; the window's valid
    bytes are ``n_valid`` and the missing rest is what the pad sentinel stands for.
    """
    stride = stride or width
    size = F.length(data)
    full = F.when(size >= width, F.floor((size - width) / stride) + 1).otherwise(F.lit(0))
    count = full
    if tail == "pad":
        count = full + F.when(size > full * stride, 1).otherwise(0)
    rest = [c for c in streams.columns if c != data]
    # The pieces are cut inside the row, so no copy of the whole stream travels per window.
    pieces = F.transform(
        F.sequence(F.lit(0).cast("long"), count.cast("long") - 1),
        lambda i: cut_bytes(data, i * stride, width),
    )
    return (
        streams.where(count > 0)
        .select(*rest, F.posexplode(pieces).alias("win_idx", "bytes"))
        .withColumn("win_idx", F.col("win_idx").cast("long"))
        .withColumn("n_valid", F.length("bytes"))
    )


def packet_windows(
    packets: DataFrame,
    keys: list[str],
    order: list[Column],
    width: int,
    tail: str = "drop",
    data: str = "data",
    ts: str = "ts_us",
    within: bool | None = None,
    done: list[str] | None = None,
) -> DataFrame:
    """Non-overlapping windows over packets concatenated per key.

    Every packet is cut where it crosses a window edge; a window collects at most
    ``width`` slices, so a group never grows with the stream. The window's time is
    the time of the packet holding its first byte. ``within`` is the answer of
    ``ordering.fits`` on a cheaper frame with the same packets, when there is one.
    ``done`` names columns to take, as ``done_…``, from the packet holding the last byte.
    """
    done = done or []
    off = byte_offsets(packets, keys, order, data, within).where(F.length(data) > 0)
    first = F.floor(F.col("byte_offset") / width)
    last = F.floor((F.col("byte_offset") + F.length(data) - 1) / width)
    sliced = off.select(
        *keys, *dict.fromkeys([ts, *done]), "byte_offset", data, F.explode(F.sequence(first, last)).alias("win_idx")
    )
    begin = F.greatest(F.col("win_idx") * width - F.col("byte_offset"), F.lit(0))
    end = F.least((F.col("win_idx") + 1) * width - F.col("byte_offset"), F.length(data))
    slices = sliced.select(
        *keys,
        "win_idx",
        ts,
        *[F.col(c).alias(f"done_{c}") for c in done],
        F.col("byte_offset").alias("_off"),
        cut_bytes(data, begin, end - begin).alias("_part"),
    )
    grouped = slices.groupBy(*keys, "win_idx").agg(
        F.min_by(ts, "_off").alias(ts),
        *[F.max_by(f"done_{c}", "_off").alias(f"done_{c}") for c in done],
        F.array_sort(F.collect_list(F.struct("_off", "_part"))).alias("_parts"),
    )
    joined = F.unhex(F.array_join(F.transform("_parts", lambda p: F.hex(p["_part"])), ""))
    out = grouped.select(*keys, "win_idx", ts, *[f"done_{c}" for c in done], joined.alias("bytes")).withColumn(
        "n_valid", F.length("bytes")
    )
    return out if tail == "pad" else out.where(F.col("n_valid") == width)


def idle_lives(packets: DataFrame, keys: list[str], ttl_us: int, ts: str = "ts_us") -> DataFrame:
    """keys, ``_tcell``, life, begun: the life of a flow that every time cell belongs to, and that life's first time.

    Packets closer than ``ttl_us`` share a time cell or sit in neighbouring cells, so
    the gap test runs on one row per (flow, cell) instead of on packets.
    """
    # Inside a cell no pause exceeds ttl_us; between cells the neighbours' edges decide.
    edges = cut(
        packets.groupBy(*keys, F.floor(F.col(ts) / ttl_us).alias("_tcell")).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    )
    fit = fits(edges, keys)
    seen = running(edges, keys, [F.col("_tcell")], {"_prev": ("previous", F.col("_hi"))}, within=fit)
    fresh = F.col("_prev").isNull() | (F.col("_lo") - F.col("_prev") > ttl_us)
    values = {"life": ("sum", (F.col("_fresh") & F.col("_prev").isNotNull()).cast("long")), "begun": ("max", F.when(F.col("_fresh"), F.col("_lo")))}
    lives = running(seen.withColumn("_fresh", fresh), keys, [F.col("_tcell")], values, within=fit)
    return lives.select(*keys, "_tcell", "life", "begun")


def idle_split(packets: DataFrame, keys: list[str], ttl_us: int, ts: str = "ts_us", begun: str | None = None) -> DataFrame:
    """Number the lives of a flow; a pause longer than ``ttl_us`` starts a new one. ``begun`` names a column for the
    first time of the packet's life."""
    lives = cut(idle_lives(packets, keys, ttl_us, ts))
    lives = lives.withColumnRenamed("begun", begun) if begun else lives.drop("begun")
    lives = F.broadcast(lives) if small(lives) else lives
    return packets.withColumn("_tcell", F.floor(F.col(ts) / ttl_us)).join(lives, [*keys, "_tcell"]).drop("_tcell")


def one_window_per_packet(packets: DataFrame, width: int = 512, data: str = "data") -> DataFrame:
    """One zero-padded or truncated window per packet; under 10 bytes it is not scored."""
    padded = F.rpad(F.substring(F.col(data), 1, width), width, F.unhex(F.lit("00")))
    return packets.withColumn("bytes", padded).withColumn("scorable", F.length(data) >= 10)


# Bytes whose counts are taken together; an Arrow batch may have more.
ENTROPY_BYTES = 1 << 20


def _entropy(parts: list[bytes]) -> np.ndarray:
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    # All byte counts of the parts in one pass.
    cell = np.repeat(np.arange(len(parts)) * 256, size) + np.frombuffer(b"".join(parts), np.uint8)
    p = np.bincount(cell, minlength=256 * len(parts)).reshape(-1, 256) / np.maximum(size, 1)[:, None]
    return np.where(size > 0, -(p * np.log2(p + 1e-9)).sum(axis=1), 0.0)


@F.pandas_udf(T.DoubleType())
def byte_entropy(data: pd.Series) -> pd.Series:
    """Shannon entropy of a byte string, with 1e-9 added inside the logarithm."""
    parts = [raw or b"" for raw in data]
    # A row weighs at least the 256 counts it takes.
    upto = np.cumsum([max(len(raw), 256) for raw in parts], dtype=np.int64)
    edges = [0, *(np.flatnonzero(np.diff(upto // ENTROPY_BYTES)) + 1).tolist(), len(parts)]
    found = [_entropy(parts[lo:hi]) for lo, hi in zip(edges, edges[1:]) if hi > lo]
    return pd.Series(np.concatenate(found) if found else np.zeros(0))


def anomaly_labels(
    packets: DataFrame, flood: Column | None = None, data: str = "data"
) -> DataFrame:
    """Flood, or entropy under 1.0, or over 7.7 on more than 100 bytes; flood names it."""
    is_flood = flood if flood is not None else F.lit(False)
    scored = packets.withColumn("entropy", byte_entropy(data))
    odd = (F.col("entropy") < 1.0) | ((F.col("entropy") > 7.7) & (F.length(data) > 100))
    return scored.withColumn(
        "anomaly_type",
        F.when(is_flood, F.lit("TCP_SYN_Flood")).when(odd, F.lit("Abnormal_Entropy")),
    )


def half_split(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first floor(n/2) rows of each ordered series are calibration, the rest holdout."""
    placed = running(df, keys, order, {"_at": ("count", F.lit(1))})
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return placed.join(sizes, keys).withColumn(
        "part",
        F.when(F.col("_at") <= F.floor(F.col("_n") / 2), F.lit("calibration")).otherwise("holdout"),
    ).drop("_at", "_n")


def every_nth(windows: DataFrame, n: int) -> DataFrame:
    """Score one of every ``n`` windows; the stream itself was cut in full."""
    return windows.where(F.col("win_idx") % n == 0)


def stop_after(packets: DataFrame, minutes: float, keys: list[str], ts: str = "ts_us") -> DataFrame:
    """Keep each capture's first minutes of capture time."""
    start = packets.groupBy(*keys).agg((F.min(ts) + int(minutes * 60e6)).alias("_stop"))
    return packets.join(start, keys).where(F.col(ts) <= F.col("_stop")).drop("_stop")


def cap_rows(df: DataFrame, keys: list[str], order: list[Column], rows: int) -> DataFrame:
    """At most ``rows`` first rows of every class."""
    return running(df, keys, order, {"_at": ("count", F.lit(1))}).where(
        F.col("_at") <= rows
    ).drop("_at")


def shuffled(windows: DataFrame, seed: int) -> DataFrame:
    """Windows in seeded random order."""
    return windows.orderBy(F.rand(seed))


def spread_by_stream(packets: DataFrame, keys: list[str], order: str, parts: int) -> DataFrame:
    """Packets in ranges of (stream, order): a stream stays together and in order, and
    one that is larger than a part continues in the next."""
    ranged = packets.repartitionByRange(parts, *keys, order)
    return ranged.sortWithinPartitions(*keys, order)


def bytes_array(data: Column | str, width: int) -> Column:
    """A window's bytes as numbers, padded with the -1 sentinel."""
    col = F.col(data) if isinstance(data, str) else data
    values = F.transform(
        F.sequence(F.lit(1), F.length(col)),
        lambda i: F.conv(F.hex(F.substring(col, i, F.lit(1))), 16, 10).cast("smallint"),
    )
    return F.concat(values, F.array_repeat(F.lit(PAD).cast("smallint"), width - F.length(col)))
