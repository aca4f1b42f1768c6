"""Header parsing, flow keys and link-layer framing of raw frames."""

from __future__ import annotations

import socket

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetgrain.functions.batches import Batch
from packetgrain.functions.octets import cut_bytes, unsigned, zeros

ETHERNET, SLL, SLL2 = 1, 113, 276
RAW_IP = (101, 12, 14)
SYN, ACK = 0x02, 0x10


def bare_syn(flags: Column) -> Column:
    """SYN without ACK, as batch labelling and rate scores count it."""
    return (flags.bitwiseAND(SYN) != 0) & (flags.bitwiseAND(ACK) == 0)


def any_syn(flags: Column) -> Column:
    """SYN with or without ACK, as the live detector counts it."""
    return flags.bitwiseAND(SYN) != 0


HEADER = T.StructType(
    [
        T.StructField("src", T.StringType()),
        T.StructField("sport", T.IntegerType()),
        T.StructField("dst", T.StringType()),
        T.StructField("dport", T.IntegerType()),
        T.StructField("proto", T.StringType()),
        T.StructField("flags", T.IntegerType()),
        T.StructField("protocol", T.IntegerType()),
    ]
)


@F.pandas_udf(HEADER)
def _headers(data: pd.Series) -> pd.DataFrame:
    f = Batch([b or b"" for b in data])
    n = f.n
    at = np.full(len(n), 12)
    tagged = f.u16(at) == 0x8100
    kind = np.where(tagged, f.u16(at + 4), f.u16(at))
    l3 = np.where(tagged, 18, 14)
    whole = n >= l3
    ihl = (f.u8(l3) & 15) * 4
    v4 = whole & (kind == 0x0800) & (ihl >= 20) & (n >= l3 + ihl)
    v6 = whole & (kind == 0x86DD) & (n >= l3 + 40)
    proto = np.select([v4, v6], [f.u8(l3 + 9), f.u8(l3 + 6)], 0)
    l4 = np.select([v4, v6], [l3 + ihl, l3 + 40], 0)
    tcp, udp = proto == 6, proto == 17
    ok = (v4 | v6) & (n >= l4 + np.select([tcp, udp], [14, 4], 0))
    known = ok & (tcp | udp)

    def number(values: np.ndarray, valid: np.ndarray = known) -> pd.Series:
        return pd.Series(pd.arrays.IntegerArray(np.where(valid, values, 0).astype(np.int32), ~ok))

    def text(back: int) -> list[str | None]:
        first = np.where(v4, l3 + 12 + 4 * back, l3 + 8 + 16 * back).tolist()
        family = np.where(v4, socket.AF_INET, socket.AF_INET6).tolist()
        size = np.where(v4, 4, 16).tolist()
        rows = zip(f.buffers, first, size, family, ok.tolist())
        return [socket.inet_ntop(k, b[a : a + s]) if good else None for b, a, s, k, good in rows]

    name = np.where(ok, np.select([tcp, udp], ["TCP", "UDP"], "other"), None)
    return pd.DataFrame(
        {
            "src": text(0), "sport": number(f.u16(l4)), "dst": text(1), "dport": number(f.u16(l4 + 2)),
            "proto": name, "flags": number(np.where(tcp, f.u8(l4 + 13), 0)),
            "protocol": number(proto, ok),
        }
    )


def parse(packets: DataFrame, data: str = "data") -> DataFrame:
    """Add src, sport, dst, dport, proto, flags, protocol and is_syn; null when not parsed.

    ``proto`` names the protocol as alerts do, ``protocol`` is its number as ground truth
    has it. One VLAN tag, IPv4 with options, IPv6. TCP needs 14 bytes of its header, UDP four.
    The headers of a batch are read together; only addresses are turned to text one by one.
    """
    read = packets.withColumn("_h", _headers(data))
    fields = [F.col(f"_h.{f.name}").alias(f.name) for f in HEADER.fields]
    return read.select(*packets.columns, *fields).withColumn("is_syn", any_syn(F.col("flags")))


def flow_key(directed: bool = True) -> Column:
    """The directed flow, or ``global`` for packets that did not parse."""
    key = F.concat_ws("|", "src", "sport", "dst", "dport")
    return F.when(F.col("src").isNull(), F.lit("global")).otherwise(key)


def target_key() -> Column:
    """Destination and port."""
    return F.concat_ws(":", "dst", "dport")


def drop_unparsed(parsed: DataFrame) -> DataFrame:
    """Packets that parsed; count the rest with ``unparsed_count``."""
    return parsed.where(F.col("src").isNotNull())


def unparsed_count(parsed: DataFrame, keys: list[str]) -> DataFrame:
    return parsed.groupBy(*keys).agg(
        F.count_if(F.col("src").isNull()).alias("skipped"), F.count(F.lit(1)).alias("packets")
    )


def to_ethernet(packets: DataFrame, data: str = "data", linktype: str = "linktype") -> DataFrame:
    """Frames of any supported link type with Ethernet framing and zero addresses.

    Cooked and raw captures keep their network layer; a frame that is not IP becomes null
    unless it was Ethernet already.
    """
    link = F.col(linktype)
    raw_version = unsigned(data, 0).bitwiseAND(0xF0)
    kind = (
        F.when(link == SLL, cut_bytes(data, 14, 2))
        .when(link == SLL2, cut_bytes(data, 0, 2))
        .when(link.isin(*RAW_IP), F.when(raw_version == 0x40, F.unhex(F.lit("0800"))).when(raw_version == 0x60, F.unhex(F.lit("86DD"))))
    )
    skip = F.when(link == SLL, 16).when(link == SLL2, 20).otherwise(0)
    body = F.substring(F.col(data), skip + 1, F.length(data))
    known = F.hex(kind).isin("0800", "86DD")
    framed = F.when(known, F.concat(zeros(12), kind, body))
    other = link.isin(SLL, SLL2, *RAW_IP)
    return packets.withColumn(data, F.when(other, framed).otherwise(F.col(data)))
