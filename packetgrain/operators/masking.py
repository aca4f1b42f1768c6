"""Blanking of addresses, per-packet random fields and encrypted payload.

One Arrow batch of frames is one flat byte array; every rule finds its offsets for all
frames of the batch at once and writes zeros there.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetgrain.functions.batches import Batch
from packetgrain.functions.octets import blank

# Link-layer tags and the ports whose payload is encrypted.
VLAN_TYPES = (0x8100, 0x88A8, 0x9100, 0x9200)
MPLS_TYPES = (0x8847, 0x8848)
TLS_PORTS = (443, 8443, 993, 995, 465, 990, 636)
SSH_PORTS = (22,)
UDP_ENCRYPTED_PORTS = (443, 4500, 51820, 1194)

ARP = 0x0806
TCP, UDP = 6, 17
HEADER = T.StructType(
    [
        T.StructField("data", T.BinaryType()),
        T.StructField("_src", T.BinaryType()),
        T.StructField("_dst", T.BinaryType()),
        T.StructField("_sp", T.IntegerType()),
        T.StructField("_dp", T.IntegerType()),
        T.StructField("_pay", T.IntegerType()),
        T.StructField("_tls", T.BooleanType()),
    ]
)


class Frames(Batch):
    """Frames of a batch with the layers of each: ``l3``, ``net``, ``l4``, ``tp`` and ports.

    P6: stacked VLAN tags and MPLS labels of any depth are followed to the network layer.
    ``net`` is 4, 6, ARP or 0; ``tp`` is TCP or UDP when its fixed header is complete.
    """

    def __init__(self, buffers: list[bytes]):
        super().__init__(buffers)
        self._network()
        self._transport()

    def _network(self) -> None:
        n = self.n
        off = np.full(len(n), 14)
        alive = n >= 14
        kind = self.u16(off - 2)
        while (tagged := alive & np.isin(kind, VLAN_TYPES)).any():
            alive &= ~tagged | (n >= off + 4)
            kind = np.where(tagged, self.u16(off + 2), kind)
            off = np.where(tagged, off + 4, off)
        labelled = alive & np.isin(kind, MPLS_TYPES)
        inside = labelled.copy()
        while inside.any():
            alive &= ~inside | (n >= off + 4)
            bottom = self.u8(off + 2) & 1
            off = np.where(inside, off + 4, off)
            inside &= alive & (bottom == 0)
        version = self.u8(off) >> 4
        net = np.select([kind == 0x0800, kind == 0x86DD, kind == ARP], [4, 6, ARP], 0)
        net = np.where(labelled, np.where(np.isin(version, (4, 6)), version, 0), net)
        need = np.select([net == 4, net == 6, net == ARP], [20, 40, 28], 0)
        self.l3 = off
        self.net = np.where(alive & (n >= off + need), net, 0)

    def _transport(self) -> None:
        net, l3 = self.net, self.l3
        proto = np.select([net == 4, net == 6], [self.u8(l3 + 9), self.u8(l3 + 6)], 0)
        l4 = np.select([net == 4, net == 6], [l3 + (self.u8(l3) & 15) * 4, l3 + 40], 0)
        room = self.n - l4
        self.l4 = l4
        self.tp = np.select([(proto == TCP) & (room >= 20), (proto == UDP) & (room >= 8)], [TCP, UDP], 0)
        known = self.tp > 0
        self.sp = np.where(known, self.u16(l4), 0)
        self.dp = np.where(known, self.u16(l4 + 2), 0)
        self.pay = np.select([self.tp == TCP, self.tp == UDP], [l4 + (self.u8(l4 + 12) >> 4) * 4, l4 + 8], 0)

    def on_port(self, ports: tuple[int, ...]) -> np.ndarray:
        return np.isin(self.sp, ports) | np.isin(self.dp, ports)

    def zero(self, rows: np.ndarray, off, size) -> None:
        """Blank ``size`` bytes from ``off`` in the chosen frames, cut at their ends."""
        off = np.broadcast_to(off, self.n.shape)[rows]
        size = np.minimum(np.broadcast_to(size, self.n.shape)[rows], self.n[rows] - off)
        keep = size > 0
        first, size = (self.start[rows] + off)[keep], size[keep]
        if len(first):
            within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            self.flat[np.repeat(first, size) + within] = 0

    def addresses(self, back: bool) -> list[bytes | None]:
        at = np.select([self.net == 4, self.net == 6], [self.l3 + 12, self.l3 + 8], 0)
        size = np.select([self.net == 4, self.net == 6], [4, 16], 0)
        at = at + size * back
        return [b[a : a + s] if s else None for b, a, s in zip(self.buffers, at.tolist(), size.tolist())]

    def masked(self) -> list[bytes]:
        whole = self.flat.tobytes()
        return [whole[s : s + n] for s, n in zip(self.start.tolist(), self.n.tolist())]


def _blank_addresses(f: Frames) -> None:
    """Hardware and network addresses."""
    f.zero(f.n >= 12, 0, 12)
    f.zero(f.net == 4, f.l3 + 12, 8)
    f.zero(f.net == 6, f.l3 + 8, 32)
    f.zero(f.net == ARP, f.l3 + 8, 20)


def _blank_options(f: Frames) -> None:
    long = (f.tp == TCP) & (f.pay > f.l4 + 20) & (f.n >= f.pay)
    f.zero(long, f.l4 + 20, f.pay - f.l4 - 20)


def _full(f: Frames) -> None:
    """P5, P7-P9, P11. Ports, TCP flags, window, TTL and lengths stay visible."""
    tcp, udp = f.tp == TCP, f.tp == UDP
    hidden = udp & f.on_port(UDP_ENCRYPTED_PORTS)
    head = np.stack([f.u8(f.pay + i) for i in range(4)])
    banner = (head == np.frombuffer(b"SSH-", np.uint8)[:, None]).all(axis=0) & (f.n >= f.pay + 4)
    hidden |= tcp & ~f.on_port(TLS_PORTS) & f.on_port(SSH_PORTS) & ~banner
    _blank_addresses(f)
    f.zero(f.net == 4, f.l3 + 4, 2)
    f.zero(f.net == 4, f.l3 + 10, 2)
    six = f.net == 6
    f.flat[(f.start + f.l3 + 1)[six]] &= 0xF0
    f.zero(six, f.l3 + 2, 2)
    f.zero(udp, f.l4 + 6, 2)
    f.zero(tcp, f.l4 + 4, 8)
    f.zero(tcp, f.l4 + 16, 2)
    _blank_options(f)
    f.zero(hidden, f.pay, f.n)


def _v1(f: Frames) -> None:
    """Addresses, TCP options and what follows a first TLS data record on 443."""
    record = (f.tp == TCP) & f.on_port((443,)) & (f.n >= f.pay + 5) & (f.u8(f.pay) == 0x17)
    _blank_addresses(f)
    _blank_options(f)
    f.zero(record, f.pay + 5, f.n)


# Bytes of frames masked together; an Arrow batch may have more.
PIECE_BYTES = 1 << 20


def pieces(sizes: Iterable[int], most: int = PIECE_BYTES) -> list[slice]:
    """Slices of rows of about ``most`` bytes, one row at least; a row weighs 64 more than its size."""
    upto = np.cumsum([size + 64 for size in sizes], dtype=np.int64)
    if not len(upto):
        return []
    edges = [0, *(np.flatnonzero(np.diff(upto // most)) + 1).tolist(), len(upto)]
    return [slice(lo, hi) for lo, hi in zip(edges, edges[1:]) if hi > lo]


@F.pandas_udf(HEADER)
def _mask_full(data: pd.Series) -> pd.DataFrame:
    parts = [_masked_full(data.iloc[s]) for s in pieces(map(len, data))]
    return pd.concat(parts, ignore_index=True) if parts else _masked_full(data)


def _masked_full(data: pd.Series) -> pd.DataFrame:
    f = Frames(list(data))
    src, dst = f.addresses(False), f.addresses(True)
    _full(f)
    return pd.DataFrame(
        {
            "data": f.masked(), "_src": src, "_dst": dst, "_sp": f.sp, "_dp": f.dp, "_pay": f.pay,
            "_tls": (f.tp == TCP) & f.on_port(TLS_PORTS),
        }
    )


@F.pandas_udf(T.BinaryType())
def _mask_v1(data: pd.Series) -> pd.Series:
    f = Frames(list(data))
    _v1(f)
    return pd.Series(f.masked())


def mask_headers(packets: DataFrame, data: str = "data") -> DataFrame:
    """Every mask that needs nothing but the packet itself.

    Adds ``_src`` and ``_dst`` (the addresses as they were), ports, the payload's start and
    ``_tls``: whose TLS records ``tls.mask_records`` still has to blank in stream order.
    """
    out = packets.withColumn("_m", _mask_full(data))
    rest = [F.col(f"_m.{f.name}").alias(f.name) for f in HEADER.fields if f.name != "data"]
    kept = [F.col("_m.data").alias(data) if c == data else F.col(c) for c in packets.columns]
    return out.select(*kept, *rest)


def mask_v1(packets: DataFrame, data: str = "data") -> DataFrame:
    """The older stateless profile."""
    return packets.withColumn(data, _mask_v1(data))


def mask_fixed(packets: DataFrame, data: str = "data") -> DataFrame:
    """Hardware addresses and untagged IPv4 addresses at fixed offsets."""
    hardware = F.when(F.length(data) >= 14, blank(data, 0, 12)).otherwise(F.col(data))
    first = packets.withColumn(data, hardware)
    return first.withColumn(data, F.when(F.length(data) >= 34, blank(data, 26, 8)).otherwise(F.col(data)))
