"""What the packets around an alert were: volume, busiest pairs and ports, protocol mix.

No alert meets a packet. The times at which the spans of a sensor's alerts begin and end cut its packets into epochs; every
packet of an epoch lies in the same spans. Packets are summed per epoch and flow, map-side first, and then per epoch and
item (pair, port, protocol). A span of length L touches two time cells of that length, so a cell of alerts is answered from
the item sums of two cells, in parts by item where they are many; the best items of the parts are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetgrain.session import cut

SPAN_US = 10_000_000
# Item sums that one task looks at.
PART_ROWS = 200_000

TOP = pa.list_(
    pa.struct([("low", pa.int64()), ("ts_us", pa.int64()), ("seq", pa.int64()), ("item", pa.string()), ("value", pa.int64())])
)
TOP_DDL = "array<struct<low: bigint, ts_us: bigint, seq: bigint, item: string, value: bigint>>"
KINDS = ("pair", "port", "proto")


def _item_sums(packets: DataFrame, edges: DataFrame, keys: list[str], span_us: int, order: str) -> DataFrame:
    """Sums per sensor, time cell, epoch and item of the packets in cells that have edges."""
    placed = packets.withColumn("_cell", F.floor(F.col("ts_us") / span_us)).join(edges, [*keys, "_cell"])
    epoch = F.size(F.filter("_edges", lambda e: e <= F.col("ts_us"))).alias("_epoch")
    flows = placed.groupBy(*keys, "_cell", epoch, "src", "dst", "dport", "proto").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").cast("long").alias("bytes"), F.sum(F.col("is_syn").cast("long")).alias("syns"),
        F.min(F.struct("ts_us", F.col(order).cast("long").alias("seq"))).alias("first"),
    )

    def item(kind: str, name: Column, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), name.alias("item"), value.alias("value"))

    pair = item("pair", F.concat_ws(" -> ", "src", "dst"), F.col("bytes"))
    port = F.when(F.col("dport") != 0, item("port", F.col("dport").cast("string"), F.col("n")))
    proto = item("proto", F.coalesce("proto", F.lit("other")), F.col("n"))
    listed = flows.select("*", F.explode(F.array_compact(F.array(pair, port, proto))).alias("i"))
    return listed.groupBy(*keys, "_cell", "_epoch", "i.kind", "i.item").agg(
        F.sum("i.value").alias("value"), F.sum("bytes").alias("bytes"), F.sum("syns").alias("syns"), F.min("first").alias("first")
    )


def around(
    alerts: DataFrame,
    packets: DataFrame,
    keys: list[str],
    span_us: int = SPAN_US,
    alert_id: str = "alert_id",
    order: str = "packet_index",
    talkers: int = 3,
    ports: int = 5,
) -> DataFrame:
    """alert_id, packets, bytes, syns, top_talkers, top_ports, proto_mix_pct of every alert's span.

    The span is the ``span_us`` before the alert's ``ts_us``, both ends included, of the same sensor. Ties among pairs and
    ports go to the one seen first. An alert without packets has no row.
    """
    at = F.col("ts_us")
    asked = alerts.select(*keys, F.col(alert_id).alias("_alert"), at.alias("_at"), F.floor(at / span_us).alias("_group"))
    ends = F.array(
        F.struct((F.col("_group") - 1).alias("_cell"), (F.col("_at") - span_us).alias("e")),
        F.struct(F.col("_group").alias("_cell"), (F.col("_at") + 1).alias("e")),
    )
    edges = asked.select(*keys, F.explode(ends).alias("x")).groupBy(*keys, "x._cell").agg(
        F.sort_array(F.collect_set("x.e")).alias("_edges")
    )
    sums = cut(_item_sums(packets, edges, keys, span_us, order))
    dealt = sums.withColumn("_group", F.explode(F.array(F.col("_cell"), F.col("_cell") + 1)))
    sizes = cut(dealt.groupBy(*keys, "_group").agg((F.count(F.lit(1)) / PART_ROWS).cast("long").alias("_last")))
    dealt = dealt.join(sizes, [*keys, "_group"]).withColumn("_part", F.pmod(F.xxhash64("item"), F.col("_last") + 1))
    wanted = asked.join(sizes, [*keys, "_group"]).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"))))
    by = [*keys, "_group", "_part"]

    def run(rows: pa.Table, alerts: pa.Table) -> pa.Table:
        ts, seq = rows["ts_us"].to_numpy(), rows["seq"].to_numpy()
        place = np.lexsort((seq, ts))
        rows, ts, seq = rows.take(pa.array(place)), ts[place], seq[place]
        kind = np.array(rows["kind"].to_pylist(), object)
        of = {}
        for name in KINDS:
            at = np.flatnonzero(kind == name)
            some = rows.take(pa.array(at)).combine_chunks()
            coded = some["item"].combine_chunks().dictionary_encode()
            if isinstance(coded, pa.ChunkedArray):
                coded = coded.combine_chunks()
            of[name] = (
                ts[at], seq[at], coded.indices.to_numpy(), coded.dictionary.to_pylist(),
                *(some[c].to_numpy() for c in ("value", "bytes", "syns")),
            )
        out: dict[str, list] = {name: [] for name in (*KINDS, "packets", "bytes", "syns")}
        for at in alerts["_at"].to_pylist():
            for name, top in zip(KINDS, (talkers, ports, None)):
                time, number, code, items, value, size, syn = of[name]
                lo, hi = np.searchsorted(time, [at - span_us, at + 1])
                codes, first, place = np.unique(code[lo:hi], return_index=True, return_inverse=True)
                total = np.zeros(len(codes), np.int64)
                np.add.at(total, place, value[lo:hi])
                best = np.lexsort((first, -total))[:top]
                out[name].append([
                    {"low": -int(total[b]), "ts_us": int(time[lo + first[b]]), "seq": int(number[lo + first[b]]),
                     "item": items[codes[b]], "value": int(total[b])}
                    for b in best
                ])
                if name == "proto":
                    for column, values in (("packets", value), ("bytes", size), ("syns", syn)):
                        out[column].append(int(values[lo:hi].sum()))
        return pa.table(
            [alerts["_alert"], *(pa.array(out[k], TOP) for k in KINDS), *(pa.array(out[k], pa.int64()) for k in ("packets", "bytes", "syns"))],
            ["_alert", *KINDS, "packets", "bytes", "syns"],
        )

    found = dealt.select(*by, "kind", "item", "value", "bytes", "syns", "first.ts_us", "first.seq").groupBy(*by).cogroup(
        wanted.select(*by, "_alert", "_at").groupBy(*by)
    ).applyInArrow(
        run, f"_alert {alerts.schema[alert_id].dataType.simpleString()}, {', '.join(f'{k} {TOP_DDL}' for k in KINDS)}, "
        "packets long, bytes long, syns long"
    )
    # A pair or port lies in one part, so the best of the parts hold the best of all; so does a protocol.
    merged = found.groupBy("_alert").agg(
        *[F.array_sort(F.flatten(F.collect_list(k))).alias(k) for k in KINDS],
        *[F.sum(c).alias(c) for c in ("packets", "bytes", "syns")],
    ).where("packets > 0")
    share = F.transform("proto", lambda p: F.struct(p["item"].alias("key"), F.bround(p["value"] * 100.0 / F.col("packets"), 0).cast("long").alias("value")))
    return merged.select(
        F.col("_alert").alias(alert_id), "packets", "bytes", "syns",
        F.transform(F.slice("pair", 1, talkers), lambda p: F.struct(p["item"].alias("pair"), p["value"].alias("bytes"))).alias("top_talkers"),
        F.transform(F.slice("port", 1, ports), lambda p: p["item"].cast("int")).alias("top_ports"),
        F.map_from_entries(share).alias("proto_mix_pct"),
    )


HEATMAP = "struct<bytes: array<int>, surprise: array<double>>"


def enrichment(frame: DataFrame) -> DataFrame:
    """The facts of ``around`` and, where the frame has them, score_percentile, cusum_level, heatmap and pcap_excerpt
    as one ``enrichment``."""
    own = {"score_percentile": "int", "cusum_level": "double", "heatmap": HEATMAP, "pcap_excerpt": "string"}
    fields = ["packets", "bytes", "top_talkers", "top_ports", "proto_mix_pct", "syns"]
    parts = [F.col(f) for f in fields]
    for name, kind in own.items():
        parts.append((F.col(name) if name in frame.columns else F.lit(None)).cast(kind).alias(name))
    return frame.withColumn("enrichment", F.struct(*parts)).drop(*fields, *own)


def context(enriched: Column) -> Column:
    """K3: the log's context column: the enrichment as JSON, without the heatmap."""
    return F.to_json(enriched.dropFields("heatmap"))
