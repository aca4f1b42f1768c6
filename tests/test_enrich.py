"""Alert enrichment against counters over each alert's own packets."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from packetgrain.operators import enrich
from packetgrain.plans import reports
from packetgrain.sources import tables

SPAN = 1000


def packets(rnd):
    rows = []
    for i in range(3000):
        sensor = "hot" if i % 4 else rnd.choice(["a", "b"])
        rows.append((
            sensor, i, rnd.randrange(0, 20_000), f"10.0.0.{rnd.randrange(12)}", f"10.1.0.{rnd.randrange(4)}", rnd.choice([0, 22, 53, 80, 443, None]),
            rnd.choice(["TCP", "UDP", "other"]), rnd.choice([10, 10, 20]), rnd.random() < 0.2,
        ))
    return rows


def brute(alerts, rows):
    out = {}
    for sensor, name, at in alerts:
        near = sorted((r for r in rows if r[0] == sensor and at - SPAN <= r[2] <= at), key=lambda r: (r[2], r[1]))
        if near:
            talk, ports, mix = Counter(), Counter(), Counter()
            for r in near:
                talk[f"{r[3]} -> {r[4]}"] += r[7]
                mix[r[6]] += 1
                if r[5]:
                    ports[r[5]] += 1
            out[name] = (
                len(near), sum(r[7] for r in near), sum(r[8] for r in near), talk.most_common(3), [p for p, _ in ports.most_common(5)],
                {p: round(100.0 * c / len(near)) for p, c in mix.items()},
            )
    return out


@pytest.mark.parametrize("part_rows", [200_000, 40])
def test_enrichment_of_spans(spark, monkeypatch, part_rows):
    monkeypatch.setattr(enrich, "PART_ROWS", part_rows)
    rnd = random.Random(8)
    rows = packets(rnd)
    alerts = [(rnd.choice(["hot", "a", "b", "none"]), i, rnd.randrange(-500, 22_000)) for i in range(200)]
    # Alerts at one time, at a packet's own time, and at the bounds of cells.
    alerts += [("hot", 200 + i, 5000) for i in range(5)] + [("hot", 300 + i, t) for i, t in enumerate((999, 1000, 1001, 1999, rows[1][2]))]
    df = spark.createDataFrame(rows, "sensor string, packet_index int, ts_us long, src string, dst string, dport int, proto string, size int, is_syn boolean")
    asked = spark.createDataFrame(alerts, "sensor string, alert_id int, ts_us long")
    got = enrich.around(asked, df.repartition(5), ["sensor"], SPAN)
    found = {
        r.alert_id: (r.packets, r.bytes, r.syns, [(t.pair, t.bytes) for t in r.top_talkers], r.top_ports, r.proto_mix_pct) for r in got.collect()
    }
    assert found == brute(alerts, rows)
    assert enrich.around(asked.limit(0), df, ["sensor"], SPAN).collect() == []
    assert enrich.around(asked, df.limit(0), ["sensor"], SPAN).collect() == []


def test_enrichment_struct_and_log_context(spark):
    rows = spark.createDataFrame([("hot", 1, 500, "1.1.1.1", "2.2.2.2", 443, "TCP", 60, True)],
                                 "sensor string, packet_index int, ts_us long, src string, dst string, dport int, proto string, size int, is_syn boolean")
    asked = spark.createDataFrame([("hot", 7, 900)], "sensor string, alert_id int, ts_us long")
    found = enrich.around(asked, rows, ["sensor"], SPAN).withColumn("cusum_level", F.lit(26.5)).withColumn(
        "heatmap", F.struct(F.array(F.lit(1)).alias("bytes"), F.array(F.lit(0.5)).alias("surprise")))
    row = enrich.enrichment(found).withColumn("context", enrich.context(F.col("enrichment"))).first()
    assert row.enrichment.heatmap.bytes == [1] and row.enrichment.cusum_level == 26.5 and row.enrichment.score_percentile is None
    assert row.context == (
        '{"packets":1,"bytes":60,"top_talkers":[{"pair":"1.1.1.1 -> 2.2.2.2","bytes":60}],"top_ports":[443],'
        '"proto_mix_pct":{"TCP":100},"syns":1,"cusum_level":26.5}'
    )


def test_incidents_see_the_packets_of_all_users(spark):
    """the context is all packets of the six hours, not those of a third of the users."""
    folder = "/root/testdata/sf0.001"
    got = reports.incident_enrichment(spark, folder).join(
        reports._incidents(spark, folder).select(F.concat_ws("/", "type", "alert_id").alias("alert"), "first_us"), "alert"
    ).orderBy("alert").limit(5).collect()
    times = [r.ts_us for r in tables.events(spark, folder).select("ts_us").collect()]
    assert got
    for r in got:
        assert r.packets == sum(r.first_us - 6 * reports.HOUR_US <= t <= r.first_us for t in times)
