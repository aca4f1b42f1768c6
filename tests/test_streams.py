"""State of the streaming detectors across turns, late rows, and calibrations that are written back."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from packetgrain.operators import calibrate, cusum, incidents, rate, windows
from packetgrain.sinks import calibrations
from packetgrain.streaming import live, recalibration

S = 1_000_000
HOUR = 3600 * S
# A day's start; a stream's watermark begins at time zero.
BASE = 19_675 * 24 * HOUR


def timed(spark, rows, schema):
    later = spark.createDataFrame(rows, schema).withColumn("ts_us", F.col("ts_us") + BASE)
    return later.withColumn("ts", F.timestamp_micros("ts_us"))


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_levels_forget_idle_keys(spark):
    rnd = random.Random(5)
    rows, now = [], 0
    for i in range(300):
        now += rnd.choice([HOUR, 2 * HOUR, 70 * HOUR if i % 20 == 0 else HOUR])
        rows.append((rnd.choice("ab"), i, now, rnd.uniform(-1, 3)))
    df = timed(spark, rows, "key string, event_id long, ts_us long, step double").withColumn("turn", F.floor(F.col("event_id") / 100))
    got = live.run_parts(df, F.col("turn"), 3, lambda s: live.cusum_levels(s, "key", 9.0))
    lives = windows.idle_split(df.drop("ts"), ["key"], live.LEVEL_TTL_US)
    want = cusum.levels(lives, ["key", "life"], [F.col("ts_us"), F.col("event_id")], F.col("step"), 9.0, 0.98, ["event_id"])
    assert [r[:2] for r in rows_of(got)] == [r[:2] for r in rows_of(want.select("key", "event_id"))]
    assert [r[2] for r in rows_of(got)] == pytest.approx([r[2] for r in rows_of(want.select("key", "event_id", "level"))])
    assert lives.agg(F.max("life")).first()[0] > 2


def test_syn_spans_cross_turns(spark):
    rnd = random.Random(6)
    rows = [(rnd.choice("ab"), i, t) for i, t in enumerate(sorted(rnd.randrange(60 * S) for _ in range(400)))]
    df = timed(spark, rows, "src string, packet_index long, ts_us long")
    turn = F.floor(F.col("packet_index") / 140)
    got = live.run_parts(df, turn, 3, lambda s: live.syn_floods(s, "src", 6, 2 * S))
    want = rate.syn_floods(df, ["src"], 6, 2 * S).select("src", "packet_index", "syns", "flood")
    assert rows_of(got.select("src", "packet_index", "syns", "flood")) == rows_of(want)
    assert {r.flood for r in got.collect()} == {True, False}


def test_bans_keep_their_longest_length(spark):
    rows = [
        ("1.1.1.1", 0, 0, "a", "BYTE", 10 * S), ("1.1.1.1", 5 * S, 1, "b", "RATE", 2000 * S), ("127.0.0.1", 5 * S, 2, "x", "BYTE", None),
        ("1.1.1.1", 1900 * S, 3, "c", "BYTE", None), ("1.1.1.1", 2000 * S, 4, "d", "BYTE", 10 * S), ("1.1.1.1", 2010 * S, 5, "e", "BYTE", 10 * S),
        ("2.2.2.2", 2011 * S, 6, "f", "SLOW", None),
    ]
    df = timed(spark, rows, "ip string, ts_us long, tie long, reason string, type string, ttl_us long")
    updates = live.run_parts(df, F.floor(F.col("tie") / 2), 4, live.bans)
    got = updates.groupBy("ip", "banned_at").agg(F.max_by(F.struct("ttl", "count", "last_seen", "reason", "incident_type"), "count").alias("b"))
    names = ["ip", "banned_at", "ttl", "count", "last_seen", "reason", "incident_type"]
    assert rows_of(got.select("ip", "banned_at", "b.*").select(names)) == rows_of(incidents.ban_episodes(df).select(names))


def test_one_address_with_all_requests(spark):
    rows = [("9.9.9.9", i * 100 * S, i, f"r{i}", "BYTE", (i % 7) * 200 * S) for i in range(5000)]
    df = spark.createDataFrame(rows, "ip string, ts_us long, tie long, reason string, type string, ttl_us long").repartition(8)
    want, ban = [], None
    for ip, ts, _, reason, kind, ttl in rows:
        if ban and ts - ban[0] < ban[1]:
            ban = [ban[0], max(ban[1], ttl), ban[2] + 1, ts, reason, ban[5]]
            want[-1] = (ip, *ban)
        else:
            ban = [ts, ttl, 1, ts, reason, kind]
            want.append((ip, *ban))
    assert rows_of(incidents.ban_episodes(df)) == sorted(want)


def test_late_and_double_packets(spark):
    day = 24 * HOUR
    sent = [(1, 0, 0), (1, 0, 0), (2, 2 * day, 0), (3, 5 * day, 0), (2, 2 * day, 1), (4, 4 * day + HOUR, 1), (3, 5 * day, 1), (5, 9 * day, 1), (6, 9 * day, 2)]
    df = timed(spark, [(i, t, turn, n) for n, (i, t, turn) in enumerate(sent)], "event_id long, ts_us long, turn int, copy int")
    got = live.run_parts(df, F.col("turn"), 3, lambda s: live.once(s, ["event_id"], "ts", "1 day"))
    # The second turn has a watermark of day four: event 2 is late there, event 4 is not, event 3 is known.
    assert rows_of(got.select("event_id", "turn")) == [(1, 0), (2, 0), (3, 0), (4, 1), (5, 1), (6, 2)]


QUARTER = 900 * S
FITTED = "sensor string, byte_threshold double, gold_threshold double, anchor_threshold double, budget_quantile double, score_quantiles array<double>"


def fitted_rows(spark, sensors=("a", "b")):
    return spark.createDataFrame([(s, 93.0, 96.0, 93.0, 0.97, [float(i) for i in range(101)]) for s in sensors], FITTED)


def test_recalibration_stream_writes_versions_that_gates_read(spark, tmp_path):
    rnd = random.Random(7)
    how = calibrate.Recalibration(ref_pct=90.0, min_samples=60, trailing=100, digest_us=4 * QUARTER, recent=150)
    rows = [("ab"[i % 2], i, i * 12 * S, rnd.uniform(0, 130), rnd.random() < 0.1) for i in range(1200)]
    df = timed(spark, rows, "sensor string, event_id long, ts_us long, score double, flagged boolean")
    store = str(tmp_path / "store")
    assert calibrations.latest(spark, store) == (0, None)
    assert calibrations.publish(fitted_rows(spark), store, 0) == 1
    start = calibrations.latest(spark, store)[1]
    turn = F.floor(F.col("event_id") / 400)
    steps = live.run_parts(df, turn, 3, lambda s: recalibration.recalibration(s, start, "sensor", how))
    batch = calibrate.adaptive_thresholds(df, fitted_rows(spark), ["sensor"], ["ts_us", "event_id"], how)
    open_ = batch.groupBy("sensor").agg(F.max("bucket").alias("bucket"))
    closed = batch.join(open_, ["sensor", "bucket"], "left_anti")
    assert rows_of(steps.select("sensor", "bucket", "n", "applied")) == rows_of(closed.select("sensor", "bucket", "n", "applied"))
    assert [r[2] for r in rows_of(steps.select("sensor", "bucket", "threshold"))] == pytest.approx(
        [r[2] for r in rows_of(closed.select("sensor", "bucket", "threshold"))]
    )

    # Each turn's thresholds go back to the store; the gates of the next scores read them.
    steps.write.parquet(str(tmp_path / "steps"))
    stream = spark.readStream.schema(steps.schema).parquet(str(tmp_path / "steps"))
    query = recalibration.write_back(stream, store, "sensor").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    query.awaitTermination()
    version, now = calibrations.latest(spark, store)
    last = {r.sensor: r for r in closed.where("applied").groupBy("sensor").agg(F.max_by("threshold", "bucket").alias("t")).collect()}
    assert version == 2
    for r in now.collect():
        assert r.byte_threshold == round(last[r.sensor].t, 4) != 93.0 and r.anchor_threshold == 93.0 and r.adapted_at
    scores = [(s, x) for s in "ab" for x in (90.0, 92.0, 94.0, 96.5)]
    frame = spark.createDataFrame(scores, "sensor string, score double")
    frame.write.parquet(str(tmp_path / "scores"))
    gates = recalibration.gate(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "scores")), store, ["sensor"], str(tmp_path / "alerts"))
    gates.option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
    alerts = spark.read.parquet(str(tmp_path / "alerts"))
    assert {r.calibration for r in alerts.collect()} == {2}
    want = sorted((s, x) for s, x in scores if x > round(last[s].t, 4))
    assert rows_of(alerts.where("type = 'BYTE'").select("sensor", "score")) == want


def test_calibration_store_versions_are_whole_and_conditional(spark, tmp_path):
    store = str(tmp_path / "store")
    calibrations.publish(fitted_rows(spark), store, 0)
    with pytest.raises(calibrations.Conflict):
        calibrations.publish(fitted_rows(spark), store, 0)
    change = spark.createDataFrame([("b", 91.23456, 80.0)], "sensor string, threshold double, reference double")
    assert calibrations.adapt(change, store, ["sensor"]) == 2
    _, rows = calibrations.latest(spark, store)
    assert rows_of(rows.select("sensor", "byte_threshold", "adapted_ref")) == [("a", 93.0, None), ("b", 91.2346, 80.0)]
    # Half of a version that is being written, and a second writer of a number: neither is read.
    _, now = calibrations.latest(spark, store)
    half = now.limit(1).withColumn("writer", F.lit("0")).withColumn("rows", F.lit(2)).withColumn("version", F.lit(3))
    half.write.mode("append").partitionBy("version").parquet(store)
    assert calibrations.latest(spark, store)[0] == 2
    other = now.withColumn("byte_threshold", F.lit(1.0)).withColumn("writer", F.lit("z")).withColumn("rows", F.lit(2)).withColumn("version", F.lit(2))
    other.write.mode("append").partitionBy("version").parquet(store)
    assert rows_of(calibrations.latest(spark, store)[1].select("byte_threshold")) == [(91.2346,), (93.0,)]
    with pytest.raises(ValueError):
        calibrations.adapt(change, str(tmp_path / "none"), ["sensor"])


def test_source_reads_a_table_of_one_file_and_one_of_many(spark, tmp_path):
    """tables that are folders of files were streamed as empty."""
    spark.range(7).coalesce(1).write.parquet(str(tmp_path / "one"))
    next((tmp_path / "one").glob("part-*.parquet")).rename(tmp_path / "single.parquet")
    spark.range(9).repartition(3).write.parquet(str(tmp_path / "many.parquet"))
    for name, rows in (("single", 7), ("many", 9)):
        assert live.run_available(live.source(spark, str(tmp_path), name)).count() == rows


def test_a_key_asks_the_state_store_once():
    """One read and one write for the rows of a key; a timer is set anew only when it moves."""
    sent = []

    class Store:
        value = None

        def __getattr__(self, name):
            def call(*given):
                sent.append(name)
                if name == "update":
                    Store.value = given[0]
                return Store.value if name == "get" else None

            return call

    levels = live._Levels("key", 1.0, 9.0, 1000)
    levels.state = levels.handle = Store()
    for times, wanted in (([3, 1], ["get", "registerTimer", "update"]), ([2], ["get", "update"]), ([3000], ["get", "deleteTimer", "registerTimer", "update"])):
        sent.clear()
        rows = pd.DataFrame({"ts_us": times, "event_id": times, "step": [float(t) for t in times]})
        [out] = levels.handleInputRows(("k",), iter([rows]), None)
        assert out["event_id"].tolist() == sorted(times) and sent == wanted
    assert Store.value[:2] == (0.0, 3000)
