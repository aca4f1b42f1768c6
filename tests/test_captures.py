"""Captures written, cut into splits once, and read again as batch and stream."""

import os
import time

import pytest
from pyspark.sql import functions as F

from packetgrain.sinks import writers
from packetgrain.sources import captures
from packetgrain.streaming import live

NAMES = "capture string, packet_index long, ts_us long, data binary"


def rows_of(df):
    return sorted((r.capture, r.packet_index, r.ts_us, bytes(r.data)) for r in df.collect())


@pytest.fixture
def written(spark, tmp_path):
    rows = [(c, i, 1_700_000_000_000_000 + i * 7, bytes([i % 251]) * (i % 90 + 1)) for c in ("a", "b") for i in range(500)]
    found = writers.write_captures(spark.createDataFrame(rows, NAMES).repartition(7), f"file://{tmp_path}/files")
    assert sorted(r.packets for r in found.collect()) == [500, 500]
    assert sorted(os.listdir(tmp_path / "files"))[-2:] == ["a.pcap", "b.pcap"]
    return str(tmp_path), sorted((f"{c}.pcap", i, t, d) for c, i, t, d in rows)


def test_second_read_walks_no_headers(spark, written, monkeypatch):
    base, want = written
    files, index = f"{base}/files", f"{base}/index"
    assert rows_of(captures.read_captures(spark, files, 3_000, index)) == want
    splits = spark.read.parquet(index).count()
    assert splits > 10

    def refuse(split_bytes):
        def run(batches):
            for pdf in batches:
                if len(pdf):
                    raise AssertionError("headers are walked again")
            yield from ()

        return run

    monkeypatch.setattr(captures, "_find_splits", refuse)
    assert rows_of(captures.read_captures(spark, files, 3_000, index)) == want
    assert spark.read.parquet(index).count() == splits


def test_changed_and_new_files(spark, written):
    base, want = written
    files, index = f"{base}/files", f"{base}/index"
    captures.update_index(spark, files, index, 3_000)
    time.sleep(1.1)
    writers.write_captures(spark.createDataFrame([("a", 0, 5, b"new"), ("c", 0, 6, b"x")], NAMES), f"file://{files}")
    got = rows_of(captures.read_captures(spark, files, 3_000, index))
    assert got == sorted([("a.pcap", 0, 5, b"new"), ("c.pcap", 0, 6, b"x"), *(r for r in want if r[0] == "b.pcap")])


def test_stream_over_the_index(spark, written, tmp_path):
    base, want = written
    files, index = f"{base}/files", f"{base}/index"
    captures.update_index(spark, files, index, 3_000)

    def run():
        stream = captures.stream_captures(spark, index)
        query = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
        query.trigger(availableNow=True).start().awaitTermination()
        return rows_of(spark.read.schema(stream.schema).parquet(f"{base}/out"))

    assert run() == want
    writers.write_captures(spark.createDataFrame([("d", 0, 9, b"late")], NAMES), f"file://{files}")
    captures.update_index(spark, files, index, 3_000)
    # Only the new file's packets are added.
    assert run() == sorted([*want, ("d.pcap", 0, 9, b"late")])
