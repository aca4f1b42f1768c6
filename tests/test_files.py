"""Listings, manifests, sinks and the state of streaming detectors."""

import hashlib
import json

from pyspark.sql import functions as F

from packetgrain.operators import match, packets, scoring, windows
from packetgrain.sinks import writers
from packetgrain.sources import captures, documents
from packetgrain.sources.schedules import schedule
from packetgrain.streaming import live
from test_packets import frame, record, steps


def test_window_estimates(spark):
    df = spark.createDataFrame([("a.pcap", 10_000), ("b.pcap.gz", 10_000), ("c.pcap", 10), ("d.pcap", None)], "name string, length long")
    got = [r.n for r in df.select(captures.estimated_windows(F.col("length"), F.col("name"), 512).alias("n")).collect()]
    assert got == [16, 83, 1, 1000]


def test_row_selections(spark):
    df = spark.range(100).select(F.lit("c").alias("capture"), F.col("id").alias("win_idx"), (F.col("id") * 10_000_000).alias("ts_us"))
    assert windows.every_nth(df, 20).count() == 5
    assert windows.stop_after(df, 1, ["capture"]).count() == 7
    assert windows.cap_rows(df, ["capture"], [F.col("win_idx")], 9).count() == 9
    assert sorted(r.win_idx for r in windows.shuffled(df, 1).collect()) == list(range(100))


def test_one_window_per_packet(spark):
    df = spark.createDataFrame([(b"abc",), (b"x" * 600,)], "data binary")
    got = windows.one_window_per_packet(df).collect()
    assert [len(r.bytes) for r in got] == [512, 512] and [r.scorable for r in got] == [False, True]
    assert bytes(got[0].bytes) == b"abc" + bytes(509)


def test_checkpoint_selection(spark):
    have = spark.createDataFrame([("a", 1), ("b", 5), ("c", 9)], "checkpoint string, step long")
    done = spark.createDataFrame([("a", 1), ("x", 4)], "checkpoint string, step long")
    assert sorted(r.checkpoint for r in match.next_checkpoints(have, done).collect()) == ["b", "c"]
    need = spark.createDataFrame([("a.pcap",), ("b.pcap",)], "name string")
    assert [r.name for r in match.missing_files(need, need.limit(1)).collect()] == ["b.pcap"]
    got = spark.range(1).select(match.holdout_or_calibration(F.lit(None).cast("string"), F.lit("c")).alias("h")).first().h
    assert got.path == "c" and got.note


def test_schedules(spark, tmp_path):
    assert schedule(spark, "friday").count() == 3 and schedule(spark).count() == 14
    (tmp_path / "s.json").write_text(json.dumps([{"name": "x", "start": "01:00", "end": "02:00"}]))
    assert schedule(spark, path=str(tmp_path / "s.json")).first().start == "01:00"


def test_packet_surprise_and_scan(spark):
    got = spark.range(1).select(scoring.packet_surprise(F.array(F.lit(0.25), F.lit(0.0))).alias("s")).first().s
    assert abs(got.mean_bits - (2 + 29.897352854) / 2) < 1e-6 and got.anomalous
    one = spark.createDataFrame([(1.0,), (2.0,)], "score double")
    assert scoring.scan_summary(one, 2.0).first().anomalies == 1


def test_incident_log_lines(spark, tmp_path):
    df = spark.createDataFrame([(0, 42_000_000, "CAPTURE_GAP", 0, 0.0, '{"gap_seconds":42}')],
                               "first_us long, last_us long, type string, raw_alerts long, peak_score double, context string")
    r = writers.incident_rows(df).first()
    assert tuple(r) == ("1970-01-01T00:00:00", "1970-01-01T00:00:42", "CAPTURE_GAP", 0, "0.00", "{'gap_seconds':42}")
    writers.write_csv(writers.incident_rows(df), str(tmp_path / "log"))
    assert spark.read.csv(str(tmp_path / "log"), header=True).count() == 1


def test_manifest_keeps_the_newest_row(spark, tmp_path):
    files = spark.createDataFrame([("a", "h1", 1.0), ("b", "h2", 1.0)], "source_filename string, file_hash string, file_mtime double")
    cut = spark.createDataFrame([("a",), ("a",)], "capture string")
    path = str(tmp_path / "m")
    writers.write_manifest(files, cut, path)
    writers.write_manifest(files.withColumn("file_mtime", F.lit(2.0)).withColumn("file_hash", F.lit("new")), cut, path)
    got = {r.source_filename: (r.file_hash, r.num_sequences_extracted) for r in writers.latest_manifest(spark.read.parquet(path)).collect()}
    assert got == {"a": ("new", 2), "b": ("new", None)}


def test_calibration_store_replaces_only_its_sensors(spark, tmp_path):
    path = str(tmp_path / "c")
    schema = "interface string, byte_threshold double, score_metric string"
    writers.save_calibration(spark.createDataFrame([("a", 1.0, "topk"), ("b", 2.0, "old")], schema), path, ["interface"])
    writers.save_calibration(spark.createDataFrame([("a", 3.0, "topk")], schema), path, ["interface"])
    assert {(r.interface, r.byte_threshold) for r in spark.read.parquet(path).collect()} == {("a", 3.0), ("b", 2.0)}
    assert [r.interface for r in documents.calibrations(spark, path, "topk").collect()] == ["a"]


def test_class_folders_and_payloads(spark, tmp_path):
    df = spark.createDataFrame([(i, i, "dos" if i < 6 else None) for i in range(10)], "ts_us long, packet_index long, cat string")
    writers.split_by_class(df, str(tmp_path / "s"), 4)
    got = {r["class"]: r["count"] for r in spark.read.parquet(str(tmp_path / "s")).groupBy("class").count().collect()}
    assert got == {"attack_dos": 4, "benign": 4}
    alert = spark.createDataFrame([(1, "BYTE", "m", 2.5)], "ts_us long, type string, message string, score double")
    assert json.loads(writers.alert_payload(alert).first().value) == {"ts_us": 1, "type": "BYTE", "message": "m", "score": 2.5}
    writers.write_lines(alert.select(F.struct("type").alias("record")), "record", str(tmp_path / "e"))
    assert spark.read.text(str(tmp_path / "e")).first().value == '{"type":"BYTE"}'


def test_label_rows(spark, tmp_path):
    df = spark.createDataFrame([("c", 0, 0, "Abnormal_Entropy", 0.5), ("c", 1, 9, None, 5.0)],
                               "capture string, packet_index long, byte_offset long, anomaly_type string, entropy double")
    writers.write_anomaly_labels(df, str(tmp_path / "l"))
    assert [r.entropy_value for r in spark.read.csv(str(tmp_path / "l"), header=True).collect()] == ["0.5000"]


def test_leaderboard_file_with_blanks(spark, tmp_path):
    (tmp_path / "l.csv").write_text("checkpoint,calib_auc\na,0.5\nb,\nc,odd\n")
    got = {r.checkpoint: r.calib_auc for r in documents.leaderboard(spark, str(tmp_path / "l.csv"), ["checkpoint", "calib_auc"]).collect()}
    assert got == {"a": 0.5, "b": None, "c": None}


def stream_of(spark, tmp_path, batches, schema):
    """One file per micro-batch, so state must carry over."""
    folder = tmp_path / "in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_stream_tls_state_crosses_batches(spark, tmp_path):
    head = frame()
    pay = len(head)
    first, rest = record(0x17, 300, b"x" * 100), b"y" * 200
    batches = [[("s", 0, head + first, pay)], [("s", 1, head + rest, pay)]]
    df = stream_of(spark, tmp_path, batches, "stream string, packet_index long, data binary, payload_at int")
    got = {r.packet_index: bytes(r.data)[pay:] for r in live.run_available(live.tls_records(df)).collect()}
    assert [got[0], got[1]] == steps(first, rest)[0]


def test_link_types(spark):
    ip = frame()[14:]
    rows = [(1, frame()), (113, bytes(14) + b"\x08\x00" + ip), (276, b"\x08\x00" + bytes(18) + ip), (101, ip), (101, b"\x00bad")]
    df = spark.createDataFrame([(i, link, data) for i, (link, data) in enumerate(rows)], "i int, linktype int, data binary")
    got = [r.data for r in packets.to_ethernet(df).orderBy("i").collect()]
    assert bytes(got[0]) == frame() and all(bytes(g) == bytes(12) + b"\x08\x00" + ip for g in got[1:4]) and got[4] is None


def test_file_hashes_and_unchanged_files(spark, tmp_path):
    contents = {"a.pcap": b"x" * 3_000_000, "b.pcap": b"b", "c.pcap": b"\x00\x01"}
    for name, body in contents.items():
        (tmp_path / name).write_bytes(body)
    hashed = captures.file_hashes(spark, str(tmp_path))
    assert {r.source_filename: r.file_hash for r in hashed.collect()} == {n: hashlib.sha256(b).hexdigest() for n, b in contents.items()}
    same = captures.unchanged(captures.listing(spark, str(tmp_path)), hashed.where("source_filename <> 'b.pcap'"))
    assert {r.name for r in same.collect()} == {"a.pcap", "c.pcap"}


def test_digests_are_written_as_text(spark, tmp_path):
    rows = [(0, 3_600_000_000, 2, {"BYTE": 1, "RATE": 1}, ["a -> b"], [80, 443], None, False, "quiet"),
            (3_600_000_000, 7_200_000_000, 0, {}, [], [], 0.25, True, "DRIFT")]
    schema = ("window_start_us long, window_end_us long, incidents long, by_type map<string,int>, top_talkers array<string>, "
              "top_ports array<int>, drift_psi double, drift_flag boolean, verdict string")
    writers.write_csv(writers.digest_rows(spark.createDataFrame(rows, schema)), str(tmp_path / "d"))
    got = spark.read.csv(str(tmp_path / "d"), header=True).orderBy("window_start").collect()
    assert [tuple(r) for r in got] == [
        ("1970-01-01T00:00:00", "1970-01-01T01:00:00", "2", "{'BYTE':1,'RATE':1}", "['a -> b']", "[80,443]", "None", "False", "quiet"),
        ("1970-01-01T01:00:00", "1970-01-01T02:00:00", "0", "{}", "[]", "[]", "0.25", "True", "DRIFT"),
    ]
