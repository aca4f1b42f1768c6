"""Files the operators' results are kept in."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetgrain.operators.ordering import running
from packetgrain.operators.windows import cap_rows
from packetgrain.session import cut


def local_time(ts_us: str):
    return F.date_format(F.timestamp_micros(F.col(ts_us)), "yyyy-MM-dd'T'HH:mm:ss")


def write_anomaly_labels(labelled: DataFrame, path: str) -> None:
    """K1: flagged packets with four decimals of entropy."""
    labelled.where(F.col("anomaly_type").isNotNull()).select(
        F.col("capture").alias("pcap_file"), "packet_index", "byte_offset", "anomaly_type",
        F.format_string("%.4f", "entropy").alias("entropy_value"),
    ).write.mode("append").csv(path, header=True)


def write_manifest(files: DataFrame, windows: DataFrame, manifest_path: str) -> None:
    """K2: one row per processed file; a later row of a file replaces the earlier on read."""
    counted = windows.groupBy(F.col("capture").alias("source_filename")).agg(
        F.count(F.lit(1)).alias("num_sequences_extracted")
    )
    files.join(counted, "source_filename", "left").withColumn(
        "timestamp_processed", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    ).write.mode("append").parquet(manifest_path)


def latest_manifest(rows: DataFrame) -> DataFrame:
    """K2: the newest row of each file."""
    newest = F.max_by(F.struct(*rows.columns), F.struct("file_mtime", "timestamp_processed"))
    return rows.groupBy(F.col("source_filename").alias("_f")).agg(newest.alias("r")).select("r.*")


def incident_rows(found: DataFrame) -> DataFrame:
    """K3: log lines of incidents and capture gaps; the heatmap is not kept."""
    context = F.col("context") if "context" in found.columns else F.lit("{}")
    return found.select(
        local_time("first_us").alias("opened_at"), local_time("last_us").alias("closed_at"), "type", "raw_alerts",
        F.format_string("%.2f", F.col("peak_score").cast("double")).alias("peak_score"),
        F.regexp_replace(context, '"', "'").alias("context"),
    )


def digest_rows(digests: DataFrame) -> DataFrame:
    """K4: log lines of hourly digests; counts by type and lists are written as text."""
    listed = [F.regexp_replace(F.to_json(c), '"', "'").alias(c) for c in ("by_type", "top_talkers", "top_ports")]
    by_name = F.map_from_entries(F.array_sort(F.map_entries("by_type")))
    return digests.withColumn("by_type", by_name).select(
        local_time("window_start_us").alias("window_start"), local_time("window_end_us").alias("window_end"),
        "incidents", *listed, F.coalesce(F.col("drift_psi").cast("string"), F.lit("None")).alias("drift_psi"),
        F.initcap(F.col("drift_flag").cast("string")).alias("drift_flag"), "verdict",
    )


def write_csv(rows: DataFrame, path: str) -> None:
    """Append rows with a header."""
    rows.write.mode("append").csv(path, header=True)


def write_json(rows: DataFrame, path: str) -> None:
    """Nested rows as JSON lines."""
    rows.write.mode("append").json(path)


def write_lines(rows: DataFrame, column: str, path: str) -> None:
    """K5/K6: one text line per row; a structure is written as JSON."""
    kind = rows.schema[column].dataType.typeName()
    line = F.to_json(column) if kind == "struct" else F.col(column)
    rows.select(line.alias("value")).write.mode("append").text(path)


def alert_payload(alerts: DataFrame) -> DataFrame:
    """Alert as one JSON text, ready for a message sink."""
    fields = [
        c for c in ("ts_us", "type", "message", "score", "enrichment", "banned_ips") if c in alerts.columns
    ]
    return alerts.select(F.to_json(F.struct(*fields)).alias("value"))


def save_calibration(rows: DataFrame, path: str, keys: list[str]) -> None:
    """K7: one partition per sensor; only the sensors in ``rows`` are overwritten."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def split_by_class(labelled: DataFrame, path: str, attack_rows: int | None = None) -> None:
    """K8: packets per class; attack classes may be capped, benign ones never."""
    named = labelled.withColumn("class", F.coalesce(F.concat(F.lit("attack_"), "cat"), F.lit("benign")))
    if attack_rows is not None:
        order = [F.col("ts_us"), F.col("packet_index")]
        attack = cap_rows(named.where(F.col("cat").isNotNull()), ["class"], order, attack_rows)
        named = named.where(F.col("cat").isNull()).unionByName(attack)
    named.write.mode("overwrite").partitionBy("class").parquet(path)


def excerpts(opened: DataFrame, packets: DataFrame, keys: list[str], last: int = 200) -> DataFrame:
    """K9: the last packets up to each incident's opening.

    Packets are numbered once per sensor; an incident's excerpt is the ``last`` numbers up
    to the newest packet it may see, found by an equi-join on the number.
    """
    order = [F.col("ts_us"), F.col("packet_index")]
    numbered = running(packets, keys, order, {"_no": ("count", F.lit(1))})
    marks = opened.select(*keys, "incident_id", F.col("first_us").alias("ts_us")).withColumn("_mark", F.lit(1))
    both = numbered.select(*keys, "ts_us", "_no", F.lit(0).alias("_mark")).unionByName(marks, allowMissingColumns=True)
    seen = running(both, keys, [F.col("ts_us"), F.col("_mark")], {"_upto": ("max", F.col("_no"))})
    wanted = seen.where(F.col("_mark") == 1).where(F.col("_upto").isNotNull()).select(
        *keys, "incident_id",
        F.explode(F.sequence(F.greatest(F.lit(1).cast("long"), F.col("_upto") - last + 1), F.col("_upto"))).alias("_no"),
    )
    return wanted.join(numbered, [*keys, "_no"]).drop("_no")


FILE_HEADER = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)


def write_captures(packets: DataFrame, folder: str, linktype: int = 1) -> DataFrame:
    """One classic capture file per ``capture`` in the order of packet_index; path and number of packets of each.

    Packets are dealt by capture and sorted, which may spill, and written as they pass. A file is written under another
    name and moved when it is whole, so a task that runs again leaves the same files.
    """
    sorted_ = packets.select("capture", "packet_index", "ts_us", "data").repartition("capture").sortWithinPartitions("capture", "packet_index")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        name = out = None
        made, held = [], ""

        def close() -> None:
            out.close()
            fs.move(held, f"{base}/{name}.pcap")

        for pdf in batches:
            for capture, _, ts, data in pdf.itertuples(index=False):
                if capture != name:
                    if out:
                        close()
                    name, held = capture, f"{base}/_{uuid.uuid4().hex}"
                    out = fs.open_output_stream(held)
                    out.write(FILE_HEADER[:-4] + struct.pack("<I", linktype))
                    made.append([f"{folder}/{name}.pcap", 0])
                out.write(struct.pack("<IIII", ts // 1_000_000, ts % 1_000_000, len(data), len(data)) + data)
                made[-1][1] += 1
        if out:
            close()
        yield pd.DataFrame(made, columns=["path", "packets"])

    return cut(sorted_.mapInPandas(write, "path string, packets long"))


def pcap_files(excerpt: DataFrame) -> DataFrame:
    """K9: one capture file per incident as ``(incident_id, content)``; an excerpt is short."""

    def frame(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            head = [
                struct.pack("<IIII", t // 1_000_000, t % 1_000_000, len(d), len(d)) + d
                for t, d in zip(pdf["ts_us"], pdf["data"])
            ]
            yield pdf[["incident_id", "ts_us", "packet_index"]].assign(record=head)

    schema = f"incident_id {excerpt.schema['incident_id'].dataType.simpleString()}, ts_us long, packet_index long, record binary"
    records = excerpt.select("incident_id", "ts_us", "packet_index", "data").mapInPandas(frame, schema)
    ordered = F.array_sort(F.collect_list(F.struct("ts_us", "packet_index", "record")))
    return records.groupBy("incident_id").agg(ordered.alias("r")).select(
        "incident_id",
        F.unhex(F.concat(F.lit(FILE_HEADER.hex()), F.array_join(F.transform("r", lambda x: F.hex(x["record"])), ""))).alias("content"),
    )
