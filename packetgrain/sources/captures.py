"""Capture files to packet rows, and file listings."""

from __future__ import annotations

import gzip
import hashlib
import io
import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PACKETS = "capture string, packet_index long, ts_us long, linktype int, data binary"
SPLITS = "path string, begin long, stop long, first_index long, head binary"
INDEX = f"{SPLITS}, modified timestamp"
SPLIT_BYTES = 64 * 1024 * 1024

# Fixed values of the two file formats.
PCAP_MAGIC = {
    b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\xc3\xd4": (">", 1),
    b"\x4d\x3c\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1000),
}
SECTION, INTERFACE, SIMPLE, ENHANCED = 0x0A0D0D0A, 1, 3, 6
CAPTURE_NAMES = r"(?i)\.(pcap|pcapng|cap)(\.gz)?$"
# Words of file names of captures split by class.
CLASS_WORDS = "attack|normal|benign|exploit|fuzz|dos|recon|shellcode|worm|backdoor|generic"


def listing(spark: SparkSession, path: str) -> DataFrame:
    """Files below a folder with size and time; contents are not read. Spark lists no empty files."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        .select("path", "length", "modificationTime")
    )
    return files.withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1))


def inventory(files: DataFrame) -> DataFrame:
    """Raw captures, captures already split by class, and ground-truth tables."""
    name = F.lower("name")
    capture = name.rlike(r"\.(pcap|pcapng|cap)$")
    kind = (
        F.when(capture & name.rlike(CLASS_WORDS), "split")
        .when(capture, "raw")
        .when(name.startswith("unsw-nb15_") & name.endswith(".csv"), "truth")
    )
    return files.withColumn("kind", kind)


def attack_files(files: DataFrame, used: DataFrame, max_mb: float | None = None) -> DataFrame:
    """Capture files not in use elsewhere, optionally up to a size, by name."""
    found = files.where(F.col("name").rlike(CAPTURE_NAMES)).join(used.select("name"), "name", "left_anti")
    if max_mb is not None:
        found = found.where(F.col("length") <= max_mb * 1024 * 1024)
    return found.orderBy("name")


def estimated_windows(length: Column, name: Column, stride: int) -> Column:
    """Windows a file will give, from its size alone."""
    raw = F.when(F.lower(name).endswith(".gz"), length * 5.0).otherwise(length.cast("double"))
    windows = F.floor(F.floor(raw * 0.85) / stride)
    return F.when(length.isNull(), 1000).otherwise(F.greatest(F.lit(1), windows)).cast("long")


def _open(path: str):
    fs, inner = pafs.FileSystem.from_uri(path)
    return fs.open_input_file(inner)


class _Reader:
    """Sequential reads from a buffered file; counts the position itself."""

    def __init__(self, raw, begin: int = 0):
        self.raw, self.at = raw, begin
        if begin:
            raw.seek(begin)

    def take(self, size: int) -> bytes:
        got = self.raw.read(size)
        self.at += len(got)
        return got

    def skip(self, size: int) -> None:
        self.raw.seek(size, io.SEEK_CUR)
        self.at += size


def _classic(r: _Reader, head: bytes, stop: int | None, bodies: bool):
    """Packets of a classic file: (position, ts_us, linktype, data)."""
    order, per_us = PCAP_MAGIC[head[:4]]
    link = struct.unpack(order + "I", head[20:24])[0] & 0xFFFF
    record = struct.Struct(order + "IIII")
    while stop is None or r.at < stop:
        begin = r.at
        fixed = r.take(16)
        if len(fixed) < 16:
            return
        sec, frac, kept, _ = record.unpack(fixed)
        if bodies:
            data = r.take(kept)
            if len(data) < kept:
                return
        else:
            data = b""
            r.skip(kept)
        yield begin, sec * 1_000_000 + frac // per_us, link, data


def _resolution(options: bytes, order: str) -> int:
    """Time units per second of an interface; microseconds unless an option says else."""
    at = 0
    while at + 4 <= len(options):
        code, size = struct.unpack(order + "HH", options[at : at + 4])
        if code == 0:
            break
        if code == 9 and size >= 1:
            value = options[at + 4]
            return 2 ** (value & 0x7F) if value & 0x80 else 10**value
        at += 4 + (size + 3) // 4 * 4
    return 1_000_000


def _blocks(r: _Reader, state: dict, stop: int | None, bodies: bool):
    """Packets of a block-structured file; ``state`` holds byte order and interfaces."""
    while stop is None or r.at < stop:
        begin = r.at
        fixed = r.take(8)
        if len(fixed) < 8:
            return
        if fixed[:4] == b"\x0a\x0d\x0d\x0a":
            mark = r.take(4)
            state["order"] = "<" if mark == b"\x4d\x3c\x2b\x1a" else ">"
            state["links"], state["units"], state["snaps"] = [], [], []
            size = struct.unpack(state["order"] + "I", fixed[4:])[0]
            r.take(size - 12)
            continue
        kind, size = struct.unpack(state["order"] + "II", fixed)
        if kind == INTERFACE:
            body = r.take(size - 8)
            state["links"].append(struct.unpack(state["order"] + "H", body[:2])[0])
            state["units"].append(_resolution(body[8:-4], state["order"]))
            state["snaps"].append(struct.unpack(state["order"] + "I", body[4:8])[0])
        elif kind == ENHANCED:
            head = r.take(20)
            face, high, low, kept, _ = struct.unpack(state["order"] + "IIIII", head)
            data = b""
            if bodies:
                data = r.take(kept)
                r.take(size - 28 - kept)
                if len(data) < kept:
                    return
            else:
                r.skip(size - 28)
            ticks = (high << 32) | low
            yield begin, ticks * 1_000_000 // state["units"][face], state["links"][face], data
        elif kind == SIMPLE:
            body = r.take(size - 8)
            # No captured length is stored: the packet is cut at the snap length (0: none), padding follows.
            sent = struct.unpack(state["order"] + "I", body[:4])[0]
            yield begin, 0, state["links"][0], body[4:-4][: min(sent, state["snaps"][0] or sent)]
        else:
            r.skip(size - 8)


def _packets(raw, head: bytes, begin: int, stop: int | None, state: dict | None, bodies: bool):
    if head[:4] in PCAP_MAGIC:
        return _classic(_Reader(raw, begin), head, stop, bodies)
    return _blocks(_Reader(raw, begin), state, stop, bodies)


def _pack(head: bytes, state: dict) -> bytes:
    """What a split must know: the classic header, or byte order and interfaces."""
    if head[:4] in PCAP_MAGIC:
        return head
    faces = zip(state.get("links", []), state.get("units", []), state.get("snaps", []))
    return head[:4] + state.get("order", "<").encode() + b"".join(struct.pack("<IQI", *f) for f in faces)


def _unpack(head: bytes) -> dict:
    if head[:4] in PCAP_MAGIC:
        return {}
    faces = list(struct.iter_unpack("<IQI", head[5:]))
    links, units, snaps = ([f[i] for f in faces] for i in range(3))
    return {"order": head[4:5].decode(), "links": links, "units": units, "snaps": snaps}


def _find_splits(split_bytes: int):
    """Cut each file where records begin, reading only record headers.

    A compressed file cannot be entered in the middle and stays one split.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, modified in pdf[["path", "modificationTime"]].itertuples(index=False):
                if path.endswith(".gz"):
                    yield pd.DataFrame([(path, 0, -1, 0, b"")], columns=SPLIT_COLUMNS).assign(modified=modified)
                    continue
                with _open(path) as raw:
                    head = raw.read(24)
                    begin = 24 if head[:4] in PCAP_MAGIC else 0
                    raw.seek(0)
                    state: dict = {}
                    if head[:4] not in PCAP_MAGIC and head[:4] != b"\x0a\x0d\x0d\x0a":
                        continue
                    first, out, index = begin, [], 0
                    packed, first_index = _pack(head, state), 0
                    for at, _, _, _ in _packets(raw, head, begin, None, state, False):
                        if at - first >= split_bytes:
                            out.append((path, first, at, first_index, packed))
                            first, first_index, packed = at, index, _pack(head, state)
                        index += 1
                    out.append((path, first, -1, first_index, packed))
                yield pd.DataFrame(out, columns=SPLIT_COLUMNS).assign(modified=modified)

    return run


SPLIT_COLUMNS = ["path", "begin", "stop", "first_index", "head"]


def _read_splits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, begin, stop, index, head in pdf[SPLIT_COLUMNS].itertuples(index=False):
            with _open(path) as opened:
                if path.endswith(".gz"):
                    raw = gzip.GzipFile(fileobj=opened)
                    head = raw.read(24)
                    begin = 24 if head[:4] in PCAP_MAGIC else 0
                    raw.seek(0)
                    state: dict = {}
                else:
                    raw, state = opened, _unpack(head)
                rows = []
                found = _packets(raw, head, begin, None if stop < 0 else stop, state, True)
                name = path.rsplit("/", 1)[-1]
                for _, ts, link, data in found:
                    rows.append((name, index, ts, link, data))
                    index += 1
                    if len(rows) >= 4096:
                        yield pd.DataFrame(rows, columns=["capture", "packet_index", "ts_us", "linktype", "data"])
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["capture", "packet_index", "ts_us", "linktype", "data"])


def _cut(files: DataFrame, split_bytes: int) -> DataFrame:
    """The splits of files, found by hopping over their record headers."""
    named = files.where(F.col("name").rlike(CAPTURE_NAMES)).select("path", "modificationTime")
    cores = files.sparkSession.sparkContext.defaultParallelism
    return named.repartition(cores, "path").mapInPandas(_find_splits(split_bytes), INDEX)


def _read(splits: DataFrame) -> DataFrame:
    cores = splits.sparkSession.sparkContext.defaultParallelism
    return splits.select(*SPLIT_COLUMNS).repartition(4 * cores, "path", "begin").mapInPandas(_read_splits, PACKETS)


def _indexed(spark: SparkSession, index: str) -> DataFrame | None:
    try:
        return spark.read.schema(INDEX).parquet(index)
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def update_index(spark: SparkSession, path: str, index: str, split_bytes: int = SPLIT_BYTES) -> None:
    """Add the splits of files below ``path`` that the index table does not have as they are now."""
    files = listing(spark, path)
    known = _indexed(spark, index)
    if known is not None:
        seen = known.select("path", F.col("modified").alias("modificationTime")).distinct()
        files = files.join(seen, ["path", "modificationTime"], "left_anti")
    _cut(files, split_bytes).write.mode("append").parquet(index)


def read_captures(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, index: str | None = None) -> DataFrame:
    """Packets of all capture files below a folder.

    A first pass hops over record headers and cuts every file into splits; the splits
    are spread over the cluster and read in parallel, so a large file is not one task.
    With an ``index`` table that pass is made once per file: its splits are stored there, and
    later reads, batch or stream, start from them. Of a file that has changed the newest splits count.
    """
    if index is None:
        return _read(_cut(listing(spark, path), split_bytes))
    update_index(spark, path, index, split_bytes)
    splits = _indexed(spark, index)
    newest = splits.groupBy("path").agg(F.max("modified").alias("modified"))
    return _read(splits.join(newest, ["path", "modified"]))


def stream_captures(spark: SparkSession, index: str, files_per_trigger: int | None = None) -> DataFrame:
    """Packets of captures as their splits come into the index; ``update_index`` brings new files.

    The index table is the stream's source, so its checkpoint knows which splits have been read. A file that is
    written again comes again.
    """
    reader = spark.readStream.schema(INDEX)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return _read(reader.parquet(index))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """K2: SHA-256 of every capture file, read as a stream, so a file may have any length."""

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for one in pdf["path"]:
                state = hashlib.sha256()
                with _open(one) as raw:
                    while block := raw.read(1 << 20):
                        state.update(block)
                found.append(state.hexdigest())
            yield pdf[["name", "modificationTime"]].assign(file_hash=found)

    files = listing(spark, path).select("path", "name", "modificationTime")
    spread = files.repartition(spark.sparkContext.defaultParallelism, "path")
    return spread.mapInPandas(digest, "name string, modificationTime timestamp, file_hash string").select(
        F.col("name").alias("source_filename"), "file_hash", F.col("modificationTime").alias("file_mtime")
    )


def unchanged(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """K2: files whose name and time the manifest already has, with their stored hash."""
    known = manifest.select(F.col("source_filename").alias("name"), F.col("file_mtime").alias("modificationTime"), "file_hash")
    return files.join(known, ["name", "modificationTime"])
