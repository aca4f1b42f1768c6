"""Structured Streaming forms of the live detectors.

Event time takes the place of the wall clock, so a replay gives the batch result. Late
rows are dropped by the watermark; sinks are checkpointed files.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from packetgrain.operators import calibrate, incidents
from packetgrain.operators.cusum import fold_levels
from packetgrain.operators.rate import FLOOD_SPAN_US, FLOOD_SYNS
from packetgrain.operators.tls import walk
from packetgrain.session import shared_folder

def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


# State layouts; a worker has no session that could parse them from text.
LEVEL_STATE = _struct(("s", T.DoubleType()), ("last", T.LongType()), ("timer", T.LongType()))
MARK = _struct(("off", T.LongType()), ("ts", T.LongType()))
BUFFER_STATE = _struct(
    ("rest", T.BinaryType()), ("marks", T.ArrayType(MARK)), ("next", T.LongType()),
    ("last", T.LongType()), ("life", T.LongType()),
)
TLS_STATE = _struct(("owed", T.LongType()), ("hide", T.BooleanType()), ("known", T.BooleanType()))
BAN_STATE = _struct(
    ("banned_at", T.LongType()), ("ttl", T.LongType()), ("count", T.LongType()), ("type", T.StringType()), ("timer", T.LongType())
)
SPAN_STATE = _struct(("times", T.BinaryType()), ("timer", T.LongType()))
LAST_STATE = _struct(("last", T.LongType()))
# A key without rows for so long is forgotten.
LEVEL_TTL_US = 172_800_000_000
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def source(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Rows of a table's files as they arrive; the table is one file or a folder of files."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    # A stream takes a single file only as what a pattern matches; a folder it matches is read whole.
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")


def run_available(stream: DataFrame) -> DataFrame:
    """Process what is there with a checkpointed file sink, and read the result back."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def run_parts(rows: DataFrame, part: Column, parts: int, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Deliver ``rows`` in ``parts`` turns and run the stream ``build`` makes after each, from its checkpoint.

    Every turn starts the query anew, so state, watermark and sink pass from turn to turn through the shared folder only.
    """
    spark = rows.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    for turn in range(parts):
        rows.where(part == turn).write.mode("append").parquet(f"{base}/in")
        stream = build(spark.readStream.schema(rows.schema).parquet(f"{base}/in"))
        query = (
            stream.writeStream.format("parquet").outputMode("append")
            .option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def once(packets: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """Drop packets delivered twice within the watermark."""
    return packets.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def rate_alerts(packets: DataFrame, syn: Column, bucket: str, limit: int, ts: str, delay: str | None) -> DataFrame:
    """SYNs per tumbling bucket; partial counts are combined before the shuffle. Without ``delay`` the packets'
    own watermark holds."""
    marked = packets.where(syn) if delay is None else packets.where(syn).withWatermark(ts, delay)
    counted = marked.groupBy(F.window(ts, bucket)).agg(
        F.count(F.lit(1)).alias("syns")
    )
    return counted.where(F.col("syns") > limit).select(
        F.unix_micros("window.start").alias("bucket_us"), "syns"
    )


def alert_sessions(alerts: DataFrame, keys: list[str], gap: str, ts: str, delay: str) -> DataFrame:
    """Incidents as session windows per type, closed by the watermark."""
    return alerts.withWatermark(ts, delay).groupBy(F.session_window(ts, gap), *keys).agg(
        F.count(F.lit(1)).alias("raw_alerts"), F.max("score").alias("peak_score"),
        F.min(ts).alias("_first"), F.max(ts).alias("_last"),
    ).select(*keys, F.unix_micros("_first").alias("first_us"), F.unix_micros("_last").alias("last_us"), "raw_alerts", "peak_score")


def byte_alerts(scores: DataFrame, calibration: DataFrame, keys: list[str]) -> DataFrame:
    """Scores against the calibration table the learning phase has left.

    The table has one row per sensor and is joined as it is at each micro-batch.
    """
    limits = calibration.select(*keys, "byte_threshold", "gold_threshold", "score_quantiles")
    joined = scores.join(limits, keys)
    kinds = incidents.gate_types(F.col("score"), F.col("byte_threshold"), F.col("gold_threshold"))
    pct = calibrate.score_percentile(F.col("score"), F.col("score_quantiles"))
    return joined.select(*scores.columns, pct.alias("score_percentile"), F.explode(kinds).alias("type"))


def _ordered(rows: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    """A key's rows of one micro-batch, whose size the source's rate limit bounds."""
    parts = list(rows)
    pdf = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
    return pdf.iloc[np.lexsort([pdf[c].to_numpy() for c in reversed(order)])] if len(pdf) > 1 else pdf


class _Expiring(StatefulProcessor):
    """A state of one value per key that event time removes: a timer is set anew with every update."""

    name: str
    layout: T.StructType

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState(self.name, self.layout)

    def held(self) -> tuple | None:
        """What the key has left; asked once for the rows of a key, as every question is a message to the state store."""
        self._held = self.state.get()
        return self._held

    def keep(self, *values, until_us: int) -> None:
        """``values`` until the watermark has passed ``until_us``, after ``held``; the last field is the timer."""
        timer = until_us // 1000 + 1
        if self._held is None or self._held[-1] != timer:
            if self._held is not None:
                self.handle.deleteTimer(self._held[-1])
            self.handle.registerTimer(timer)
        self.state.update((*values, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


class _Levels(_Expiring):
    """The leaky sum of a key between micro-batches; it starts from zero after a pause longer than ``ttl_us``."""

    name, layout = "level", LEVEL_STATE

    def __init__(self, key: str, leak: float, h: float, ttl_us: int):
        self.key, self.leak, self.h, self.ttl_us = key, leak, h, ttl_us

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _ordered(rows, ["ts_us", "event_id"])
        level, last = (self.held() or (0.0, None))[:2]
        times, steps = pdf["ts_us"].to_numpy(), pdf["step"].tolist()
        fresh = np.flatnonzero(np.diff(times, prepend=times[0] if last is None else last) > self.ttl_us)
        out: list[float] = []
        for lo, hi in zip([0, *fresh], [*fresh, len(steps)]):
            if lo in fresh:
                level = 0.0
            if hi > lo:
                out += fold_levels(steps[lo:hi], self.leak, self.h, level)
                level = 0.0 if out[-1] > self.h else out[-1]
        last = int(max(times[-1], times[-1] if last is None else last))
        self.keep(level, last, until_us=last + self.ttl_us)
        yield pd.DataFrame(
            {self.key: key[0], "event_id": pdf["event_id"].to_numpy(), "level": out, "alarm": [v > self.h for v in out]}
        )


def _stateful(
    stream: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str | T.StructType, event_time: str = ""
) -> DataFrame:
    """``event_time`` names the output column that a later stateful step goes by. Event time removes the state of an ``_Expiring`` processor. The others take ``ttl_ms`` of the wall clock, which
    keeps a query alive, so a replay of what is there has none."""
    if isinstance(processor, _Expiring):
        mode = "EventTime"
    else:
        mode = "ProcessingTime" if getattr(processor, "ttl_ms", None) is not None else "None"
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return stream.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=T.StructType.fromDDL(schema) if isinstance(schema, str) else schema,
        outputMode="Append", timeMode=mode, eventTimeColumnName=event_time,
    )


def cusum_levels(
    steps: DataFrame, key: str, h: float, leak: float = 0.98, ttl_us: int = LEVEL_TTL_US, delay: str = "0 seconds"
) -> DataFrame:
    """Levels per flow or target; ``steps`` has event_id, ts (a timestamp), ts_us and step.

    A key is forgotten ``ttl_us`` after its last row, so the state holds the keys of that time only. The batch form is
    ``cusum.levels`` over the lives of ``windows.idle_split``.
    """
    kind = steps.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, event_id bigint, level double, alarm boolean"
    return _stateful(steps.withWatermark("ts", delay), [key], _Levels(key, leak, h, ttl_us), schema)


class _Spans(_Expiring):
    """The times of a source's SYNs within the trailing span."""

    name, layout = "span", SPAN_STATE

    def __init__(self, key: str, tie: str, limit: int, span_us: int):
        self.key, self.tie, self.limit, self.span_us = key, tie, limit, span_us

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _ordered(rows, ["ts_us", self.tie])
        left = self.held()
        held = np.frombuffer(left[0], np.int64) if left else np.zeros(0, np.int64)
        times = pdf["ts_us"].to_numpy(np.int64)
        # A row counts what is held up to its own time, itself and the rows before it.
        first = times - self.span_us
        before = np.searchsorted(held, times, side="right") - np.searchsorted(held, first, side="left")
        syns = np.maximum(before, 0) + np.arange(1, len(times) + 1) - np.searchsorted(times, first, side="left")
        every = np.sort(np.concatenate([held, times]))
        last = int(every[-1])
        self.keep(every[every >= last - self.span_us].tobytes(), until_us=last + self.span_us)
        yield pd.DataFrame({self.key: key[0], self.tie: pdf[self.tie].to_numpy(), "syns": syns, "flood": syns > self.limit})


def syn_floods(
    syns: DataFrame, key: str, limit: int = FLOOD_SYNS, span_us: int = FLOOD_SPAN_US, tie: str = "packet_index", delay: str = "0 seconds"
) -> DataFrame:
    """SYNs of the source in the trailing span at every SYN, across micro-batches; ``syns`` has ts, ts_us and the tie."""
    kinds = [f"{c} {syns.schema[c].dataType.simpleString()}" for c in (key, tie)]
    return _stateful(
        syns.withWatermark("ts", delay), [key], _Spans(key, tie, limit, span_us), ", ".join([*kinds, "syns bigint, flood boolean"])
    )


class _FlowBuffer(StatefulProcessor):
    """The bytes of a flow that do not fill a window yet."""

    def __init__(self, width: int, idle_us: int, ttl_ms: int | None):
        self.width, self.idle_us, self.ttl_ms = width, idle_us, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("buffer", BUFFER_STATE, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _ordered(rows, ["ts_us", "packet_index"])
        if self.state.exists():
            rest, marks, number, last, life = self.state.get()
            rest, marks = bytearray(rest), [(m[0], m[1]) for m in marks]
        else:
            rest, marks, number, last, life = bytearray(), [], 0, None, 0
        out = []
        for ts, data in zip(pdf["ts_us"].tolist(), pdf["data"]):
            if last is not None and ts - last > self.idle_us:
                rest, marks, life = bytearray(), [], life + 1
            last = ts
            marks.append((len(rest), ts))
            rest += data or b""
            while len(rest) >= self.width:
                # The window's time is that of the packet holding its first byte.
                at = max(i for i, m in enumerate(marks) if m[0] <= 0)
                out.append((key[0], life, number, marks[at][1], bytes(rest[: self.width])))
                number += 1
                rest = rest[self.width :]
                marks = [(o - self.width, t) for o, t in marks]
                while len(marks) > 1 and marks[1][0] <= 0:
                    marks.pop(0)
        self.state.update((bytes(rest), [(o, t) for o, t in marks], number, last, life))
        yield pd.DataFrame(out, columns=["flow", "life", "win_idx", "ts_us", "bytes"])

    def close(self) -> None:
        pass


def flow_windows(packets: DataFrame, width: int = 512, idle_us: int = 300_000_000, ttl_ms: int | None = None) -> DataFrame:
    """Windows of each flow as its packets arrive."""
    schema = "flow string, life bigint, win_idx bigint, ts_us bigint, bytes binary"
    return _stateful(packets, ["flow"], _FlowBuffer(width, idle_us, ttl_ms), schema)


class _Tls(StatefulProcessor):
    """P10: owed bytes of a record, whether they are hidden, and that the stream is TLS."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("tls", TLS_STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _ordered(rows, ["packet_index"])
        now = tuple(self.state.get()) if self.state.exists() else (0, False, False)
        out = []
        for raw, start in zip(pdf["data"], pdf["payload_at"].tolist()):
            payload = bytearray(raw[start:])
            now = walk(payload, *now)
            out.append(raw[:start] + bytes(payload))
        self.state.update(now)
        yield pd.DataFrame({"stream": key[0], "packet_index": pdf["packet_index"].to_numpy(), "data": out})

    def close(self) -> None:
        pass


def tls_records(packets: DataFrame) -> DataFrame:
    """P10: ``packets`` has stream, packet_index, data and the payload's start ``payload_at``."""
    return _stateful(packets, ["stream"], _Tls(), "stream string, packet_index bigint, data binary")


class _Bans(_Expiring):
    """The running ban of an address; every request emits the ban as it then stands."""

    name, layout = "ban", BAN_STATE

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _ordered(rows, ["ts_us", "tie"])
        left = self.held()
        ban = tuple(left[:4]) if left else None
        out = []
        for ts, ttl, reason, kind in pdf[["ts_us", "ban_ttl", "reason", "type"]].itertuples(index=False):
            ban = incidents.banned(ban, int(ts), int(ttl), kind)
            out.append((key[0], *ban[:3], int(ts), reason, ban[3]))
        # A ban that is over is as good as none.
        self.keep(*ban, until_us=ban[0] + ban[1])
        yield pd.DataFrame(out, columns=["ip", "banned_at", "ttl", "count", "last_seen", "reason", "incident_type"])


def bans(requests: DataFrame, ttl_us: int = incidents.BAN_TTL_US, delay: str = "0 seconds") -> DataFrame:
    """Ban updates; the highest count of a start is the ban's final row. ``requests`` has ts, ts_us, tie, reason and
    type; a ``ttl_us`` column gives requests a length of their own."""
    schema = "ip string, banned_at bigint, ttl bigint, count bigint, last_seen bigint, reason string, incident_type string"
    return _stateful(incidents.ban_requests(requests, ttl_us).withWatermark("ts", delay), ["ip"], _Bans(), schema)


class _Gaps(StatefulProcessor):
    """The time of the last packet of a capture."""

    def __init__(self, key: str, gap_us: int):
        self.key, self.gap_us = key, gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", LAST_STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _ordered(rows, ["lo_us"])
        last = self.state.get()[0] if self.state.exists() else None
        out = []
        for lo, hi in pdf[["lo_us", "hi_us"]].itertuples(index=False):
            if last is not None and lo - last > self.gap_us:
                out.append((key[0], int(last), int(lo), round((lo - last) / 1e6)))
            last = int(hi) if last is None else max(last, int(hi))
        self.state.update((last,))
        yield pd.DataFrame(out, columns=[self.key, "opened_us", "closed_us", "gap_seconds"])

    def close(self) -> None:
        pass


def capture_gaps(packets: DataFrame, key: str, ts: str, gap: str, gap_us: int, delay: str) -> DataFrame:
    """Pauses of a capture. Packets are first reduced to their edges per time cell,
    so a busy capture brings one row per cell to its state."""
    edges = packets.withWatermark(ts, delay).groupBy(F.window(ts, gap), key).agg(
        F.min(F.unix_micros(ts)).alias("lo_us"), F.max(F.unix_micros(ts)).alias("hi_us")
    ).select(key, "lo_us", "hi_us")
    kind = packets.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, opened_us bigint, closed_us bigint, gap_seconds bigint"
    return _stateful(edges, [key], _Gaps(key, gap_us), schema)
