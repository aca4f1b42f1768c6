"""From captured frames to alert records: one batch plan and one streaming plan with the same answer.

Frames are parsed and masked, the bytes of every flow are cut into windows, windows are scored, the scores feed a leaky
sum per host pair and one per target, and all detectors' alerts become incidents and records. In the stream each step
with state works by event time: a window carries the time of the packet that completed it, and what that time has left
behind is removed.

A flow that was idle for longer than ``idle_us`` starts anew, with its TLS state; so does a pair or target after
``ttl_us``. A window's score is any column expression over ``bytes``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetgrain.operators import cusum, incidents, masking, packets, tls, windows
from packetgrain.operators.cusum import fold_levels
from packetgrain.operators.tls import walk
from packetgrain.session import cut
from packetgrain.streaming import live


@dataclass(frozen=True)
class Settings:
    """What the detectors are set to. The limits are those of a calibration."""

    threshold: float
    gold: float
    reference: float
    flow_h: float = 25.0
    target_h: float = 25.0
    leak: float = 0.98
    width: int = 512
    idle_us: int = 300_000_000
    ttl_us: int = live.LEVEL_TTL_US
    syn_bucket_us: int = 100_000
    syn_limit: int = 75
    gap_us: int = incidents.INCIDENT_GAP_US


FLOW = ["capture", "flow"]
SCORED = [*FLOW, "life_us", "win_idx", "ts_us", "done_ts_us", "done_packet_index", "pair", "target", "score"]


def _masked(frames: DataFrame) -> DataFrame:
    """Frames parsed, with everything blanked that a packet alone can tell."""
    parsed = packets.parse(frames).withColumn("flow", packets.flow_key())
    return masking.mask_headers(parsed)


def _scored(cut_windows: DataFrame, score: Callable[[], Column]) -> DataFrame:
    """Windows with score, host pair (either direction) and target; the packets that did not parse have neither."""
    side = F.split("flow", r"\|")
    known = F.col("flow") != "global"
    pair = F.concat_ws("|", F.array_sort(F.array(side[0], side[2])))
    out = cut_windows.withColumn("score", score()).withColumn("pair", F.when(known, F.concat_ws("|", "capture", pair)))
    return out.withColumn("target", F.when(known, F.concat_ws("|", "capture", F.concat_ws(":", side[2], side[3]))))


def _alerts(levelled: DataFrame, s: Settings) -> DataFrame:
    """A window's alerts, at the time it was complete."""
    side = F.split("flow", r"\|")

    def alert(kind: str, when: Column, score: str, text: Column) -> Column:
        row = F.struct(F.lit(kind).alias("type"), F.col(score).alias("score"), text.alias("message"), F.round(score, 2).alias("level"))
        return F.when(when, row)

    over = F.col("score") > s.threshold
    kinds = F.array_compact(F.array(
        alert("SLOW", F.col("pair_alarm"), "pair_level", F.concat(F.lit("slow anomaly between "), F.regexp_replace(F.col("pair"), r"^[^|]*\|", ""))),
        alert("SLOW_DISTRIBUTED", F.col("target_alarm"), "target_level", F.concat(F.lit("slow anomaly targeting "), F.regexp_replace(F.col("target"), r"^[^|]*\|", ""))),
        alert("BYTE", over, "score", F.format_string("payload surprise %.2f bits", "score")),
        alert("CRITICAL_BYTE", F.col("score") > s.gold, "score", F.format_string("payload surprise %.2f bits over the ceiling", "score")),
    ))
    # The stream's event time has to stay the column it is.
    time = [c for c in ("ts",) if c in levelled.columns]
    return levelled.select(
        *time, "capture", F.col("done_ts_us").alias("ts_us"), F.col("done_packet_index").alias("tie"), F.col("win_idx").alias("tie_2"),
        F.concat_ws(" -> ", side[0], F.get(side, F.lit(2))).alias("talker"), F.get(side, F.lit(3)).alias("port"), F.explode(kinds).alias("a"),
    ).select(*time, "capture", "ts_us", "tie", "tie_2", "talker", "port", "a.type", "a.score", "a.message",
             F.when(F.col("a.type").startswith("SLOW"), F.col("a.level")).alias("cusum_level"))


ALERT = ["capture", "ts_us", "tie", "tie_2", "talker", "port", "type", "score", "message", "cusum_level"]


def _flood(capture: Column, end_us: Column, syns: Column) -> list[Column]:
    """An alert of a bucket with too many SYNs, at the bucket's last microsecond."""
    return [
        capture.alias("capture"), (end_us - 1).alias("ts_us"), F.lit(-1).cast("long").alias("tie"), F.lit(-1).cast("long").alias("tie_2"),
        F.lit(None).cast("string").alias("talker"), F.lit(None).cast("string").alias("port"), F.lit("RATE").alias("type"),
        syns.cast("double").alias("score"), F.format_string("%d connection attempts in a bucket", syns).alias("message"),
        F.lit(None).cast("double").alias("cusum_level"),
    ]


OPENING = ["tie", "talker", "port", "score", "message", "cusum_level"]


def _records(found: DataFrame, product: str, category: str, detector: str) -> DataFrame:
    """I4/I8: a record when an incident opens, and one when it closes after several alerts."""
    closing = incidents.close_message(F.col("type"), F.col("raw_alerts"), F.col("first_us"), F.col("last_us"), F.col("peak_score"))
    at = F.array_compact(F.array(
        F.struct(F.lit("opened").alias("state"), F.col("first_us").alias("ts_us"), F.col("score").alias("score"), F.col("message").alias("message")),
        F.when(closing.isNotNull(), F.struct(
            F.lit("closed").alias("state"), F.col("last_us").alias("ts_us"), F.col("peak_score").alias("score"), closing.alias("message")
        )),
    ))
    rows = found.select("capture", "type", "first_us", "last_us", "raw_alerts", "talker", "port", "cusum_level", F.explode(at).alias("r"))
    flat = rows.select("*", "r.*").drop("r").withColumn("score_percentile", F.lit(None).cast("int"))
    return incidents.eve_records(flat, product, category, detector)


# Batch


def batch(frames: DataFrame, s: Settings, score: Callable[[], Column], named: tuple[str, str, str]) -> DataFrame:
    """Records of ``frames(capture, packet_index, ts_us, data)``; ``named`` is product, category and detector."""
    # Frames are parsed and masked once; every later step reads what was written.
    parsed = cut(_masked(frames).select("capture", "packet_index", "ts_us", "flow", "is_syn", "data", "_src", "_dst", "_sp", "_dp", "_pay", "_tls"))
    lives = windows.idle_split(parsed, FLOW, s.idle_us, begun="life_us").drop("is_syn", "life")
    # A life's TLS stream is its own.
    sent = lives.withColumn("_own", F.col("capture")).withColumn("capture", F.concat_ws("/", "capture", "life_us"))
    masked = cut(tls.mask_records(sent).withColumn("capture", F.col("_own")).select(*FLOW, "packet_index", "ts_us", "life_us", "data"))
    by = [*FLOW, "life_us"]
    pieces = windows.packet_windows(
        masked, by, [F.col("ts_us"), F.col("packet_index")], s.width, done=["ts_us", "packet_index"]
    )
    scored = cut(_scored(pieces, score).select(*SCORED))

    def levels(rows: DataFrame, key: str, h: float) -> DataFrame:
        known = rows.where(F.col(key).isNotNull())
        split = windows.idle_split(known, [key], s.ttl_us, "done_ts_us").withColumnRenamed("life", "_life")
        order = [F.col(c) for c in ("done_ts_us", "done_packet_index", "win_idx")]
        payload = [c for c in rows.columns if c != key]
        out = cusum.levels(split, [key, "_life"], order, F.col("score") - s.reference, h, s.leak, payload)
        plain = rows.where(F.col(key).isNull()).withColumn(f"{key}_level", F.lit(0.0)).withColumn(f"{key}_alarm", F.lit(False))
        named_ = out.withColumnRenamed("level", f"{key}_level").withColumnRenamed("alarm", f"{key}_alarm")
        return named_.select(*rows.columns, f"{key}_level", f"{key}_alarm").unionByName(plain)

    found = _alerts(levels(cut(levels(scored, "pair", s.flow_h)), "target", s.target_h), s)
    bucket = F.floor(F.col("ts_us") / s.syn_bucket_us)
    floods = parsed.where("is_syn").groupBy("capture", bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > s.syn_limit)
    rate = floods.select(*_flood(F.col("capture"), (F.col("b") + 1) * s.syn_bucket_us, F.col("n")))
    alerts = found.select(*ALERT).unionByName(rate.select(*ALERT))
    order = F.struct("tie", "tie_2").alias("alert_id")
    named_alerts = alerts.select("*", order, F.col("score").alias("opening"))
    grouped = incidents.incidents(
        named_alerts, ["capture", "type"], s.gap_us, [c if c != "score" else "opening" for c in OPENING]
    ).withColumnRenamed("opening", "score")
    return _records(grouped, *named)


# Stream

FLOW_STATE = T.StructType([
    T.StructField("rest", T.BinaryType()), T.StructField("marks", T.BinaryType()), T.StructField("next", T.LongType()),
    T.StructField("begun", T.LongType()), T.StructField("last", T.LongType()), T.StructField("owed", T.LongType()),
    T.StructField("hide", T.BooleanType()), T.StructField("known", T.BooleanType()), T.StructField("timer", T.LongType()),
])


class _Flows(live._Expiring):
    """A flow's TLS state and the bytes that do not fill a window yet; both end with an idle pause."""

    name, layout = "flow", FLOW_STATE

    def __init__(self, width: int, idle_us: int):
        self.width, self.idle_us = width, idle_us

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = live._ordered(rows, ["ts_us", "packet_index"])
        held = self.held()
        if held:
            rest, marks, number, begun, last, *record = held[:8]
            rest, marks = bytearray(rest), np.frombuffer(marks, np.int64).reshape(-1, 2).tolist()
        else:
            last = None
        out = []
        for ts, index, data, start, hidden in zip(pdf["ts_us"].tolist(), pdf["packet_index"].tolist(), pdf["data"], pdf["start"].tolist(), pdf["hidden"].tolist()):
            if last is None or ts - last > self.idle_us:
                rest, marks, number, begun, record = bytearray(), [], 0, ts, [0, False, False]
            last = ts
            if hidden:
                payload = bytearray(data[start:])
                record = list(walk(payload, int(record[0]), bool(record[1]), bool(record[2])))
                data = data[:start] + bytes(payload)
            if not len(data):
                continue
            marks.append([len(rest), ts])
            rest += data
            done = 0
            while len(rest) - done >= self.width:
                # The window's time is that of the packet holding its first byte.
                while len(marks) > 1 and marks[1][0] <= done:
                    marks.pop(0)
                out.append((*key, begun, number, marks[0][1], ts, index, bytes(rest[done : done + self.width])))
                number, done = number + 1, done + self.width
            rest = rest[done:]
            while len(marks) > 1 and marks[1][0] <= done:
                marks.pop(0)
            marks = [[at - done, t] for at, t in marks] if rest else []
        self.keep(
            bytes(rest), np.array(marks, np.int64).tobytes(), number, begun, last, int(record[0]), bool(record[1]), bool(record[2]),
            until_us=last + self.idle_us,
        )
        frame = pd.DataFrame(out, columns=[*FLOW, "life_us", "win_idx", "ts_us", "done_ts_us", "done_packet_index", "bytes"])
        yield frame.assign(ts=pd.to_datetime(frame["done_ts_us"], unit="us"))


class _Level(live._Expiring):
    """Adds a key's leaky sum to the windows that pass."""

    name, layout = "level", live.LEVEL_STATE

    def __init__(self, key: str, reference: float, leak: float, h: float, ttl_us: int):
        self.key, self.reference, self.leak, self.h, self.ttl_us = key, reference, leak, h, ttl_us

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = live._ordered(rows, ["done_ts_us", "done_packet_index", "win_idx"])
        if pdf[self.key].isna().all():
            yield pdf.assign(**{f"{self.key}_level": 0.0, f"{self.key}_alarm": False})
            return
        level, last = (self.held() or (0.0, None))[:2]
        out = []
        for ts, score in zip(pdf["done_ts_us"].tolist(), pdf["score"].tolist()):
            if last is not None and ts - last > self.ttl_us:
                level = 0.0
            last = ts
            out += fold_levels([score - self.reference], self.leak, self.h, level)
            level = 0.0 if out[-1] > self.h else out[-1]
        self.keep(level, last, until_us=last + self.ttl_us)
        yield pdf.assign(**{f"{self.key}_level": out, f"{self.key}_alarm": [v > self.h for v in out]})


def stream(frames: DataFrame, s: Settings, score: Callable[[], Column], named: tuple[str, str, str], delay: str) -> DataFrame:
    """The records of ``batch`` over a stream of frames with their time ``ts``; incidents come out once they are over."""
    sent = _masked(frames.withWatermark("ts", delay)).withColumnsRenamed({"_pay": "start", "_tls": "hidden"})
    schema = (
        f"capture string, flow string, life_us bigint, win_idx bigint, ts_us bigint, done_ts_us bigint, "
        f"done_packet_index bigint, bytes binary, ts timestamp"
    )
    cut_windows = live._stateful(
        sent.select(*FLOW, "ts", "ts_us", "packet_index", "data", "start", "hidden"), FLOW, _Flows(s.width, s.idle_us), schema, "ts"
    )
    rows = _scored(cut_windows, score).select(*SCORED, "ts")
    for key, h in (("pair", s.flow_h), ("target", s.target_h)):
        level = T.StructType([*rows.schema.fields, T.StructField(f"{key}_level", T.DoubleType()), T.StructField(f"{key}_alarm", T.BooleanType())])
        names = level.names
        rows = live._stateful(rows, [key], _Level(key, s.reference, s.leak, h, s.ttl_us), level, "ts").select(*names)
    found = _alerts(rows, s)

    syns = packets.parse(frames.withWatermark("ts", delay)).where("is_syn")
    span = F.window("ts", f"{s.syn_bucket_us} microseconds")
    floods = syns.groupBy("capture", span).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > s.syn_limit)
    rate = floods.select(
        *_flood(F.col("capture"), F.unix_micros("window.end"), F.col("n")), F.window_time("window").alias("ts")
    )
    alerts = found.select(*ALERT, "ts").unionByName(rate.select(*ALERT, "ts"))
    first = F.min_by(F.struct(*OPENING), F.struct("ts_us", "tie", "tie_2")).alias("opening")
    grouped = alerts.groupBy(F.session_window("ts", f"{s.gap_us} microseconds"), "capture", "type").agg(
        F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.count(F.lit(1)).alias("raw_alerts"),
        F.max("score").alias("peak_score"), first,
    )
    return _records(grouped.select("capture", "type", "first_us", "last_us", "raw_alerts", "peak_score", "opening.*"), *named)
