"""The adaptive recalibration as a stream, and gates that follow the calibrations it writes back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from packetgrain.operators import calibrate
from packetgrain.operators.calibrate import Recalibration
from packetgrain.sinks import calibrations
from packetgrain.streaming import live

NOW_STATE = T.StructType(
    [
        T.StructField("threshold", T.DoubleType()),
        T.StructField("reference", T.DoubleType()),
        T.StructField("bucket", T.LongType()),
        T.StructField("held", T.LongType()),
    ]
)
KEY = T.StructType([T.StructField("key", T.LongType())])
BYTES = T.StructType([T.StructField("bytes", T.BinaryType())])


class _Recalibrator(StatefulProcessor):
    """The thresholds of a sensor, its last unflagged scores by interval, and the bins of the running digest.

    An interval is closed by the first row of a later one. A row that comes after its interval was closed counts in the
    open one. Intervals that hold none of the last ``trailing`` scores are dropped.
    """

    def __init__(self, key: str, how: Recalibration):
        self.key, self.how = key, how

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", NOW_STATE)
        self.sample = handle.getMapState("sample", KEY, BYTES)
        self.digest = handle.getMapState("digest", KEY, BYTES)

    def _add(self, state, key: int, values: np.ndarray) -> None:
        if len(values):
            old = state.getValue((key,))[0] if state.containsKey((key,)) else b""
            state.updateValue((key,), (old + values.tobytes(),))

    def _close(self, bucket: int, held: int, t: float, r: float, anchors) -> tuple:
        how = self.how
        n = min(held, how.trailing)
        bins = None
        digest = bucket * how.interval_us // how.digest_us
        if how.measures(bucket) and self.digest.containsKey((digest,)):
            recent = np.frombuffer(self.digest.getValue((digest,))[0], np.uint8)[-how.recent :]
            bins = np.bincount(recent, minlength=10).tolist()
        psi = calibrate.psi_of(bins) if bins else None
        use = how.applies(n, psi)
        if use:
            parts, missing = [], n
            for at in sorted((k[0] for k in self.sample.keys()), reverse=True):
                if missing <= 0:
                    self.sample.removeKey((at,))
                    continue
                parts.append(np.frombuffer(self.sample.getValue((at,))[0], np.float64)[-missing:])
                missing -= len(parts[-1])
            scores = np.concatenate(parts)
            ranks = how.ranks(n, anchors["budget_quantile"])
            scores.partition(sorted(set(ranks)))
            t = how.moved(float(scores[ranks[0]]), t, anchors["byte_threshold"])
            r = how.moved(float(scores[ranks[1]]), r, anchors["anchor_ref"])
        return n, psi, use, t, r

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(["ts_us", "event_id"], kind="stable")
        first = pdf.iloc[0]
        t, r, bucket, held = self.now.get() if self.now.exists() else (first["byte_threshold"], first["anchor_ref"], None, 0)
        out = []
        for at, part in pdf.groupby(pdf["ts_us"] // self.how.interval_us):
            at = int(at)
            if bucket is not None and at > bucket:
                n, psi, use, t, r = self._close(bucket, held, t, r, first)
                out.append((key[0], bucket, n, psi, use, t, r))
            bucket = at if bucket is None else max(at, bucket)
            clean = part.loc[~part["flagged"].astype(bool), "score"].to_numpy(np.float64)
            held += len(clean)
            self._add(self.sample, bucket, clean)
            digest = bucket * self.how.interval_us // self.how.digest_us
            for (old,) in list(self.digest.keys()):
                if old < digest:
                    self.digest.removeKey((old,))
            self._add(self.digest, digest, part["bin"].to_numpy(np.uint8))
        self.now.update((float(t), float(r), bucket, held))
        frame = pd.DataFrame(out, columns=[self.key, "bucket", "n", "psi", "applied", "threshold", "reference"])
        yield frame.astype({"psi": "float64", "threshold": "float64", "reference": "float64"})

    def close(self) -> None:
        pass


def recalibration(scores: DataFrame, calibration: DataFrame, key: str, how: Recalibration) -> DataFrame:
    """``calibrate.adaptive_thresholds`` over a stream of event_id, ts_us, score and flagged; an interval
    comes out once a later one has begun. ``calibration`` is the one of the learning phase."""
    anchors = calibration.select(key, "budget_quantile", "byte_threshold", "score_quantiles")
    rows = scores.where(F.col("score").isNotNull()).join(anchors, key).select(
        key, "event_id", "ts_us", "score", F.coalesce("flagged", F.lit(False)).alias("flagged"), "budget_quantile", "byte_threshold",
        F.get("score_quantiles", F.lit(int(how.ref_pct))).alias("anchor_ref"), calibrate._bins("score").alias("bin"),
    )
    kind = calibration.schema[key].dataType.simpleString()
    return live._stateful(
        rows, [key], _Recalibrator(key, how),
        f"{key} {kind}, bucket bigint, n bigint, psi double, applied boolean, threshold double, reference double",
    )


def write_back(steps: DataFrame, store: str, key: str):
    """K7: a query that writes each micro-batch's last applied thresholds to the calibration store."""

    def publish(batch: DataFrame, batch_id: int) -> None:
        newest = batch.where("applied").groupBy(key).agg(
            F.max_by(F.struct("bucket", "threshold", "reference"), "bucket").alias("r")
        ).select(key, "r.*")
        calibrations.adapt(newest, store, [key])

    return steps.writeStream.outputMode("append").foreachBatch(publish)


def gate(scores: DataFrame, store: str, keys: list[str], out: str):
    """A query that gates each micro-batch by the newest calibration of the store. A batch that is run again
    replaces its own rows."""

    def check(batch: DataFrame, batch_id: int) -> None:
        version, fitted = calibrations.latest(batch.sparkSession, store)
        found = live.byte_alerts(batch, fitted, keys).withColumn("calibration", F.lit(version))
        found.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return scores.writeStream.outputMode("append").foreachBatch(check)
