"""Cumulative-sum change detection over ordered score series.

State per series: S = max(0, leak * S + d); an alarm is S > h, after which S is 0.
A series is folded in ordered chunks. A series of one chunk starts from 0. For a longer
one every chunk is first summarised as a function of the state it is entered with;
following those functions from chunk to chunk gives each chunk its true entry state,
and the chunks are then folded in parallel. No task sees a whole long series.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetgrain.operators.ordering import fits, row_index, running
from packetgrain.session import FOLD_ROWS, cut, limit

PIECES = T.ArrayType(
    T.StructType(
        [
            T.StructField("upper", T.DoubleType()),
            T.StructField("slope", T.DoubleType()),
            T.StructField("offset", T.DoubleType()),
            T.StructField("alarms", T.LongType()),
        ]
    )
)


def path(
    df: DataFrame, keys: list[str], order: list[Column], step: Column, name: str = "level"
) -> DataFrame:
    """The path without reset, P - min(0, running min P) with P the running sum of steps."""
    moved = df.withColumn("_step", step)
    within = fits(moved, keys)
    summed = running(moved, keys, order, {"_p": ("sum", F.col("_step"))}, within=within)
    low = running(summed, keys, order, {"_low": ("min", F.col("_p"))}, within=within)
    return low.withColumn(name, F.col("_p") - F.least(F.lit(0.0), F.col("_low"))).drop("_step", "_p", "_low")


def fold_levels(steps, leak: float, h: float, start: float = 0.0) -> list[float]:
    """Level after every step, before the reset that an alarm causes."""
    out, s = [], start
    for d in steps:
        s = leak * s + d
        if s < 0.0:
            s = 0.0
        out.append(s)
        if s > h:
            s = 0.0
    return out


def entry_function(steps, leak: float, h: float) -> list[tuple[float, float, float, int]]:
    """The chunk's last state as a function of its first one, in pieces of [0, h].

    A piece ``(upper, slope, offset, alarms)`` covers entry states up to ``upper`` from
    the piece before. While neither the floor nor an alarm has touched an entry state,
    its state is affine in it; the affine stretch only ever loses its ends, and what it
    loses shares one value from then on.
    """
    lo, hi, a, b = 0.0, h, 1.0, 0.0
    alive = True
    states: list[float] = []
    counts: list[int] = []
    merged: dict[int, tuple[int, int]] = {}
    left: list[tuple[float, int]] = []
    right: list[tuple[float, int]] = []
    live: list[int] = []

    def born() -> int:
        states.append(0.0)
        counts.append(0)
        live.append(len(states) - 1)
        return len(states) - 1

    for d in steps:
        for i in live:
            s = leak * states[i] + d
            if s < 0.0:
                s = 0.0
            if s > h:
                counts[i] += 1
                s = 0.0
            states[i] = s
        if alive:
            a, b = a * leak, b * leak + d
            if a * lo + b < 0.0:
                edge = min(hi, -b / a) if a > 0.0 else hi
                left.append((edge, born()))
                lo = edge
                alive = lo < hi
            if alive and a * hi + b > h:
                edge = max(lo, (h - b) / a)
                i = born()
                counts[i] = 1
                right.append((hi, i))
                hi = edge
                alive = lo < hi
            if a < 1e-300:
                left.append((hi, born()))
                states[live[-1]] = max(0.0, b)
                alive = False
        if len(live) > 1:
            first: dict[float, int] = {}
            kept = []
            for i in live:
                j = first.setdefault(states[i], i)
                if j == i:
                    kept.append(i)
                else:
                    merged[i] = (j, counts[i] - counts[j])
            live = kept

    def settle(i: int) -> tuple[float, int]:
        extra = 0
        while i in merged:
            i, more = merged[i]
            extra += more
        return states[i], counts[i] + extra

    pieces = [(u, 0.0, *settle(i)) for u, i in left]
    if alive:
        pieces.append((hi, a, b, 0))
    pieces += [(u, 0.0, *settle(i)) for u, i in reversed(right)]
    if not pieces or pieces[-1][0] < h:
        pieces.append((h, *pieces[-1][1:]))
    return [(float(u), float(m), float(o), int(n)) for u, m, o, n in pieces]


def enter(pieces, state: float) -> tuple[float, int]:
    """State and alarms after a chunk entered with ``state``."""
    for upper, slope, offset, alarms in pieces:
        if state <= upper:
            break
    return max(0.0, slope * state + offset), int(alarms)


def chunked(
    df: DataFrame, keys: list[str], order: list[Column], step: Column, payload: list[str], within: bool
) -> DataFrame:
    """One row per (key, chunk) with the ordered steps and the payload of their rows.

    ``within`` says that every series is one chunk; only longer ones are numbered first.
    """
    size = limit(df.sparkSession, FOLD_ROWS)
    names = [f"_at{i}" for i in range(len(order))]
    moved = df.select(*keys, *payload, step.cast("double").alias("_step"), *[o.alias(n) for o, n in zip(order, names)])
    if within:
        placed = moved.withColumn("chunk", F.lit(0).cast("long"))
    else:
        placed = row_index(moved, keys, [F.col(n) for n in names]).withColumn("chunk", F.floor(F.col("idx") / size))
    rows = F.struct(*names, "_step", *payload)
    return placed.groupBy(*keys, "chunk").agg(F.array_sort(F.collect_list(rows)).alias("rows"))


def _entry_states(chunks: DataFrame, keys: list[str], leak: float, h: float) -> DataFrame | None:
    """Entry state of every chunk after the first; None when no series has a second chunk."""
    long = chunks.where(F.col("chunk") > 0).select(*keys).distinct()
    if long.isEmpty():
        return None

    @F.pandas_udf(PIECES)
    def summarise(steps: pd.Series) -> pd.Series:
        return steps.map(lambda xs: [
            {"upper": u, "slope": m, "offset": o, "alarms": n} for u, m, o, n in entry_function(xs, leak, h)
        ])

    summary = chunks.join(long, keys, "left_semi").select(
        *keys, "chunk", summarise(F.col("rows._step")).alias("pieces")
    )
    schema = T.StructType(
        [chunks.schema[k] for k in keys]
        + [T.StructField("chunk", T.LongType()), T.StructField("entry", T.DoubleType())]
    )

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        state, entries = 0.0, []
        for pieces in pdf["pieces"]:
            entries.append(state)
            state, _ = enter([(p["upper"], p["slope"], p["offset"], p["alarms"]) for p in pieces], state)
        return pdf[keys + ["chunk"]].assign(entry=entries)

    # One row per chunk: the group shrinks by the chunk size.
    return summary.groupBy(*keys).applyInPandas(follow, schema)


def levels(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    step: Column,
    h: float,
    leak: float = 1.0,
    payload: list[str] | None = None,
) -> DataFrame:
    """Level and alarm of every row, with reset after an alarm."""
    payload = payload or []
    size = limit(df.sparkSession, FOLD_ROWS)
    within = fits(df, keys, size)
    chunks = chunked(df, keys, order, step, payload, within)
    entries = None
    if not within:
        chunks = cut(chunks)
        entries = _entry_states(chunks, keys, leak, h)
    if entries is None:
        entered = chunks.withColumn("entry", F.lit(0.0))
    else:
        entered = chunks.join(entries, [*keys, "chunk"], "left").withColumn(
            "entry", F.coalesce("entry", F.lit(0.0))
        )

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def fold(steps: pd.Series, entry: pd.Series) -> pd.Series:
        return pd.Series([fold_levels(xs.tolist(), leak, h, e) for xs, e in zip(steps, entry)])

    zipped = F.arrays_zip(F.col("rows"), fold(F.col("rows._step"), F.col("entry")).alias("level"))
    out = entered.select(*keys, "chunk", F.posexplode(zipped).alias("_i", "z"))
    return out.select(
        *keys,
        (F.col("chunk") * size + F.col("_i")).alias("idx"),
        *[F.col(f"z.rows.{c}").alias(c) for c in payload],
        F.col("z.level").alias("level"),
        (F.col("z.level") > h).alias("alarm"),
    )


def geometric_grid(low: float, high: float, n: int) -> list[float]:
    ratio = math.log(high / low) / (n - 1)
    return [low * math.exp(ratio * i) for i in range(n - 1)] + [high]


def bounds(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    step: Column,
    alarms_per_10k: float,
    grid: list[float],
    leak: float = 1.0,
) -> DataFrame:
    """The smallest grid bound whose alarms on the fit series stay within budget.

    A higher bound never alarms more often, so the grid is searched by halving. Series
    of one chunk are searched inside their row; longer ones take one pass per halving.
    """
    within = fits(df, keys, limit(df.sparkSession, FOLD_ROWS))
    chunks = chunked(df, keys, order, step, [], within)
    budget = F.lit(alarms_per_10k / 10000.0)

    @F.pandas_udf(T.DoubleType())
    def search(steps: pd.Series) -> pd.Series:
        def one(xs):
            xs = xs.tolist()
            allowed = alarms_per_10k * len(xs) / 10000.0
            lo, hi = 0, len(grid) - 1
            while lo < hi:
                mid = (lo + hi) // 2
                if sum(v > grid[mid] for v in fold_levels(xs, leak, grid[mid])) <= allowed:
                    hi = mid
                else:
                    lo = mid + 1
            return grid[lo]

        return steps.map(one)

    if within:
        return chunks.select(*keys, F.size("rows").cast("long").alias("n"), search(F.col("rows._step")).alias("h"))
    chunks = cut(chunks)
    sizes = chunks.groupBy(*keys).agg(F.sum(F.size("rows")).alias("n"), F.max("chunk").alias("_last"))
    one = chunks.join(sizes.where(F.col("_last") == 0), keys).select(
        *keys, "n", search(F.col("rows._step")).alias("h")
    )
    many = sizes.where(F.col("_last") > 0)
    if many.isEmpty():
        return one
    state = many.select(*keys, "n", F.lit(0).alias("lo"), F.lit(len(grid) - 1).alias("hi"))
    long = chunks.join(many.select(*keys), keys, "left_semi")
    values = F.array(*[F.lit(g) for g in grid])
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")

    @F.pandas_udf(PIECES)
    def summarise(steps: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([
            [{"upper": u, "slope": m, "offset": o, "alarms": n} for u, m, o, n in entry_function(xs.tolist(), leak, b)]
            for xs, b in zip(steps, h)
        ])

    schema = T.StructType([chunks.schema[k] for k in keys] + [T.StructField("alarms", T.LongType())])

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        s, total = 0.0, 0
        for pieces in pdf.sort_values("chunk")["pieces"]:
            s, n = enter([(p["upper"], p["slope"], p["offset"], p["alarms"]) for p in pieces], s)
            total += n
        return pdf[keys].head(1).assign(alarms=total)

    for _ in range(math.ceil(math.log2(len(grid))) + 1):
        asked = state.withColumn("mid", middle)
        summary = long.join(asked, keys).select(
            *keys, "chunk", summarise(F.col("rows._step"), F.get(values, F.col("mid"))).alias("pieces")
        )
        alarms = summary.groupBy(*keys).applyInPandas(count, schema)
        good = F.col("alarms") <= budget * F.col("n")
        state = cut(
            asked.join(alarms, keys).select(
                *keys, "n",
                F.when(good, F.col("lo")).otherwise(F.least(F.col("mid") + 1, F.col("hi"))).alias("lo"),
                F.when(good, F.col("mid")).otherwise(F.col("hi")).alias("hi"),
            )
        )
    return one.unionByName(state.select(*keys, "n", F.get(values, F.col("lo")).alias("h")))


def trace_verdicts(flagged: DataFrame, keys: list[str]) -> DataFrame:
    """Detection, the first and all alarm positions as fractions of the trace, alarms per 10,000 windows."""
    alarms = F.sum(F.col("alarm").cast("long"))
    return flagged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("windows"),
        alarms.alias("alarms"),
        (F.min(F.when(F.col("alarm"), F.col("idx"))) / F.count(F.lit(1))).alias("first_alarm_at"),
        F.array_sort(F.collect_list(F.when(F.col("alarm"), F.col("idx")))).alias("_at"),
        (alarms * 10000.0 / F.count(F.lit(1))).alias("alarms_per_10k"),
    ).withColumn("detected", F.col("alarms") > 0).withColumn(
        "alarm_positions", F.transform("_at", lambda i: i / F.col("windows"))
    ).drop("_at")


def trace_rates(verdicts: DataFrame, by: list[str]) -> DataFrame:
    """Share of traces detected, and alarms per 10,000 windows over all of them."""
    return verdicts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("traces"), F.count_if("detected").alias("detected"),
        (F.count_if("detected") / F.count(F.lit(1))).alias("detection_rate"),
        F.sum("alarms").alias("alarms"), F.sum("windows").alias("windows"),
        (F.sum("alarms") * 10000.0 / F.sum("windows")).alias("alarms_per_10k"),
    )
