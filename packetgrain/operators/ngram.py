"""n-gram byte model: training, surprise in bits, and window scores.

Contexts never cross a window edge. A (context, byte) pair of order K is one long,
``context * 256 + byte``, so counting and lookup group on a fixed-width key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetgrain.operators.scoring import window_scores
from packetgrain.session import MODEL_ROWS, cut, limit

ALPHA = 0.1
MAX_ORDER = 6


def _codes(buffers: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all positions that have a full context, with row number and position."""
    lengths = np.fromiter((len(b) for b in buffers), np.int64, len(buffers))
    flat = np.frombuffer(b"".join(buffers), np.uint8).astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    rows = np.repeat(np.arange(len(buffers)), lengths)
    pos = np.arange(len(flat)) - starts[rows] if len(flat) else np.zeros(0, np.int64)
    code = np.zeros(len(flat), np.int64)
    for back in range(order, -1, -1):
        shifted = np.zeros(len(flat), np.int64)
        if back:
            shifted[back:] = flat[:-back] if back < len(flat) else 0
        else:
            shifted = flat
        code = code * 256 + shifted
    full = pos >= order
    return code[full], rows[full], pos[full]


# Windows worked on at once; an Arrow batch may have more.
PIECE = 1024


def _counted(buffers: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and how often they stand there; one piece's positions at a time are held."""
    found = [np.unique(_codes(buffers[at:at + PIECE], order)[0], return_counts=True) for at in range(0, len(buffers), PIECE)]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code, back = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
    n = np.zeros(len(code), np.int64)
    np.add.at(n, back, np.concatenate([n for _, n in found]))
    return code, n


def train(windows: DataFrame, order: int = 3, data: str = "bytes") -> DataFrame:
    """M1: counts per (ctx, byte). Every batch is counted before anything is shuffled."""
    if order > MAX_ORDER:
        raise ValueError(f"order must be at most {MAX_ORDER}")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            code, n = _counted([b for b in pdf[data] if b is not None], order)
            yield pd.DataFrame({"code": code, "n": n})

    partial = windows.select(data).mapInPandas(count, "code long, n long")
    counts = partial.groupBy("code").agg(F.sum("n").alias("n"))
    return counts.select(
        F.shiftright("code", 8).alias("ctx"),
        F.col("code").bitwiseAND(255).cast("int").alias("byte"),
        "n",
    )


def totals(model: DataFrame) -> DataFrame:
    """Occurrences of each context; the row count is the model's context count."""
    return model.groupBy("ctx").agg(F.sum("n").alias("total"))


def surprise_table(model: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Bits of every trained (ctx, byte) and of a byte the context never showed."""
    joined = model.join(totals(model), "ctx")
    denominator = F.col("total") + 256 * alpha
    return joined.select(
        "ctx",
        (F.col("ctx") * 256 + F.col("byte")).alias("code"),
        (-F.log2((F.col("n") + alpha) / denominator)).alias("bits"),
        (-F.log2(F.lit(alpha) / denominator)).alias("unseen_bits"),
    )


class Lookup:
    """Sorted arrays of a model that fits the broadcast bound."""

    def __init__(self, code, bits, ctx, unseen):
        self.code, self.bits, self.ctx, self.unseen = code, bits, ctx, unseen

    def __call__(self, code: np.ndarray) -> np.ndarray:
        out = np.full(len(code), 8.0)
        if not len(self.code):
            return out
        wanted, back = np.unique(code, return_inverse=True)
        res = np.full(len(wanted), 8.0)
        c = wanted >> 8
        at = np.minimum(np.searchsorted(self.ctx, c), len(self.ctx) - 1)
        known = self.ctx[at] == c
        res[known] = self.unseen[at[known]]
        at = np.minimum(np.searchsorted(self.code, wanted), len(self.code) - 1)
        seen = self.code[at] == wanted
        res[seen] = self.bits[at[seen]]
        return res[back]


def lookup(model: DataFrame, alpha: float = ALPHA) -> Lookup | None:
    """The model as arrays, or None when it is larger than may be broadcast."""
    bound = limit(model.sparkSession, MODEL_ROWS)
    table = surprise_table(model, alpha)
    # Reading one row past the bound both measures the model and fetches a small one.
    got = table.limit(bound + 1).toPandas()
    if len(got) > bound:
        return None
    got = got.sort_values("code")
    per_ctx = got.drop_duplicates("ctx")
    return Lookup(
        got["code"].to_numpy(np.int64),
        got["bits"].to_numpy(float),
        per_ctx["ctx"].to_numpy(np.int64),
        per_ctx["unseen_bits"].to_numpy(float),
    )


def _top_mean(bits: np.ndarray, rows: np.ndarray, pos: np.ndarray, n: int, frac: float) -> np.ndarray:
    """Mean of the highest k bits of every row, k = max(1, round-half-even(frac * count))."""
    counts = np.bincount(rows, minlength=n)
    k = np.maximum(1, np.rint(frac * counts)).astype(np.int64)
    grid = np.full((n, int(pos.max()) + 1 if len(pos) else 1), -np.inf)
    grid[rows, pos] = bits
    out = np.full(n, np.nan)
    for size in np.unique(k):
        take = np.flatnonzero((k == size) & (counts > 0))
        if len(take):
            out[take] = np.partition(grid[take], -size, axis=1)[:, -size:].mean(axis=1)
    return out


# Windows of one block: what they ask a large model for is asked once.
BLOCK_BITS = 12


def context_rows(model: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """The model by context: ctx, unseen_bits, and the bytes it showed with their bits; at most 256 each."""
    table = surprise_table(model, alpha)
    shown = F.array_sort(F.collect_list(F.struct(F.col("code").bitwiseAND(255).cast("int").alias("byte"), "bits"))).alias("s")
    return table.groupBy("ctx").agg(F.max("unseen_bits").alias("unseen_bits"), shown).select(
        "ctx", "unseen_bits", F.col("s.byte").alias("bytes"), F.col("s.bits").alias("bits")
    )


def _bits_by_context(wanted: DataFrame, contexts: DataFrame) -> DataFrame:
    """The bits of codes that blocks ask for, by one join on the context."""
    place = F.array_position("bytes", F.col("code").bitwiseAND(255).cast("int"))
    shown = F.when(place > 0, F.get("bits", (place - 1).cast("int")))
    asked = wanted.withColumn("ctx", F.shiftright("code", 8))
    return asked.join(contexts, "ctx", "left").select(
        "_block", "code", F.coalesce(shown, "unseen_bits", F.lit(8.0)).alias("value")
    )


Answer = Callable[[np.ndarray], np.ndarray]


def _by_blocks(
    windows: DataFrame,
    order: int,
    data: str,
    answer: Callable[[DataFrame], DataFrame],
    work: Callable[[pd.DataFrame, Answer], pd.DataFrame],
    schema: T.StructType | str,
) -> DataFrame:
    """``work`` on every window with the values of its codes, for tables of any size.

    Windows are numbered in blocks as they are stored. A block's distinct codes are what is shuffled;
    ``answer`` gives them values, and each block meets its own dictionary once. The values and the work on
    them are those of a broadcast table.
    """
    stored = cut(windows.withColumn("_block", F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS)))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for block, part in pdf.groupby("_block", sort=False):
                code, _, _ = _codes([b or b"" for b in part[data]], order)
                yield pd.DataFrame({"_block": block, "code": np.unique(code)})

    wanted = stored.select("_block", data).mapInPandas(ask, "_block long, code long").distinct()

    def join(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        place = np.argsort(found["code"].to_numpy())
        codes, values = found["code"].to_numpy()[place], found["value"].to_numpy()[place]
        return work(rows.drop(columns="_block"), lambda code: values[np.searchsorted(codes, code)])

    return stored.groupBy("_block").cogroup(answer(wanted).groupBy("_block")).applyInPandas(join, schema)


def _scores(pdf: pd.DataFrame, bits_of: Answer, order: int, topk_frac: float, data: str) -> pd.DataFrame:
    buffers = [b or b"" for b in pdf[data]]
    code, rows, pos = _codes(buffers, order)
    bits = bits_of(code)
    n = len(buffers)
    counts = np.bincount(rows, minlength=n)
    out = pdf.drop(columns=data)
    out["mean_bits"] = np.bincount(rows, weights=bits, minlength=n) / np.maximum(counts, 1)
    peak = np.full(n, -np.inf)
    np.maximum.at(peak, rows, bits)
    out["max_bits"] = peak
    out["topk_bits"] = _top_mean(bits, rows, pos - order, n, topk_frac)
    return out[counts > 0]


def map_bits(
    windows: DataFrame,
    model: DataFrame,
    work: Callable[[pd.DataFrame, Answer], pd.DataFrame],
    schema: T.StructType | str,
    order: int = 3,
    alpha: float = ALPHA,
    data: str = "bytes",
) -> DataFrame:
    """``work`` on pieces of batches, with the bits of their codes.

    A model within the bound is broadcast and this is map-only. For a larger one see ``_by_blocks``.
    """
    found = lookup(model, alpha)
    if found is None:
        contexts = context_rows(model, alpha)
        return _by_blocks(windows, order, data, lambda wanted: _bits_by_context(wanted, contexts), work, schema)
    shared = windows.sparkSession.sparkContext.broadcast((found.code, found.bits, found.ctx, found.unseen))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits_of = Lookup(*shared.value)
        for pdf in batches:
            for at in range(0, len(pdf), PIECE):
                yield work(pdf.iloc[at:at + PIECE], bits_of)

    return windows.mapInPandas(run, schema)


def heatmap_sums(
    windows: DataFrame, model: DataFrame, columns: int = 32, order: int = 3, alpha: float = ALPHA, data: str = "bytes"
) -> DataFrame:
    """M19 over all windows: positions, mean intensity and sum of bytes per grid cell of ``scoring.heatmap``.

    Every piece is summed before anything is shuffled.
    """

    def work(pdf: pd.DataFrame, bits_of: Answer) -> pd.DataFrame:
        code, _, pos = _codes([b or b"" for b in pdf[data]], order)
        at = pos - order
        n = np.bincount(at)
        shown = np.flatnonzero(n)
        intensity = np.bincount(at, weights=np.clip(bits_of(code) / 8.0, 0.0, 1.0))
        return pd.DataFrame({
            "row": shown // columns, "column": shown % columns, "n": n[shown], "total": intensity[shown],
            "bytes": np.bincount(at, weights=code & 255)[shown].astype(np.int64),
        })

    sums = map_bits(windows.select(data), model, work, "row long, column long, n long, total double, bytes long", order, alpha, data)
    return sums.groupBy("row", "column").agg(
        F.sum("n").alias("cells"), (F.sum("total") / F.sum("n")).alias("intensity"), F.sum("bytes").alias("byte_sum")
    )


def score_windows(
    windows: DataFrame,
    model: DataFrame,
    order: int = 3,
    topk_frac: float = 0.1,
    alpha: float = ALPHA,
    data: str = "bytes",
) -> DataFrame:
    """M2/M3: add mean, max and top-k surprise per window; too short windows are dropped."""
    schema = T.StructType(
        [f for f in windows.schema.fields if f.name != data]
        + [T.StructField(n, T.DoubleType()) for n in ("mean_bits", "max_bits", "topk_bits")]
    )
    return map_bits(
        windows, model, lambda pdf, bits_of: _scores(pdf, bits_of, order, topk_frac, data), schema, order, alpha, data
    )


def context_entropy(model: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Entropy in bits of each context's next byte, unseen bytes included."""
    joined = model.join(totals(model), "ctx")
    denominator = F.col("total") + 256 * alpha
    p = (F.col("n") + alpha) / denominator
    per = joined.groupBy("ctx").agg(
        F.sum(-p * F.log2(p + 1e-9)).alias("seen"),
        F.count(F.lit(1)).alias("kinds"),
        F.max(F.lit(alpha) / denominator).alias("rest"),
    )
    return per.select(
        "ctx", (F.col("seen") - (256 - F.col("kinds")) * F.col("rest") * F.log2(F.col("rest") + 1e-9)).alias("entropy")
    )


def spikes(
    windows: DataFrame,
    model: DataFrame,
    keys: list[str],
    threshold: float = 5.0,
    order: int = 3,
    alpha: float = ALPHA,
    data: str = "bytes",
) -> DataFrame:
    """Per position, whether the next byte's entropy after it exceeds the threshold.

    Positions without a full context do not spike; a context the model never saw is
    uniform and has 8 bits.
    """
    table = context_entropy(model, alpha).select("ctx", (F.col("entropy") > threshold).alias("high"))
    bound = limit(windows.sparkSession, MODEL_ROWS)
    schema = T.StructType(
        [windows.schema[k] for k in keys] + [T.StructField("spikes", T.ArrayType(T.BooleanType()))]
    )

    def marks(pdf: pd.DataFrame, high_of: Answer) -> pd.DataFrame:
        buffers = [b or b"" for b in pdf[data]]
        ctx, rows, pos = _codes(buffers, order - 1)
        lengths = [len(b) for b in buffers]
        grid = np.zeros((len(buffers), max(lengths, default=1)), bool)
        grid[rows, pos] = high_of(ctx)
        return pdf[keys].assign(spikes=[grid[i, :n] for i, n in enumerate(lengths)])

    got = table.limit(bound + 1).toPandas()
    if len(got) > bound:
        def answer(wanted: DataFrame) -> DataFrame:
            joined = wanted.join(table.withColumnRenamed("ctx", "code"), "code", "left")
            return joined.select("_block", "code", F.coalesce("high", F.lit(8.0 > threshold)).alias("value"))

        return _by_blocks(windows.select(*keys, data), order - 1, data, answer, marks, schema)
    got = got.sort_values("ctx")
    shared = windows.sparkSession.sparkContext.broadcast(
        (got["ctx"].to_numpy(np.int64), got["high"].to_numpy(bool))
    )

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, high = shared.value

        def high_of(ctx: np.ndarray) -> np.ndarray:
            if not len(known):
                return np.full(len(ctx), 8.0 > threshold)
            at = np.minimum(np.searchsorted(known, ctx), len(known) - 1)
            return np.where(known[at] == ctx, high[at], 8.0 > threshold)

        for pdf in batches:
            yield marks(pdf, high_of)

    return windows.select(*keys, data).mapInPandas(mark, schema)


def position_bits(
    windows: DataFrame, model: DataFrame, keys: list[str], order: int = 3, alpha: float = ALPHA, data: str = "bytes"
) -> DataFrame:
    """Bits per (keys, distinct code) with the number of positions.

    Codes are counted per key before the join, so a frequent code is a single row there.
    """
    kept = [windows.schema[k] for k in keys]
    schema = T.StructType(kept + [T.StructField("code", T.LongType()), T.StructField("n", T.LongType())])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            # A key is a data set, so a batch has few.
            for _, part in pdf.groupby(keys, dropna=False, sort=False):
                code, n = _counted([b or b"" for b in part[data]], order)
                head = part[keys].iloc[np.zeros(len(code), np.int64)].reset_index(drop=True)
                yield head.assign(code=code, n=n)

    counted = windows.select(*keys, data).mapInPandas(count, schema)
    counted = counted.groupBy(*keys, "code").agg(F.sum("n").alias("n"))
    # A key is a data set here, so it stands for the block that asks.
    marked = counted.withColumn("_block", F.struct(*keys))
    answered = _bits_by_context(marked.select("_block", "code"), context_rows(model, alpha))
    return marked.join(answered, ["_block", "code"]).select(*keys, "code", "n", F.col("value").alias("bits"))


def bits_arrays(
    windows: DataFrame, model: DataFrame, keys: list[str], order: int = 3, alpha: float = ALPHA, data: str = "bytes"
) -> DataFrame:
    """Bits of every predicted byte of a window as an array, in byte order."""
    schema = T.StructType([windows.schema[k] for k in keys] + [T.StructField("bits", T.ArrayType(T.DoubleType()))])
    return map_bits(
        windows.select(*dict.fromkeys([*keys, data])), model,
        lambda pdf, bits_of: pdf[keys].assign(bits=_arrays([b or b"" for b in pdf[data]], bits_of, order)), schema, order, alpha, data
    )


def _arrays(buffers: list[bytes], bits_of: Answer, order: int) -> list[np.ndarray]:
    code, rows, _ = _codes(buffers, order)
    ends = np.bincount(rows, minlength=len(buffers)).cumsum()
    return np.split(bits_of(code), ends[:-1])


def width_scores(
    windows: DataFrame, model: DataFrame, width: int, keys: list[str], order: int = 3, alpha: float = ALPHA, data: str = "bytes"
) -> DataFrame:
    """M4 on the model's bits: mean, max and topk of every window, k taken of ``width``; without a scored byte no row."""
    schema = T.StructType([windows.schema[k] for k in keys] + [T.StructField(n, T.DoubleType()) for n in ("mean", "max", "topk")])

    def work(pdf: pd.DataFrame, bits_of: Answer) -> pd.DataFrame:
        got = window_scores(_arrays([b or b"" for b in pdf[data]], bits_of, order), width)
        return pd.concat([pdf[keys].reset_index(drop=True), got], axis=1)[got["mean"].notna()]

    return map_bits(windows.select(*keys, data), model, work, schema, order, alpha, data)
