"""Values over the last rows before many points of a series, in chunks of bounded size.

A series is numbered in its order. A check asks for the ``most`` rows before row number ``upto``. Rows are dealt to chunks
of four times ``most`` numbers; a chunk also gets the ``most`` rows before its first, so every check is answered in one
chunk and a series of any length is many tasks. Inside a chunk the window slides from check to check: rows are added
and taken away, none is looked at again.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1024


class RankCounts:
    """Counts of distinct values with sums of blocks of them; adds, removes and finds by rank."""

    def __init__(self, values: np.ndarray):
        self.values, self.place = np.unique(values, return_inverse=True)
        self.counts = np.zeros(-(-max(1, len(self.values)) // BLOCK) * BLOCK, np.int64)
        self.blocks = np.zeros(len(self.counts) // BLOCK, np.int64)

    def change(self, lo: int, hi: int, by: int) -> None:
        """Rows ``lo`` to ``hi`` of the values come (1) or go (-1)."""
        if hi > lo:
            place = self.place[lo:hi]
            np.add.at(self.counts, place, by)
            np.add.at(self.blocks, place // BLOCK, by)

    def at(self, rank: int) -> float:
        """The value with ``rank`` smaller ones, repeats counted."""
        ends = np.cumsum(self.blocks)
        block = int(np.searchsorted(ends, rank, side="right"))
        before = ends[block - 1] if block else 0
        inner = np.cumsum(self.counts[block * BLOCK : (block + 1) * BLOCK])
        return float(self.values[block * BLOCK + int(np.searchsorted(inner, rank - before, side="right"))])


def order_values(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The values at ``ranks[k]`` (several per check, ascending from 0) of the rows ``lo[k]:hi[k]``; NaN where there are none.

    Both bounds rise from check to check.
    """
    held = RankCounts(values)
    out = np.full(ranks.shape, np.nan)
    start = end = 0
    for k in range(len(lo)):
        held.change(end, int(hi[k]), 1)
        held.change(start, int(lo[k]), -1)
        start, end = int(lo[k]), int(hi[k])
        if end > start:
            out[k] = [held.at(int(r)) for r in ranks[k]]
    return out


def bin_counts(bins: np.ndarray, lo: np.ndarray, hi: np.ndarray, width: int) -> np.ndarray:
    """How often each of ``width`` bins occurs in the rows ``lo[k]:hi[k]``."""
    upto = np.zeros((len(bins) + 1, width), np.int64)
    upto[1:] = np.cumsum(bins[:, None] == np.arange(width), axis=0)
    return upto[hi] - upto[lo]


def over_last(
    rows: DataFrame,
    checks: DataFrame,
    keys: list[str],
    most: int,
    compute: Callable[[pa.Table, np.ndarray, np.ndarray, pa.Table], list[pa.Array]],
    fields: str,
) -> DataFrame:
    """``checks(keys…, upto, …)`` with the columns ``fields`` that ``compute`` finds in the last ``most`` rows before ``upto``.

    ``rows(keys…, idx, …)`` are numbered from 0 in each series. ``compute(rows, lo, hi, checks)`` gets the rows of a
    chunk in order and, for its checks in order, the places their windows begin and end at.
    """
    wide = 4 * most
    dealt = rows.withColumn(
        "_chunk", F.explode(F.sequence(F.expr(f"idx div {wide}"), F.expr(f"(idx + {most}) div {wide}")))
    )
    asked = checks.withColumn("_chunk", F.expr(f"greatest(upto - 1, 0) div {wide}"))
    names = checks.columns

    def run(part: pa.Table, wanted: pa.Table) -> pa.Table:
        part, wanted = part.sort_by("idx"), wanted.sort_by("upto")
        first = part["idx"][0].as_py() if len(part) else 0
        hi = wanted["upto"].to_numpy() - first
        lo = np.maximum(hi - most, -first)
        # Without rows, every window is empty.
        hi, lo = np.minimum(hi, len(part)), np.clip(lo, 0, len(part))
        out = wanted.select(names)
        for name, column in zip(made, compute(part, lo, hi, wanted), strict=True):
            out = out.append_column(name, column)
        return out

    made = [f.split()[0] for f in fields.split(", ")]
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in checks.schema]
    by = [*keys, "_chunk"]
    return dealt.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(run, ", ".join([*kinds, fields]))
