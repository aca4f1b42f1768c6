"""Ordered computations that stay balanced when one key holds most rows.

Spark's window functions put every row of a partition key into one task. The
functions here first count rows per key (map-side combined, keys only). Keys
within the limit use the plain window. Keys beyond it are cut into ordered
cells: the cell of a row is found by binary search in quantile bounds of the
order column, each cell is computed by itself, and the per-cell totals are
carried forward. The cell is a function of the row's own values, so both
branches and any recomputed task agree on it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetgrain.session import HOT_ROWS, limit, small

MAX_CELLS = 10_000
CELL = "_order_cell"
_HOT = "_order_hot"


@dataclass
class Cells:
    """Rows of hot keys carry their ordered cell number, all others cell 0."""

    frame: DataFrame
    split: bool


def _search(df: DataFrame, source: str, target: str, bounds: list[float]) -> DataFrame:
    splits = [-math.inf, *bounds, math.inf]
    return Bucketizer(
        splits=splits, inputCol=source, outputCol=target, handleInvalid="keep"
    ).transform(df)


def fits(df: DataFrame, keys: list[str], rows: int | None = None) -> bool:
    """True when no key has more rows than the limit; one job over the keys alone.

    A chain of ordered steps over the same rows asks once and passes the answer on.
    """
    bound = rows or limit(df.sparkSession, HOT_ROWS)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return counts.where(F.col("_n") > bound).isEmpty()


def cells(
    df: DataFrame, keys: list[str], order: list[Column], rows: int | None = None, within: bool | None = None
) -> Cells:
    """Add the ``_order_cell`` column; ``order`` is ascending and numeric, unique per key.

    ``within=True`` says that ``fits`` has already found every key within the limit.

    ``order[0]`` decides the cells. A value of ``order[0]`` shared by so many rows
    that it fills a cell alone gets a cell of its own, cut further by ``order[1]``.
    """
    if within:
        return Cells(df.withColumn(CELL, F.lit(0).cast("long")), False)
    bound = rows or limit(df.sparkSession, HOT_ROWS)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > bound)
    if keys:
        measured = counts.agg(F.sum("_n").alias("rows")).first()
    else:
        measured = df.agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > bound).first()
    hot_rows = (measured and measured["rows"]) or 0
    if not hot_rows:
        return Cells(df.withColumn(CELL, F.lit(0).cast("long")), False)

    # At most total/bound keys can exceed the bound, so this side is small by construction.
    if keys:
        hot = counts.select(*keys, F.lit(True).alias(_HOT))
        flagged = df.join(F.broadcast(hot), keys, "left")
    else:
        flagged = df.withColumn(_HOT, F.lit(True))
    d = flagged.withColumn("_order_1", order[0].cast("double"))
    second = order[1] if len(order) > 1 else F.lit(0)
    d = d.withColumn("_order_2", second.cast("double"))
    hot_part = d.where(F.col(_HOT))
    n = min(MAX_CELLS, max(2, math.ceil(2 * hot_rows / bound)))
    probs = [i / n for i in range(1, n)]
    cuts = hot_part.stat.approxQuantile("_order_1", probs, 1.0 / (4 * n))
    heavy = sorted({a for a, b in zip(cuts, cuts[1:]) if a == b})
    first = sorted(set(cuts) | {v for h in heavy for v in (h, math.nextafter(h, math.inf))})
    d = _search(d, "_order_1", "_order_c1", first)
    cell = F.col("_order_c1").cast("long")
    if heavy:
        tied = hot_part.where(F.col("_order_1").isin(heavy))
        ties = sorted(set(tied.stat.approxQuantile("_order_2", probs, 1.0 / (4 * n))))
        d = _search(d, "_order_2", "_order_c2", ties)
        inner = F.when(F.col("_order_1").isin(heavy), F.col("_order_c2").cast("long")).otherwise(F.lit(0))
        cell = cell * (len(ties) + 2) + inner
    d = d.withColumn(CELL, F.when(F.col(_HOT), cell).otherwise(F.lit(0)).cast("long"))
    return Cells(d.drop("_order_1", "_order_2", "_order_c1", "_order_c2", _HOT), True)


_AGGREGATE = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


def _merge(op: str, local: Column, carry: Column) -> Column:
    if op == "min":
        return F.least(local, carry)
    if op == "max":
        return F.greatest(local, carry)
    if op == "previous":
        return F.coalesce(local, carry)
    both = F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0))
    return F.when(local.isNull() & carry.isNull(), F.lit(None)).otherwise(both)


def running(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    values: dict[str, tuple[str, Column]],
    inclusive: bool = True,
    rows: int | None = None,
    within: bool | None = None,
) -> DataFrame:
    """Add running aggregates per key in ascending ``order``.

    ``values`` maps a new column to ``(op, expression)`` with op one of sum, count,
    min, max, previous (the value of the row before). ``inclusive=False`` leaves the
    row itself out.
    """
    parts = cells(df, keys, order, rows, within)
    by = [*keys, CELL] if parts.split else list(keys)
    ordered = Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order)
    frame = ordered.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)

    def local(op: str, col: Column) -> Column:
        return F.lag(col).over(ordered) if op == "previous" else _AGGREGATE[op](col).over(frame)

    if not parts.split:
        out = parts.frame.drop(CELL)
        return out.select("*", *[local(op, col).alias(n) for n, (op, col) in values.items()])

    position = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    totals = parts.frame.groupBy(*by).agg(
        *[
            (F.max_by(col, position) if op == "previous" else _AGGREGATE[op](col)).alias(n)
            for n, (op, col) in values.items()
        ]
    )
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(CELL)
    before_all = before.rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *by,
        *[
            (
                F.last(n, ignorenulls=True).over(before_all)
                if op == "previous"
                else (F.sum if op == "count" else _AGGREGATE[op])(F.col(n)).over(before_all)
            ).alias(f"_carry_{n}")
            for n, (op, _) in values.items()
        ],
    )
    here = parts.frame.select(
        "*", *[local(op, col).alias(f"_local_{n}") for n, (op, col) in values.items()]
    )
    joined = here.join(carried, by, "left")
    return joined.select(
        *df.columns,
        *[
            _merge(op, F.col(f"_local_{n}"), F.col(f"_carry_{n}")).alias(n)
            for n, (op, _) in values.items()
        ],
    )


def row_index(
    df: DataFrame, keys: list[str], order: list[Column], name: str = "idx", within: bool | None = None
) -> DataFrame:
    """Zero-based position of every row within its key."""
    out = running(df, keys, order, {name: ("count", F.lit(1))}, within=within)
    return out.withColumn(name, (F.col(name) - 1).cast("long"))


def order_statistics(
    df: DataFrame, keys: list[str], value: str, ranks: DataFrame, rank: str = "rank"
) -> DataFrame:
    """Values at given zero-based ``ranks(keys…, rank)`` of the ascending ``value``.

    Distinct values are counted first, so a value shared by many rows is one row.
    """
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    placed = running(counted, keys, [F.col(value)], {"_end": ("sum", F.col("_c"))})
    wanted = ranks.select(*keys, F.lit(0).alias("i"), F.lit(0.0).alias("at"), F.col(rank).alias("rank"))
    return _rank_join(wanted, placed, keys).select(*keys, F.col("rank").alias(rank), value)


def quantiles(
    df: DataFrame, keys: list[str], value: str, fractions: list[float], name: str = "q", within: bool | None = None
) -> DataFrame:
    """Linearly interpolated quantiles per key as one array column.

    ``percentile`` keeps a count per distinct value of a group in memory, so it only
    gets groups within the limit; larger groups are read off their running counts.
    """
    bound = limit(df.sparkSession, HOT_ROWS)
    wanted = F.array(*[F.lit(float(f)) for f in fractions])
    present = df.where(F.col(value).isNotNull())
    sizes = present.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = sizes.where(F.col("_n") > bound)
    if within or hot.isEmpty():
        return present.groupBy(*keys).agg(F.percentile(value, wanted).alias(name))
    marked = F.broadcast(hot.select(*keys))
    cold = present.join(marked, keys, "left_anti")
    large = present.join(marked, keys, "left_semi")
    plain = cold.groupBy(*keys).agg(F.percentile(value, wanted).alias(name))
    place = F.col("f.p") * (F.col("_n") - 1)
    ends = (
        hot.select(*keys, "_n", F.explode(F.array(*[
            F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p"))
            for i, p in enumerate(fractions)
        ])).alias("f"))
        .select(*keys, F.col("f.i").alias("i"), place.alias("at"))
        .select(*keys, "i", "at", F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("rank"))
    )
    counted = large.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    placed = running(counted, keys, [F.col(value)], {"_end": ("sum", F.col("_c"))})
    joined = _rank_join(ends, placed, keys)
    low, high = F.min(value), F.max(value)
    share = F.max(F.col("at") - F.floor("at"))
    exact = (
        joined.groupBy(*keys, "i").agg((low + (high - low) * share).alias("_v"))
        .groupBy(*keys)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "_v"))), lambda x: x["_v"]).alias(name))
    )
    return plain.unionByName(exact)


def _rank_join(ends: DataFrame, placed: DataFrame, keys: list[str]) -> DataFrame:
    """Pick the distinct value covering each wanted rank; ``ends`` is a few rows per key."""
    start = F.col("_end") - F.col("_c")
    per_key = ends.groupBy(*keys).agg(F.collect_set(F.struct("i", "at", "rank")).alias("_wanted"))
    both = placed.join(F.broadcast(per_key) if small(per_key) else per_key, keys)
    inside = F.filter(
        "_wanted", lambda w: (w["rank"] >= start) & (w["rank"] < F.col("_end"))
    )
    hits = both.withColumn("_hits", inside).where(F.size("_hits") > 0)
    return hits.select("*", F.explode("_hits").alias("_h")).select(
        *[c for c in placed.columns if c not in ("_end", "_c")], "_h.i", "_h.at", "_h.rank"
    )
