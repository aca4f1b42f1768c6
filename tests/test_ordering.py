"""Ordered computations: the split path must equal the plain one."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetgrain.operators import ordering


def rows(n=3000, hot=0.5, ties=0.0, seed=1):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        key = "hot" if rnd.random() < hot else f"k{rnd.randrange(20)}"
        ts = 500 if rnd.random() < ties else rnd.randrange(2000)
        out.append((key, ts, i, float(rnd.randrange(-50, 50))))
    return out


def expected(data):
    by = {}
    for key, ts, i, x in sorted(data, key=lambda r: (r[0], r[1], r[2])):
        by.setdefault(key, []).append((i, x))
    out = {}
    for key, seq in by.items():
        xs = [x for _, x in seq]
        for at, (i, x) in enumerate(seq):
            out[i] = (at, sum(xs[: at + 1]), min(xs[: at + 1]), max(xs[: at + 1]), xs[at - 1] if at else None)
    return out


@pytest.mark.parametrize("ties", [0.0, 0.7])
@pytest.mark.parametrize("bound", [10_000, 120])
def test_running_equals_loop(spark, ties, bound):
    data = rows(ties=ties)
    df = spark.createDataFrame(data, "key string, ts long, id long, x double").repartition(7)
    out = ordering.running(
        df, ["key"], [F.col("ts"), F.col("id")],
        {"n": ("count", F.lit(1)), "s": ("sum", F.col("x")), "lo": ("min", F.col("x")),
         "hi": ("max", F.col("x")), "p": ("previous", F.col("x"))},
        rows=bound,
    )
    got = {r.id: (r.n - 1, r.s, r.lo, r.hi, r.p) for r in out.collect()}
    assert got == expected(data)


def test_hot_key_is_cut_into_small_cells(spark):
    data = rows(n=5000, hot=0.9, ties=0.8)
    df = spark.createDataFrame(data, "key string, ts long, id long, x double")
    parts = ordering.cells(df, ["key"], [F.col("ts"), F.col("id")], rows=300)
    assert parts.split
    largest = parts.frame.groupBy("key", ordering.CELL).count().agg(F.max("count")).first()[0]
    assert largest <= 600


def test_exclusive_and_keyless(spark):
    df = spark.range(1000).withColumn("x", F.lit(2))
    for bound in (10_000, 100):
        out = ordering.running(df, [], [-F.col("id")], {"s": ("sum", F.col("x"))}, inclusive=False, rows=bound)
        got = {r.id: r.s for r in out.collect()}
        assert got[999] is None and got[0] == 2 * 999 and got[500] == 2 * 499


@pytest.mark.parametrize("bound", [1_000_000, 200])
def test_quantiles_match_numpy(spark, limits, bound):
    limits(hotRows=bound)
    data = rows(n=4000, hot=0.6)
    df = spark.createDataFrame(data, "key string, ts long, id long, x double")
    fractions = [0.0, 0.01, 0.5, 0.98, 0.999, 1.0]
    got = {r.key: r.q for r in ordering.quantiles(df, ["key"], "x", fractions).collect()}
    for key in {d[0] for d in data}:
        xs = np.array([d[3] for d in data if d[0] == key])
        assert np.allclose(got[key], np.quantile(xs, fractions))


def test_order_statistics(spark):
    df = spark.createDataFrame([("a", float(i // 3)) for i in range(30)], "key string, x double")
    ranks = spark.createDataFrame([("a", 0), ("a", 4), ("a", 29)], "key string, rank long")
    got = {r["rank"]: r.x for r in ordering.order_statistics(df, ["key"], "x", ranks).collect()}
    assert got == {0: 0.0, 4: 1.0, 29: 9.0}
