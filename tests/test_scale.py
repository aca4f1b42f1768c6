"""Steps that must sum or cut their rows inside tasks, next to plain versions of themselves."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from packetgrain.operators import match, ngram, scoring, windows
from packetgrain.plans import byte_streams, capture
from packetgrain.streaming import chain

FOLDER = "/root/testdata/sf0.001"


def pieces(spark):
    texts = ["abcabcabcabc" * 9, "abcdabcd", "xyz", "abd" * 40]
    return spark.createDataFrame([(i, bytearray(t.encode())) for i, t in enumerate(texts)], "k long, bytes binary")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_heatmap_sums_are_those_of_its_cells(spark):
    rows = pieces(spark)
    model = ngram.train(rows.where("k < 2"))
    bits = ngram.bits_arrays(rows.withColumn("shown", windows.bytes_array("bytes", 128)), model, ["shown"])
    cells = bits.select(F.explode(scoring.heatmap(F.col("bits"), F.slice("shown", 3, 128), 8)).alias("c"))
    want = cells.groupBy("c.row", "c.column").agg(F.count(F.lit(1)), F.round(F.avg("c.intensity"), 9), F.sum("c.byte"))
    got = ngram.heatmap_sums(rows, model, 8).withColumn("intensity", F.round("intensity", 9))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    # Cells are summed in the tasks; the only rows made from one are the windows of a document.
    assert plan(byte_streams.heatmap_cells(spark, FOLDER)).count("Generate") == 1


def test_entropy_counts_a_bounded_number_of_bytes_at_once(spark, monkeypatch):
    """parts of a batch give what the whole batch gives, empty and long rows included."""
    parts = [b"", b"ab" * 700_000, b"abcd", bytes(range(256)) * 9000, *[b"x%d" % i for i in range(5000)], b""]
    held = []
    whole = windows._entropy

    def seen(some):
        held.append(max(sum(map(len, some)), 256 * len(some)))
        return whole(some)

    monkeypatch.setattr(windows, "_entropy", seen)
    got = windows.byte_entropy.func(pd.Series(parts)).to_numpy()
    assert np.array_equal(got, whole(parts))
    assert sorted(held)[-3] <= windows.ENTROPY_BYTES and max(held) <= len(parts[3]) + windows.ENTROPY_BYTES


def test_scores_of_a_batch_are_those_of_its_arrays(spark):
    """mean, max and topk in the tasks, as the columns over arrays of bits have them."""
    rnd = np.random.default_rng(5)
    bits = [rnd.uniform(0, 9, n) for n in (0, 1, 3, 40, 64)] + [np.array([np.nan, 2.0, np.nan]), np.array([np.nan])]
    got = scoring.window_scores(bits, 64)
    rows = spark.createDataFrame([(i, [float(v) for v in b]) for i, b in enumerate(bits)], "i long, bits array<double>")
    want = rows.orderBy("i").select(*[scoring.window_score(F.col("bits"), how, 64).alias(how) for how in got.columns]).collect()
    for r, w in zip(got.itertuples(index=False), want):
        assert [None if np.isnan(v) else round(v, 9) for v in r] == [None if v is None else round(v, 9) for v in w]
    assert "aggregate(" not in plan(byte_streams.window_aggregates(spark, FOLDER))


def test_codes_are_counted_in_pieces(spark, monkeypatch):
    """counts of pieces are those of the batch."""
    buffers = [b"abcabcabc", b"", b"abcd", b"bcabc"] * 5
    want = ngram._counted(buffers, 2)
    monkeypatch.setattr(ngram, "PIECE", 3)
    got = ngram._counted(buffers, 2)
    assert all(np.array_equal(a, b) for a, b in zip(got, want))


def test_labels_look_up_ends_of_spans_not_packets(spark, limits, monkeypatch):
    """blocks are asked for the two ends of a span only; packets of any number pass in order."""
    limits(hotRows=50)
    rnd = np.random.default_rng(3)
    rows = [(f"a{i % 3}", i % 2, "b", 0, "tcp", int(t), i) for i, t in enumerate(rnd.integers(0, 400, 600))]
    rows += [(None, None, None, None, None, 7, 600), ("a0", None, None, None, None, 9, 601)]
    packets = spark.createDataFrame(rows, "srcip string, sport long, dstip string, dsport long, proto string, t long, id long")
    spans = [("a0", 0, "b", 0, "tcp", 50, 200, "x", 2), ("b", 0, "a0", 0, "tcp", 100, 120, "y", 1), ("a1", 1, "b", 0, "tcp", 10, 12, "z", 3)]
    flows = spark.createDataFrame(spans, "srcip string, sport long, dstip string, dsport long, proto string, stime long, ltime long, cat string, ordinal long")
    asked, hits = [], match._time_hits

    def seen(points, *more):
        asked.append(points.count())
        return hits(points, *more)

    monkeypatch.setattr(match, "_time_hits", seen)
    got = match.label_packets(packets.withColumn("c", F.lit("c")), flows, ["c"], "strict").collect()
    # Two ends of three spans for host pairs, and in both directions for 5-tuples.
    assert sorted(asked) == [6, 12]

    def first(covers):
        return min(((o, c) for s, p, d, q, _, lo, hi, c, o in spans if covers(s, p, d, q, lo - 1, hi + 1)), default=(0, None))[1]

    wanted = {}
    for src, sport, dst, dport, _, t, i in rows:
        five = first(lambda s, p, d, q, lo, hi: lo <= t <= hi and (src, sport, dst, dport) in ((s, p, d, q), (d, q, s, p)))
        pair = first(lambda s, p, d, q, lo, hi: lo <= t <= hi and {src, dst} == {s, d})
        # The first flow of the pair a0, b is that of ordinal 1.
        wanted[i] = five or pair or {"a0": "y", "a1": "z"}.get(src) or (dst and "y")
    assert {r.id: r.cat for r in got} == wanted and len(got) == 602


def test_chain_parses_and_masks_frames_once(spark, monkeypatch):
    """what Python made of the frames is written, and no later step makes it again."""
    plans, cut = [], chain.cut

    def seen(df):
        plans.append(plan(df))
        return cut(df)

    monkeypatch.setattr(chain, "cut", seen)
    monkeypatch.setattr(windows, "cut", seen)
    capture.capture_to_records(spark, FOLDER)
    for made in ("_headers(", "_mask_full(", "byte_entropy("):
        assert sum(made in p for p in plans) == 1
