"""CUSUM, rate, incidents and bans against plain loops and known vectors."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetgrain.functions.text import fixed_all
from packetgrain.operators import calibrate, cusum, incidents, leaderboard, match, rate, scoring, trailing, windows


def series(seed, n=900):
    rnd = random.Random(seed)
    return [rnd.gauss(0.1, 1.5) for _ in range(n)]


def loop(xs, leak, h):
    s, out = 0.0, []
    for d in xs:
        s = max(0.0, leak * s + d)
        out.append(s)
        s = 0.0 if s > h else s
    return out


@pytest.mark.parametrize("leak", [1.0, 0.98])
@pytest.mark.parametrize("chunk", [100_000, 70])
def test_levels_equal_the_loop(spark, limits, leak, chunk):
    limits(foldRows=chunk, hotRows=10 * chunk)
    data = [("a", i, x) for i, x in enumerate(series(1))] + [("b", i, x) for i, x in enumerate(series(2, 40))]
    df = spark.createDataFrame(data, "key string, i long, x double").repartition(5)
    out = cusum.levels(df, ["key"], [F.col("i")], F.col("x"), 6.0, leak, ["i"]).collect()
    for key, xs in (("a", series(1)), ("b", series(2, 40))):
        want = loop(xs, leak, 6.0)
        got = {r.i: (r.level, r.alarm) for r in out if r.key == key}
        assert len(got) == len(want)
        for i, level in enumerate(want):
            assert got[i][0] == pytest.approx(level, abs=1e-9)
            assert got[i][1] == (level > 6.0)


@pytest.mark.parametrize("chunk", [100_000, 64])
def test_bounds_equal_the_scan(spark, limits, chunk):
    limits(foldRows=chunk)
    grid = cusum.geometric_grid(1.0, 40.0, 25)
    data = [("a", i, x) for i, x in enumerate(series(3))] + [("b", i, x) for i, x in enumerate(series(4, 50))]
    df = spark.createDataFrame(data, "key string, i long, x double")
    got = {r.key: r.h for r in cusum.bounds(df, ["key"], [F.col("i")], F.col("x"), 100.0, grid).collect()}
    for key, xs in (("a", series(3)), ("b", series(4, 50))):
        fits = [h for h in grid if sum(v > h for v in loop(xs, 1.0, h)) <= 100.0 * len(xs) / 10000]
        assert got[key] == pytest.approx(fits[0] if fits else grid[-1])


def test_target_cusum_vector(spark):
    df = spark.createDataFrame([("t", i, 8.0) for i in range(4)], "key string, i long, x double")
    out = cusum.levels(df, ["key"], [F.col("i")], F.col("x") - 5.0, 10.0, 1.0, ["i"]).orderBy("i").collect()
    assert [r.level for r in out] == [3.0, 6.0, 9.0, 12.0]
    assert [r.alarm for r in out] == [False, False, False, True]


def test_closed_form_path(spark):
    xs = series(5, 300)
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(xs)], "key string, i long, x double")
    got = cusum.path(df, ["key"], [F.col("i")], F.col("x")).orderBy("i").collect()
    assert [r.level for r in got] == pytest.approx(loop(xs, 1.0, float("inf")), abs=1e-9)


def syns(spark, groups):
    data, i = [], 0
    for src, times in groups.items():
        for t in times:
            data.append((src, t, i))
            i += 1
    return spark.createDataFrame(data, "src string, ts_us long, packet_index long")


def test_flood_starts_at_the_51st_syn(spark):
    df = syns(spark, {"a": [i * 1000 for i in range(50)], "b": [i * 1000 for i in range(51)], "c": [0]})
    got = {r.src: r.n for r in rate.syn_floods(df, ["src"]).groupBy("src").agg(F.sum(F.col("flood").cast("int")).alias("n")).collect()}
    assert got == {"a": 0, "b": 1, "c": 0}


def test_flood_span_includes_its_edge_and_ties_count_in_order(spark):
    df = syns(spark, {"a": [0, 0, 1_000_000, 1_000_001]})
    got = [r.syns for r in rate.syn_floods(df, ["src"]).orderBy("packet_index").collect()]
    assert got == [1, 2, 3, 2]


def test_alert_gates(spark):
    rows = [(10.0, 12.0, None), (13.5, 12.0, None), (16.0, 12.0, None), (20.0, 12.0, 18.0), (17.0, 12.0, 18.0), (16.0, 20.0, 15.0)]
    df = spark.createDataFrame(rows, "s double, t double, g double")
    got = [r.x for r in df.select(incidents.gate_types(F.col("s"), F.col("t"), F.col("g")).alias("x")).collect()]
    assert got == [[], ["BYTE"], ["BYTE", "CRITICAL_BYTE"], ["BYTE", "CRITICAL_BYTE"], ["BYTE"], ["CRITICAL_BYTE"]]


def test_incident_gap_is_strict(spark):
    times = [0, 60_000_000, 120_000_001, 120_000_002]
    df = spark.createDataFrame([("BYTE", t, i, float(i)) for i, t in enumerate(times)], "type string, ts_us long, alert_id long, score double")
    got = incidents.incidents(df, ["type"]).orderBy("first_us").collect()
    assert [(r.first_us, r.last_us, r.raw_alerts, r.peak_score) for r in got] == [
        (0, 60_000_000, 2, 1.0), (120_000_001, 120_000_002, 2, 3.0)
    ]


def test_capture_gap_vector(spark):
    df = spark.createDataFrame([(0,), (42_000_000,)], "ts_us long")
    got = incidents.capture_gaps(df, [], 30_000_000).collect()
    assert [(r.type, r.peak_score, r.gap_seconds) for r in got] == [("CAPTURE_GAP", 0.0, 42)]


def test_bans(spark):
    s = 1_000_000
    rows = [("1.1.1.1", 0), ("1.1.1.1", 899 * s), ("1.1.1.1", 900 * s), ("127.0.0.1", 5), ("0.0.0.0", 5), ("::1", 5)]
    df = spark.createDataFrame([(ip, t, i, f"r{i}", "BYTE") for i, (ip, t) in enumerate(rows)], "ip string, ts_us long, tie long, reason string, type string")
    got = incidents.ban_episodes(df).orderBy("banned_at").collect()
    assert [(r.ip, r.banned_at, r["count"], r.reason) for r in got] == [("1.1.1.1", 0, 2, "r1"), ("1.1.1.1", 900 * s, 1, "r2")]
    live = incidents.active_bans(df, F.lit(1000 * s)).collect()
    assert [(r.banned_at, r.remaining_secs) for r in live] == [(900 * s, 800.0)]
    early = incidents.active_bans(df, F.lit(100 * s)).collect()
    assert [(r.banned_at, r["count"], r.reason, r.last_seen) for r in early] == [(0, 1, "r0", 0)]


def test_bans_with_lengths_of_their_own(spark):
    s = 1_000_000
    rows = [("1.1.1.1", 0, 0, "a", "BYTE", 10 * s), ("1.1.1.1", 5 * s, 1, "b", "RATE", 2000 * s),
            ("1.1.1.1", 1900 * s, 2, "c", "BYTE", None), ("1.1.1.1", 2000 * s, 3, "d", "BYTE", 10 * s),
            ("1.1.1.1", 2010 * s, 4, "e", "BYTE", 10 * s)]
    df = spark.createDataFrame(rows, "ip string, ts_us long, tie long, reason string, type string, ttl_us long")
    got = incidents.ban_episodes(df).orderBy("banned_at").collect()
    assert [(r.banned_at // s, r.ttl // s, r["count"], r.reason) for r in got] == [
        (0, 2000, 3, "c"), (2000, 10, 1, "d"), (2010, 10, 1, "e")
    ]


@pytest.mark.parametrize(("fit", "budget", "want"), [
    ([], 5.0, 1.0), ([7, 7, 9], 5.0, 9.0), ([7, 7, 9], 3400.0, 7.0), ([7, 7, 9], 10_000.0, 1.0), ([1, 1], 0.0, 1.0)])
def test_rate_threshold_is_the_smallest_within_budget(spark, fit, budget, want):
    every = spark.createDataFrame([("x", v) for v in [*fit, 60]], "capture string, score long")
    some = spark.createDataFrame([("x", v) for v in fit], "capture string, score long")
    got = rate.rate_threshold(some, every, ["capture"], budget).collect()
    assert [(r.capture, r.threshold) for r in got] == [("x", want)]


def test_benign_hours_follow_the_lead(spark):
    hour = 3_600_000_000
    spans = spark.createDataFrame([(10 * hour, 11 * hour)], "lo_us long, hi_us long")
    end = spark.createDataFrame([(20 * hour,)], "span_end_us long")
    for lead in (0, 1, 2):
        assert match.benign_hours(spans, end, lead * hour).first().benign_hours == pytest.approx(9 + lead)


def test_eve_record_vector(spark):
    df = spark.createDataFrame(
        [("CRITICAL_BYTE", 14.25, "192.168.1.100 -> 10.0.0.1", "TCP/80", 27.5, "m", 0, 99)],
        "type string, score double, talker string, port string, cusum_level double, message string, ts_us long, score_percentile int",
    )
    r = incidents.eve_records(df, "P", "C", "D").first().record
    assert (r.src_ip, r.dest_ip, r.dest_port, r.proto) == ("192.168.1.100", "10.0.0.1", 80, "TCP")
    assert (r.alert.severity, r.alert.signature_id, r.alert.metadata.cusum_level) == (1, 900001, 27.5)
    assert r.timestamp == "1970-01-01T00:00:00.000+0000"
    line = incidents.syslog_lines(
        spark.createDataFrame([("SLOW_DISTRIBUTED", 28.5, "m", 0)], "type string, score double, message string, ts_us long"), "h", "p"
    ).first().line
    assert "[SLOW_DISTRIBUTED score=28.50]" in line and line.startswith("<132>1 ")


def test_half_split_vectors(spark):
    data = [("a", i) for i in range(4)] + [("b", i) for i in range(3)] + [("c", 0)]
    df = spark.createDataFrame(data, "key string, i long")
    got = windows.half_split(df, ["key"], [F.col("i")]).where("part = 'calibration'").collect()
    assert sorted((r.key, r.i) for r in got) == [("a", 0), ("a", 1), ("b", 0)]


def test_evt_formula_and_fit(spark):
    f = calibrate.evt_threshold(F.lit(12.0664), F.lit(-0.1611), F.lit(0.3173), F.lit(13614), F.lit(273), 0.01)
    assert spark.range(1).select(f.alias("t")).first().t == pytest.approx(12.2752, abs=1e-3)
    rnd = random.Random(7)
    data = [("s", 10 + rnd.expovariate(1.0)) for _ in range(20000)]
    df = spark.createDataFrame(data, "sensor string, score double")
    r = calibrate.evt_thresholds(df, ["sensor"], 0.001).first()
    assert r.num_tail_points == 400 and abs(r.gpd_shape) < 0.25
    over = sum(x > r.threshold for _, x in data) / len(data)
    assert 0.0003 < over < 0.003


def test_psi_counts_empty_bins_and_needs_samples(spark):
    fitted = spark.createDataFrame([("s", [float(i) for i in range(101)])], "sensor string, score_quantiles array<double>")
    live = spark.createDataFrame([("s", 5.0)] * 100, "sensor string, score double")
    r = calibrate.psi(live, fitted, ["sensor"]).first()
    import math
    want = (1.0 - 0.1) * math.log(10) + 9 * (1e-4 - 0.1) * math.log(1e-3)
    assert r.psi == pytest.approx(want) and r.drift_flag
    assert calibrate.psi(live.limit(99), fitted, ["sensor"]).first().psi is None


QUARTER = 900_000_000
FITTED = "sensor string, byte_threshold double, budget_quantile double, score_quantiles array<double>"
LIVE = "sensor string, ts_us long, event_id long, score double, flagged boolean"


def replay(rows, threshold, quantile, quantiles, how):
    """The recalibrator over one sensor's rows in order, with plain lists."""
    t, at, r, ar = threshold, threshold, quantiles[int(how.ref_pct)], quantiles[int(how.ref_pct)]
    out, sample, recent = [], [], []
    buckets = sorted({x[0] // how.interval_us for x in rows})
    for b in buckets:
        for ts, score, flagged in rows:
            if ts // how.interval_us == b:
                recent.append((ts, score))
                if not flagged:
                    sample.append(score)
        end = (b + 1) * how.interval_us
        start = end // how.digest_us * how.digest_us
        seen = [x for ts, x in recent if start <= ts][-how.recent :]
        psi = None
        if len(seen) >= 100 and end != start:
            bins = [0] * 10
            for x in seen:
                bins[min(9, max(0, sum(e <= x for e in quantiles[::10]) - 1))] += 1
            psi = sum((max(c / len(seen), 1e-4) - 0.1) * math.log(max(c / len(seen), 1e-4) / 0.1) for c in bins)
        last = sorted(sample[-how.trailing :])
        n = len(last)
        use = n >= how.min_samples and (psi is None or psi <= how.max_psi)
        if use:
            pick = lambda q: last[min(n - 1, max(0, round(q * (n - 1))))]
            bound = lambda c, now, anchor: min(anchor + how.cap, max(anchor - how.cap, min(now + how.step, max(now - how.step, c))))
            t, r = bound(pick(quantile), t, at), bound(pick(how.ref_pct / 100), r, ar)
        out.append((b, n, psi, use, t, r))
    return out


def test_adaptive_thresholds_sample_over_intervals(spark):
    """No interval has enough scores by itself; the trailing window, drift and the cap each take effect."""
    rnd = random.Random(1)
    quantiles = [float(i) for i in range(101)]
    how = calibrate.Recalibration(ref_pct=90.0, min_samples=150, trailing=220, digest_us=4 * QUARTER, recent=160, max_psi=0.12, cap=2.5)
    rows, data = {}, []
    for s in ("a", "b"):
        rows[s] = sorted(
            (b * QUARTER + rnd.randrange(QUARTER), rnd.uniform(0, 100 if s == "a" or b < 25 else 60), rnd.random() < 0.1)
            for b in range(40) if b not in (5, 6, 30) for _ in range(rnd.randint(1, 70))
        )
        data += [(s, ts, i, x, f) for i, (ts, x, f) in enumerate(rows[s])]
    fitted = spark.createDataFrame([(s, 93.0, 0.97, quantiles) for s in rows], FITTED)
    df = spark.createDataFrame(data, LIVE).repartition(3)
    got = calibrate.adaptive_thresholds(df, fitted, ["sensor"], ["ts_us", "event_id"], how)
    for s in rows:
        mine = [tuple(r)[1:] for r in got.where(F.col("sensor") == s).orderBy("bucket").collect()]
        want = replay(rows[s], 93.0, 0.97, quantiles, how)
        assert [m[:2] + (m[3],) for m in mine] == [w[:2] + (w[3],) for w in want]
        assert [m[2] for m in mine] == pytest.approx([w[2] for w in want], nan_ok=True)
        assert [m[4:] for m in mine] == [pytest.approx(w[4:]) for w in want]
        assert {w[3] for w in want} == {True, False} and max(w[1] for w in want) == 220
    frozen = [w for w in replay(rows["b"], 93.0, 0.97, quantiles, how) if w[1] >= 150 and not w[3]]
    assert frozen and max(w[1] for w in want if w[0] == 2) < 220


def test_adaptive_threshold_freezes_on_drift(spark):
    quantiles = [float(i) for i in range(101)]
    fitted = spark.createDataFrame([("s", 95.0, 0.95, quantiles)], FITTED)
    data = [("s", 0, i, float(i % 100) + 0.5, False) for i in range(200)]
    data += [("s", QUARTER, i, 100.0, False) for i in range(200)] + [("s", 0, 300, 1e6, True), ("s", 5, 301, None, False)]
    df = spark.createDataFrame(data, LIVE)
    how = calibrate.Recalibration(min_samples=100)
    got = calibrate.adaptive_thresholds(df, fitted, ["sensor"], ["ts_us", "event_id"], how).orderBy("bucket").collect()
    assert [r.applied for r in got] == [True, False]
    assert got[0].threshold == pytest.approx(94.5) and got[1].threshold == got[0].threshold
    with pytest.raises(ValueError):
        calibrate.Recalibration(digest_us=QUARTER + 1)


def test_ranks_of_sliding_windows():
    rnd = np.random.default_rng(3)
    values = rnd.integers(0, 3000, 9000).astype(float)
    hi = np.sort(rnd.integers(0, 9001, 60))
    lo = np.maximum(0, hi - 2500)
    ranks = np.array([[0, max(0, (b - a) // 2), max(0, b - a - 1)] for a, b in zip(lo, hi)])
    got = trailing.order_values(values, lo, hi, ranks)
    for k, (a, b) in enumerate(zip(lo, hi)):
        assert np.array_equal(got[k], np.sort(values[a:b])[ranks[k]] if b > a else [np.nan] * 3, equal_nan=True)


def test_collapse_streak_and_best(spark):
    rows = [(1, 0.9, 0.2, 0.001, 5.0), (2, 0.5, 0.9, 0.001, 5.0), (3, 0.9, 0.9, 0.6, 5.0), (4, 0.9, 0.9, 0.001, 6.5), (5, 0.9, 0.1, 0.001, 5.0)]
    df = spark.createDataFrame(rows, "step long, auc double, evt_dr double, evt_fpr double, sigma double")
    got = leaderboard.judge(df.withColumn("run", F.lit(1)), ["run"], [F.col("step")]).orderBy("step").collect()
    assert [r.verdict for r in got] == ["NEW BEST", "COLLAPSED", "COLLAPSED", "COLLAPSED", "KEPT"]
    assert [r.abort for r in got] == [False, False, False, True, False]


def test_patches_and_focal_loss(spark):
    df = spark.createDataFrame([([False] * 150,), ([True, False, False, True, False],)], "spikes array<boolean>")
    got = [r.p for r in df.select(scoring.patch_lengths("spikes").alias("p")).collect()]
    assert got == [[64, 64, 22], [1, 3, 1]]
    one = spark.createDataFrame([(0.25, 3), (0.5, -1)], "p double, byte int").withColumn("split", F.lit("t"))
    assert scoring.mean_loss(one, ["split"]).first().loss == pytest.approx(1.3862943611)
    pads = one.where("byte < 0")
    assert scoring.mean_loss(pads, ["split"]).first().loss == 0.0


def test_interval_pairs_equal_the_nested_loop(spark, limits):
    limits(broadcastRows=3)
    rnd = random.Random(3)
    points = [(i, rnd.randrange(10**11)) for i in range(400)]
    spans = [(f"n{i}", s, s + rnd.randrange(2 * 10**10)) for i, s in ((i, rnd.randrange(10**11)) for i in range(12))]
    got = match.interval_pairs(
        spark.createDataFrame(points, "id long, ts_us long"), spark.createDataFrame(spans, "name string, a long, b long"), "ts_us", "a", "b"
    ).collect()
    want = {(i, n) for i, t in points for n, a, b in spans if a <= t <= b}
    assert {(r.id, r.name) for r in got} == want and len(got) == len(want)


def test_excerpts(spark):
    from packetgrain.sinks.writers import excerpts, pcap_files

    packets = spark.createDataFrame([("s", i * 10, i, bytes([i])) for i in range(20)], "sensor string, ts_us long, packet_index long, data binary")
    opened = spark.createDataFrame([("s", "x", 55), ("s", "y", 100), ("s", "z", -5)], "sensor string, incident_id string, first_us long")
    found = excerpts(opened, packets, ["sensor"], 3)
    got = sorted((r.incident_id, r.packet_index) for r in found.collect())
    assert got == [("x", 3), ("x", 4), ("x", 5), ("y", 8), ("y", 9), ("y", 10)]
    files = {r.incident_id: bytes(r.content) for r in pcap_files(found).collect()}
    assert len(files["x"]) == 24 + 3 * 17 and files["x"][:4] == b"\xd4\xc3\xb2\xa1" and files["x"][-1] == 5


def test_dyadic_pieces_cover_exactly(spark):
    rnd = random.Random(5)
    spans = [(a, a + rnd.randrange(300)) for a in (rnd.randrange(1000) for _ in range(60))] + [(7, 7), (0, 255)]
    long = [(1 << 32, (1 << 33) - 1), (0, 1 << 35), (-5, 9), (1_705_700_000_000_001, 1_805_700_000_000_002), (3, (1 << 60) + 1)]
    df = spark.createDataFrame(spans + long, "a long, b long")
    for r in df.select("a", "b", match.dyadic_pieces(F.col("a"), F.col("b")).alias("p")).collect():
        edges = sorted((p.block << p.level, (p.block + 1) << p.level) for p in r.p)
        assert edges[0][0] == r.a and edges[-1][1] == r.b + 1
        assert all(one[1] == two[0] for one, two in zip(edges, edges[1:]))


def test_ranges_keep_streams_together(spark):
    df = spark.createDataFrame([("a", i) for i in range(80)] + [("b", i) for i in range(5)], "flow string, i long")
    parts = windows.spread_by_stream(df, ["flow"], "i", 4).withColumn("p", F.spark_partition_id())
    sizes = [r["count"] for r in parts.groupBy("p").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 40


def test_compressor_as_complexity(spark):
    import zlib

    texts = [b"", b"a" * 400, bytes(range(256))]
    ratio = scoring.compressor_bits(lambda b: zlib.compress(b, 6))
    got = [r.r for r in spark.createDataFrame([(t,) for t in texts], "data binary").select(ratio("data").alias("r")).collect()]
    assert got == [8.0 * len(zlib.compress(t, 6)) / max(1, len(t)) for t in texts]


def test_long_tails_are_fitted_like_short_ones(spark, limits):
    rnd = random.Random(9)
    data = [(s, 10 + rnd.expovariate(1.0 if s == "a" else 0.5)) for s in ("a", "b") for _ in range(3000)] + [("c", 1.0)] * 40
    df = spark.createDataFrame(data, "sensor string, score double").repartition(6)

    def fits():
        return {r.sensor: (r.num_tail_points, r.gpd_shape, r.gpd_scale, r.threshold) for r in calibrate.evt_thresholds(df, ["sensor"], 0.001).collect()}

    near = fits()
    limits(hotRows=50)
    far = fits()
    assert near.keys() == far.keys() == {"a", "b"}
    for k in near:
        assert far[k] == pytest.approx(near[k], rel=1e-9)


def test_positions_are_rounded_from_exact_values(spark):
    """0.15625 is a tie and goes to even; 0.00015 lies below the tie its shortest text shows."""
    rows = spark.createDataFrame([([0.15625, 0.65625, 0.46875, 0.00015, 1.0],), ([],)], "p array<double>")
    got = [r.t for r in rows.select(F.array_join(fixed_all("p", 4), ",").alias("t")).collect()]
    assert got == ["0.1562,0.6562,0.4688,0.0001,1.0000", ""]
