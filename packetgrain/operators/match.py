"""Matching alarms, packets and files to ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetgrain.operators.ordering import fits, running
from packetgrain.session import cut, small

MINUTE_US = 60_000_000
HOUR_US = 3_600_000_000


def interval_pairs(
    points: DataFrame, intervals: DataFrame, ts: str, start: str, end: str, keys: list[str] | None = None, cell_us: int = HOUR_US
) -> DataFrame:
    """Points inside [start, end] with the interval's columns.

    Both sides are placed in time cells and joined on them, so only points and intervals
    that share a cell meet; an interval list within the bound is broadcast.
    """
    keys = keys or []
    spread = intervals.withColumn(
        "_cell", F.explode(F.sequence(F.floor(F.col(start) / cell_us), F.floor(F.col(end) / cell_us)))
    )
    side = F.broadcast(spread) if small(spread) else spread
    placed = points.withColumn("_cell", F.floor(F.col(ts) / cell_us))
    joined = placed.join(side, [*keys, "_cell"])
    return joined.where((F.col(ts) >= F.col(start)) & (F.col(ts) <= F.col(end))).drop("_cell")


def schedule_epochs(schedule: DataFrame, first_packet: DataFrame, utc_offset_hours: float) -> DataFrame:
    """Local ``HH:MM`` times to microseconds, counted from the capture's local midnight.

    The midnight keeps the first packet's fraction of a second, as the source does.
    """
    shift = int(utc_offset_hours * HOUR_US)
    local = F.col("t0_us") + shift
    second = F.pmod(F.floor(local / 1_000_000), F.lit(86_400))
    midnight = F.col("t0_us") - second * 1_000_000

    def clock(name: str) -> Column:
        parts = F.split(name, ":")
        return parts[0].cast("long") * HOUR_US + parts[1].cast("long") * MINUTE_US

    # ``first_packet`` is one aggregate row.
    return (
        schedule.withColumn("_one", F.lit(1))
        .join(first_packet.withColumn("_one", F.lit(1)), "_one")
        .select("name", (midnight + clock("start")).alias("start_us"), (midnight + clock("end")).alias("end_us"))
    )


def padded(intervals: DataFrame, margin_us: int) -> DataFrame:
    return intervals.withColumn("lo_us", F.col("start_us") - margin_us).withColumn(
        "hi_us", F.col("end_us") + margin_us
    )


LEAD_US = 5 * MINUTE_US


def fit_end(intervals: DataFrame, lead_us: int = LEAD_US) -> DataFrame:
    """Benign fitting stops this long before the first padded attack."""
    return intervals.agg((F.min("lo_us") - lead_us).alias("fit_end_us"))


def fit_slice(points: DataFrame, intervals: DataFrame, ts: str = "ts_us", lead_us: int = LEAD_US) -> DataFrame:
    """Rows before the end of the benign lead-in."""
    end = fit_end(intervals, lead_us).withColumn("_one", F.lit(1))
    return points.withColumn("_one", F.lit(1)).join(F.broadcast(end), "_one").where(
        F.col(ts) < F.col("fit_end_us")
    ).drop("_one", "fit_end_us")


def attack_hits(alarms: DataFrame, intervals: DataFrame, span_end: DataFrame, ts: str = "ts_us") -> DataFrame:
    """Per attack the alarms in its padded interval and the delay from its own start."""
    hits = interval_pairs(alarms, intervals, ts, "lo_us", "hi_us").groupBy("name").agg(
        F.count(F.lit(1)).alias("alarms"), F.min(ts).alias("_first")
    )
    # ``span_end`` is one aggregate row; the schedule drives the result.
    base = intervals.withColumn("_one", F.lit(1)).join(span_end.withColumn("_one", F.lit(1)), "_one")
    outside = F.col("lo_us") > F.col("span_end_us")
    return base.join(hits, "name", "left").select(
        "name",
        outside.alias("outside_captured_range"),
        F.when(~outside, F.coalesce("alarms", F.lit(0)) > 0).alias("detected"),
        F.when(outside, 0).otherwise(F.coalesce("alarms", F.lit(0))).cast("long").alias("alarms"),
        F.when(~outside, (F.col("_first") - F.col("start_us")) / 1e6).alias("delay_sec"),
    )


def false_alarms(alarms: DataFrame, intervals: DataFrame, ts: str = "ts_us", after: DataFrame | None = None) -> DataFrame:
    """Alarms outside every padded interval; ``after`` also drops the fit period."""
    inside = interval_pairs(alarms.select(ts).distinct(), intervals.select("lo_us", "hi_us"), ts, "lo_us", "hi_us")
    out = alarms.join(inside.select(ts).distinct(), ts, "left_anti")
    if after is None:
        return out
    one = after.withColumn("_one", F.lit(1))
    return out.withColumn("_one", F.lit(1)).join(F.broadcast(one), "_one").where(
        F.col(ts) >= F.col("fit_end_us")
    ).drop("_one", "fit_end_us")


def benign_hours(intervals: DataFrame, span_end: DataFrame, lead_us: int = LEAD_US) -> DataFrame:
    """Span after the fit period minus each attack's clipped length; overlaps count twice."""
    one = intervals.withColumn("_one", F.lit(1)).join(span_end.withColumn("_one", F.lit(1)), "_one")
    all_ = one.join(fit_end(intervals, lead_us).withColumn("_one", F.lit(1)), "_one")
    clipped = F.greatest(
        F.lit(0), F.least("hi_us", "span_end_us") - F.greatest("lo_us", "fit_end_us")
    )
    seen = F.when(F.col("lo_us") <= F.col("span_end_us"), clipped).otherwise(0)
    total = all_.agg(
        F.max("span_end_us").alias("s"), F.max("fit_end_us").alias("f"), F.sum(seen).alias("a")
    )
    return total.select(
        F.greatest(F.lit(1e-9), (F.col("s") - F.col("f") - F.col("a")) / float(HOUR_US)).alias("benign_hours")
    )


def fuse_attacks(byte_hits: DataFrame, rate_hits: DataFrame) -> DataFrame:
    """Either detector counts; ``by`` names the ones that fired."""
    b = byte_hits.select("name", "outside_captured_range", F.col("detected").alias("byte"))
    r = rate_hits.select("name", F.col("detected").alias("rate"))
    who = F.concat_ws(",", F.when(F.col("byte"), F.lit("byte")), F.when(F.col("rate"), F.lit("rate")))
    return b.join(r, "name").select(
        "name", "outside_captured_range", "byte", "rate",
        (F.col("byte") | F.col("rate")).alias("detected"),
        F.when(F.col("outside_captured_range"), F.lit(None)).otherwise(
            F.when(who == "", F.lit("none")).otherwise(who)
        ).alias("by"),
    )


def fuse_files(byte_scores: DataFrame, rate_scores: DataFrame, byte_threshold: Column, rate_threshold: Column, file: str = "file") -> DataFrame:
    """File-level union; a file one detector never scored is a miss for it."""
    b = byte_scores.select(file, F.col("score").alias("byte_score"))
    r = rate_scores.select(file, F.col("score").alias("rate_score"))
    hit_b = F.coalesce(F.col("byte_score") > byte_threshold, F.lit(False))
    hit_r = F.coalesce(F.col("rate_score") > rate_threshold, F.lit(False))
    return b.join(r, file, "full_outer").select(
        file, "byte_score", "rate_score", hit_b.alias("byte_hit"), hit_r.alias("rate_hit"),
        (hit_b | hit_r).alias("fused"),
        (hit_r & ~hit_b).alias("rate_only"),
        (hit_b & ~hit_r).alias("byte_only"),
    )


def combined_fpr(a: Column, b: Column) -> Column:
    """A10: joint false-positive rate if the detectors were independent."""
    return 1 - (1 - a) * (1 - b)


def pair_key(a: str, b: str) -> Column:
    """The unordered host pair."""
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def both_directions(flows: DataFrame) -> DataFrame:
    """Every labelled flow also in the reverse direction, with its padded time span."""
    span = [
        (F.col("stime") - 1).alias("st"), (F.col("ltime") + 1).alias("lt"), "cat", "ordinal",
    ]
    there = flows.select("srcip", "sport", "dstip", "dsport", "proto", *span)
    back = flows.select(
        F.col("dstip").alias("srcip"), F.col("dsport").alias("sport"),
        F.col("srcip").alias("dstip"), F.col("sport").alias("dsport"), "proto", *span,
    )
    return there.unionByName(back)


FIVE = ["srcip", "sport", "dstip", "dsport", "proto"]


def attacker_categories(flows: DataFrame) -> DataFrame:
    """Every attacker source with the category of the first pair it belongs to."""
    attackers = flows.select(F.col("srcip").alias("ip")).distinct()
    first = flows.withColumn("pair", pair_key("srcip", "dstip")).groupBy("pair").agg(
        F.min_by(F.struct("cat", "srcip", "dstip"), "ordinal").alias("f"), F.min("ordinal").alias("ordinal")
    )
    ends = first.select(
        F.explode(F.array_distinct(F.array("f.srcip", "f.dstip"))).alias("ip"),
        F.col("f.cat").alias("cat"), "ordinal",
    )
    found = ends.groupBy("ip").agg(F.min_by("cat", "ordinal").alias("cat"))
    return attackers.join(found, "ip", "left").select("ip", F.coalesce("cat", F.lit("unknown")).alias("cat"))


# Blocks of up to 2^61 numbers: whole numbers within 2^61 of zero, so any span in microseconds.
LEVELS = 62


def dyadic_pieces(start: Column, end: Column) -> Column:
    """[start, end] as the fewest aligned blocks of 2^level whole numbers.

    A level gives at most its first block, when that is an odd one, and its last, when
    that is even; any other block inside is half of a larger one that is inside too.
    """
    start, end = start.cast("long"), end.cast("long")

    def at(level: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), level)
        first = F.call_function("shiftright", start + size - 1, level)
        last = F.call_function("shiftright", end + 1, level) - 1
        inside = first <= last
        return F.array(
            F.when(inside & (first.bitwiseAND(1) == 1), F.struct(level.alias("level"), first.alias("block"))),
            F.when(inside & (last.bitwiseAND(1) == 0), F.struct(level.alias("level"), last.alias("block"))),
        )

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), at)))


def _time_hits(asked: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """First span, by file order, that covers each second of ``asked(keys…, t)``; null where none does.

    Spans are cut into aligned blocks and the first span of every block is kept; a second
    then looks up the one block of each size it lies in. However many spans cover a
    second, it meets at most one row per block size, so no pairs are listed.
    """
    blocks = (
        spans.select(*keys, "cat", "ordinal", F.inline(dyadic_pieces(F.col("st"), F.col("lt"))))
        .groupBy(*keys, "level", "block")
        .agg(F.min_by("cat", "ordinal").alias("cat"), F.min("ordinal").alias("ordinal"))
    )
    used = [r["level"] for r in blocks.select("level").distinct().collect()]  # at most LEVELS rows
    if not used:
        used = [0]
    levels = F.explode(F.array(*[F.lit(v) for v in sorted(used)])).alias("level")
    block = F.call_function("shiftright", F.col("t"), F.col("level")).alias("block")
    return (
        asked.select(*keys, "t", levels).select(*keys, "t", "level", block)
        .join(blocks, [*keys, "level", "block"], "left")
        .groupBy(*keys, "t")
        .agg(F.min_by("cat", "ordinal").alias("cat"))
    )


# Before any second a packet or a span may have.
BEFORE = -(1 << 62)


def _steps(spans: DataFrame, keys: list[str]) -> DataFrame:
    """keys, t, any, cat: what holds for a key from ``t`` on. ``any`` is its first span's category, in its first row alone;
    ``cat`` that of the first span that covers the seconds up to the next row."""
    ends = spans.select(*keys, F.explode(F.array(F.col("st").cast("long"), F.col("lt").cast("long") + 1)).alias("t")).distinct()
    turns = _time_hits(ends, spans, keys)
    first = spans.groupBy(*keys).agg(F.min_by("cat", "ordinal").alias("any")).withColumn("t", F.lit(BEFORE))
    return turns.unionByName(first, allowMissingColumns=True).select(*keys, "t", "any", "cat")


def _span_facts(packets: DataFrame, steps: DataFrame, keys: list[str], name: str, within: bool | None) -> DataFrame:
    """``packets`` with the key's first category and that at the packet's second, in one ordered pass over the key.

    Only the ends of spans are looked up in blocks; packets take what the last end before them left.
    """
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    turns = steps.where(known).select(*keys, "t", F.col("any").alias("_any"), "cat", F.lit(0).alias("_side"))
    both = packets.where(known).withColumn("_side", F.lit(1)).unionByName(turns, allowMissingColumns=True)
    last = F.when(F.col("_side") == 0, F.struct("t", "cat"))
    seen = running(
        both, keys, [F.col("t"), F.col("_side")], {"_first": ("max", F.col("_any")), "_last": ("max", last)}, within=within
    )
    found = seen.where("_side = 1").select(
        *packets.columns, F.col("_first").alias(f"{name}_any"), F.col("_last.cat").alias(f"{name}_time")
    )
    return found.unionByName(packets.where(~known), allowMissingColumns=True)


def flow_fields(parsed: DataFrame, ts: str = "ts_us") -> DataFrame:
    """Parsed packets under the names and types of the ground-truth flows, for ``label_packets``."""
    return parsed.withColumns({
        "srcip": F.col("src"), "sport": F.col("sport").cast("long"), "dstip": F.col("dst"),
        "dsport": F.col("dport").cast("long"), "proto": F.col("protocol"), "t": F.floor(F.col(ts) / 1_000_000),
    }).drop("src", "dst", "dport", "protocol")


def label_packets(
    packets: DataFrame, flows: DataFrame, capture: list[str], mode: str = "auto", hits: bool = False
) -> DataFrame:
    """Attack category per packet by 5-tuple, then host pair, then attacker address.

    ``packets`` has srcip, sport, dstip, dsport, proto and ``t`` in whole seconds;
    ``flows`` has the same with stime, ltime, cat and the row's ordinal. With time
    matching a tier without a covering span falls through to the next. ``auto`` uses
    time for a capture when at least five of its packets hit a 5-tuple span. ``hits`` adds
    which lookups found something, for ``diagnostics``.
    """
    flows = cut(flows)
    spans = both_directions(flows)
    pairs = flows.select(
        pair_key("srcip", "dstip").alias("pair"),
        (F.col("stime") - 1).alias("st"), (F.col("ltime") + 1).alias("lt"), "cat", "ordinal",
    )
    # A packet without addresses has no pair.
    some = F.col("srcip").isNotNull() | F.col("dstip").isNotNull()
    p = packets.withColumn("pair", F.when(some, pair_key("srcip", "dstip")))
    pair_steps = cut(_steps(pairs, ["pair"]))
    # Packets of one 5-tuple are packets of one pair, so one answer holds for both passes.
    within = fits(p.select("pair").unionByName(pair_steps.select("pair")).where("pair IS NOT NULL"), ["pair"]) or None
    ips = cut(attacker_categories(flows))
    ips = F.broadcast(ips) if small(ips) else ips
    joined = (
        _span_facts(_span_facts(p, _steps(spans, FIVE), FIVE, "five", within), pair_steps, ["pair"], "pair", within)
        .join(ips.select(F.col("ip").alias("srcip"), F.col("cat").alias("src_cat")), "srcip", "left")
        .join(ips.select(F.col("ip").alias("dstip"), F.col("cat").alias("dst_cat")), "dstip", "left")
    )
    if mode == "auto":
        joined = cut(joined.drop(*{"pair"} - set(packets.columns)))
        votes = joined.groupBy(*capture).agg(
            (F.count("five_time") >= 5).alias("use_time")
        )
        joined = joined.join(F.broadcast(votes) if small(votes) else votes, capture)
    else:
        joined = joined.withColumn("use_time", F.lit(mode == "strict"))
    five = F.when(F.col("use_time"), F.col("five_time")).otherwise(F.col("five_any"))
    pair = F.when(F.col("use_time"), F.col("pair_time")).otherwise(F.col("pair_any"))
    tier = (
        F.when(five.isNotNull(), "5tuple")
        .when(pair.isNotNull(), "pair")
        .when(F.col("src_cat").isNotNull() | F.col("dst_cat").isNotNull(), "ip")
        .otherwise("none")
    )
    found = {"five_any": "_five", "five_time": "_five_time", "pair_any": "_pair", "pair_time": "_pair_time"} if hits else {}
    return joined.select(
        *packets.columns, "use_time", tier.alias("tier"),
        F.coalesce(five, pair, F.col("src_cat"), F.col("dst_cat")).alias("cat"),
        *[F.col(c).isNotNull().alias(n) for c, n in found.items()],
        *([(F.col("src_cat").isNotNull() | F.col("dst_cat").isNotNull()).alias("_attacker")] if hits else []),
    )


def diagnostics(labelled: DataFrame, capture: list[str]) -> DataFrame:
    """Per capture its time range, what could be parsed, and how many packets each lookup hit."""
    named = {"five_hits": "_five", "five_time_hits": "_five_time", "pair_hits": "_pair", "pair_time_hits": "_pair_time", "attacker_packets": "_attacker"}
    return labelled.groupBy(*capture).agg(
        F.bool_and("use_time").alias("use_time"), F.count(F.lit(1)).alias("packets"), F.count("srcip").alias("parseable"),
        F.min("t").alias("first_t"), F.max("t").alias("last_t"), *[F.count_if(c).alias(n) for n, c in named.items()],
    )


def routing_stats(labelled: DataFrame) -> DataFrame:
    """Packets per class and tier."""
    return labelled.groupBy(F.coalesce("cat", F.lit("benign")).alias("class"), "tier").agg(
        F.count(F.lit(1)).alias("packets")
    )


def source_census(packets: DataFrame, src: str = "srcip", top: int = 10) -> DataFrame:
    """The busiest source addresses."""
    return packets.groupBy(src).agg(F.count(F.lit(1)).alias("packets")).orderBy(
        F.desc("packets"), src
    ).limit(top)


def exclude_files(files: DataFrame, used: DataFrame, by: str = "name") -> DataFrame:
    """Files not already used for calibration or holdout."""
    return files.join(used.select(by), by, "left_anti")


def next_checkpoints(available: DataFrame, scored: DataFrame) -> DataFrame:
    """Checkpoints not yet scored and beyond the highest scored step."""
    top = scored.agg(F.coalesce(F.max("step"), F.lit(-1)).alias("_top")).withColumn("_one", F.lit(1))
    fresh = available.join(scored.select("checkpoint"), "checkpoint", "left_anti")
    return fresh.withColumn("_one", F.lit(1)).join(F.broadcast(top), "_one").where(
        F.col("step") > F.col("_top")
    ).drop("_one", "_top")


def missing_files(required: DataFrame, listing: DataFrame) -> DataFrame:
    """Required files that are not there."""
    return required.join(listing.select("name"), "name", "left_anti")


def holdout_or_calibration(holdout: Column, calibration: Column) -> Column:
    """An absent benign holdout reuses the calibration capture, with a note."""
    return F.struct(
        F.coalesce(holdout, calibration).alias("path"),
        F.when(holdout.isNull(), F.lit("no separate benign holdout: calibration reused")).alias("note"),
    )


def as_of(left: DataFrame, right: DataFrame, keys: list[str], ts: str, value: str, name: str) -> DataFrame:
    """The latest ``right`` value at or before each ``left`` row, in one ordered pass."""
    both = left.withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).unionByName(
        right.select(*keys, ts, F.col(value).alias("_v")).withColumn("_side", F.lit(0)), allowMissingColumns=True
    )
    # The latest right row in (ts, side) order is the greatest one so far.
    pair = F.when(F.col("_side") == 0, F.struct(ts, F.col("_v")))
    seen = running(both, keys, [F.col(ts), F.col("_side")], {"_last": ("max", pair)})
    return seen.where(F.col("_side") == 1).select(*left.columns, F.col("_last._v").alias(name))
