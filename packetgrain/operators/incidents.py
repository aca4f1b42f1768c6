"""Alerts, incidents, enrichment, bans, gaps and digests."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetgrain.operators.ordering import fits, running
from packetgrain.session import cut

INCIDENT_GAP_US = 60_000_000
CAPTURE_GAP_US = 300_000_000
BAN_TTL_US = 900_000_000
DAY_US = 86_400_000_000

# Fixed values of the alert record format.
SEVERITY = {"CRITICAL_BYTE": 1, "BYTE": 2, "SLOW_DISTRIBUTED": 2, "SLOW": 3, "INFO": 4}
SIGNATURE_ID = {
    "CRITICAL_BYTE": 900001, "BYTE": 900002, "SLOW_DISTRIBUTED": 900003, "SLOW": 900004, "INFO": 900000,
}
NEVER_BANNED = ["0.0.0.0", "127.0.0.1", "::1", "localhost"]
BANNING_TYPES = ["BYTE", "CRITICAL_BYTE", "SLOW", "SLOW_DISTRIBUTED", "RATE"]


def gate_types(score: Column, threshold: Column, gold: Column | None = None) -> Column:
    """BYTE over the threshold, CRITICAL_BYTE over the frozen ceiling, each by itself."""
    ceiling = threshold + 3.0 if gold is None else F.coalesce(gold, threshold + 3.0)
    return F.array_compact(
        F.array(
            F.when(score > threshold, F.lit("BYTE")),
            F.when(score > ceiling, F.lit("CRITICAL_BYTE")),
        )
    )


def union_alerts(*alerts: DataFrame) -> DataFrame:
    """Alerts of all detectors as one frame."""
    out = alerts[0]
    for more in alerts[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def incidents(
    alerts: DataFrame, keys: list[str], gap_us: int = INCIDENT_GAP_US, opening: list[str] | None = None, tie: str = "alert_id", ts: str = "ts_us", score: str = "score"
) -> DataFrame:
    """Alerts of a type closer than the gap are one incident.

    Two alerts in one time cell of the gap's length always belong together, so alerts are
    first reduced to one row per (type, cell); only these few rows are put in order. The
    number of rows per type is bounded by time, not by how many alerts fired.
    """
    opening = opening or []
    if gap_us <= 0:
        return alerts.select(
            *keys, F.col(ts).alias("first_us"), F.col(ts).alias("last_us"),
            F.lit(1).cast("long").alias("raw_alerts"),
            F.coalesce(score, F.lit(0.0)).alias("peak_score"), *opening,
        )
    at = F.struct(ts, tie)
    cells = alerts.groupBy(*keys, F.floor(F.col(ts) / gap_us).alias("_cell")).agg(
        F.min(ts).alias("_lo"), F.max(ts).alias("_hi"), F.count(F.lit(1)).alias("_n"),
        F.max(F.coalesce(score, F.lit(0.0))).alias("_peak"),
        *[F.min_by(c, at).alias(f"_open_{c}") for c in opening],
    )
    cells = cut(cells)
    fit = fits(cells, keys)
    seen = running(cells, keys, [F.col("_cell")], {"_prev": ("previous", F.col("_hi"))}, within=fit)
    fresh = F.when(F.col("_prev").isNull() | (F.col("_lo") - F.col("_prev") > gap_us), 1).otherwise(0)
    numbered = running(
        seen.withColumn("_fresh", fresh), keys, [F.col("_cell")], {"incident": ("sum", F.col("_fresh"))}, within=fit
    )
    return numbered.groupBy(*keys, "incident").agg(
        F.min("_lo").alias("first_us"), F.max("_hi").alias("last_us"),
        F.sum("_n").alias("raw_alerts"),
        F.max("_peak").alias("peak_score"),
        *[F.min_by(f"_open_{c}", "_cell").alias(c) for c in opening],
    )


def close_message(kind: Column, count: Column, first_us: Column, last_us: Column, peak: Column) -> Column:
    """I4: summary text of an incident that collapsed several alerts."""
    seconds = F.bround(F.greatest(F.lit(1.0), (last_us - first_us) / 1e6), 0).cast("long")
    text = F.format_string(
        "Incident closed: %d %s alerts over %ds (peak score %.2f)", count, kind, seconds, peak
    )
    return F.when(count > 1, text)


def capture_gaps(packets: DataFrame, keys: list[str], gap_us: int = CAPTURE_GAP_US, ts: str = "ts_us") -> DataFrame:
    """Pauses longer than the limit; found between time cells, as in ``incidents``."""
    cells = packets.groupBy(*keys, F.floor(F.col(ts) / gap_us).alias("_cell")).agg(
        F.min(ts).alias("_lo"), F.max(ts).alias("_hi")
    )
    seen = running(cells, keys, [F.col("_cell")], {"_prev": ("previous", F.col("_hi"))})
    return seen.where(F.col("_lo") - F.col("_prev") > gap_us).select(
        *keys, F.col("_prev").alias("opened_us"), F.col("_lo").alias("closed_us"),
        F.lit("CAPTURE_GAP").alias("type"), F.lit(0).cast("long").alias("raw_alerts"),
        F.lit(0.0).alias("peak_score"),
        F.bround((F.col("_lo") - F.col("_prev")) / 1e6, 0).cast("long").alias("gap_seconds"),
    )


def incidents_per_day(found: DataFrame, packets: DataFrame, gaps: DataFrame, ts: str = "ts_us") -> DataFrame:
    """Incidents over the time the capture was up. All three sides are one aggregate row."""
    one = F.lit(1).alias("_one")
    n = found.agg(F.count(F.lit(1)).alias("incidents")).select("*", one)
    span = packets.agg((F.max(ts) - F.min(ts)).alias("span_us")).select("*", one)
    lost = gaps.agg(F.coalesce(F.sum(F.col("closed_us") - F.col("opened_us")), F.lit(0)).alias("gap_us")).select("*", one)
    return n.join(span, "_one").join(lost, "_one").select(
        "incidents", "span_us", "gap_us",
        F.try_divide(F.col("incidents") * float(DAY_US), F.col("span_us") - F.col("gap_us")).alias("per_day"),
    )


def top_items(counted: DataFrame, by: list[str], value: str, top: int) -> DataFrame:
    """The highest ``top`` rows per group, ties by first appearance, with their ``_rank``.

    A bounded partial result per part of the group is ranked again, so a group with many
    distinct items is not sorted by one task.
    """
    order = [F.desc(value), F.asc("_first")]
    part = F.pmod(F.xxhash64("_first"), F.lit(32))
    near = Window.partitionBy(*by, "_part").orderBy(*order)
    best = counted.withColumn("_part", part).withColumn("_rank", F.row_number().over(near)).where(
        F.col("_rank") <= top
    )
    final = Window.partitionBy(*by).orderBy(*order)
    return best.withColumn("_rank", F.row_number().over(final)).where(F.col("_rank") <= top).drop("_part")


def ban_candidates(alerts: DataFrame) -> DataFrame:
    """The source of the first talker of an alert type that bans."""
    first = F.get("top_talkers", F.lit(0))["pair"]
    return alerts.where(F.col("type").isin(BANNING_TYPES)).withColumn(
        "ip", F.split(first, " -> ")[0]
    ).where(F.col("ip").isNotNull() & ~F.col("ip").isin(NEVER_BANNED) & (F.col("ip") != ""))


def eve_records(alerts: DataFrame, product: str, category: str, detector: str) -> DataFrame:
    """I8: nested alert record; talkers and ports are taken as text or as structures.

    ``alerts`` has ts_us, type, message, score, talker, port, cusum_level and
    score_percentile.
    """
    severity = _choose(SEVERITY, 3)
    signature = _choose(SIGNATURE_ID, 900000)
    sides = F.split("talker", " -> ")
    named = F.col("talker").contains(" -> ")
    port = F.split(F.col("port").cast("string"), "/")
    has_port = F.col("port").cast("string").contains("/")
    plain = F.col("port").cast("string").rlike("^[0-9]+$")
    record = F.struct(
        utc_millis(F.col("ts_us"), "+0000").alias("timestamp"),
        F.lit("alert").alias("event_type"),
        F.when(named, F.trim(sides[0])).otherwise("0.0.0.0").alias("src_ip"),
        F.lit(0).alias("src_port"),
        F.when(named, F.trim(sides[1])).otherwise("0.0.0.0").alias("dest_ip"),
        F.coalesce(
            F.when(has_port, port[1].try_cast("int")).when(plain, port[0].try_cast("int")), F.lit(0)
        ).alias("dest_port"),
        F.when(has_port, F.upper(port[0])).otherwise("TCP").alias("proto"),
        F.struct(
            F.lit("allowed").alias("action"), F.lit(1).alias("gid"), signature.alias("signature_id"),
            F.concat(F.lit(f"{product} - "), F.col("type")).alias("signature"),
            F.lit(category).alias("category"), severity.alias("severity"),
            F.struct(
                F.lit(detector).alias("detector"), F.col("type").alias("incident_type"), "message",
                F.coalesce(F.round("score", 4), F.lit(0.0)).alias("score"),
                F.coalesce("cusum_level", F.lit(0.0)).alias("cusum_level"), "score_percentile",
            ).alias("metadata"),
        ).alias("alert"),
    )
    return alerts.withColumn("record", record)


def _choose(table: dict[str, int], default: int) -> Column:
    out = None
    for name, value in table.items():
        out = F.when(F.col("type") == name, value) if out is None else out.when(F.col("type") == name, value)
    return out.otherwise(default)


def utc_millis(ts_us: Column, suffix: str) -> Column:
    """ISO time with milliseconds, cut not rounded."""
    return F.concat(
        F.date_format(F.timestamp_micros(ts_us), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit(suffix)
    )


def syslog_lines(alerts: DataFrame, host: str, product: str) -> DataFrame:
    """RFC 5424 line; facility local0."""
    severity = _choose(SEVERITY, 3)
    priority = 128 + F.when(severity == 1, 3).when(severity == 2, 4).otherwise(6)
    line = F.format_string(
        f"<%d>1 %s {host} {product} - - - [%s score=%.2f] %s",
        priority, utc_millis(F.col("ts_us"), "Z"), F.col("type"), F.coalesce("score", F.lit(0.0)), F.col("message"),
    )
    return alerts.withColumn("line", line)


def digests(found: DataFrame, span_us: int = 3_600_000_000, drift: DataFrame | None = None) -> DataFrame:
    """A4: per interval incident counts by type, busiest pairs and ports, drift and verdict.

    ``found`` has first_us, type, top_talkers and top_ports; ``drift`` has bucket and psi.
    """
    rows = found.withColumn("bucket", F.floor(F.col("first_us") / span_us))
    by = ["bucket"]
    kinds = rows.groupBy("bucket", "type").agg(F.count(F.lit(1)).alias("n"), F.min("first_us").alias("_first"))
    listed = F.array_sort(F.collect_list(F.struct("_first", "type", "n")))
    counts = kinds.groupBy(*by).agg(
        F.sum("n").alias("incidents"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("by_type"),
        F.array_join(F.transform(listed, lambda r: F.concat_ws(":", r["type"], r["n"])), ", ").alias("_kinds"),
    )
    talk = rows.select("bucket", "first_us", F.posexplode("top_talkers").alias("_at", "t"))
    pairs = talk.groupBy("bucket", F.col("t.pair").alias("pair")).agg(
        F.sum("t.bytes").alias("v"), F.min(F.struct("first_us", "_at")).alias("_first")
    )
    ports = rows.select("bucket", "first_us", F.posexplode("top_ports").alias("_at", "port")).groupBy(
        "bucket", "port"
    ).agg(F.count(F.lit(1)).alias("v"), F.min(F.struct("first_us", "_at")).alias("_first"))

    def listed_top(df: DataFrame, item: str, top: int, name: str) -> DataFrame:
        return top_items(df, by, "v", top).groupBy(*by).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("_rank", item))), lambda r: r[item]).alias(name)
        )

    out = counts.join(listed_top(pairs, "pair", 3, "top_talkers"), by, "left").join(
        listed_top(ports, "port", 5, "top_ports"), by, "left"
    )
    if drift is None:
        out = out.withColumn("psi", F.lit(None).cast("double"))
    else:
        out = out.join(drift.select("bucket", "psi"), by, "full_outer")
    flag = F.coalesce(F.col("psi") > 0.25, F.lit(False))
    n = F.coalesce("incidents", F.lit(0))
    verdict = (
        F.when(flag, F.format_string("DRIFT: baseline may be stale (PSI %.2f) - consider recalibrating", "psi"))
        .when(n == 0, F.lit("quiet hour - no incidents"))
        .otherwise(F.concat(F.format_string("%d incident(s), ", n), F.col("_kinds")))
    )
    return out.select(
        "bucket",
        (F.col("bucket") * span_us).alias("window_start_us"),
        ((F.col("bucket") + 1) * span_us).alias("window_end_us"),
        n.cast("long").alias("incidents"), "by_type", "top_talkers", "top_ports",
        F.round("psi", 3).alias("drift_psi"), flag.alias("drift_flag"), verdict.alias("verdict"),
    )


def feed_counters(alerts: DataFrame) -> DataFrame:
    """Alert totals of the live feed."""
    return alerts.agg(
        F.count_if(F.col("type") == "BYTE").alias("byte_alerts"),
        F.count_if(F.col("type") == "RATE").alias("rate_alerts"),
        F.max(F.when(F.col("type") == "BYTE", F.col("score"))).alias("max_byte_score"),
    )


def newest(alerts: DataFrame, rows: int = 100, ts: str = "ts_us", tie: str = "alert_id") -> DataFrame:
    """The newest alerts of the feed."""
    return alerts.orderBy(F.desc(ts), F.desc(tie)).limit(rows)


def campaign_target(message: Column) -> Column:
    """The target an alert names."""
    found = F.regexp_extract(message, r"targeting (\S+)", 1)
    return F.when(found != "", found)


def context_line(packets: Column, size: Column, talker: Column, ports: Column, syns: Column) -> Column:
    """One line of context for an alert."""
    return F.concat_ws(
        " | ",
        F.format_string("%d pkts / %d B", packets, size),
        talker,
        F.when(F.size(ports) > 0, F.concat(F.lit("ports "), F.array_join(ports.cast("array<string>"), ","))),
        F.when(syns > 0, F.format_string("%d SYN", syns)),
    )


def ban_requests(requests: DataFrame, ttl_us: int) -> DataFrame:
    """Requests that ban an address, each with its length ``_ttl``."""
    clean = requests.where(F.col("ip").isNotNull() & ~F.col("ip").isin(NEVER_BANNED) & (F.col("ip") != ""))
    own = F.coalesce("ttl_us", F.lit(ttl_us)) if "ttl_us" in requests.columns else F.lit(ttl_us)
    return clean.withColumn("ban_ttl", own.cast("long"))


def banned(ban: tuple | None, ts: int, ttl: int, kind: str) -> tuple:
    """banned_at, ttl, count, type after a request. A running ban keeps its start and the longest ttl it was given."""
    if ban is None or ts - ban[0] >= ban[1]:
        return (ts, ttl, 1, kind)
    return (ban[0], max(ban[1], ttl), ban[2] + 1, ban[3])


def ban_episodes(requests: DataFrame, ttl_us: int = BAN_TTL_US) -> DataFrame:
    """Bans per address from requests ``(ip, ts_us, tie, reason, type)``.

    A request during a ban raises its count and replaces the reason; the start stays.
    A ban ends when its time is over, and the next request starts a new one. A ``ttl_us``
    column gives requests a length of their own (null: the default).

    Requests are dealt by address and sorted inside their partition, which may spill; a
    pass over the partition keeps the running ban alone, so no address is held as a list.
    """
    names = ["ip", "ts_us", "tie", "reason", "type", "ban_ttl"]
    ordered = ban_requests(requests, ttl_us).select(*names).repartition("ip").sortWithinPartitions("ip", "ts_us", "tie", "reason")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ip = ban = last = None
        for batch in batches:
            out = []
            for address, ts, _, reason, kind, ttl in zip(*(c.to_pylist() for c in batch.columns)):
                if address != ip:
                    if ban:
                        out.append((ip, *ban[:3], *last, ban[3]))
                    ip, ban = address, None
                after = banned(ban, ts, ttl, kind)
                if ban and after[2] == 1:
                    out.append((ip, *ban[:3], *last, ban[3]))
                ban, last = after, (ts, reason)
            yield _episodes(out)
        if ban:
            yield _episodes([(ip, *ban[:3], *last, ban[3])])

    return ordered.mapInArrow(run, ", ".join(f"{name} {kind}" for name, kind, _ in EPISODE))


EPISODE = (
    ("ip", "string", pa.string()), ("banned_at", "long", pa.int64()), ("ttl", "long", pa.int64()), ("count", "long", pa.int64()),
    ("last_seen", "long", pa.int64()), ("reason", "string", pa.string()), ("incident_type", "string", pa.string()),
)


def _episodes(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(EPISODE)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kind) for c, (_, _, kind) in zip(columns, EPISODE)], [name for name, _, _ in EPISODE]
    )


def active_bans(requests: DataFrame, now_us: Column, ttl_us: int = BAN_TTL_US) -> DataFrame:
    """Bans running at ``now_us`` as the requests up to then left them, longest remaining first."""
    episodes = ban_episodes(requests.where(F.col("ts_us") <= now_us), ttl_us)
    left = (F.col("banned_at") + F.col("ttl") - now_us) / 1e6
    live = now_us - F.col("banned_at") < F.col("ttl")
    return episodes.where(live).withColumn("remaining_secs", F.round(left, 1)).orderBy(
        F.desc("remaining_secs"), "ip"
    )
