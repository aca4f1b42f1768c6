"""Parsing, masking and capture files, from hand-built frames."""

import gzip
import struct

import pandas as pd
import pytest
from pyspark.sql import functions as F

from packetgrain.operators import masking, match, ngram, packets, tls, windows
from packetgrain.operators.tls import walk
from packetgrain.plans import frames
from packetgrain.sources import captures, documents


def ip4(src, dst, proto, body):
    a = bytes(int(x) for x in src.split("."))
    b = bytes(int(x) for x in dst.split("."))
    return struct.pack("!BBHHHBBH", 0x45, 0, 20 + len(body), 7, 0, 64, proto, 0xBEEF) + a + b + body


def tcp(sport, dport, flags, payload=b"", options=b""):
    offset = (20 + len(options)) // 4
    return struct.pack("!HHIIBBHHH", sport, dport, 1, 2, offset << 4, flags, 500, 0xCAFE, 0) + options + payload


def eth(body, kind=0x0800, tags=b""):
    return b"\xaa" * 6 + b"\xbb" * 6 + tags + struct.pack("!H", kind) + body


def frame(sport=50000, dport=443, payload=b"", flags=0x18, src="10.0.0.1", dst="10.0.0.2"):
    return eth(ip4(src, dst, 6, tcp(sport, dport, flags, payload)))


def record(kind, declared, body):
    return bytes([kind, 3, 3]) + struct.pack("!H", declared) + body


def table(spark, frames):
    return spark.createDataFrame([("c", i, i, 1, f) for i, f in enumerate(frames)], captures.PACKETS)


def masked(spark, frames):
    return [bytes(r.data) for r in tls.mask(table(spark, frames)).orderBy("packet_index").collect()]


def test_parse_vectors(spark):
    udp = struct.pack("!HHHH", 5353, 53, 8, 0)
    v6 = struct.pack("!IHBB", 6 << 28, 0, 17, 64) + bytes.fromhex("20010db8000000000000000000000001") + b"\0" * 16 + udp
    frames = [
        eth(ip4("192.168.1.100", "10.0.0.1", 6, tcp(12345, 80, 0x02))),
        eth(ip4("192.168.1.100", "10.0.0.1", 6, tcp(12345, 80, 0x10))),
        eth(ip4("192.168.1.100", "10.0.0.1", 17, udp)),
        b"too_short",
        eth(ip4("1.2.3.4", "5.6.7.8", 6, tcp(1, 2, 0x12)), tags=b"\x81\x00\x00\x05"),
        eth(v6, 0x86DD),
        eth(ip4("1.2.3.4", "5.6.7.8", 1, b"ping")),
        eth(ip4("1.2.3.4", "5.6.7.8", 6, tcp(1, 2, 2))[:33]),
    ]
    got = [
        (r.src, r.sport, r.dst, r.dport, r.proto, r.is_syn)
        for r in packets.parse(table(spark, frames)).orderBy("packet_index").collect()
    ]
    assert got[0] == ("192.168.1.100", 12345, "10.0.0.1", 80, "TCP", True)
    assert got[1][-1] is False and got[2] == ("192.168.1.100", 5353, "10.0.0.1", 53, "UDP", False)
    assert got[3] == (None,) * 6
    assert got[4] == ("1.2.3.4", 1, "5.6.7.8", 2, "TCP", True)
    assert got[5][0] == "2001:db8::1" and got[5][2] == "::"
    assert got[6] == ("1.2.3.4", 0, "5.6.7.8", 0, "other", False)
    assert got[7] == (None,) * 6


def test_deep_tags_and_labels_are_masked(spark):
    inner = ip4("9.9.9.9", "8.8.8.8", 6, tcp(1, 2, 2))
    tags = b"\x81\x00\x00\x01" * 7
    labels = b"\x00\x01\x00\x40" * 6 + b"\x00\x01\x01\x40"
    got = masked(spark, [eth(inner, tags=tags), eth(labels + inner, 0x8847), eth(labels[:-5], 0x8847)])
    assert got[0][14 + 28 + 12 : 14 + 28 + 20] == bytes(8)
    assert got[1][14 + 28 + 12 : 14 + 28 + 20] == bytes(8)
    assert got[2][12:] == eth(labels[:-5], 0x8847)[12:]


def test_header_fields(spark):
    got = masked(spark, [eth(ip4("10.0.0.1", "10.0.0.2", 6, tcp(50000, 80, 2, b"GET /", b"\x02\x04\x05\xb4")))])[0]
    assert got[:12] == bytes(12) and got[18:20] == bytes(2) and got[24:34] == bytes(10)
    assert got[34:38] == struct.pack("!HH", 50000, 80) and got[38:46] == bytes(8)
    assert got[50:52] == bytes(2) and got[54:58] == bytes(4) and got[58:] == b"GET /"


def test_udp_and_ssh(spark):
    udp = lambda port, body: eth(ip4("1.1.1.1", "2.2.2.2", 17, struct.pack("!HHHH", 40000, port, 8 + len(body), 0xD00D) + body))
    got = masked(spark, [udp(443, b"q" * 48), udp(53, b"dns"), frame(dport=22, payload=b"SSH-2.0-x"), frame(dport=22, payload=b"z" * 64)])
    assert got[0][34:40] == struct.pack("!HHH", 40000, 443, 56) and got[0][40:] == bytes(50)
    assert got[1][42:] == b"dns" and got[1][40:42] == bytes(2)
    assert got[2][54:] == b"SSH-2.0-x" and got[3][54:] == bytes(64)


def steps(*payloads):
    state, out = (0, False, False), []
    for p in payloads:
        buf = bytearray(p)
        state = walk(buf, *state)
        out.append(bytes(buf))
    return out, state


def test_walk_vectors():
    a, b = record(0x17, 300, b"x" * 100), b"y" * 200
    out, state = steps(a, b)
    assert out == [a[:5] + bytes(100), bytes(200)] and state == (0, True, True)
    first = record(0x17, 10, b"x" * 10) + record(0x17, 100, b"x" * 20)
    assert steps(first)[1] == (80, True, True)
    out, state = steps(first, b"y" * 80)
    assert out[1] == bytes(80) and state[0] == 0
    first, rest = record(0x16, 200, b"x" * 50), b"\x17" + b"y" * 149
    out, state = steps(first, rest)
    assert out == [first, rest] and state == (0, False, True)
    plain = b"GET /shell?cmd=id HTTP/1.1\r\n"
    assert steps(plain) == ([plain], (0, False, False))
    out, _ = steps(record(0x17, 10, b"x" * 10), b"g" * 60)
    assert out[1] == bytes(60)


@pytest.mark.parametrize("chunk", [1000, 3])
def test_tls_streams_do_not_depend_on_chunks(spark, limits, chunk):
    limits(tlsChunk=chunk)
    body = bytes(range(1, 251)) * 8
    stream = b"".join(record(k, n, body[:n]) for k, n in ((0x16, 90), (0x17, 700), (0x17, 15), (0x16, 300), (0x17, 900), (0x15, 2)))
    cuts = [stream[i : i + 61] for i in range(0, len(stream), 61)]
    frames = []
    for c in cuts:
        frames += [frame(payload=c), frame(sport=50001, payload=c), frame(payload=b"GET / HTTP/1.1", sport=50002)]
    got = masked(spark, frames)
    want, _ = steps(*cuts)
    assert [g[54:] for g in got[0::3]] == want and [g[54:] for g in got[1::3]] == want
    assert all(g[54:] == b"GET / HTTP/1.1" for g in got[2::3])


def test_other_profiles(spark):
    f = frame(payload=record(0x17, 4, b"data") + b"more")
    v1 = bytes(masking.mask_v1(table(spark, [f])).first().data)
    assert v1[59:] == bytes(8) and v1[38:46] == f[38:46] and v1[26:34] == bytes(8)
    fixed = bytes(masking.mask_fixed(table(spark, [f])).first().data)
    assert fixed == bytes(12) + f[12:26] + bytes(8) + f[34:]


def pcap(frames, order="<", nano=False):
    magic = 0xA1B23C4D if nano else 0xA1B2C3D4
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, 1)
    for i, f in enumerate(frames):
        out += struct.pack(order + "IIII", 100 + i, 5000 if nano else 5, len(f), len(f)) + f
    return out


def pcapng(frames):
    def block(kind, body):
        body += bytes(-len(body) % 4)
        return struct.pack("<II", kind, 12 + len(body)) + body + struct.pack("<I", 12 + len(body))

    out = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1))
    out += block(1, struct.pack("<HHI", 1, 0, 0) + struct.pack("<HHB3x", 9, 1, 9) + struct.pack("<HH", 0, 0))
    for i, f in enumerate(frames):
        ticks = (100 + i) * 10**9 + 5000
        out += block(6, struct.pack("<IIIII", 0, ticks >> 32, ticks & 0xFFFFFFFF, len(f), len(f)) + f)
    return out


def test_capture_files_are_read_in_splits(spark, tmp_path):
    frames = [frame(payload=bytes([i]) * (i + 1)) for i in range(60)]
    (tmp_path / "a.pcap").write_bytes(pcap(frames))
    (tmp_path / "b.pcap").write_bytes(pcap(frames, ">", True))
    (tmp_path / "c.pcapng").write_bytes(pcapng(frames))
    (tmp_path / "d.pcap.gz").write_bytes(gzip.compress(pcap(frames)))
    (tmp_path / "notes.txt").write_text("x")
    for split in (500, 1 << 20):
        got = captures.read_captures(spark, str(tmp_path), split).collect()
        for name in ("a.pcap", "b.pcap", "c.pcapng", "d.pcap.gz"):
            mine = sorted((r.packet_index, r.ts_us, r.linktype, bytes(r.data)) for r in got if r.capture == name)
            assert mine == [(i, (100 + i) * 1_000_000 + 5, 1, f) for i, f in enumerate(frames)], name
    files = captures.listing(spark, str(tmp_path))
    kinds = {r.name: r.kind for r in captures.inventory(files).collect()}
    assert kinds == {"a.pcap": "raw", "b.pcap": "raw", "c.pcapng": "raw", "d.pcap.gz": None, "notes.txt": None}
    used = spark.createDataFrame([("a.pcap",)], "name string")
    assert [r.name for r in captures.attack_files(files, used, 5).collect()] == ["b.pcap", "c.pcapng", "d.pcap.gz"]


def test_simple_packet_blocks_lose_their_padding(spark, tmp_path):
    def block(kind, body):
        body += bytes(-len(body) % 4)
        return struct.pack("<II", kind, 12 + len(body)) + body + struct.pack("<I", 12 + len(body))

    packets = [b"abcde", b"x" * 8, b"cut here" + b"y" * 30]
    for snap in (0, 9):
        out = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, snap))
        for p in packets:
            out += block(3, struct.pack("<I", len(p)) + p[: snap or None])
        folder = tmp_path / str(snap)
        folder.mkdir()
        (folder / "s.pcapng").write_bytes(out)
        for split in (50, 1 << 20):
            got = captures.read_captures(spark, str(folder), split).orderBy("packet_index").collect()
            assert [bytes(r.data) for r in got] == [p[: snap or None] for p in packets]


def test_flow_table(spark, tmp_path):
    def row(src="1.1.1.1", sport="0x50", proto="tcp", label="1", cat=" DoS "):
        c = [""] * 49
        c[0], c[1], c[2], c[3], c[4], c[28], c[29], c[47], c[48] = src, sport, "2.2.2.2", "443", proto, "100", "200", cat, label
        return ",".join(c)

    lines = [row(), row(label="0"), row(proto="ospf"), row(sport="x1"), row(cat=""), "a,b,c", row(sport="")]
    (tmp_path / "f.csv").write_text("\n".join(lines))
    got = documents.attack_flows(spark, str(tmp_path)).orderBy("ordinal").collect()
    assert [(r.sport, r.proto, r.cat) for r in got] == [(80, 6, "dos"), (80, 6, "unknown"), (0, 6, "dos")]


def test_flow_window_vector(spark):
    rows = [("A", 0, b"\xaa" * 300), ("B", 1, b"\xbb" * 300), ("A", 2, b"\xaa" * 250)]
    df = spark.createDataFrame(rows, "flow string, packet_index long, data binary").withColumn("ts_us", F.col("packet_index"))
    got = windows.packet_windows(df, ["flow"], [F.col("packet_index")], 512).collect()
    assert [(r.flow, r.ts_us, bytes(r.bytes)) for r in got] == [("A", 0, b"\xaa" * 512)]


def test_entropy_and_pads(spark):
    df = spark.createDataFrame([(bytes(range(256)),), (b"a" * 100,), (b"",)], "data binary")
    got = [r.e for r in df.select(windows.byte_entropy("data").alias("e")).collect()]
    assert got[0] == pytest.approx(8.0, abs=1e-5) and abs(got[1]) < 1e-3 and got[2] == 0.0
    one = spark.createDataFrame([(b"\x00\xff",)], "data binary").select(windows.bytes_array("data", 4).alias("a")).first().a
    assert one == [0, 255, -1, -1]


def test_frames_are_labelled_from_the_flow_table(spark, tmp_path):
    def row(src, sport, proto, cat):
        c = [""] * 49
        c[0], c[1], c[2], c[3], c[4], c[28], c[29], c[47], c[48] = src, sport, "10.0.0.1", "80", proto, "0", "9", cat, "1"
        return ",".join(c)

    (tmp_path / "f.csv").write_text("\n".join([row("192.168.1.100", "12345", "tcp", "dos"), row("9.9.9.9", "1", "udp", "fuzz")]))
    flows = documents.attack_flows(spark, str(tmp_path))
    frames = [frame(n, 80, src="192.168.1.100", dst="10.0.0.1") for n in (12345, 5)]
    rows = match.flow_fields(packets.parse(table(spark, frames)).withColumn("ts_us", F.lit(3_000_000)))
    got = match.label_packets(rows.withColumn("capture", F.lit("c")), flows, ["capture"], "relaxed").orderBy("packet_index")
    assert [(r.proto, r.tier, r.cat) for r in got.collect()] == [(6, "5tuple", "dos"), (6, "pair", "dos")]


def test_large_model_keeps_windows_of_equal_keys_apart(spark, limits):
    texts = [("k", b"abcabcabd" * 5), ("k", b"abcabcabd" * 5), ("k", b"zyxwvabca" * 4), (None, b"abcd" * 9), ("short", b"ab")]
    df = spark.createDataFrame(texts, "win string, bytes binary")
    model = ngram.train(df, 2)

    def scores():
        return sorted((str(r.win), round(r.mean_bits, 9), round(r.max_bits, 9), round(r.topk_bits, 9)) for r in ngram.score_windows(df, model, 2).collect())

    def arrays():
        return sorted((str(r.win), [round(b, 9) for b in r.bits]) for r in ngram.bits_arrays(df, model, ["win"], 2).collect())

    def marks():
        return sorted((str(r.win), r.spikes) for r in ngram.spikes(df, model, ["win"], 2.0, 2).collect())

    near = scores(), arrays(), marks()
    limits(modelRows=1)
    assert (scores(), arrays(), marks()) == near
    assert [len(x) for x in near] == [4, 5, 5]


def test_large_model_paths_agree(spark, limits):
    texts = [(i, bytes((j * j + i) % 23 + 97 for j in range(60 + i))) for i in range(40)]
    df = spark.createDataFrame(texts, "win long, bytes binary")
    model = ngram.train(df.where("win < 20"), 2)
    near = {r.win: (r.mean_bits, r.max_bits, r.topk_bits) for r in ngram.score_windows(df, model, 2).collect()}
    near_bits = {r.win: r.bits for r in ngram.bits_arrays(df, model, ["win"], 2).collect()}
    near_marks = {r.win: r.spikes for r in ngram.spikes(df, model, ["win"], 2.0, 2).collect()}
    limits(modelRows=5)
    far = {r.win: (r.mean_bits, r.max_bits, r.topk_bits) for r in ngram.score_windows(df, model, 2).collect()}
    assert far.keys() == near.keys()
    for k in near:
        assert far[k] == pytest.approx(near[k])
    for r in ngram.bits_arrays(df, model, ["win"], 2).collect():
        assert r.bits == pytest.approx(near_bits[r.win])
    for r in ngram.spikes(df, model, ["win"], 2.0, 2).collect():
        assert r.spikes == near_marks[r.win]


def test_frames_of_more_users_than_two_bytes_hold(spark, tmp_path):
    """users above 65535 were cut to four digits in the frame."""
    users = [0, 5, 65535, 65536, 70000, 90001]
    rows = [(i, u, kind, 1.0, '{"k": 3}') for i, (u, kind) in enumerate((u, k) for u in users for k in ("click", "signup"))]
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string")
    df.withColumn("ts", F.timestamp_micros(F.col("event_id"))).write.parquet(str(tmp_path / "events.parquet"))
    got = [r.src for r in frames.frame_parse(spark, str(tmp_path)).orderBy("packet_index").collect()]
    assert got == [s for u in users for s in (f"10.0.{u // 256}.{u % 256}", f"fd00::{u:x}" if u else "fd00::")]


def test_a_batch_is_masked_in_pieces(spark, monkeypatch):
    """pieces of a batch give what the whole batch gives, and hold a bounded number of bytes."""
    frames_ = [frame(payload=record(0x17, n, b"x" * n)) for n in (5, 0, 900, 40, 41, 3000, 7)]
    held, whole = [], masking._masked_full
    want = whole(pd.Series(frames_))
    monkeypatch.setattr(masking, "_masked_full", lambda data: held.append(sum(map(len, data))) or whole(data))
    cut = masking.pieces
    monkeypatch.setattr(masking, "pieces", lambda sizes: cut(sizes, 1000))
    got = masking._mask_full.func(pd.Series(frames_))
    assert got.equals(want) and len(held) > 2 and sum(held) == sum(map(len, frames_))
