"""Fingerprints of closed syncmers: values against brute force, likeness of edited texts with and without spaces."""

import random
import re
import struct

import xxhash
from pyspark.sql import functions as F

from packetgrain.llm import syncmers

K, S, SIZE = syncmers.K, syncmers.S, syncmers.SIZE


def signed(value):
    return value - (1 << 64) if value >> 63 else value


def of_text(text):
    return signed(xxhash.xxh64(text.encode(), seed=42).intdigest())


def of_longs(*values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64(struct.pack("<q", v), seed=seed & (1 << 64) - 1).intdigest()
    return signed(seed)


def cut_up(text):
    out = []
    for run in re.findall(r"[^ \t\n\x0b\f\r]+", text or ""):
        out += [run] if len(run) <= 16 else list(run)
    return out


def kept(text):
    h = [of_text(t) for t in cut_up(text)]
    if len(h) < K:
        return [(0, of_longs(*h))] if h else []
    inner = [of_longs(a, b) for a, b in zip(h, h[1:])]
    out = []
    for i in range(len(h) - K + 1):
        least = min(inner[i : i + K - S + 1])
        if least in (inner[i], inner[i + K - S]):
            out.append((i, of_longs(inner[i], inner[i + S], h[i + K - 1])))
    return out


def sketch(text):
    return sorted({h >> 32 for _, h in kept(text)})[:SIZE]


def shown(found):
    return "".join(f"{h & 0xFFFFFFFF:08x}" for h in found)


def likeness(a, b):
    union = sorted({*a, *b})[:SIZE]
    return len({*union} & {*a} & {*b}) / len(union) if union else 1.0


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", -1) for i, t in enumerate(rows)], "doc_id long, text string, sketch string, cell int")


def mixed():
    rnd = random.Random(9)
    some = [" ".join(f"w{rnd.randint(0, 400)}" for _ in range(rnd.randint(0, 300))) for _ in range(12)]
    joined = ["".join(chr(rnd.randint(0x4E00, 0x4E80)) for _ in range(n)) for n in (3, 16, 17, 400)]
    return [*some, *joined, some[3], None, "", " \n", "one", "a b c d", "same " * 500, "x" * 5000, "x" * 16 + " " + "y" * 17 + "\tz"]


def test_fingerprints_and_likeness_equal_brute_force(spark):
    rows = mixed()
    got = {r.doc_id: r for r in syncmers.edited_pairs(table(spark, rows)).collect()}
    places: dict = {i: set() for i in range(len(rows))}
    for r in syncmers.anchors(table(spark, rows)).collect():
        places[r.doc_id].add((r.position, r.hash))
    assert len(got) == len(rows)
    for i, text in enumerate(rows):
        text, other = text or "", rows[i - 1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        assert places[i] == set(kept(text))
        assert got[i].fingerprint == shown(sketch(text))
        assert got[i].edited_fingerprint == shown(sketch(edited))
        assert abs(got[i].near_edited - likeness(sketch(text), sketch(edited))) < 1e-12
        assert abs(got[i].near_next - likeness(sketch(text), sketch(other))) < 1e-12


def test_one_inserted_character_changes_little(spark):
    rnd = random.Random(4)
    chinese = "".join(chr(rnd.randint(0x4E00, 0x9000)) for _ in range(3000))
    spaced = " ".join(f"w{rnd.randint(0, 10**6)}" for _ in range(2000))
    coded = "".join(rnd.choice("ABCDEFGHabcdefgh0123456789+/") for _ in range(4000))
    other = "".join(chr(rnd.randint(0x4E00, 0x9000)) for _ in range(3000))
    rows = []
    for text in (chinese, spaced, coded):
        rows.append((text, text[:1000] + "Q" + text[1000:]))
    rows.append((chinese, other))
    frame = spark.createDataFrame(rows, "a string, b string")
    near = frame.select(syncmers.likeness(syncmers.sketch(F.col("a")), syncmers.sketch(F.col("b"))).alias("n")).collect()
    assert all(r.n > 0.9 for r in near[:3]) and near[3].n < 0.05
