"""The text operators against brute force, on rows with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from packetgrain.llm import (
    decontaminate,
    language,
    license_scan,
    main_text,
    packing,
    quality,
    queries,
    simhash,
    suffix_dedup,
    syncmers,
    token_store,
)

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SHARED = " ".join(f"passage{i} word" for i in range(40))


def texts():
    rnd = random.Random(5)
    some = ["".join(rnd.choice("abcdefg hé ") for _ in range(rnd.randint(0, 700))) for _ in range(20)]
    return [
        *some,
        some[0],
        some[0],
        None,
        "",
        " \n ",
        "a" * 900,
        "ab" * 300,
        "é" * 250,
        "Under the MIT License. CC BY 4.0, GNU General Public License; mit license",
        "start " + SHARED,
        SHARED + " end",
        "one " + SHARED[10:330] + " two " + SHARED[20:300],
        "word " * 9000,
        some[1][:200] + "Q" + some[1][201:],
    ]


def table(spark, rows=None):
    rows = texts() if rows is None else rows
    # Columns named like the operators' own, to clash with them.
    made = [(i, t, "x", 1, -1, "q") for i, t in enumerate(rows)]
    return spark.createDataFrame(
        made, "doc_id long, text string, item string, node int, quality_score int, main_text string"
    )


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, []).cache()


def by_id(frame):
    return {r["doc_id"]: r for r in frame.collect()}


def strings_removed(rows, width=200):
    seen = Counter(t[i : i + width] for t in rows for i in range(len(t) - width + 1))
    for t in rows:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                gone[i : i + width] = True
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        spans = int((gone[1:] < gone[:-1]).sum())
        yield len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 1])
def test_suffix_dedup(spark, hot):
    rows = [t for t in texts() if t is None or len(t) < 5000]
    got = by_id(suffix_dedup.deduplicate(table(spark, rows), hot=hot))
    want = list(strings_removed([(t or "").encode() for t in rows]))
    assert [(got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) for i in range(len(rows))] == want
    assert sum(w[1] for w in want) > 1000


def test_equal_strings():
    rnd = np.random.default_rng(3)
    data = rnd.integers(97, 99, 4000).astype(np.uint8)
    data[2002:2602] = data[100:700]
    data[3004:3504] = data[100:600]
    starts = np.arange(0, len(data) - 200, 3)
    group = starts % 2
    found = suffix_dedup.equal_strings(data, starts, group)
    seen = Counter((g, data[s : s + 200].tobytes()) for s, g in zip(starts, group, strict=True))
    assert found.tolist() == [seen[g, data[s : s + 200].tobytes()] for s, g in zip(starts, group, strict=True)]
    assert found.max() > 1


def encoded(name, end):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    tokenizer.encode_special_tokens = True
    return [tokenizer.encode(t or "", add_special_tokens=False).ids + [end] for t in texts()]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_store(spark, docs):
    path = token_store.folder(spark)
    schema = token_store.write(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    got = by_id(token_store.digests(token_store.read(spark, path, schema)))
    start = 0
    for i, ids in enumerate(encoded("byte_bpe_50k.json", 0)):
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)
    assert [r.doc_id for r in token_store.read(spark, path, schema, ids=[3]).collect()] == [3]


def test_packing(spark, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    want = encoded("word_bpe_49k.json", 1)
    rows = packing.sequences(docs, path, "word_end", 1).collect()
    held = {}
    for r in rows:
        assert r.start == 4096 * r.piece
        assert r.ids_crc32 == crc(want[r.doc_id][r.start : r.start + r.length])
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in rows) == sum(map(len, want))
    for places in held.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(held) == -(-sum(map(len, want)) // 4096)
    whole = packing.token_sequences(docs, path, "word_end", 1)
    assert whole.select(F.sum(F.size("ids"))).first()[0] == sum(map(len, want))


def fingerprint(text, size=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    runs = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(n, near):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if near(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash(docs):
    prints = [fingerprint(t) for t in texts()]
    want = linked(len(prints), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    got = by_id(simhash.classes(docs))
    assert [(got[i].fingerprint, got[i].component_id) for i in range(len(prints))] == [
        (f"{p:016x}", c) for p, c in zip(prints, want, strict=True)
    ]


def test_links_in_leaves_of_few_homes_and_many_guests(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 10)
    monkeypatch.setattr(simhash, "LEAST_DEPTH", 8)
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, 1 + i % 4, replace=False)) for i in range(300)], np.uint64)
    prints = np.unique(np.concatenate([base, base ^ flips])).view(np.int64).tolist()
    nodes = spark.createDataFrame([(p, [p]) for p in prints], "node long, print array<long>")
    found = {frozenset((r["u"], r["v"])) for r in simhash.links(nodes, 4).collect()}
    mask = (1 << 64) - 1
    near = {frozenset((a, b)) for i, a in enumerate(prints) for b in prints[:i] if ((a ^ b) & mask).bit_count() <= 4}
    assert len(near) >= 300 and found == near


def test_near_duplicates(spark):
    rnd = random.Random(9)
    base = [[f"w{rnd.randint(0, 400)}" for _ in range(300)] for _ in range(12)]
    rows = [" ".join(b) for b in base]
    rows += [" ".join([*b[:150], "new", *b[151:]]) for b in base] + [rows[0], None, ""]
    sets = []
    for t in rows:
        w = (t or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    near = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    got = by_id(simhash.near_duplicates(table(spark, rows)))
    assert [got[i].component_id for i in range(len(rows))] == linked(len(rows), near)


def five_words(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_wanted(rows):
    sets = [five_words(t) for t in rows]
    return linked(len(rows), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))


@pytest.mark.parametrize("texts_", [1024, 7])
def test_near_duplicates_among_variants_of_a_template(spark, monkeypatch, texts_):
    monkeypatch.setattr(simhash, "GROUP_TEXTS", texts_, raising=False)
    rnd = random.Random(4)
    base, rows = [f"w{i}" for i in range(300)], []
    for i in range(60):
        w = list(base)
        for at in rnd.sample(range(300), 4 + i % 5):
            w[at] = f"v{rnd.randint(0, 999_999)}"
        rows.append(" ".join(w))
    got = by_id(simhash.near_duplicates(table(spark, rows)))
    want = near_wanted(rows)
    assert 1 < len(set(want)) < 60
    assert [got[i].component_id for i in range(len(rows))] == want


def test_near_duplicates_with_repeated_lines(spark):
    rnd = random.Random(6)
    rows = []
    for i in range(40):
        w = [f"w{rnd.randint(0, 9999)}" for _ in range(200)]
        rows.append(" ".join(w))
        rows.append(" ".join(w + w[:10] * (1 + 5 * i)))
    got = by_id(simhash.near_duplicates(table(spark, rows)))
    assert [got[i].component_id for i in range(len(rows))] == near_wanted(rows) == [i // 2 * 2 for i in range(80)]


def test_texts_dominated_by_one_shingle_differ(spark):
    rows = [f"{'= ' * 200}" + " ".join(f"{k}of{i}" for k in range(60)) for i in range(8)]
    got = by_id(simhash.near_duplicates(table(spark, rows)))
    assert [got[i].component_id for i in range(len(rows))] == near_wanted(rows) == list(range(8))


def test_pipeline_stage_takes_candidates_from_simhash_trees(spark, monkeypatch):
    rnd = random.Random(3)
    rows = []
    for _ in range(60):
        # Two sets of 104 shingles with 93 in common: Jaccard 0.81.
        w = [f"w{rnd.randint(0, 9999)}" for _ in range(108)]
        rows += [" ".join(w), " ".join([*w[:97], *[f"v{rnd.randint(0, 9999)}" for _ in range(11)]])]
    asked, links = [], simhash.links

    def watched(nodes, radius, lanes, *more):
        asked.append((nodes.collect(), radius, lanes))
        return links(nodes, radius, lanes, *more)

    monkeypatch.setattr(simhash, "links", watched)
    kept = corpus_pipeline.simhash_near_dedup(spark, table(spark, rows), "").collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(near_wanted(rows))) == list(range(0, 120, 2))
    [(nodes, radius, lanes)] = asked
    assert (lanes, radius) == simhash.near_settings(0.8) and len(nodes) == 120
    words_ = rows[0].split()
    hashes = {xxhash.xxh64_intdigest(" ".join(words_[i : i + 5]), 42) for i in range(104)}
    first = sum((sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) << b for b in range(64))
    assert first in {r["print"][0] % (1 << 64) for r in nodes}


@pytest.mark.parametrize("texts_", [1024, 40])
def test_edges_of_one_large_near_group_grow_with_its_members(spark, monkeypatch, texts_):
    monkeypatch.setattr(simhash, "GROUP_TEXTS", texts_)
    rnd = random.Random(12)
    base = [f"w{rnd.randint(0, 9999)}" for _ in range(150)]
    rows = []
    for i in range(300):
        w = list(base)
        w[rnd.randrange(150)] = f"v{i}"
        rows.append(" ".join(w))
    rows += [" ".join(f"x{rnd.randint(0, 9999)}" for _ in range(80)) for _ in range(20)]
    seen, components = [], simhash.graph.components

    def watched(edges):
        seen.append(edges.count())
        return components(edges)

    monkeypatch.setattr(simhash.graph, "components", watched)
    got = by_id(simhash.near_duplicates(table(spark, rows)))
    assert [got[i].component_id for i in range(320)] == near_wanted(rows) == [0] * 300 + list(range(300, 320))
    # Candidates: about one edge a member, not one for each of 44 bands. Confirmed: one a member and pair of blocks it is in.
    assert 299 <= seen[0] <= 450 and 299 <= seen[1] <= 300 * -(-300 // texts_)
    got = by_id(simhash.classes(table(spark, rows)))
    assert seen[2] <= 450 and len({got[i].component_id for i in range(300, 320)}) == 20


def test_confirmed_edges_of_a_group_dealt_as_blocks_grow_with_its_members(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP_TEXTS", 20)
    rnd = random.Random(16)
    base = [f"w{rnd.randint(0, 9999)}" for _ in range(150)]
    seen, components = [], simhash.graph.components

    def watched(edges):
        seen.append(edges.count())
        return components(edges)

    monkeypatch.setattr(simhash.graph, "components", watched)
    for n in (120, 240):
        rows = [" ".join([*base[: i % 150], f"v{i}", *base[i % 150 + 1 :]]) for i in range(n)]
        got = by_id(simhash.near_duplicates(table(spark, rows)))
        assert {got[i].component_id for i in range(n)} == {0}
    # A member is in 6 and 12 pairs of blocks, and is tied once; so are the smallest nodes of the pairs, in a block about four.
    assert 119 <= seen[1] <= 2 * 120 and 239 <= seen[3] <= 2 * 240, seen


@pytest.mark.parametrize("block", [10, 1 << 15])
def test_ties_keep_the_components_of_links(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(15)
    # Chains: each fingerprint is up to three bits from the one before it, so their ends are far apart.
    prints = []
    for _ in range(12):
        x = int(rng.integers(0, 1 << 63))
        for _ in range(20):
            prints.append(x)
            x ^= sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
    prints = np.unique(np.array(prints, np.uint64)).view(np.int64).tolist()
    nodes = spark.createDataFrame([(i, [p]) for i, p in enumerate(prints)], "node long, print array<long>")
    ties = [tuple(r) for r in simhash.links(nodes, 4, ties=True).collect()]
    assert all(v < u for u, v in ties)
    mask, tied = (1 << 64) - 1, {frozenset(t) for t in ties}
    want = linked(len(prints), lambda i, j: ((prints[i] ^ prints[j]) & mask).bit_count() <= 4)
    assert linked(len(prints), lambda i, j: frozenset((i, j)) in tied) == want
    assert 1 < len(set(want)) <= 12


def test_stages_judge_rows_of_null_and_repeated_ids(spark, tmp_path):
    rnd = random.Random(8)
    some = [" ".join(f"w{rnd.randint(0, 9999)}" for _ in range(100)) for _ in range(6)]
    near = some[0] + " more"
    rows = [(None, some[0]), (None, near), (None, some[1]), (None, some[1]), (7, some[2]), (7, some[3]), (7, some[3]),
            (8, some[4]), (None, some[4]), (9, some[5] + " end"), (3, some[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in corpus_pipeline.simhash_near_dedup(spark, docs, "").collect()]
    assert Counter(r for r in got if r[1] not in (some[0], near)) == Counter(
        [(None, some[1]), (7, some[2]), (7, some[3]), (8, some[4]), (3, some[5])]
    )
    assert len(got) == 6
    spark.createDataFrame([("b", some[1]), ("c", some[2])], "item_id string, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet"
    )
    got = [tuple(r) for r in corpus_pipeline.benchmark_decontamination(spark, docs, str(tmp_path)).collect()]
    assert Counter(got) == Counter(r for r in rows if r[1] not in (some[1], some[2]))


def test_decontamination(spark, docs):
    items = [("b", SHARED[:200]), ("a", "mit license"), ("c", ""), ("d", None), ("e", SHARED[:200])]
    got = by_id(
        decontaminate.contaminated(
            decontaminate.occurrences(docs, spark.createDataFrame(items, "item_id string, text string"))
        )
    )
    for i, text in enumerate(texts()):
        words = WORD.findall((text or "").translate(LOWER))
        hit, held = set(), set()
        for name, item in items:
            own = WORD.findall((item or "").translate(LOWER))
            n = min(len(own), 13)
            for k in range(len(own) - n + 1 if own else 0):
                for p in range(len(words) - n + 1):
                    if words[p : p + n] == own[k : k + n]:
                        hit |= set(range(p, p + n))
                        held.add(name)
        row = got[i]
        assert (row.n_words, row.n_hit, sorted(row["items"])) == (len(words), len(hit), sorted(held)), i
        assert row.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(words))


def test_syncmers(docs):
    rows = texts()
    got = by_id(syncmers.edited_pairs(docs))
    assert len(got) == len(rows)
    for i, text in enumerate(rows):
        text, other = text or "", rows[i - 1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        assert got[i].n_chars == len(text)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[0].fingerprint == got[20].fingerprint == got[21].fingerprint and got[21].near_next == 1
    assert got[22].fingerprint == "" and got[23].near_next == 1


def test_syncmers_do_not_depend_on_context(spark):
    rnd = random.Random(2)
    words = [f"w{rnd.randint(0, 99)}" for _ in range(300)]
    rows = [" ".join(words), " ".join(["x", "y", "z", *words])]
    held = {0: set(), 1: set()}
    for r in syncmers.anchors(table(spark, rows)).collect():
        held[r.doc_id].add((r.position - 3 * r.doc_id, r.hash))
    assert held[0] == {a for a in held[1] if a[0] >= 0}
    assert len(held[0]) > 60


def test_license_scan(docs):
    base = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
    got = by_id(license_scan.labels(license_scan.scan(docs)))
    for i, text in enumerate(texts()):
        words = WORD.findall((text or "").translate(LOWER))
        places, labels = [], set()
        for phrase, label in base:
            own = phrase.split()
            found = [p for p in range(len(words)) if words[p : p + len(own)] == own]
            places += found
            labels |= {label} if found else set()
        row = got[i]
        assert (row.n_words, row.n_base, row.base_labels) == (len(words), len(places), ",".join(sorted(labels)))
        assert (row.first_word, row.last_word) == ((min(places), max(places)) if places else (None, None))
        assert labels <= set(row["labels"].split(","))


PAGE = """<html><head><title>no</title><script>var a="</p>";</script></head><body><header><a href="/">Home</a></header>
<nav><ul><li><a href="/a">menu</a></ul></nav><div class="cookie-notice"><p>We use cookies.</p></div>
<article><h1>Head &amp; line</h1><p><b>First   block of the text,<br>goes on here.<p>Second &eacute; block.</p>
<div class="ad">Buy this now.</div><ul><li>point one<li>point two</ul><form><label>mail</label></form></article>
<div id="comments"><p>A reader has written a longer comment here.</p></div><footer>&copy; all</footer></body></html>"""


def test_main_text(spark):
    want = "Head & line\nFirst block of the text, goes on here.\nSecond é block.\npoint one\npoint two"
    rows = [(1, "u", PAGE), (2, "v", None), (3, None, ""), (1, "u", PAGE), (4, "w", "<p" * 3000), (5, "x", "<![if a]><p>" * 9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("main_text", F.lit(0))
    got = main_text.extract(pages, main_text.fit(pages)).collect()
    assert len(got) == len(rows)
    assert [r.main_text for r in got if r.page_id == 1] == [want, want]
    assert [r.main_text for r in got if r.page_id in (2, 3)] == ["", ""]
    none = main_text.extract(pages.limit(0), main_text.fit(pages.limit(0)))
    assert none.count() == 0


@pytest.mark.parametrize(
    "html",
    [
        "<p>one.</p><svg width=1/><p>two.</p>",
        "<p>one.</p><math/><svg><path/><title/><circle/></svg><p>two.</p>",
        "<p>one.</p><svg><path d='x'><p>two.</p>",
        "<svg><foreignObject><p>no</p></foreignObject><desc/></svg><p>one.</p><p>two.</p>",
        "<html><head><title>no</title><meta charset=x><script>no</script><p>one.</p><p>two.</p>",
        "<head><title>no</title><style>no</style><svg/><p>one.</p><p>two.</p>",
        "<head><title>no</title></head><body><p>one.</p><p>two.</p>",
        "<div><p>one.</p><div><button><div>no</div>no</div><p>two.</p></div>",
        "<div><p>one.</p><div><object>no<p>no</div><p>two.</p></div>",
        "<p>one.</p><div><select><option>no</div><p>two.</p>",
        "<p>one.</p><button>no<button>no</button><p>two.</p>",
        "<p>one.</p><div><button><div>no</button></div><p>two.</p>",
    ],
)
def test_text_after_hidden_elements_stays(html):
    assert [text for _, text in main_text.parse(html).pieces] == ["one.", "two."]


def test_messages_give_exact_marginals():
    page = main_text.parse("<div><p>one two.</p><ul><li><a>x</a></li><li>y</li></ul></div><p>z.</p>")
    model = main_text.estimate(np.zeros((0, len(main_text.PRIOR))), np.zeros(0), np.zeros(0), np.zeros((2, 2, 2)))
    own = main_text.features(page) @ model.weights
    n = len(page.tag)
    weight = np.zeros((n, 2))
    for bits in range(1 << n):
        state = [bits >> i & 1 for i in range(n)]
        total = sum(own[i] for i in range(n) if state[i])
        for i in range(1, n):
            up = page.parent[i]
            total += model.pairs[main_text._firm(page, up), state[up], state[i]]
        for i in range(n):
            weight[i, state[i]] += np.exp(total)
    assert np.allclose(model.marginals(page), weight[:, 1] / weight.sum(axis=1))


def test_empty_tables(spark, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    path = public_tokenizers.path("word_bpe_49k.json")
    assert suffix_dedup.deduplicate(empty, with_text=True).count() == 0
    assert simhash.classes(empty).count() == simhash.near_duplicates(empty).count() == 0
    assert packing.sequences(empty, path, "word_end", 1).count() == 0
    assert syncmers.edited_pairs(empty).count() == syncmers.anchors(empty).count() == 0
    assert license_scan.labels(license_scan.scan(empty)).count() == 0
    model = quality.fit(empty, none)
    assert quality.score(empty, model).count() == 0
    spoken = empty.withColumn("lang", F.lit("en"))
    assert language.identify(spoken, language.fit(spoken)).count() == 0


def test_models_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.quality_score for r in quality.score(docs, quality.fit(docs, none)).collect()} == {0.5}
    unknown = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identify(unknown, language.fit(unknown)).collect()} == {"und"}


FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    marked = spark.read.parquet(f"{FOLDER}/labels.parquet")
    found = queries.op10_subword_quality(spark, FOLDER).where("held_out").join(marked, "doc_id").toPandas()
    good, bad = (found[found.quality == y].score.to_numpy() for y in (1, 0))
    assert (good[:, None] > bad[None]).mean() > 0.95
    assert ((found.predicted == found.quality).mean()) > 0.9
    spoken = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    rows = queries.op8_string_kernel(spark, FOLDER).where("held_out").join(spoken, "doc_id").toPandas()
    assert (rows.lang == rows.lang_pred).mean() > 0.97


def test_language_of_odd_rows(spark):
    rows = [(i, t, "en" if i % 2 else "fr") for i, t in enumerate(["le chat", "the dog", "la vie", "this is", "une", "that"] * 5)]
    rows += [(100, None, "en"), (101, "12 3!", "en"), (102, "", None), (103, "the that this", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit(3))
    got = by_id(language.identify(docs, language.fit(docs)))
    assert [got[i].lang_pred for i in (100, 101, 102, 103)] == ["und", "und", "und", "en"]
    assert all(0 <= r.lang_score <= 1 for r in got.values())


def test_suffix_stage_cuts_repeats_and_leaves_other_rows(spark):
    passage = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(300))
    rows = [(1, "A" + passage, 301, "x"), (2, passage + "\u00e9", 301, None), (3, None, None, "x"), (None, "short", 5, "x"),
            (4, "short", 5, "x"), (4, "", 0, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, digest string")
    got = corpus_pipeline.suffix_array_dedup(spark, docs, "")
    assert got.columns == docs.columns
    want = [(1, "A", 1, "x"), (2, "\u00e9", 1, None), *rows[2:]]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    texts = suffix_dedup.deduplicate(docs, with_text=True).collect()
    assert sorted((str(r.doc_id), r.kept) for r in texts) == sorted((str(w[0]), w[1] or "") for w in want)


def test_pipeline(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut(stage(spark, docs, folder))
        sizes.append(docs.count())
        assert name == "best_fit_packing" or docs.columns == columns
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3] >= sizes[4]
    fills = [r[0] for r in docs.groupBy("sequence_id").agg(F.sum("length")).collect()]
    assert max(fills) <= 4096


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names
    assert [n for n in range(1, 11) if not any(q.startswith(f"op{n}_") for q in names)] == []
