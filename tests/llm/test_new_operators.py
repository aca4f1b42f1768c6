"""Merkle manifest, URL aliases and periodic runs against brute force."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from packetgrain.llm import graph, language, merkle, periodic_runs, quality, queries, url_filter, url_sql

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, leaf string, _copy int, rank int"


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def docs():
    rnd = random.Random(11)
    rows = [(i, f"Text {rnd.random()} É", rnd.choice(["en", "en", "en", "de"]), "s", i, "k", "l", 1, 2) for i in range(150)]
    return [
        *rows,
        (None, None, None, None, None, None, None, None, None),
        (None, "Null id", "en", "s", 1, None, None, None, None),
        (7, "other text, same id", "en", "s", 1, None, None, None, None),
        rows[3],
        rows[3],
        (900, "", "", "", 0, None, None, None, None),
        (901, "Alone " * 50_000, "zz", "s", 300_000, None, None, None, None),
    ]


# Merkle manifest


def leaf(doc_id, source, lang, n_chars, text):
    return sha(
        b"".join(b"-" if v is None else b"%d:%s" % (len(str(v).encode()), str(v).encode()) for v in (doc_id, source, lang, n_chars, text))
    )


def climb(leaves):
    """Root and the siblings of every leaf, level by level, left and right."""
    sides, place, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for k, at in enumerate(place):
            run = at // 8 * 8
            sides[k].append(("".join(level[run:at]), "".join(level[at + 1 : run + 8])))
            place[k] = at // 8
        level = [sha("".join(level[i : i + 8])) for i in range(0, len(level), 8)]
    return level[0], sides


def merkle_rows(rows):
    leaves = [leaf(r[0], r[3], r[2], r[4], r[1]) for r in rows]
    keys = sorted({r[2] for r in rows}, key=lambda k: (k is not None, (k or "").encode()))
    of = {k: sorted((i for i, r in enumerate(rows) if r[2] == k), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, leaves[i])) for k in keys}
    below = {k: climb([leaves[i] for i in of[k]]) for k in keys}
    root, above = climb([below[k][0] for k in keys])
    out = []
    for k, up in zip(keys, above, strict=True):
        for i, sides in zip(of[k], below[k][1], strict=True):
            r, now = rows[i], leaves[i]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None:
                now = leaf(r[0], r[3], r[2], r[4], r[1].translate(LOWER))
            for left, right in sides + up:
                now = sha(left + now + right)
            proof = sha("".join(a + b for a, b in sides + up))
            out.append((r[0], leaves[i], below[k][0], root, proof, now, now == root))
    return out


def order(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("levels", [4, 1, 2])
def test_merkle_manifest_at_any_block_height(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle.manifest, "__defaults__", (levels,))
    monkeypatch.setattr(queries, "table", lambda *_: spark.createDataFrame(docs(), DOCS).repartition(5))
    got = queries.op11_merkle_veb(spark, "")
    assert order(got.collect()) == order(merkle_rows(docs()))


def test_merkle_sql_on_the_same_rows(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    # The SQL knows equal rows by nothing; they would be one place.
    rows = list(dict.fromkeys(r[:5] for r in docs()))
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    assert order(con.execute(queries.ORACLE["op11_merkle_veb"]).fetchall()) == order(merkle_rows(rows))


def test_merkle_proofs_lead_to_the_root(spark):
    rows = spark.createDataFrame(docs(), DOCS).select(F.col("lang").alias("key"), "doc_id", merkle.leaf_of(F.col("text")).alias("leaf"))
    made = merkle.manifest(rows, 1)
    for row in merkle.proofs(made).collect():
        now = row["leaf"].hex()
        for left, right in row["sides"]:
            now = sha(left.decode() + now + right.decode())
        assert now == row["root"]


def test_merkle_of_an_empty_table(spark, monkeypatch):
    monkeypatch.setattr(queries, "table", lambda *_: spark.createDataFrame([], DOCS))
    assert queries.op11_merkle_veb(spark, "").collect() == []


@pytest.mark.parametrize("levels", [1, 2, 3, 4, 5])
def test_van_emde_boas_addresses(levels):
    """Every place is used once, and aligned bottom subtrees are stored without a gap."""
    places = [merkle.address(levels, d, np.arange(8**d)) for d in range(levels)]
    assert sorted(np.concatenate(places).tolist()) == list(range(merkle.nodes(levels)))
    if levels > 1:
        top = levels // 2
        for tree in range(8**top):
            inside = np.concatenate([p[tree * 8 ** (d - top) : (tree + 1) * 8 ** (d - top)] for d, p in enumerate(places) if d >= top])
            assert inside.max() - inside.min() + 1 == len(inside) == merkle.nodes(levels - top)


# URL aliases

PAGE = "page_id long, url string, html string, host string, node string, verdict string"


def link(target, head='<link rel="canonical" href="{}">'):
    return f"<html><head>{head.format(target)}</head><body>x</body></html>"


def pages():
    return [
        # Rules and host forms.
        (1, "http://A.Example.NET/en/1", "", "clash", "clash", "clash"),
        (2, "http://net/", "", None, None, None),
        (3, "http://notnet.example.org/x", "", None, None, None),
        (4, "HTTP://shop.example.com/de/5?x#y", "", None, None, None),
        (5, "http://example.net", "", None, None, None),
        (6, None, link("http://x.net/"), None, None, None),
        (7, "no address", link("http://x.net/"), None, None, None),
        (8, "", None, None, None, None),
        # A chain of links into a blocked host, through an address that is no page.
        (10, "https://a.org/1", link("http://b.org/2"), None, None, None),
        (11, "http://www.b.org/2/", link("2; URL='http://c.org/3?utm_source=q'", "<META content=\"{}\" http-equiv=Refresh>"), None, None, None),
        (12, "http://d.org/4", link("//c.org/3"), None, None, None),
        (13, "http://c.org/3#f", link("http://spam.net/z", "<link href={} rel='nofollow CANONICAL'>"), None, None, None),
        # An allowed member outweighs a blocked one for those without a rule.
        (20, "http://e.org/fr/1", link("http://spam.net/y"), None, None, None),
        (21, "http://f.org/q", link("http://e.org/fr/1"), None, None, None),
        # One node: the blocked directory and its name without a slash.
        (30, "http://example.com/de/", "", None, None, None),
        (31, "https://m.example.com/de", "", None, None, None),
        # Relative and unusable links, links in comments and scripts.
        (40, "http://g.org/a/b.html?k=1", link("c"), None, None, None),
        (41, "http://g.org/a/c", link("?p=2"), None, None, None),
        (42, "http://g.org/a/c?p=2", link("/t"), None, None, None),
        (43, "http://g.org/t", link("http://spam.net/"), None, None, None),
        (50, "http://h.org/1", "<!-- " + link("http://spam.net/") + " -->", None, None, None),
        (51, "http://h.org/2", link("x", "<script>var a='<link rel=canonical href=http://spam.net/>'</script>"), None, None, None),
        (52, "http://h.org/3", link("mailto:a@spam.net") + link("#top") + link(""), None, None, None),
        (53, "http://h.org/4", link("http://spam.net/", "<link rel=alternate href={}>"), None, None, None),
        (10, "https://a.org/1", "", None, None, None),
        (None, "https://a.org/1?ref=x", "", None, None, None),
    ]


EXPECTED = {
    1: ("a.example.net", "/en/1", "example.net/en/", "allow", "rule"),
    2: ("net", "/", "net/", "block", "rule"),
    3: ("notnet.example.org", "/x", None, "allow", "default"),
    4: ("shop.example.com", "/de/5", "example.com/de/", "block", "rule"),
    5: ("example.net", "", None, "allow", "default"),
    6: ("", "", None, "allow", "default"),
    7: ("", "", None, "allow", "default"),
    8: ("", "", None, "allow", "default"),
    10: ("a.org", "/1", None, "block", "alias"),
    11: ("www.b.org", "/2/", None, "block", "alias"),
    12: ("d.org", "/4", None, "block", "alias"),
    13: ("c.org", "/3", None, "block", "alias"),
    20: ("e.org", "/fr/1", "org/fr/", "allow", "rule"),
    21: ("f.org", "/q", None, "allow", "alias"),
    30: ("example.com", "/de/", "example.com/de/", "block", "rule"),
    31: ("m.example.com", "/de", None, "block", "alias"),
    40: ("g.org", "/a/b.html", None, "block", "alias"),
    41: ("g.org", "/a/c", None, "block", "alias"),
    42: ("g.org", "/a/c", None, "block", "alias"),
    43: ("g.org", "/t", None, "block", "alias"),
    50: ("h.org", "/1", None, "allow", "default"),
    51: ("h.org", "/2", None, "allow", "default"),
    52: ("h.org", "/3", None, "allow", "default"),
    53: ("h.org", "/4", None, "allow", "default"),
    None: ("a.org", "/1", None, "block", "alias"),
}


def test_url_aliases(spark):
    rows = spark.createDataFrame(pages(), PAGE)
    found = url_filter.judge(rows, queries.URL_RULES)
    got = found.collect()
    assert len(got) == len(pages())
    assert {r["page_id"]: tuple(r)[1:] for r in got} == EXPECTED
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", [r[:3] for r in pages()])
    assert order(con.execute(url_sql.sql(queries.URL_RULES)).fetchall()) == order(got)


def test_url_redirect_table_and_empty_pages(spark):
    rows = spark.createDataFrame([r for r in pages() if r[0] == 3], PAGE)
    moved = spark.createDataFrame([("http://notnet.example.org/x", "http://u.org/"), ("http://u.org/", "http://q.net/")], "source string, target string")
    assert [r["verdict"] for r in url_filter.judge(rows, queries.URL_RULES, moved).collect()] == ["block"]
    assert url_filter.judge(rows.limit(0), queries.URL_RULES).collect() == []


def test_url_dot_steps(spark):
    cases = {"../x": "http://a.org/x", "./y?q": "http://a.org/d/y?q", "../../../z": "http://a.org/z", "..": "http://a.org/", "e/./f/../g": "http://a.org/d/e/g"}
    rows = spark.createDataFrame([("http://a.org/d/p", k, v) for k, v in cases.items()], "base string, link string, want string")
    got = rows.select("want", url_filter.resolved(F.col("base"), F.col("link")).alias("got")).collect()
    assert all(r["got"] == r["want"] for r in got)


def test_url_python_free_plan(spark):
    rows = spark.createDataFrame(pages(), PAGE)
    plan = url_filter.judge(rows, queries.URL_RULES)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_hot_keys_meet_their_facts(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(900)] + [(f"k{i % 50}", i) for i in range(100)] + [(None, 1), ("none", 2)], "k string, v int")
    facts = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(60)], "k string, f int")
    for how in ("inner", "left"):
        got = graph.attach(rows, facts, "k", how).select("k", "v", "f").collect()
        assert order(got) == order(rows.join(facts, "k", how).select("k", "v", "f").collect())


# Periodic runs


def runs(w, least=24, power=3):
    out = []
    for q in range(1, len(w) // power + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(least, power * q):
                s = w[i : i + length]
                if not any(s[p:] == s[: length - p] for p in range(1, q)):
                    out.append((i, length, q))
            i = j + 1
    return sorted(out)


def planted(doc_id, text):
    w = [x for x in (text or "").encode().split()]
    if doc_id is not None and w and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def run_texts():
    rnd = random.Random(2)
    rows = []
    for i in range(300):
        w = [rnd.choice(["a", "b", "É", "c c", "D"][: rnd.choice([1, 2, 3, 5])]) for _ in range(rnd.randint(0, 120))]
        if rnd.random() < 0.5:
            w = w + w[: rnd.randint(1, 9)] * rnd.randint(2, 30) + w
        rows.append((i, rnd.choice([" ", "\n", "\t ", "\x0b"]).join(w)))
    return [*rows, (1, "x " * 40), (1, "x " * 40), (None, "x y " * 40), (None, None), (500, ""), (501, " \n "), (502, "one two " * 60_000), (503, " ".join(f"w{i % 4001}" for i in range(30_000)))]


def test_periodic_runs(spark, monkeypatch):
    rows = run_texts()
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, runs string, n int")
    monkeypatch.setattr(queries, "table", lambda *_: frame)
    want = []
    for doc_id, text in rows:
        w = planted(doc_id, text)
        # Brute force is quadratic; the long texts have one known run.
        found = {502: [(0, 120_000, 2)], 503: [(0, 30_000, 4001)]}.get(doc_id) or runs(w)
        dropped = {i for s, length, q in found for i in range(s + q, s + length)}
        best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if found else (None, None, None)
        milli = best[1] * 1000 // best[2] if found else None
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
        kept = b" ".join(x for i, x in enumerate(w) if i not in dropped)
        want.append((doc_id, len(found), *best, milli, sha(lines), sha(kept)))
    assert order(queries.op13_lcp_runs(spark, "").collect()) == order(want)
    assert sum(w[1] for w in want) > 100
    monkeypatch.setattr(queries, "table", lambda *_: frame.limit(0))
    assert queries.op13_lcp_runs(spark, "").collect() == []


def test_runs_of_small_powers():
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice("ab") for _ in range(rnd.randint(0, 40))).encode() for _ in range(200)]
    for least, power in ((1, 2), (6, 3), (9, 4)):
        got = [found for _, found in periodic_runs.found_in(texts, least, power)]
        assert got == [runs(t.split(), least, power) for t in texts]


# Bounds and names


def test_fits_bring_a_bounded_number_of_rows(spark, monkeypatch):
    rows = [(i if i % 2 else 7, f"text {i % 900} of many words", "en" if i % 3 else "de") for i in range(4000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)
    labels = frame.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")).distinct()
    brought = []
    to_arrow = type(frame).toArrow
    monkeypatch.setattr(type(frame), "toArrow", lambda self: brought.append(to_arrow(self)) or brought[-1])
    quality.fit(frame, labels, most=50)
    language.fit(frame, most=40)
    assert [t.num_rows for t in brought] == [50, 40]


HELPERS = ["digest", "kept", "row", "quality_score", "quality_kept", "_digest", "_kept", "_chosen", "_least", "least", "root", "node", "contaminated", "key"]


def test_stages_leave_other_columns_alone(spark, tmp_path):
    texts = ["one two three four five six seven " * 40 + str(i % 20) for i in range(60)] + [None, "", "word " * 3000]
    rows = [(i, t, len(t or ""), *[f"{h}{i}" for h in HELPERS]) for i, t in enumerate(texts)]
    names = ", ".join(f"`{h}` string" for h in HELPERS)
    docs = spark.createDataFrame(rows, f"doc_id long, text string, n_chars long, {names}")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "nothing in common with these")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        for r in out.collect():
            assert [r[h] for h in HELPERS] == [f"{h}{r.doc_id}" for h in HELPERS], name
        empty = stage(spark, docs.limit(0), str(tmp_path))
        assert empty.columns == docs.columns and empty.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).count() == 0


def test_empty_tables_of_tokens_and_benchmark(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "some words of a document")], "doc_id long, text string")
    none = docs.limit(0)
    items = docs.select(F.col("doc_id").alias("item_id"), "text")
    for d, b, n in ((none, items, 0), (docs, items.limit(0), 1), (none, items.limit(0), 0)):
        monkeypatch.setattr(queries, "table", lambda s, f, name, d=d, b=b: d if name == "documents" else b)
        assert queries.op6_winnowing(spark, "").count() == n
    monkeypatch.setattr(queries, "table", lambda *_: none)
    assert queries.op2_token_orc(spark, "").count() == 0
