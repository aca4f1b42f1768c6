"""Licence scan: labels and scores against brute force, notices with changed words, identifiers, long and empty texts."""

import math
import random
import re

import pytest

from packetgrain.llm import license_scan

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
GPL = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
    "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
    "version."
)
MIT = (
    "Permission is hereby granted, free of charge, to any individual person obtaining a copy of this software and "
    "documentation files, to deal in the Software without restriction"
)


def table(spark, rows):
    return spark.createDataFrame([(i, t, -1) for i, t in enumerate(rows)], "doc_id long, text string, matches int")


def by_id(frame):
    return {r["doc_id"]: r for r in frame.collect()}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def common(template, window, weight):
    """Weight of the heaviest common subsequence."""
    row = [0.0] * (len(window) + 1)
    for a in template:
        last = row[:]
        for j, b in enumerate(window, 1):
            row[j] = max(last[j], row[j - 1], last[j - 1] + weight[a] if a == b else 0.0)
    return row[-1]


def brute(texts, minimum=license_scan.MINIMUM, slack=license_scan.SLACK):
    """Matches (label, base, start, score) of every text, proposals taken from all places of looked-up words."""
    docs = [words(t) for t in texts]
    base = [(t.split(), [t.split()], name, True) for t, name in license_scan.BASE]
    notices = license_scan.NOTICES + license_scan.tagged()
    every = base + [(t.split(), [k.split() for k in keys], label, False) for t, keys, label in notices]
    held = [set(d) for d in docs]
    weight = {}
    for a in {w for t in every for w in t[0]}:
        weight[a] = 1 + math.log((1 + len(docs)) / (1 + sum(a in h for h in held)))
    out = []
    for doc in docs:
        found = []
        for template, keys, label, plain in every:
            size, total = len(template), sum(weight[a] for a in template)
            if plain:
                found += [(label, True, p, 1.0) for p in range(len(doc)) if doc[p : p + size] == template]
                continue
            order = sorted(range(size), key=lambda q: (-weight[template[q]], q))
            rare, so_far = [], 0.0
            for q in order:
                rare.append(q)
                so_far += weight[template[q]]
                if so_far > (1 - minimum) * total + 1e-9:
                    break
            good = []
            for s in sorted({p - q for q in rare for p in range(len(doc)) if doc[p] == template[q]}):
                window = doc[max(0, s - slack) : s + size + slack]
                if all(any(window[i : i + len(k)] == k for i in range(len(window))) for k in keys):
                    score = common(template, window, weight) / total
                    if score >= minimum - 1e-9:
                        good.append((s, score))
            end, best = None, None
            for s, score in good + [(10**9, 0.0)]:
                if best is None or s >= end:
                    if best is not None:
                        found.append((label, False, max(0, best[0]), best[1]))
                    best, end = (s, score), s + size
                elif score > best[1] + 1e-9:
                    best = (s, score)
        out.append(sorted((label, plain, start, round(min(1.0, score), 9)) for label, plain, start, score in found))
    return out


def planted():
    rnd = random.Random(11)
    notices = [t for t, _, _ in license_scan.NOTICES + license_scan.tagged()]
    vocabulary = sorted({w for t in notices for w in t.split()}) + [f"word{i}" for i in range(40)]
    out = [GPL, MIT, None, "", "license", "gnu " * 300, "MIT License " * 40, "x " * 3000 + GPL]
    for _ in range(120):
        parts = []
        for _ in range(rnd.randint(1, 4)):
            parts += rnd.choices(vocabulary, k=rnd.randint(0, 12))
            some = rnd.choice(notices).split()
            for _ in range(rnd.choice([0, 0, 1, 2, 4])):
                at = rnd.randrange(len(some))
                some[at : at + rnd.randint(0, 1)] = rnd.choice([[], [rnd.choice(vocabulary)]])
                some = some or ["x"]
            parts += some
        out.append(rnd.choice([" ", ", ", "\n# "]).join(parts))
    return out


def test_matches_equal_brute_force(spark):
    rows = planted()
    want = brute(rows)
    got = by_id(license_scan.scan(table(spark, rows)))
    for i, text in enumerate(rows):
        found = sorted((m.label, m.base, m.start, round(m.score, 9)) for m in got[i].matches)
        assert [f[:3] for f in found] == [w[:3] for w in want[i]], text
        assert all(abs(f[3] - w[3]) < 1e-6 for f, w in zip(found, want[i], strict=True))
        assert got[i].n_words == len(words(text))
        assert all(0 <= m.start <= m.end <= got[i].n_words for m in got[i].matches)
    shown = by_id(license_scan.labels(license_scan.scan(table(spark, rows))))
    for i in range(len(rows)):
        assert shown[i]["labels"] == ",".join(sorted({w[0] for w in want[i]}))
        assert abs(shown[i].score - max([w[3] for w in want[i]], default=0.0)) < 1e-6
    assert sum(any(0.8 <= w[3] < 1 for w in found) for found in want) > 10


def test_common_forms_of_notices(spark):
    rows = [
        GPL,
        "Licensed under the terms of the GNU General Public License, version 2.",
        MIT,
        "This work is under Creative Commons Attribution-ShareAlike 4.0.",
        "// SPDX-License-Identifier: GPL-3.0-or-later",
        GPL.replace("General Public", "Affero General Public"),
        "The licence of software is a matter of version and permission, they said; a license may be general or public.",
        "Neither the name of Example Corp. nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission.",
    ]
    got = by_id(license_scan.labels(license_scan.scan(table(spark, rows))))
    assert [set(re.split(",", got[i]["labels"])) - {""} for i in range(len(rows))] == [
        {"gpl", "gpl-3.0"},
        {"gpl", "gpl-2.0"},
        {"mit-text"},
        {"cc-by-sa"},
        {"gpl-3.0"},
        {"agpl", "agpl-3.0"},
        set(),
        {"bsd-3-clause"},
    ]


@pytest.mark.parametrize("pieces", [1, 2000])
def test_long_texts_are_read_whole(spark, pieces):
    rows = ["plain words of a text " * 5 * pieces + MIT + " plain" * pieces, None]
    got = by_id(license_scan.labels(license_scan.scan(table(spark, rows))))
    assert got[0]["labels"] == "mit-text" and got[1]["labels"] == "" and got[1].score == 0.0
