"""Licence notices by a positional index of rare template words.

A template is a passage of a licence text, notice or identifier with mandatory key phrases in it; most licences have
several. Its words' document frequencies are counted over all documents and give their weights (IDF). Each template is
looked up by its rarest words: as many as weigh together more than a match may miss, so every match holds at least one
of them. An occurrence of such a word at word ``p`` of a file and at word ``q`` of the template proposes that the
template starts at ``p - q``. A proposal is judged in the window from ``SLACK`` words before that start to ``SLACK``
words after the template's end: its key phrases must stand there whole, and its score is the weight of the heaviest
run of template words that stand in order in the window, so inserted, changed and lacking words move the others
without losing them. Scores of ``MINIMUM`` and more are matches; of those that overlap the best is kept, then the
first. Base phrases must stand whole, and each of their places is a match.

Defined results: a null or empty text has no words and no matches; every row of a repeated document has its own
result; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetgrain.llm import arrow, words

MINIMUM = 0.8
SLACK = 4
# Proposals that are judged at once.
CHUNK = 2048

# The base phrases and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Wording of common notices and licence texts, their mandatory phrases, and the label.
_FREE = (
    "this {0} is free software you can redistribute it and or modify it under the terms of the {1} as published by the "
    "free software foundation either version {2} of the license or at your option any later version"
)
_MIT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files the software to deal in the software without restriction",
    "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of "
    "the software and to permit persons to whom the software is furnished to do so",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
    "software",
)
NOTICES = (
    ("licensed under the gnu general public license version 2", ("general public license version 2",), "gpl-2.0"),
    ("licensed under the gnu general public license version 3", ("general public license version 3",), "gpl-3.0"),
    ("gnu lesser general public license", ("lesser general public license",), "lgpl"),
    ("gnu affero general public license", ("affero general public license",), "agpl"),
    (_FREE.format("program", "gnu general public license", "2"), ("gnu general public license", "version 2"), "gpl-2.0"),
    (_FREE.format("program", "gnu general public license", "3"), ("gnu general public license", "version 3"), "gpl-3.0"),
    (_FREE.format("library", "gnu lesser general public license", "2 1"), ("lesser general public license", "version 2 1"), "lgpl-2.1"),
    (_FREE.format("library", "gnu lesser general public license", "3"), ("lesser general public license", "version 3"), "lgpl-3.0"),
    (_FREE.format("program", "gnu affero general public license", "3"), ("affero general public license", "version 3"), "agpl-3.0"),
    ("licensed under the apache license version 2 0", ("apache license version 2 0",), "apache-2.0"),
    (
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www "
        "apache org licenses license 2 0",
        ("in compliance with the license", "apache org licenses license 2 0"),
        "apache-2.0",
    ),
    ("licensed under cc by nc 4 0", ("cc by nc",), "cc-by-nc"),
    ("licensed under cc by sa 4 0", ("cc by sa",), "cc-by-sa"),
    ("licensed under cc by nd 4 0", ("cc by nd",), "cc-by-nd"),
    ("creative commons attribution 4 0 international", ("creative commons attribution 4 0",), "cc-by"),
    ("creative commons attribution sharealike 4 0", ("attribution sharealike",), "cc-by-sa"),
    ("creative commons attribution noncommercial 4 0", ("attribution noncommercial",), "cc-by-nc"),
    ("creative commons attribution noderivatives 4 0", ("attribution noderivatives",), "cc-by-nd"),
    ("creative commons zero 1 0 universal public domain dedication", ("creative commons zero",), "cc0"),
    (_MIT[0], ("permission is hereby granted free of charge",), "mit-text"),
    (_MIT[1], ("publish distribute sublicense and or sell",), "mit-text"),
    (_MIT[2], ("above copyright notice and this permission notice",), "mit-text"),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met",
        ("redistribution and use in source and binary forms",),
        "bsd",
    ),
    (
        "redistributions of source code must retain the above copyright notice this list of conditions and the following "
        "disclaimer",
        ("redistributions of source code must retain",),
        "bsd",
    ),
    (
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission",
        ("endorse or promote products derived from this software",),
        "bsd-3-clause",
    ),
    (
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        ("mozilla public license",),
        "mpl-2.0",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted",
        ("permission to use copy modify and or distribute this software",),
        "isc",
    ),
    (
        "this is free and unencumbered software released into the public domain",
        ("free and unencumbered software",),
        "unlicense",
    ),
    ("all rights reserved", ("all rights reserved",), "all-rights-reserved"),
)

# Licence identifiers; their words after the tag "SPDX-License-Identifier" are a notice and its phrase.
IDENTIFIERS = (
    "gpl-2.0 gpl-3.0 lgpl-2.1 lgpl-3.0 agpl-3.0 apache-2.0 mit isc bsd-2-clause bsd-3-clause mpl-2.0 unlicense "
    "cc-by-4.0 cc-by-sa-4.0 cc-by-nc-4.0 cc-by-nd-4.0 cc0-1.0"
)


def tagged(identifiers: str = IDENTIFIERS) -> tuple:
    texts = [(f"spdx license identifier {re.sub('[-.]', ' ', name)}", name) for name in identifiers.split()]
    return tuple((text, (text,), name) for text, name in texts)


@dataclass
class Template:
    label: str
    base: bool
    words: list[bytes]
    hashes: np.ndarray
    keys: list[slice]  # the words that must stand together
    weights: np.ndarray | None = None
    looked_up: list[int] | None = None  # template words whose occurrences propose a match


def templates(base=BASE, notices=NOTICES + tagged()) -> list[Template]:
    out = []
    for text, phrases, label, plain in [(t, (t,), name, True) for t, name in base] + [(*n, False) for n in notices]:
        split, keys = text.encode().split(), []
        for inner in (phrase.encode().split() for phrase in phrases):
            at = next(i for i in range(len(split)) if split[i : i + len(inner)] == inner)
            keys.append(slice(at, at + len(inner)))
        raw = np.frombuffer(text.encode(), np.uint8)
        hashes = words.find(raw, np.array([0, len(raw)])).hashes
        out.append(Template(label, plain, split, hashes, keys))
    return out


def document_frequencies(docs: DataFrame, vocabulary: np.ndarray) -> tuple[int, np.ndarray]:
    """Number of documents, and how many of them hold each word of the sorted vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = np.zeros(len(vocabulary) + 1, np.int64), 0
        for batch in batches:
            for part, data, offsets in arrow.pieces(batch, "text"):
                w = words.find(data, offsets)
                at = words.among(w.hashes, vocabulary)
                pair = np.unique(w.doc[at >= 0] * len(vocabulary) + at[at >= 0])
                held[:-1] += np.bincount(pair % len(vocabulary), minlength=len(vocabulary))
                rows += len(part)
        held[-1] = rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(held))), pa.array(held)], ["word", "n"])

    # One row per template word, however many documents there are.
    found = docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    out = np.zeros(len(vocabulary) + 1, np.int64)
    for r in found.collect():
        out[r["word"]] = r["n"]
    return int(out[-1]), out[:-1]


def weigh(every: list[Template], vocabulary: np.ndarray, n: int, frequencies: np.ndarray, minimum: float) -> None:
    """Weights of the template words, and the rarest words that every match must touch."""
    idf = np.array([1 + math.log((1 + n) / (1 + f)) for f in frequencies])
    for t in every:
        t.weights = idf[words.among(t.hashes, vocabulary)]
        need = 0.0 if t.base else (1 - minimum) * t.weights.sum()
        t.looked_up, weight = [], 0.0
        for q in np.argsort(-t.weights, kind="stable").tolist():
            t.looked_up.append(q)
            weight += t.weights[q]
            if weight > need + 1e-9:
                break


def _stands(w: words.Words, at: int, split: list[bytes]) -> bool:
    ends = w.ends[at : at + len(split)]
    return all(w.low[a:b].tobytes() == word for a, b, word in zip(w.starts[at:], ends, split, strict=False))


def _judge(w: words.Words, t: Template, starts: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of proposals whose key phrases stand in their window, and their scores."""
    at = starts[:, None] + np.arange(-SLACK, len(t.words) + SLACK)
    inside = (at >= w.first[owner, None]) & (at < w.first[owner + 1, None])
    seen = w.hashes[np.where(inside, at, 0)]
    good = np.ones(len(starts), bool)
    for key in t.keys:
        size = key.stop - key.start
        places = at.shape[1] - size + 1
        whole = np.ones((len(starts), places), bool)
        for i, h in enumerate(t.hashes[key]):
            whole &= (seen[:, i : i + places] == h) & inside[:, i : i + places]
        good &= whole.any(axis=1)
        # Equal hashes are compared as words.
        for n in np.flatnonzero(good):
            good[n] = any(_stands(w, int(at[n, j]), t.words[key]) for j in np.flatnonzero(whole[n]))
    kept = np.flatnonzero(good)
    seen, inside = seen[kept], inside[kept]
    # The heaviest common subsequence, one template word after the other for all proposals.
    best = np.zeros((len(kept), at.shape[1] + 1))
    for h, weight in zip(t.hashes, t.weights, strict=True):
        step = best[:, :-1] + weight * ((seen == h) & inside)
        best[:, 1:] = np.maximum(best[:, 1:], step)
        best = np.maximum.accumulate(best, axis=1)
    return kept, best[:, -1] / t.weights.sum()


def _best(t: Template, starts: np.ndarray, owner: np.ndarray, score: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """Of the matches of a text that overlap the best, then the first."""
    size, end, text = len(t.words), 0, -1
    held: tuple | None = None
    for s, doc, value in zip(starts.tolist(), owner.tolist(), score.tolist(), strict=True):
        if held is None or doc != text or s >= end:
            if held is not None:
                yield held
            held, text, end = (s, doc, value), doc, s + size
        elif value > held[2] + 1e-9:
            held = (s, doc, value)
    if held is not None:
        yield held


def _matches(w: words.Words, every: list[Template], minimum: float) -> Iterator[tuple[int, int, int, float]]:
    """Template number, text, first word in the text, and score."""
    keys = np.unique(np.concatenate([t.hashes[t.looked_up] for t in every]))
    at = words.among(w.hashes, keys)
    place = np.flatnonzero(at >= 0)
    at, doc = at[place], w.doc
    for number, t in enumerate(every):
        size = len(t.words)
        starts = [place[at == np.searchsorted(keys, t.hashes[q])] - q for q in t.looked_up]
        owners = [doc[s + q] for s, q in zip(starts, t.looked_up, strict=True)]
        # A start before a text's first word may be proposed by two texts.
        width = len(w.hashes) + size
        owner, starts = np.divmod(np.unique(np.concatenate(owners) * width + np.concatenate(starts) + size), width)
        starts -= size
        if t.base:
            inside = (starts >= w.first[owner]) & (starts + size <= w.first[owner + 1])
            starts, owner = starts[inside], owner[inside]
            same = (w.hashes[starts[:, None] + np.arange(size)] == t.hashes).all(axis=1)
            found = [(s, o, 1.0) for s, o in zip(starts[same].tolist(), owner[same].tolist(), strict=True) if _stands(w, s, t.words)]
        else:
            judged = [np.zeros((3, 0))]
            for i in range(0, len(starts), CHUNK):
                kept, score = _judge(w, t, starts[i : i + CHUNK], owner[i : i + CHUNK])
                judged.append(np.stack([starts[i + kept], owner[i + kept], score])[:, score >= minimum - 1e-9])
            first, text, score = np.concatenate(judged, axis=1)
            found = _best(t, first.astype(np.int64), text.astype(np.int64), score)
        for s, o, score in found:
            yield number, o, max(0, s - int(w.first[o])), min(1.0, score)


def scan(docs: DataFrame, base=BASE, notices=NOTICES + tagged(), minimum: float = MINIMUM) -> DataFrame:
    """doc_id, n_words and the matches (label, base, start, end, score) of every document, by word from 0."""
    every = templates(base, notices)
    vocabulary = np.unique(np.concatenate([t.hashes for t in every]))
    weigh(every, vocabulary, *document_frequencies(docs, vocabulary), minimum)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in arrow.pieces(batch, "text"):
                w = words.find(data, offsets)
                found = [[] for _ in range(len(rows))]
                for number, o, start, score in _matches(w, every, minimum):
                    t = every[number]
                    end = min(start + len(t.words), int(w.counts[o]))
                    found[o].append({"label": t.label, "base": t.base, "start": start, "end": end, "score": score})
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(rows.schema.get_field_index("doc_id")),
                        pa.array(w.counts),
                        pa.array([sorted(x, key=lambda m: (m["start"], m["label"])) for x in found], kind),
                    ],
                    ["doc_id", "n_words", "matches"],
                )

    fields = [("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]
    kind = pa.list_(pa.struct(fields))
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("n_words", T.LongType()),
            T.StructField(
                "matches",
                T.ArrayType(
                    T.StructType(
                        [
                            T.StructField("label", T.StringType()),
                            T.StructField("base", T.BooleanType()),
                            T.StructField("start", T.LongType()),
                            T.StructField("end", T.LongType()),
                            T.StructField("score", T.DoubleType()),
                        ]
                    )
                ),
            ),
        ]
    )
    return docs.select("doc_id", "text").mapInArrow(find, schema)


def labels(rows: DataFrame) -> DataFrame:
    """Counts, places, labels and the best score of scanned documents."""
    base = F.filter("matches", lambda m: m["base"])
    joined = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda m: m["label"]))), ",")
    starts = F.transform(base, lambda m: m["start"])
    return rows.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0)).alias("score"),
    )
