"""Periodic runs in the words of a text, found from its suffixes by descending common prefixes.

A run is a stretch of words with smallest period q (words q apart are identical), at least ``LEAST`` words and ``POWER``
periods long, that no neighbouring word extends with that period. If it starts at i, the suffixes at i and i + q share
exactly length - q words, and no suffix between them shares as many: the smaller distance would be a period too. So:

1. Suffixes of the words are sorted by doubling their ranks; the ranks of every round give the common prefix of
   lexicographic neighbours.
2. Kruskal: neighbours are united by decreasing common prefix. A union-find holds the classes, each with its positions
   in order; the smaller one is put into the larger. Positions i < j that become adjacent in a class when it is made by
   a common prefix of l words share exactly l words. They seed a run of period j - i, start i and length l + j - i where
   l is at least (POWER - 1) (j - i) and the words before i and j differ.
3. No shorter prefix than LEAST (POWER - 1) / POWER words can seed a run: there the unions end. Only texts that repeat
   so many words at all are sorted; which ones is asked by hashes, which can name too many texts but miss none.

A word is dropped if any run contains it after that run's first period. Words are compared byte by byte.

Defined results: a null text has no words, no runs and an empty collapsed text; a text without runs collapses to its
words joined by one space; every row has its own result, whatever its id; an empty table gives no rows. Columns besides
doc_id and text are not read. Time and memory follow the largest text, which one task holds as a whole.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from packetgrain.llm import arrow, hashing, words

LEAST = 24
POWER = 3
SHORTEST = -(-LEAST * (POWER - 1) // POWER)


def ranked(symbols: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, … symbols, until all differ; the last symbol occurs once."""
    ranks = [np.searchsorted(np.sort(symbols), symbols)]
    step = 1
    while True:
        rank = ranks[-1]
        # A suffix that shares its rank has more symbols: the last one would tell it apart.
        shared = np.flatnonzero(np.bincount(rank, minlength=len(rank))[rank] > 1)
        if not len(shared):
            return ranks
        first, second = rank[shared], rank[shared + step]
        order = np.lexsort((second, first))
        first, second = first[order], second[order]
        index = np.arange(len(order))
        new = np.ones(len(order), bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        lead = np.ones(len(order), bool)
        lead[1:] = first[1:] != first[:-1]
        start = np.maximum.accumulate(np.where(lead, index, 0))
        place = np.maximum.accumulate(np.where(new, index, 0))
        rank = rank.copy()
        rank[shared[order]] = first + place - start
        ranks.append(rank)
        step *= 2


def neighbours(ranks: list[np.ndarray], shortest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lexicographic neighbours that share at least ``shortest`` symbols, and how many they share."""
    order = np.argsort(ranks[-1])
    left, right = order[:-1], order[1:]
    level = shortest.bit_length() - 1
    if level >= len(ranks):
        return left[:0], right[:0], left[:0]
    alike = ranks[level][left] == ranks[level][right]
    left, right = left[alike], right[alike]
    shared = np.zeros(len(left), np.int64)
    a, b = left.copy(), right.copy()
    for k in range(len(ranks) - 1, -1, -1):
        # Equal suffixes differ before the end, so no place passes it.
        same = ranks[k][a] == ranks[k][b]
        shared[same] += 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
    enough = shared >= shortest
    return left[enough], right[enough], shared[enough]


def runs_of(symbols: np.ndarray, least: int = LEAST, power: int = POWER) -> list[tuple[int, int, int]]:
    """start, length, period of all runs; the last symbol occurs once."""
    left, right, shared = neighbours(ranked(symbols), -(-least * (power - 1) // power))
    order = np.argsort(-shared, kind="stable")
    parent: dict[int, int] = {}
    members: dict[int, list[int]] = {}
    out = []

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    def seed(i: int, j: int, common: int) -> None:
        period = j - i
        if (power - 1) * period <= common and common + period >= least and (i == 0 or symbols[i - 1] != symbols[j - 1]):
            out.append((i, common + period, period))

    for a, b, common in zip(left[order].tolist(), right[order].tolist(), shared[order].tolist(), strict=True):
        a, b = root(a), root(b)
        large, small = members.pop(a, None) or [a], members.pop(b, None) or [b]
        if len(large) < len(small):
            a, b, large, small = b, a, small, large
        last = len(small) - 1
        for k, position in enumerate(small):
            at = bisect_left(large, position)
            # Positions of one class that were adjacent before are not seeded again.
            if at and (not k or small[k - 1] < large[at - 1]):
                seed(large[at - 1], position, common)
            if at < len(large) and (k == last or small[k + 1] > large[at]):
                seed(position, large[at], common)
        if 8 * len(small) > len(large):
            large = sorted(large + small)
        else:
            for position in small:
                insort(large, position)
        parent[b] = a
        members[a] = large
    return sorted(out)


def _repeating(data: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    """Texts in which ``width`` consecutive words may occur twice."""
    seen = words.VISIBLE[data]
    inside = np.concatenate([[False], seen, [False]])
    begin = inside[1:-1] & ~inside[:-2]
    end = inside[1:-1] & ~inside[2:]
    edges = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    begin[edges] = seen[edges]
    end[edges - 1] = seen[edges - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    grams = hashing.grams(hashing.spans(hashing.prefix(data), starts, ends), width)
    text = np.searchsorted(offsets, starts, side="right") - 1
    own = text[: len(grams)] == text[width - 1 :][: len(grams)]
    grams, text = grams[own], text[: len(own)][own]
    order = np.lexsort((grams, text))
    again = (grams[order][1:] == grams[order][:-1]) & (text[order][1:] == text[order][:-1])
    return np.unique(text[order][1:][again])


def found_in(texts: list[bytes], least: int = LEAST, power: int = POWER) -> list[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """The words and the runs of every text; the texts are sorted together, words of different texts never match."""
    split = [text.split() for text in texts]
    first = np.cumsum([0, *(len(w) + 1 for w in split)])
    symbols = np.empty(first[-1], np.int64)
    base = 0
    for i, found in enumerate(split):
        known: dict[bytes, int] = {}
        symbols[first[i] : first[i + 1] - 1] = [known.setdefault(w, len(known)) + base for w in found]
        # The end of a text is a symbol of its own.
        base += len(known) + 1
        symbols[first[i + 1] - 1] = base - 1
    out: list = [(w, []) for w in split]
    runs = runs_of(symbols, least, power) if len(symbols) else []
    of = np.searchsorted(first, [start for start, _, _ in runs], side="right") - 1
    for (start, length, period), i in zip(runs, of.tolist(), strict=True):
        out[i][1].append((start - int(first[i]), length, period))
    return out


def collapsed(found: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run contains after its first period, joined by one space."""
    if runs:
        change = np.zeros(len(found) + 1, np.int64)
        for start, length, period in runs:
            change[start + period] += 1
            change[start + length] -= 1
        found = [found[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
    return b" ".join(found)


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def scan(docs: DataFrame, least: int = LEAST, power: int = POWER) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and collapsed text of every document."""
    width = -(-least * (power - 1) // power)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in arrow.pieces(batch, "text"):
                raw = data.tobytes()
                texts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                chosen = _repeating(data, offsets, width).tolist()
                runs: list[list] = [[] for _ in texts]
                kept: list[bytes | None] = [None] * len(texts)
                for i, (found, own) in zip(chosen, found_in([texts[i] for i in chosen], least, power), strict=True):
                    runs[i], kept[i] = own, collapsed(found, own)
                split = [text.split() for text in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0),
                        pa.array([len(w) for w in split], pa.int64()),
                        pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in own] for own in runs], pa.list_(RUN)),
                        pa.array([b" ".join(w) if k is None else k for w, k in zip(split, kept, strict=True)], pa.binary()).cast(pa.string()),
                    ],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    )
