"""Exact removal of repeated byte strings by sorting suffixes in buckets.

Every string of ``WIDTH`` bytes names one place in itself: the start of its least ``GRAM``-byte run by hash. Equal
strings name the same place, so only suffixes that share such an anchor have to be sorted together:

1. Equal texts are reduced to one with its number of copies.
2. Each text is cut in runs of consecutive string starts with one anchor (about one run per 70 bytes). Runs whose
   anchor occurs nowhere else are done: their strings are unique.
3. The bytes of the other runs (contexts) are joined where they are equal, batch by batch before they are dealt to
   buckets of anchors and once more in the bucket.
4. The strings of different contexts of one anchor are sorted bucket by bucket, deep-shallow: multikey quicksort,
   eight bytes at a time, to ``SHALLOW`` words; groups that are still equal then go to a blind trie, which skips to
   the word where the members of a node first differ and branches there. Members of a leaf are equal strings.
5. Covered runs go back to the texts.

An anchor with more than ``HOT`` different contexts is not sorted in one task: its strings are counted by two
64-bit hashes over all tasks. Equality of contexts and of whole texts is taken from 128-bit hashes as well.

Defined results: a null or empty text has no bytes; texts shorter than ``WIDTH`` keep all bytes; repeated rows each
have their own result, and as they repeat each other they are removed as a whole from ``WIDTH`` bytes on; a null
doc_id has a result like any other; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetgrain.llm import arrow, hashing, words
from packetgrain.session import cut

WIDTH = 200
GRAM = 64
SHALLOW = 4
# Different contexts of one anchor that one task sorts, and context bytes of one bucket.
HOT = 4_096
BUCKET_BYTES = 4 << 20
# String starts worked on at once; places in such a chunk fit in PLACE_BITS.
CHUNK = 2 << 20
PLACE_BITS = 24


def anchor_runs(data: np.ndarray, offsets: np.ndarray):
    """Text, first and last string start (in ``data``), and anchor hash of every run of strings with one anchor."""
    out: list[tuple] = []
    mask = np.uint64((1 << PLACE_BITS) - 1)
    for low in range(0, len(data) - WIDTH + 1, CHUNK):
        part = data[low : low + CHUNK + WIDTH - 1]
        at = np.arange(len(part) - GRAM + 1)
        grams = hashing.spans(hashing.prefix(part), at, at + GRAM)
        # The leftmost of the least hashes: a rule on the string alone.
        place = (words.sliding((grams & ~mask) | at.astype(np.uint64), WIDTH - GRAM + 1, np.minimum) & mask).astype(np.int64)
        start = np.arange(low, low + len(place))
        text = np.searchsorted(offsets, start, side="right") - 1
        inside = start + WIDTH <= offsets[text + 1]
        new = inside.copy()
        new[1:] &= (place[1:] != place[:-1]) | (text[1:] != text[:-1]) | ~inside[:-1]
        end = inside.copy()
        end[:-1] &= new[1:] | ~inside[1:]
        first, last = np.flatnonzero(new), np.flatnonzero(end)
        out.append((text[first], first + low, last + low, grams[place[first]].view(np.int64), place[first] - first))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


# Sorting


def _ranks(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by the columns, first one first, and where a new value starts in that order."""
    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in columns])
    return order, new


def equal_strings(data: np.ndarray, starts: np.ndarray, group: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """For every string ``data[start : start + width]`` the number of equal ones in its group, itself included.

    ``width`` is a multiple of eight. Shallow phase and blind tries as described above, all groups side by side.
    """
    out = np.ones(len(starts), np.int64)
    if not len(starts):
        return out
    word = np.ndarray((len(data) - 7,), ">u8", np.ascontiguousarray(data), strides=(1,))
    depth = width // 8
    live = np.arange(len(starts))
    node = group

    def split(live, node, key):
        """Members in the order of (node, key), nodes renumbered; members alone in their node are done."""
        order, new = _ranks(node, key)
        number = np.cumsum(new) - 1
        several = np.bincount(number)[number] > 1
        return live[order][several], number[several]

    for level in range(min(SHALLOW, depth)):
        live, node = split(live, node, word[starts[live] + 8 * level].astype(np.uint64))
    known = np.full(len(live), min(SHALLOW, depth))
    while len(live):
        # Nodes are runs of ``node``; the first member stands for its node.
        _, first, node = np.unique(node, return_index=True, return_inverse=True)
        head = starts[live[first]][node]
        own = starts[live]
        # The word at which each member leaves the first one; equal members never do.
        leaves = np.full(len(live), depth)
        undecided = np.arange(len(live))
        for level in range(int(known.min()), depth):
            differs = word[own[undecided] + 8 * level] != word[head[undecided] + 8 * level]
            leaves[undecided[differs]] = level
            undecided = undecided[~differs]
            if not len(undecided):
                break
        branch = np.minimum.reduceat(leaves, first)
        done = branch[node] == depth
        out[live[done]] = np.bincount(node)[node[done]]
        live, node, at = live[~done], node[~done], branch[node][~done]
        if not len(live):
            break
        key = word[starts[live] + 8 * at].astype(np.uint64)
        order, new = _ranks(node, key)
        number = np.cumsum(new) - 1
        several = np.bincount(number)[number] > 1
        live, node, known = live[order][several], number[several], at[order][several] + 1
    return out


def _runs_of(flag: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of every run of set flags with one owner."""
    new, end = flag.copy(), flag.copy()
    new[1:] &= ~flag[:-1] | (owner[1:] != owner[:-1])
    end[:-1] &= ~flag[1:] | (owner[1:] != owner[:-1])
    return np.flatnonzero(new), np.flatnonzero(end)


def _windows(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context, place in it and place in the bytes of every string of contexts that lie end to end."""
    count = np.diff(offsets) - WIDTH + 1
    row = np.repeat(np.arange(len(count)), count)
    step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return row, step, offsets[:-1][row] + step


def _combined(table: pa.Table) -> pa.Table:
    """Equal contexts as one row with the sum of their copies."""
    order, new = _ranks(*(table[c].to_numpy() for c in ("key", "h1", "h2")))
    total = np.add.reduceat(table["copies"].to_numpy()[order], np.flatnonzero(new)) if len(order) else np.zeros(0, np.int64)
    kept = table.take(pa.array(order[new]))
    return kept.set_column(kept.schema.get_field_index("copies"), "copies", pa.array(total, pa.int64()))


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal contexts of a batch joined before they are dealt out."""
    for batch in batches:
        yield from _combined(pa.Table.from_batches([batch])).combine_chunks().to_batches()


def _cover(key, table: pa.Table) -> pa.Table:
    """Covered string starts of every context of a bucket, as runs."""
    table = _combined(table).combine_chunks()
    data, offsets = arrow.octets(table["context"])
    anchor, lead, copies = (table[c].to_numpy() for c in ("key", "lead", "copies"))
    row, step, start = _windows(offsets)
    several = np.unique(anchor, return_inverse=True, return_counts=True)
    shared = (several[2][several[1]] > 1)[row]
    repeated = copies[row] > 1
    # Equal strings stand at the same distance from their anchor.
    order, new = _ranks(anchor[row[shared]], (lead[row] - step)[shared])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new)
    found = equal_strings(data, start[shared], group) > 1
    repeated[np.flatnonzero(shared)[found]] = True
    first, last = _runs_of(repeated, row)
    owner = row[first]
    return pa.table(
        {
            "key": anchor[owner],
            "h1": table["h1"].to_numpy()[owner],
            "h2": table["h2"].to_numpy()[owner],
            "first": step[first].astype(np.int32),
            "last": step[last].astype(np.int32),
        }
    )


def _string_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two hashes of every string of contexts of hot anchors."""
    for batch in batches:
        all_data, all_offsets = arrow.octets(batch.column(batch.schema.get_field_index("context")))
        for lo, hi in arrow.slices(all_offsets, 1 << 18):
            data = all_data[all_offsets[lo] : all_offsets[hi]]
            row, step, start = _windows(all_offsets[lo : hi + 1] - all_offsets[lo])
            one = hashing.spans(hashing.prefix(data), start, start + WIDTH)
            other = hashing.spans(hashing.prefix(data[::-1]), len(data) - start - WIDTH, len(data) - start)
            take = pa.array(row + lo)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(batch.schema.get_field_index(c)).take(take) for c in ("key", "h1", "h2", "copies")),
                    pa.array(step.astype(np.int32)),
                    pa.array(one.view(np.int64)),
                    pa.array(other.view(np.int64)),
                ],
                ["key", "h1", "h2", "copies", "step", "s1", "s2"],
            )


# Steps


def _anchored(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in arrow.pieces(batch, "data"):
                text, first, last, key, lead = anchor_runs(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0).take(pa.array(text)),
                        pa.array(first - offsets[text]),
                        pa.array(last - offsets[text]),
                        pa.array(key),
                        pa.array(lead.astype(np.int32)),
                    ],
                    ["row", "first", "last", "key", "lead"],
                )

    return texts.select("row", "data").mapInArrow(run, "row long, first long, last long, key long, lead int")


def _contexts(texts: DataFrame, runs: DataFrame) -> DataFrame:
    """The bytes of runs, read from their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text = memoryview(batch.column(1)[i].as_buffer())
                runs_ = batch.column(2)[i].values
                first, last = runs_.field("first").to_numpy(), runs_.field("last").to_numpy()
                for lo in range(0, len(first), 4096):
                    hi = lo + 4096
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.repeat(batch.column(0)[i], len(first[lo:hi])),
                            pa.array(first[lo:hi]),
                            runs_.field("key").slice(lo, 4096),
                            runs_.field("lead").slice(lo, 4096),
                            pa.array(
                                [bytes(text[a : b + WIDTH]) for a, b in zip(first[lo:hi], last[lo:hi], strict=True)],
                                pa.binary(),
                            ),
                        ],
                        ["row", "first", "key", "lead", "context"],
                    )

    asked = runs.groupBy("row").agg(F.collect_list(F.struct("first", "last", "key", "lead")).alias("runs"))
    return (
        texts.join(asked, "row")
        .select("row", "data", "runs")
        .mapInArrow(run, "row long, first long, key long, lead int, context binary")
        .withColumn("h1", F.xxhash64("context"))
        .withColumn("h2", F.xxhash64(F.lit(1), "context"))
    )


def repeats(texts: DataFrame, hot: int = HOT) -> DataFrame:
    """row, start, end of byte runs covered by strings that occur more than once, for ``texts(row, data)``."""
    runs = cut(_anchored(texts))
    # Written first, so that adaptive execution knows its size and can split the join's skewed keys.
    shared = cut(runs.groupBy("key").count().where("count > 1").select("key"))
    places = cut(_contexts(texts, runs.join(shared, "key", "left_semi")))
    crowded = cut(
        places.select("key", "h1", "h2").distinct().groupBy("key").count().where(F.col("count") > hot).select("key")
    )
    contexts = places.select("key", "h1", "h2", F.lit(1).cast("long").alias("copies"), "lead", "context").mapInArrow(
        _combine, "key long, h1 long, h2 long, copies long, lead int, context binary"
    )
    size = places.agg(F.sum(F.octet_length("context"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    found = (
        contexts.join(crowded, "key", "left_anti")
        .withColumn("_bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
        .groupBy("_bucket")
        .applyInArrow(
            lambda key, table: _cover(key, table), "key long, h1 long, h2 long, first int, last int"
        )
    )
    if crowded.limit(1).count():
        strings = cut(
            places.join(crowded, "key", "left_semi")
            .groupBy("key", "h1", "h2")
            .agg(F.count("*").alias("copies"), F.first("context").alias("context"))
            .mapInArrow(_string_hashes, "key long, h1 long, h2 long, copies long, step int, s1 long, s2 long")
        )
        names = cut(strings.groupBy("key", "s1", "s2").agg(F.sum("copies").alias("n")).where("n > 1").drop("n"))
        found = found.unionByName(
            strings.join(names, ["key", "s1", "s2"], "left_semi").select(
                "key", "h1", "h2", F.col("step").alias("first"), F.col("step").alias("last")
            )
        )
    found = found.select("key", "h1", "h2", F.col("first").alias("_from"), F.col("last").alias("_to"))
    return places.select("row", "first", "key", "h1", "h2").join(found, ["key", "h1", "h2"]).select(
        "row", (F.col("first") + F.col("_from")).alias("start"), (F.col("first") + F.col("_to") + WIDTH).alias("end")
    )


def _merge(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping and touching byte runs joined."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > reach[:-1]
    return start[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)]


def _kept(texts: DataFrame, spans: DataFrame, with_text: bool) -> DataFrame:
    """row, n_bytes, n_removed, n_spans, kept_sha256 and, where asked for, the kept bytes of every distinct text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                text = memoryview(batch.column(1)[i].as_buffer())
                found = batch.column(3)[i].values
                if batch.column(2)[i].as_py() > 1 and len(text) >= WIDTH:
                    start, end = np.array([0]), np.array([len(text)])
                elif found is None:
                    start = end = np.zeros(0, np.int64)
                else:
                    start, end = _merge(found.field("start").to_numpy(), found.field("end").to_numpy())
                edges = [0, *np.column_stack([start, end]).ravel().tolist(), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                removed = len(text) - len(kept)
                row = (len(text), removed, len(start), hashlib.sha256(kept).hexdigest())
                # Characters of which bytes were removed go as a whole.
                out.append((*row, kept.decode("utf-8", "ignore") if removed else None) if with_text else row)
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])]
            columns = list(zip(*out, strict=True)) if out else [[] for _ in names]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=False))], ["row", *names]
            )

    gathered = spans.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    schema = "row long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return (
        texts.join(gathered, "row", "left")
        .select("row", "data", "copies", "spans")
        .mapInArrow(run, schema + (", kept string" if with_text else ""))
    )


def _bytes(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def digest(text: str = "text") -> Column:
    """The 128 bits by which whole texts are taken as equal; a null text is an empty one."""
    return F.unhex(F.substring(F.sha2(_bytes(text), 256), 1, 32))


def distinct_texts(docs: DataFrame, with_text: bool = False, hot: int = HOT) -> DataFrame:
    """digest, n_bytes, n_removed, n_spans, kept_sha256 of every distinct text.

    What is removed depends on the text alone, so documents join this by ``digest``. Where
    asked for, ``kept`` is the remaining text; it is null where nothing was removed.
    """
    rows = docs.select(_bytes("text").alias("data"), digest().alias("digest"))
    distinct = rows.groupBy("digest").agg(F.first("data").alias("data"), F.count("*").alias("copies"))
    # The row number is stored with the text, so it is the same in every later read.
    texts = cut(distinct.withColumn("row", F.monotonically_increasing_id()))
    done = cut(_kept(texts, repeats(texts.select("row", "data"), hot), with_text))
    return texts.select("row", "digest").join(done, "row").drop("row")


def deduplicate(docs: DataFrame, with_text: bool = False, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document, and its ``kept`` text where asked for."""
    texts = distinct_texts(docs, with_text, hot)
    if not with_text:
        return docs.select("doc_id", digest().alias("digest")).join(texts, "digest").drop("digest")
    named = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"), digest().alias("digest")).join(texts, "digest")
    return named.withColumn("kept", F.coalesce("kept", "_text")).drop("digest", "_text")
