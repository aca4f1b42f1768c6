"""Near duplicates by SimHash fingerprints, searched with vantage-point trees.

A metric tree over whole 64-bit fingerprints prunes almost nothing: distances of unrelated fingerprints to any
vantage point are 32 +- 4, as wide as the radius. So the trees stand over bands of 16 bits. Fingerprints that
differ in ``radius`` bits differ in at most ``radius // bands`` bits of some band, and distances in a band are
8 +- 2. One tree per band parts the 65,536 band values by their distance to vantage points. A fingerprint has its
home in one leaf and visits every leaf the triangle bound does not exclude, so each linked pair meets in a leaf of
some band; there it is compared over all bits. The trees depend on their depth alone, never on data.

A leaf returns a minimum spanning forest of its links, at most one link per member: links of every radius keep
their components, and no group is expanded to all pairs. Where only components are asked for, each member is tied to
the smallest node of its component instead: a group that meets in many leaves has the same ties there, not a forest
of its own in each. A leaf with more than ``BLOCK`` members is dealt as pairs of blocks. Components are found over
the links in Spark.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetgrain.llm import arrow, graph, hashing, suffix_dedup, words
from packetgrain.session import cut

BAND_BITS = 16
LEAF_ROWS = 16_384
BLOCK = 32_768
LEAST_DEPTH, MOST_DEPTH = 4, 11
# Pairs compared at once.
CHUNK = 1 << 20
# Near duplicates: share of pairs at the similarity that meet in no leaf, lanes that travel with a member of a leaf, nodes
# of a leaf and of a block, and the texts and shingles of a block of candidates.
MISSED = 1e-6
CARRIED = 4
NEAR_ROWS, NEAR_BLOCK = 1 << 20, 1 << 22
GROUP_TEXTS, GROUP_SHINGLES = 1024, 1 << 20


# Fingerprints


def bit_majorities(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For every run ``first[i]:first[i + 1]`` the bits set in over half of its hashes; an empty run gives zero."""
    rows = len(first) - 1
    out = np.zeros(rows, np.uint64)
    counts = np.diff(first)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    # Eight counters of one byte in a word: runs are summed in blocks of at most 255.
    blocks = -(-counts[full] // 255)
    owner = np.repeat(np.arange(len(full)), blocks)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    starts = first[:-1][full][owner] + step * 255
    begin = np.searchsorted(owner, np.arange(len(full)))
    for bit in range(8):
        plane = (hashes >> np.uint64(bit)) & np.uint64(0x0101010101010101)
        sums = np.add.reduceat(plane, starts).view(np.uint8).reshape(-1, 8)
        totals = np.add.reduceat(sums.astype(np.int64), begin, axis=0)
        major = (2 * totals > counts[full][:, None]).astype(np.uint64)
        for byte in range(8):
            out[full] |= major[:, byte] << np.uint64(8 * byte + bit)
    return out


def shingle_hashes(w: words.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 (seed 42) of every run of ``size`` words, or of all words where a text has fewer; and each text's runs."""
    joined, at, end = w.joined()
    counts = np.where(w.counts > 0, np.maximum(w.counts - size + 1, 1), 0)
    first = np.concatenate([[0], np.cumsum(counts)])
    start = np.repeat(w.first[:-1], counts) + np.arange(first[-1]) - np.repeat(first[:-1], counts)
    last = np.minimum(start + size, np.repeat(w.first[1:], counts)) - 1
    digest = xxhash.xxh64_intdigest
    found = [digest(joined[a:b], 42) for a, b in zip(at[start].tolist(), end[last].tolist(), strict=True)]
    return np.array(found, np.uint64), first


def fingerprints(docs: DataFrame, size: int = 4, lanes: int = 1, key: str = "doc_id") -> DataFrame:
    """The key, and ``lanes`` 64-bit fingerprints of the whole text as signed longs.

    Words are runs of anything but ASCII white space, A-Z lower-cased. The first lane is the majority of the
    shingles' hashes, further lanes are majorities of independent mixes of them. Texts without words, empty or
    null ones, have fingerprint zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in arrow.pieces(batch, "text"):
                hashes, first = shingle_hashes(words.find(data, offsets, words.VISIBLE), size)
                made = [bit_majorities(hashes, first)]
                for lane in range(1, lanes):
                    salted = hashing.mix(hashes ^ hashing.VALUES[lane])
                    made.append(bit_majorities(salted, first))
                flat = np.stack(made, axis=1).ravel().view(np.int64)
                ends = np.arange(0, len(flat) + 1, lanes, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(rows.schema.get_field_index(key)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                    ],
                    [key, "print"],
                )

    schema = T.StructType(
        [T.StructField(key, docs.schema[key].dataType), T.StructField("print", T.ArrayType(T.LongType(), False))]
    )
    return docs.select(key, "text").mapInArrow(run, schema)


# Vantage-point tree over the values of one band


def tree(depth: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home leaf of every band value; for each value the leaves it visits, in order, as places and leaves."""
    every = np.arange(1 << BAND_BITS, dtype=np.int64)
    home = np.zeros(len(every), np.int64)
    seen: list[tuple[np.ndarray, int]] = []
    stack, leaf = [(every, every, 0)], 0
    while stack:
        own, guests, level = stack.pop()
        if level == depth or len(own) < 2:
            home[own] = leaf
            seen.append((guests, leaf))
            leaf += 1
            continue
        # The vantage point is the member whose mixed value is smallest.
        vantage = own[np.argmin(hashing.mix((own + (level << 20) + 1).astype(np.uint64)))]
        away = np.bitwise_count(own ^ vantage)
        sizes = np.cumsum(np.bincount(away, minlength=BAND_BITS + 1))
        border = int(np.argmin(np.abs(2 * sizes - len(own))))
        far = np.bitwise_count(guests ^ vantage).astype(np.int64)
        inside = (own[away <= border], guests[far - reach <= border], level + 1)
        outside = (own[away > border], guests[far + reach > border], level + 1)
        stack += [side for side in (outside, inside) if len(side[0])]
    value = np.concatenate([g for g, _ in seen])
    to = np.repeat([n for _, n in seen], [len(g) for g, _ in seen])
    order = np.lexsort((to, value))
    return home, np.searchsorted(value[order], np.arange(len(every) + 1)), to[order]


def _bands(prints: np.ndarray) -> np.ndarray:
    """Band values of fingerprints of shape (rows, lanes)."""
    return np.ascontiguousarray(prints).view("<u2").astype(np.int64)


# Links inside a leaf


def spanning_forest(n: int, u: np.ndarray, v: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Places of the links of a minimum spanning forest; ties go to the first link."""
    label, kept = np.arange(n), []
    rank = np.lexsort((np.arange(len(d)), d))
    u, v = u[rank], v[rank]
    alive = np.arange(len(u))
    while True:
        a, b = label[u[alive]], label[v[alive]]
        alive = alive[a != b]
        if not len(alive):
            return rank[np.unique(np.concatenate([np.zeros(0, np.int64), *kept]))]
        a, b = label[u[alive]], label[v[alive]]
        best = np.full(n, len(u), np.int64)
        np.minimum.at(best, a, alive)
        np.minimum.at(best, b, alive)
        chosen = np.unique(best[best < len(u)])
        kept.append(chosen)
        # Tie the ends of the chosen links until every group has one label.
        while True:
            x, y = label[u[chosen]], label[v[chosen]]
            if (x == y).all():
                break
            low, high = np.minimum(x, y), np.maximum(x, y)
            parent = np.arange(n)
            np.minimum.at(parent, high, low)
            while (parent != parent[parent]).any():
                parent = parent[parent]
            label = parent[label]


def _close(home: np.ndarray, guests: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places whose band values differ in at most ``reach`` bits (0 or 1), in bounded chunks."""
    order = np.argsort(home, kind="stable")
    values = home[order]
    for flip in [0] + [1 << b for b in range(BAND_BITS)] * (reach > 0):
        lo = np.searchsorted(values, guests ^ flip)
        count = np.searchsorted(values, guests ^ flip, side="right") - lo
        total, at = np.cumsum(count), 0
        while at < len(guests):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + CHUNK, side="right")))
            size = count[at:to]
            if size.sum():
                left = np.repeat(np.arange(at, to), size)
                step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
                yield order[np.repeat(lo[at:to], size) + step], left
            at = to


def _leaf_links(node: np.ndarray, prints: np.ndarray, role: np.ndarray, band: int, radius: int, reach: int):
    """Spanning forest of the links of one block pair; ``band`` is one of the first lane's.

    Roles: 0 home, 1 guest from another leaf, 2 home and guest, 3 guest from the leaf itself.
    """
    value = _bands(prints)[:, band]
    home, guest = np.flatnonzero((role == 0) | (role == 2)), np.flatnonzero(role > 0)
    found, held = [], 0
    for a, b in _close(value[home], value[guest], reach):
        x, y = home[a], guest[b]
        # A pair of the leaf's own members is met once, by the order of the nodes.
        keep = node[x] != node[y]
        keep &= (role[y] == 1) | (node[x] < node[y])
        x, y = x[keep], y[keep]
        d = np.zeros(len(x), np.int64)
        for lane in range(prints.shape[1]):
            d += np.bitwise_count(prints[x, lane] ^ prints[y, lane])
        near = d <= radius
        if near.any():
            found.append((x[near], y[near], d[near]))
            held += int(near.sum())
        if held > 4 * CHUNK:
            found = [_forest(len(node), found)]
            held = len(found[0][0])
    return _forest(len(node), found) if found else (home[:0], home[:0], home[:0])


def _forest(n: int, found: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    u, v, d = (np.concatenate(x) for x in zip(*found, strict=True))
    kept = spanning_forest(n, u, v, d)
    return u[kept], v[kept], d[kept]


def _ties(node: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For links between the places ``u`` and ``v``: every linked node but the smallest of its component, and that one."""
    names, at = np.unique(np.concatenate([node[u], node[v]]), return_inverse=True)
    x, y = at[: len(u)], at[len(u) :]
    label = np.arange(len(names))
    while (label[x] != label[y]).any():
        low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        np.minimum.at(label, high, low)
        while (label != label[label]).any():
            label = label[label]
    member = np.flatnonzero(label != np.arange(len(names)))
    return names[member], names[label[member]]


def _least_ties(found: DataFrame) -> DataFrame:
    """For ties u, v, one for each leaf or pair of blocks that ``u`` is in: all of them and ``u`` tied to the smallest."""
    tied = found.withColumn("least", F.min("v").over(Window.partitionBy("u")))
    return tied.select(F.when(F.col("v") == F.col("least"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("least").alias("v")).distinct()


def links(
    nodes: DataFrame, radius: int, lanes: int = 1, reach: int | None = None, carried: int | None = None,
    leaf_rows: int | None = None, block_rows: int | None = None, ties: bool = False,
) -> DataFrame:
    """u, v, distance: links of at most ``radius`` bits that keep all components, for ``nodes(node long, print)``.

    ``print`` has ``lanes`` longs. With ``reach`` (bits a band may differ in, 0 or 1) at least ``radius // bands``,
    the default, no link is lost; a smaller reach is a search with misses. Distances are those of ``carried`` lanes,
    the band's own and the next; all lanes without it. With ``ties`` only u, v: nodes and
    smaller ones of their component, about one row per node. They keep the components of this radius, and are no links.
    """
    carried = carried or lanes
    leaf_rows, block_rows = leaf_rows or LEAF_ROWS, block_rows or BLOCK
    bands = 4 * lanes
    exact = radius // bands
    if reach is None:
        reach = exact
    if reach > 1:
        raise ValueError("bands may differ in one bit at most; use more lanes or a smaller radius")
    n = nodes.count()
    depth = int(min(MOST_DEPTH, max(LEAST_DEPTH, np.ceil(np.log2(max(n, 1) / leaf_rows)))))
    home, at, to = tree(depth, reach)
    leaves = int(home.max()) + 1

    def visits(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and leaves beyond the home leaf; of two leaves that a pair could meet in, only the later."""
        size = at[values + 1] - at[values]
        row = np.repeat(np.arange(len(values)), size)
        leaf = to[np.repeat(at[values], size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)]
        later = leaf > home[values][row]
        return row[later], leaf[later]

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        column = batch.column(1)
        return column.flatten().to_numpy().view(np.uint64).reshape(-1, lanes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, bands * leaves), np.int64)
        for batch in batches:
            for band, values in enumerate(_bands(matrix(batch)).T):
                held[0] += np.bincount(band * leaves + home[values], minlength=bands * leaves)
                held[1] += np.bincount(band * leaves + visits(values)[1], minlength=bands * leaves)
        used = np.flatnonzero(held.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(held[0][used]), pa.array(held[1][used])], ["leaf", "h", "g"])

    rows = nodes.select("node", "print")
    # A row per band and leaf, however many nodes there are.
    sizes = rows.mapInArrow(count, "leaf long, h long, g long").groupBy("leaf").agg(F.sum("h").alias("h"), F.sum("g").alias("g"))
    home_blocks, guest_blocks = np.ones(bands * leaves, np.int64), np.ones(bands * leaves, np.int64)
    for r in sizes.collect():
        home_blocks[r["leaf"]] = max(1, -(-r["h"] // block_rows))
        # Home members of a leaf in several block pairs are guests of all its home blocks too.
        if max(r["h"], r["g"]) > block_rows:
            guest_blocks[r["leaf"]] = -(-(r["h"] + r["g"]) // block_rows)
    single = (home_blocks == 1) & (guest_blocks == 1)

    def spread(row, leaf, nodes_, own, other, role):
        """Row, block-pair key and role: a member goes to its own block paired with every block of the other side."""
        block = (hashing.mix(nodes_[row].view(np.uint64)) % own[leaf].astype(np.uint64)).astype(np.int64)
        size = other[leaf]
        step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        row, leaf, block = np.repeat(row, size), np.repeat(leaf, size), np.repeat(block, size)
        pair = block * guest_blocks[leaf] + step if role == 0 else step * guest_blocks[leaf] + block
        return row, leaf, pair, np.full(len(row), role, np.int8)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column(0).to_numpy()
            prints = matrix(batch)
            for band, values in enumerate(_bands(prints).T):
                row = np.arange(len(values))
                leaf = band * leaves + home[values]
                guest_row, guest_leaf = visits(values)
                guest_leaf = guest_leaf + band * leaves
                alone = single[leaf]
                split = row[~alone]
                parts = [
                    (row[alone], leaf[alone], np.zeros(int(alone.sum()), np.int64), np.full(int(alone.sum()), 2, np.int8)),
                    spread(split, leaf[~alone], node, home_blocks, guest_blocks, 0),
                    spread(guest_row, guest_leaf, node, guest_blocks, home_blocks, 1),
                ]
                if len(split):
                    r, l, p, _ = spread(split, leaf[~alone], node, guest_blocks, home_blocks, 1)
                    parts.append((r, l, p, np.full(len(r), 3, np.int8)))
                r, l, p, role = (np.concatenate(x) for x in zip(*parts, strict=True))
                own = np.ascontiguousarray(prints[:, (band // 4 + np.arange(carried)) % lanes])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(l),
                        pa.array(p),
                        pa.array(role),
                        pa.array(node[r]),
                        pa.FixedSizeBinaryArray.from_buffers(
                            pa.binary(8 * carried), len(r), [None, pa.py_buffer(own[r].tobytes())]
                        ).cast(pa.binary()),
                    ],
                    ["leaf", "pair", "role", "node", "print"],
                )

    def meet(key, table):
        node = table["node"].to_numpy()
        raw = b"".join(table["print"].to_pylist())
        prints = np.frombuffer(raw, np.uint64).reshape(-1, carried)
        role = table["role"].to_numpy()
        u, v, d = _leaf_links(node, prints, role, key[0].as_py() // leaves % 4, radius, reach)
        if ties:
            return pa.table(dict(zip(("u", "v"), _ties(node, u, v), strict=True)))
        return pa.table({"u": node[u], "v": node[v], "distance": d.astype(np.int32)})

    dealt = rows.mapInArrow(deal, "leaf long, pair long, role byte, node long, print binary")
    found = dealt.groupBy("leaf", "pair").applyInArrow(meet, "u long, v long" + ", distance int" * (not ties))
    if not ties:
        return found
    return _least_ties(found)


# Operators


def classes(docs: DataFrame, size: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document.

    component_id is the smallest doc_id that links of at most ``radius`` differing bits reach. Defined results: a
    null document id has its fingerprint, and counts for no component's smallest id unless it is alone; repeated
    rows are kept; an empty table gives no rows. Other columns are not read.
    """
    prints = cut(fingerprints(docs, size).select("doc_id", F.col("print")[0].alias("node")))
    nodes = cut(prints.groupBy("node").agg(F.min("doc_id").alias("least")))
    found = links(nodes.select("node", F.array("node").alias("print")), radius, ties=True)
    roots = graph.components(found)
    rooted = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    member = rooted.select("node", "root").join(least, "root").select("node", "component_id")
    return prints.join(member, "node").select(
        "doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id"
    )


def near_settings(similarity: float) -> tuple[int, int]:
    """Lanes, and radius over the carried ones, that find pairs of shingle sets of this Jaccard index.

    Two sets of one size have an angle with cosine 2 s / (1 + s), and every bit of their fingerprints differs with
    probability angle / pi, on its own. A pair meets where a band differs in at most one bit.
    """
    differ = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    same = 1 - differ
    meets = same**BAND_BITS + BAND_BITS * differ * same ** (BAND_BITS - 1)
    lanes = max(CARRIED, math.ceil(math.log(MISSED) / math.log1p(-meets) / 4)) if meets < 1 else CARRIED
    bits = 64 * CARRIED
    return lanes, math.ceil(bits * differ + 6 * math.sqrt(bits * differ * same))


def _set_prints(docs: DataFrame, size: int, lanes: int) -> DataFrame:
    """doc_id, digest, number of shingles and fingerprint of the distinct shingles of every row of ``docs(doc_id, digest, text)``.

    Over distinct shingles, repeats in a text change nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in arrow.pieces(batch, "text"):
                hashes, first = shingle_hashes(words.find(data, offsets, words.VISIBLE), size)
                sets = [np.unique(hashes[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
                own = np.concatenate([np.zeros(0, np.uint64), *sets])
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets], dtype=np.int64)])
                made = [bit_majorities(hashing.mix(own ^ hashing.VALUES[lane]) if lane else own, ends) for lane in range(lanes)]
                flat = np.stack(made, axis=1).ravel().view(np.int64)
                places = np.arange(0, len(flat) + 1, lanes, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array(np.diff(first)),
                        pa.ListArray.from_arrays(pa.array(places), pa.array(flat)),
                    ],
                    ["doc_id", "digest", "n", "print"],
                )

    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("digest", T.BinaryType()),
            T.StructField("n", T.LongType()),
            T.StructField("print", T.ArrayType(T.LongType(), False)),
        ]
    )
    return docs.select("doc_id", "digest", "text").mapInArrow(run, schema)


def _shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """``docs(node, root, blocks, text)`` with the distinct shingle hashes in place of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in arrow.pieces(batch, "text"):
                hashes, first = shingle_hashes(words.find(data, offsets, words.VISIBLE), size)
                sets = [np.unique(hashes[a:b]).view(np.int64) for a, b in zip(first[:-1], first[1:], strict=True)]
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns[:3], pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                    ["node", "root", "blocks", "shingles"],
                )

    return docs.select("node", "root", "blocks", "text").mapInArrow(
        run, "node long, root long, blocks long, shingles array<long>"
    )


def _confirmed(block: np.ndarray, flat: np.ndarray, first: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links of sets ``flat[first[i]:first[i + 1]]`` that join all pairs of at least the given Jaccard index.

    With two blocks, pairs of one block are left out. Members already joined are not compared.
    """
    sizes, found = np.diff(first), []
    place = np.unique(flat, return_inverse=True)[1]
    label = np.arange(len(sizes))
    mark = np.zeros(int(place.max(initial=-1)) + 1, np.int64)
    later, crossing = np.arange(len(sizes)), block.min() != block.max()
    for x in range(len(sizes)):
        low, high = np.minimum(sizes, sizes[x]), np.maximum(sizes, sizes[x])
        rest = np.flatnonzero((later > x) & (label != label[x]) & (low >= similarity * high))
        if crossing:
            rest = rest[block[rest] != block[x]]
        if not len(rest):
            continue
        own = place[first[x] : first[x + 1]]
        mark[own] = 1
        ends = np.cumsum(sizes[rest])
        at = np.arange(int(ends[-1])) + np.repeat(first[rest] - ends + sizes[rest], sizes[rest])
        total = np.concatenate([[0], np.cumsum(mark[place[at]])])
        mark[own] = 0
        both = total[ends] - total[ends - sizes[rest]]
        near = rest[both >= similarity * (sizes[rest] + sizes[x] - both)]
        found += [(x, int(y)) for y in near]
        label[np.isin(label, label[near])] = label[x]
    return found


def _near_links(sets: DataFrame, similarity: float) -> DataFrame:
    """u, v: members of the components of confirmed links within every root of ``sets(node, root, blocks, shingles)``, each
    with the smallest node of its component. A root is dealt as pairs of blocks."""
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    dealt = sets.withColumn("block", block).withColumn("step", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(
        "root", F.least("block", "step").alias("low"), F.greatest("block", "step").alias("high"), "block", "node", "shingles"
    )

    def meet(key, table):
        block, node = table["block"].to_numpy(), table["node"].to_numpy()
        column = table["shingles"].combine_chunks()
        size = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
        first = np.concatenate([[0], np.cumsum(size)])
        pairs = np.array(_confirmed(block, column.flatten().to_numpy(), first, similarity), np.int64).reshape(-1, 2)
        return pa.table(dict(zip(("u", "v"), _ties(node, pairs[:, 0], pairs[:, 1]), strict=True)))

    return _least_ties(dealt.groupBy("root", "low", "high").applyInArrow(meet, "u long, v long"))


def text_classes(docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """digest and root of every distinct text of ``docs(doc_id, digest, text)``: equal roots are one class."""
    lanes, radius = near_settings(similarity)
    prints = cut(_set_prints(docs, size, lanes))
    kinds = prints.groupBy("digest", "doc_id").agg(F.count("*").alias("n_rows"), F.first("n").alias("n"), F.first("print").alias("print"))
    first = F.struct(F.col("doc_id").isNull(), F.col("doc_id"))
    nodes = cut(
        kinds.groupBy("digest")
        .agg(
            F.min(first)["doc_id"].alias("least"),
            F.max("n_rows").alias("n_rows"),
            F.first("n").alias("n"),
            F.first("print").alias("print"),
        )
        .withColumn("node", F.monotonically_increasing_id())
    )
    # Texts of one fingerprint are candidates without a search; the first of them is searched.
    heads = cut(nodes.groupBy("print").agg(F.min("node").alias("v"), F.count("*").alias("n")))
    found = links(heads.select(F.col("v").alias("node"), "print"), radius, lanes, 1, CARRIED, NEAR_ROWS, NEAR_BLOCK, True)
    equal = nodes.select("node", "print").join(heads.where("n > 1").select("print", "v"), "print").where("node <> v")
    # The ties of the leaves keep the components of all candidate pairs.
    edges = found.unionByName(equal.select(F.col("node").alias("u"), "v"))
    roots = cut(graph.components(edges))
    member = nodes.select("node", "digest", "least", "n", "n_rows").join(roots, "node")
    blocks = F.ceil(F.greatest(F.count("*") / GROUP_TEXTS, F.sum("n") / GROUP_SHINGLES))
    sizes = member.groupBy("root").agg(F.greatest(F.lit(1), blocks).cast("long").alias("blocks"))
    member = cut(member.join(sizes, "root"))
    texts = docs.select("digest", F.col("doc_id").alias("least"), "text")
    same = (texts["digest"] == member["digest"]) & texts["least"].eqNullSafe(member["least"])
    sets = _shingle_sets(texts.join(member, same).select("node", "root", "blocks", "text"), size)
    if member.where("n_rows > 1").limit(1).count():
        sets = sets.dropDuplicates(["node"])
    checked = graph.components(cut(_near_links(sets, similarity)))
    return nodes.select("node", "digest", "least").join(checked, "node", "left").select(
        "digest", "least", F.coalesce("root", "node").alias("root")
    )


def near_duplicates(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id and component_id of every document: classes of texts whose shingle sets have the given Jaccard index.

    Nodes are distinct texts. Candidates are links of their fingerprints, found by the trees of all bands; every component
    of candidates is then compared by exact shingle sets, all pairs but those already joined, and only confirmed links
    make classes. A pair just at ``similarity`` is met in no leaf in less than one of 1,000,000 cases (calculated), in
    up to 3 of 10,000 where texts have as few as five shingles. A text without words is a copy of any other such text. Defined results for null ids and repeated rows as in ``classes``.
    """
    named = docs.select("doc_id", "text").withColumn("digest", suffix_dedup.digest())
    found = cut(text_classes(named, size, similarity))
    least = found.groupBy("root").agg(F.min("least").alias("component_id"))
    member = found.select("digest", "root").join(least, "root").select("digest", "component_id")
    return named.select("doc_id", "digest").join(member, "digest").select("doc_id", "component_id")


def first_of_classes(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of every class of ``near_duplicates``: that of the smallest id, a null id last, then of the smallest digest.

    Each row is judged by its text, also where ids are null or repeated; of rows of one text and id any one is kept.
    """
    named = docs.withColumn("_digest", suffix_dedup.digest())
    found = cut(text_classes(named.select("doc_id", F.col("_digest").alias("digest"), "text"), size, similarity))
    order = F.struct(F.col("least").isNull(), F.col("least"), F.col("digest"))
    chosen = cut(found.groupBy("root").agg(F.min(order).alias("first")).select(F.col("first.digest").alias("_chosen"), F.col("first.least").alias("_least")))
    same = (F.col("_digest") == F.col("_chosen")) & F.col("doc_id").eqNullSafe(F.col("_least"))
    kept = named.join(chosen, same, "left_semi")
    if kept.groupBy("_digest").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["_digest"])
    return kept.select(*docs.columns)
