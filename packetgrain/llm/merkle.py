"""Merkle manifest of a dataset: one hash tree per key and one over their roots, stored as van Emde Boas blocks.

A node has 8 children. A tree is stored as blocks of ``LEVELS`` steps from leaf to root: aligned subtrees of 4096
leaves, whose roots are the leaves of the next tier, until one block holds the whole tree. Inside a block the nodes lie
in van Emde Boas order: the levels are halved, the upper half comes first, then its bottom subtrees one after the
other, each laid out the same way. ``address`` computes the place of a node; construction and the retrieval of
siblings read and write through it alone, so a path touches few neighbouring places at any block size.

Leaves are dealt to blocks by their rank in the tree, so a key that holds a third of all rows is many blocks. A block
is the unit of work: a lost one is computed again from its leaves.

Defined results: null values hash as ``-``; a null key has its own tree, the first one; rows with a null id come first;
rows with one id are ordered by their leaf, equal rows are leaves of their own; an empty table has no blocks and no root.
Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetgrain.session import cut

FAN = 8
LEVELS = 4
DIGEST = 32


# Layout


def nodes(levels: int) -> int:
    """Nodes of a full tree of so many levels."""
    return (FAN**levels - 1) // (FAN - 1)


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Place of the nodes ``index`` at ``depth`` (the root has 0) in a block of ``levels`` levels."""
    if levels == 1:
        return np.zeros_like(index)
    top = levels // 2
    if depth < top:
        return address(top, depth, index)
    below = FAN ** (depth - top)
    return nodes(top) + index // below * nodes(levels - top) + address(levels - top, depth - top, index % below)


def counts(leaves: int, levels: int) -> list[int]:
    """Nodes present at every depth, the root first, over ``leaves`` leaves."""
    out = [leaves]
    for _ in range(levels - 1):
        out.append(-(-out[-1] // FAN))
    return out[::-1]


def height(leaves: int, most: int) -> int:
    """Node levels of the block that holds ``leaves`` leaves of a tree; at most ``most`` steps below its root."""
    levels = 1
    while FAN ** (levels - 1) < leaves and levels <= most:
        levels += 1
    return levels


def build(digests: np.ndarray, levels: int) -> np.ndarray:
    """A block in van Emde Boas order over the leaves ``digests`` (rows of 32 bytes); absent nodes are zero."""
    out = np.zeros((nodes(levels), DIGEST), np.uint8)
    present = counts(len(digests), levels)
    out[address(levels, levels - 1, np.arange(len(digests)))] = digests
    for depth in range(levels - 1, 0, -1):
        text = level_text(out, levels, depth, present[depth])
        made = [hashlib.sha256(text[at : at + FAN * 64]).digest() for at in range(0, len(text), FAN * 64)]
        parents = np.frombuffer(b"".join(made), np.uint8).reshape(-1, DIGEST)
        out[address(levels, depth - 1, np.arange(len(parents)))] = parents
    return out


def level_text(block: np.ndarray, levels: int, depth: int, present: int) -> bytes:
    """Hex digests of one level from left to right."""
    return block[address(levels, depth, np.arange(present))].tobytes().hex().encode()


@dataclass
class Path:
    """The siblings of a node up to the root: hex digests left and right of it, level by level."""

    sides: list[tuple[bytes, bytes]]

    @property
    def text(self) -> bytes:
        return b"".join(left + right for left, right in self.sides)

    def fold(self, digest: bytes) -> bytes:
        """The root over a node with this hex digest."""
        for left, right in self.sides:
            digest = hashlib.sha256(left + digest + right).hexdigest().encode()
        return digest


def paths(block: np.ndarray, leaves: int, levels: int, above: Path) -> list[Path]:
    """The path of every leaf of a block whose root has the path ``above``."""
    present = counts(leaves, levels)
    own = [above]
    for depth in range(1, levels):
        text = level_text(block, levels, depth, present[depth])
        below = []
        for i in range(present[depth]):
            run = i // FAN * FAN
            left, right = text[run * 64 : i * 64], text[(i + 1) * 64 : (run + FAN) * 64]
            below.append(Path([(left, right), *own[i // FAN].sides]))
        own = below
    return own


# Trees over DataFrames


def numbered(rows: DataFrame, order: list[str], tree: list[str]) -> DataFrame:
    """``rows`` with ``rank``, their place from 0 in ``order`` within the columns ``tree``, which lead it.

    Rows are dealt by ranges of the whole order; a range starts at the number of rows of its tree in the ranges before.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # The id is the number of the range times 2^33 plus the place in it.
    dealt = cut(ranged.withColumn("at", F.monotonically_increasing_id())).withColumn("part", F.shiftright("at", 33))
    keys = [F.col(c).alias(f"_{c}") for c in tree]
    sizes = dealt.groupBy(*keys, F.col("part").alias("_part")).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    # One row per range and tree in it.
    earlier = Window.partitionBy(F.lit(0), *(f"_{c}" for c in tree)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    same = [F.col("part") == F.col("_part"), *(F.col(c).eqNullSafe(F.col(f"_{c}")) for c in tree)]
    return (
        dealt.join(starts, same)
        .withColumn("rank", F.col("at") - F.col("first") + F.col("before"))
        .select(*rows.columns, "rank")
    )


def _tier(leaves: DataFrame, levels: int) -> DataFrame:
    """tree, block, size, leaves, levels, nodes of one tier; ``size`` is the number of leaves of the whole tree."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        digests = np.frombuffer(b"".join(table["leaf"].to_pylist()), np.uint8).reshape(-1, DIGEST)
        own = height(table["size"][0].as_py(), levels)
        head = table.slice(0, 1).select(["tree", "block", "size"])
        made = build(digests, own).tobytes()
        for name, value, kind in (("leaves", len(digests), pa.int32()), ("levels", own, pa.int32()), ("nodes", made, pa.binary())):
            head = head.append_column(name, pa.array([value], kind))
        return head

    return (
        leaves.select("tree", "size", "rank", "leaf", F.shiftright("rank", 3 * levels).alias("block"))
        .groupBy("tree", "block")
        .applyInArrow(run, "tree long, block long, size long, leaves int, levels int, nodes binary")
    )


def _root(blocks: DataFrame, **names: Column | str) -> DataFrame:
    return blocks.select(F.substring("nodes", 1, DIGEST).alias("leaf"), *(F.expr(v).alias(k) for k, v in names.items()))


def forest(leaves: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """The blocks of all trees over ``leaves(tree, size, rank, leaf)``, tier by tier from the leaves up."""
    largest = leaves.agg(F.max("size")).first()[0] or 0
    tiers = [cut(_tier(leaves, levels))]
    while largest > FAN**levels:
        largest = -(-largest // FAN**levels)
        above = _root(tiers[-1], tree="tree", size=f"(size + {FAN**levels - 1}) div {FAN**levels}", rank="block")
        tiers.append(cut(_tier(above, levels)))
    return tiers


@dataclass
class Manifest:
    members: DataFrame  # the given rows with tree, size, rank
    tiers: list[DataFrame]  # blocks of the trees of the keys
    top: list[DataFrame]  # blocks of the tree over their roots
    levels: int


def manifest(rows: DataFrame, levels: int = LEVELS) -> Manifest:
    """Trees over ``rows(key, doc_id, leaf)``, one per key by doc_id, and one over the keys; more columns are kept."""
    rows = cut(rows.withColumn("_copy", F.monotonically_increasing_id()))
    keys = cut(numbered(rows.groupBy("key").agg(F.count("*").alias("size")), ["key"], []).withColumnRenamed("rank", "tree"))
    named = rows.join(keys.withColumnRenamed("key", "_key"), F.col("key").eqNullSafe(F.col("_key"))).drop("_key")
    members = cut(numbered(named, ["tree", "doc_id", "leaf", "_copy"], ["tree"]).drop("_copy"))
    tiers = forest(members, levels)
    subroots = _root(tiers[-1], tree="0L", size=f"{keys.count()}L", rank="tree")
    return Manifest(members, tiers, forest(subroots, levels), levels)


SIDES = "array<struct<left: binary, right: binary>>"


def _sides(paths: list[Path]) -> pa.Array:
    kind = pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())]))
    return pa.array([[{"left": a, "right": b} for a, b in path.sides] for path in paths], kind)


def _path(sides) -> Path:
    return Path([(side["left"], side["right"]) for side in sides])


def _block(row: dict, above: Path) -> list[Path]:
    return paths(np.frombuffer(row["nodes"], np.uint8).reshape(-1, DIGEST), row["leaves"], row["levels"], above)


def _down(blocks: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """tree, block, sides of the blocks below: the path of every leaf of ``blocks``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = _block(row, _path(row["sides"]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["tree"]] * len(found), pa.int64()),
                        pa.array(np.arange(len(found)) + row["block"] * FAN**levels),
                        _sides(found),
                    ],
                    ["tree", "block", "sides"],
                )

    return blocks.join(above, ["tree", "block"]).mapInArrow(run, f"tree long, block long, sides {SIDES}")


def _above(made: Manifest) -> DataFrame:
    """tree, block, sides, subroot, root: the path of the root of every block of leaves."""
    start = made.top[-1].select("tree", "block", F.array().cast(SIDES).alias("sides"))
    for blocks in made.top[::-1]:
        start = _down(blocks, start, made.levels)
    # A place in the tree over the keys is a tree; its path is that of the tree's last block.
    start = start.select(F.col("block").alias("tree"), F.lit(0).cast("long").alias("block"), "sides")
    for blocks in made.tiers[:0:-1]:
        start = _down(blocks, start, made.levels)
    root = _root(made.top[-1]).first()
    subroots = _root(made.tiers[-1], tree="tree").withColumnRenamed("leaf", "subroot")
    return cut(start.join(subroots, "tree").withColumn("root", F.lit(root and bytes(root["leaf"])).cast("binary")))


def _walk(made: Manifest, columns: list[str], add, schema: str) -> DataFrame:
    """Columns of the members, subroot, root (hex) and what ``add(table, paths, root)`` appends from their paths."""

    def run(rows: pa.Table, blocks: pa.Table) -> pa.Table:
        rows = rows.sort_by("rank")
        block = blocks.to_pylist()[0]
        found = _block(block, _path(block["sides"]))
        out = rows.select(columns)
        for name in ("subroot", "root"):
            out = out.append_column(name, pa.array([block[name].hex()] * len(rows), pa.string()))
        for name, values in add(rows, found, block["root"]):
            out = out.append_column(name, values)
        return out

    kept = made.members.select(*columns)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema]
    rows = made.members.withColumn("block", F.shiftright("rank", 3 * made.levels)).groupBy("tree", "block")
    blocks = made.tiers[0].join(_above(made), ["tree", "block"]).groupBy("tree", "block")
    return rows.cogroup(blocks).applyInArrow(run, ", ".join([*kinds, "subroot string, root string", schema]))


def proofs(made: Manifest) -> DataFrame:
    """key, doc_id, rank, leaf, subroot, root, sides: hex digests of the siblings left and right, level by level."""
    return _walk(made, ["key", "doc_id", "rank", "leaf"], lambda rows, found, root: [("sides", _sides(found))], f"sides {SIDES}")


def audit(made: Manifest, claim: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for the leaf in column ``claim`` of the members.

    proof_sha256 is of the siblings from the leaf to the root; folded_root is the root over ``claim`` and them.
    """

    def add(rows: pa.Table, found: list[Path], root: bytes):
        folded = [path.fold(leaf.hex().encode()).decode() for path, leaf in zip(found, rows[claim].to_pylist(), strict=True)]
        yield "proof_sha256", pa.array([hashlib.sha256(path.text).hexdigest() for path in found], pa.string())
        yield "folded_root", pa.array(folded, pa.string())
        yield "verified", pa.array([f == root.hex() for f in folded], pa.bool_())

    found = _walk(made, ["doc_id", "leaf"], add, "proof_sha256 string, folded_root string, verified boolean")
    return found.withColumn("leaf", F.lower(F.hex("leaf")))


def leaf_of(*values: Column) -> Column:
    """Digest of a row: each value as its byte count, a colon and its text, or ``-`` where it is null."""
    parts = []
    for value in values:
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))
