"""Document fingerprints from closed syncmers, in DataFrame functions only.

A text is cut in tokens: runs without white space of at most 16 characters, and the single characters of longer runs,
so that text written without spaces is cut alike on both sides of an edit. Of all runs of ``K`` tokens those are kept
whose least run of ``S`` tokens, by hash, stands first or last in them (closed syncmers). Whether a run is kept depends
on its own tokens alone, so an edit changes only the runs it touches, and kept runs are anchors for matching by
position. The fingerprint is the ``SIZE`` smallest distinct hashes of kept runs; the likeness of two of them is the
share both have of the ``SIZE`` smallest of their union, an estimate of the Jaccard index. Runs of ``K`` characters of
a small alphabet (digits, bases) are few, so texts of nothing else are alike by chance.

Defined results: a null text is empty; a text of fewer than ``K`` tokens has one run, all its tokens; an empty text
has an empty fingerprint, which is like another empty one (1) and unlike any other (0); repeated rows are kept; an
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 5
S = 2
SIZE = 64
TOKEN = r"(?<!\S)\S{1,16}(?!\S)|\S"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _runs(tokens: Column) -> Column:
    """Place and hash of every closed syncmer of a token array."""

    def chosen(h):
        inner = F.transform(F.sequence(F.lit(1), F.size(h) - S + 1), lambda i: F.xxhash64(h[i - 1], h[i]))

        def places(m):
            middle = lambda i: F.least(*[m[i + j] for j in range(1, K - S)])
            kept = F.filter(
                F.sequence(F.lit(0), F.size(h) - K), lambda i: F.least(m[i], m[i + K - S]) <= middle(i)
            )
            return F.transform(
                kept,
                lambda i: F.struct(
                    i.cast("int").alias("position"),
                    F.xxhash64(*[m[i + j] for j in range(0, K - 1, S)], h[i + K - 1]).alias("hash"),
                ),
            )

        whole = F.array(F.struct(F.lit(0).alias("position"), F.xxhash64(h).alias("hash")))
        none = F.array().cast("array<struct<position:int,hash:bigint>>")
        return F.when(F.size(h) == 0, none).when(F.size(h) < K, whole).otherwise(let(inner, places))

    return let(F.transform(tokens, lambda t: F.xxhash64(t)), chosen)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def anchors(docs: DataFrame) -> DataFrame:
    """doc_id, position (token, from 0) and hash of every kept run."""
    return docs.select("doc_id", F.inline(_runs(tokens(F.col("text")))))


def sketch(text: Column) -> Column:
    """The smallest distinct hashes of kept runs, 32 bits each, ascending."""
    hashes = F.transform(_runs(tokens(text)), lambda r: F.shiftright(r["hash"], 32).cast("int"))
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, SIZE)


def likeness(a: Column, b: Column) -> Column:
    def shared(union):
        both = F.size(F.array_intersect(F.array_intersect(union, a), b))
        return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union))

    return let(F.slice(F.sort_array(F.array_union(a, b)), 1, SIZE), shared)


def text_form(found: Column) -> Column:
    """Eight hexadecimal digits per hash."""
    return F.array_join(F.transform(found, lambda h: F.lower(F.lpad(F.hex(h.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))), "")


def _bounds(docs: DataFrame) -> tuple[list, object]:
    """Ids that part the table in cells of like size, and the largest id. Their number follows the shuffle width."""
    n, top = docs.agg(F.count("doc_id"), F.max("doc_id")).first()
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = min(max(1, n // 128), 16 * width)
    shares = [i / cells for i in range(1, cells)]
    found = docs.approxQuantile("doc_id", shares, 1 / (4 * cells)) if shares else []
    return sorted({int(b) for b in found} - {top}), top


def with_next(docs: DataFrame) -> DataFrame:
    """``docs`` with ``next_text`` and ``next_sketch`` of the next lower doc_id; the lowest is followed by the highest.

    Rows are dealt to cells between ids of the table. The highest row of a cell is also a guest of the cell above,
    the highest of all a guest of the lowest cell, so each cell finds every neighbour alone. Rows of one id follow
    each other by their text's hash; null ids come after all others.
    """
    rows = docs.select("doc_id", "text", sketch(F.col("text")).alias("sketch"))
    bounds, top = _bounds(docs)
    limits = F.array(*[F.lit(b) for b in bounds]).cast("array<bigint>")
    step = 1 << max(len(bounds).bit_length() - 1, 0)
    steps = F.array(*[F.lit(step >> i) for i in range(step.bit_length())])

    def search(lo, s):
        inside = (lo + s <= len(bounds)) & (F.get(limits, lo + s - 1) < F.col("doc_id"))
        return F.when(inside, lo + s).otherwise(lo)

    cell = F.when(F.col("doc_id").isNull(), 0).otherwise(F.aggregate(steps, F.lit(0), search)) if bounds else F.lit(0)
    rows = rows.withColumn("_cell", cell.cast("int"))
    home = F.struct(F.col("_cell").alias("cell"), F.lit(0).alias("guest"))
    if top is None:
        guest = F.lit(False)
    else:
        guest = F.col("doc_id") == top
    above = F.when(guest, F.lit(0)).otherwise(F.col("_cell") + 1)
    edge = guest | (F.get(limits, F.col("_cell")) == F.col("doc_id")) if bounds else guest
    visit = F.struct(above.cast("int").alias("cell"), F.lit(1).alias("guest"))
    dealt = rows.select(
        "doc_id", "text", "sketch", F.inline(F.when(edge, F.array(home, visit)).otherwise(F.array(home)))
    )
    order = Window.partitionBy("cell").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    nearest = dealt.select(
        "doc_id",
        "text",
        "sketch",
        "guest",
        F.lead(F.coalesce("text", F.lit(""))).over(order).alias("next_text"),
        F.lead("sketch").over(order).alias("next_sketch"),
    )
    # Only where all ids are null has a last row no guest behind it; it is then its own next.
    return nearest.where("guest = 0").select(
        "doc_id",
        F.coalesce("text", F.lit("")).alias("text"),
        "sketch",
        F.coalesce("next_text", "text", F.lit("")).alias("next_text"),
        F.coalesce("next_sketch", "sketch").alias("next_sketch"),
    )


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of the text whose latter half is taken from the next document."""
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_text", F.lit(1), half)
    )
    rows = with_next(docs).withColumn("n_chars", F.char_length("text").cast("long")).withColumn("edited", edited)
    rows = rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "sketch",
        sketch(F.col("edited")).alias("edited_sketch"),
        "next_sketch",
    )
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        text_form(F.col("sketch")).alias("fingerprint"),
        text_form(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
