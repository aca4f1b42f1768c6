"""Connected components of an undirected edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from packetgrain.session import cut


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node, root for ``edges(u, v)``: the smallest node reachable from every node that has an edge to another.

    Alternating large-star and small-star rounds: every node takes the smallest of its neighbours, neighbours are
    never gathered in one place, and the edges of a round are written and read again.
    """
    stars = cut(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    before = None
    for _ in range(most):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Larger neighbours of a node are tied to its smallest neighbour, or to itself if it is smaller.
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        # The smaller neighbours of a node are tied to the smallest of them, and so is the node.
        tied = large.join(least, "u")
        small = tied.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        # Counted while they are written.
        seen = Observation()
        total = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("total")
        stars = cut(stars.observe(seen, F.count("*").alias("n"), total))
        now = seen.get
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def attach(rows: DataFrame, facts: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``facts`` that have one row per ``on``, balanced when one key holds most rows.

    Keys with more than a quarter of a partition's fair share of rows meet their facts by broadcast: there are at most
    four such keys a partition, whatever the number of rows. All others are shuffled. ``rows`` is read twice.
    """
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = cut(rows.where(F.col(on).isNotNull()).groupBy(on).agg(F.count("*").alias("n")))
    share = (counts.agg(F.sum("n")).first()[0] or 0) / (4 * width)
    # Below this many rows a key is no burden for a task.
    hot = cut(counts.where(F.col("n") > max(share, 32)).select(on))
    if hot.isEmpty():
        return rows.join(facts, on, how)
    crowded = rows.join(F.broadcast(hot), on, "left_semi")
    others = rows.join(F.broadcast(hot), on, "left_anti")
    known = cut(facts.join(F.broadcast(hot), on, "left_semi"))
    return crowded.join(F.broadcast(known), on, how).unionByName(others.join(facts, on, how))
