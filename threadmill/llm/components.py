"""Connected components of a graph held in a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadmill.llm.common import settled


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) for the nodes of `edges` (a, b).

    Alternates the large-star and small-star operations: the neighbours of a
    node are linked to the smallest of them, larger ones first and then smaller
    ones.  The number of edges never grows, and the rounds are about the
    logarithm of the longest path.  Each round is written out.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    current, before = settled(pairs.distinct()), None
    while True:
        now = current.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31))).alias("s")
        ).first()
        if now == before:
            break
        before = now
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = settled(large.where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(least, "u")
        small = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            linked.select("u", F.col("m").alias("v"))
        )
        current = settled(small.where("u <> v").distinct())
    roots = current.select(F.col("v").alias("node")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
