"""Connected components of an edge list by min-label hooking and jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _digest(pairs: DataFrame) -> tuple:
    """Number of distinct pairs and 128 bits of hashes over them: tells whether
    a round changed anything by one aggregation, without a shuffle of the pairs."""
    return tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", F.lit(1), "u"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of ``edges``: the smallest node that
    it can reach.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): each
    round links nodes to the smallest neighbour they see, so the edge list
    never holds more rows than before and becomes one star a component after
    about log2(n)^2 rounds at most.  Every round is an aggregation with
    map-side combine and a join, checkpointed to the shared folder, so no
    neighbourhood is collected and lost executors cost one round."""
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u != v")
    pairs = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    seen = _digest(pairs)
    while True:
        # large star: a node's larger neighbours move to its smallest one
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: a node and its smaller neighbours move to the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", F.col("m").alias("v"))).distinct().checkpoint())
        pairs, before, seen = small, seen, _digest(small)
        if seen == before:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                pairs.select("v", "v").distinct())
