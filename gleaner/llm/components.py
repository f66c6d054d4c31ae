"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import settle


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is tied to the least node of the neighbourhood."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each smaller neighbour of a node, and the node, are tied to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): for every node of an edge, the least node it is connected to. edges: (u, v),
    in either direction, repeated or not; loops don't matter.

    Every round at least squares down the distances to the least node in practice (log rounds); edges
    never grow in number. A node with very many edges is combined before the shuffle, and its join is
    one that Spark can split. Each round is written to the shared folder; only two numbers of it come
    to the driver, a count and a sum of hashes, which say whether it changed anything."""
    now = settle(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), name)
    before = None
    while True:
        after = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if after == before or not after[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = after
        now = settle(_small_star(_large_star(now)), name)
