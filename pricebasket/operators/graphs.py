"""Connected components of a graph given as a table of edges, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from pricebasket.session import stored


def _mark(edges: DataFrame) -> Row:
    """Equal for equal sets of edges: their number and two 64-bit digests, one aggregate without a join."""
    return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64(F.lit(1), "b", "a"))).first()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of all nodes that an edge (a, b) names.

    Each round links every node's larger neighbours, and then its smaller ones, to the smallest node it knows (large
    and small stars in turn), until nothing changes (by the edges' number and digests). Stars are pre-aggregated
    minima; no neighbourhood is gathered; rounds grow with the logarithm of the longest path. Loops and repeated edges do nothing; no edges, no nodes.
    """
    now = stored(edges.sparkSession, edges.select("a", "b").filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _mark(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        small_least = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        small = large.join(small_least, F.col("a") == F.col("n")).select(
            F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")
        ).filter("a != b").distinct()
        after = stored(edges.sparkSession, small, "edges")
        mark, now = before, after
        before = _mark(now)
        if mark == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
