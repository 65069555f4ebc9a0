"""Connected components of an edge table, by alternating large and small stars.

Every step is an aggregation and a join, both by node; nothing is collected. The table of minima is
written before it is joined, so that the join reads two plain exchanges and Spark can split the
partition of a node with very many neighbours. Tables have about ``ROWS`` edges a partition, so that
a few edges don't make as many files a round as the session has shuffle partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Edges of a partition, about; and partitions, at least.
ROWS, LEAST = 100_000, 8


def _minima(adjacent: DataFrame, parts: int) -> DataFrame:
    return shared.cut(adjacent.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(parts))


def components(edges: DataFrame, most_rounds: int = 100, files: int | None = None) -> DataFrame:
    """node and root of each node of an edge (u, v), the root being the smallest node it reaches, itself left out.

    The rounds grow with the logarithm of a component's size; not to be done after ``most_rounds`` is an error. The edges are first
    written as at most ``files`` files, if that is given.
    """
    e = shared.cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), files)
    parts = max(LEAST, -(-e.count() // ROWS))  # the stars never make more edges
    e, before = e.coalesce(parts), None
    for _ in range(most_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.where("v > u").join(_minima(both, parts), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = shared.cut(large.where("u <> v").coalesce(parts).distinct().coalesce(parts))
        small = large.join(_minima(large, parts), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("v"))
        e = shared.cut(small.coalesce(parts).union(least.coalesce(parts)).distinct().coalesce(parts))
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"the components of the links are not settled after {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
