"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import SMALL, settled, spread_join

#: Edges a partition, where fewer partitions are enough.
EDGES_EACH = 50_000


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of the nodes that are not their component's smallest.

    ``links`` has columns a and b, in any order, with repeats allowed. Edges go
    from the larger node u to the smaller v. Large-star moves the edges of a node
    to its least neighbour: only smaller neighbours matter for that, so the
    minimum is over a node's edges to them. Minima are gathered with partial
    aggregation, and the edges of a node that has very many are not brought
    together to learn its minimum. Each round is written to the shared checkpoint
    folder.
    """
    edges, n = settled(_distinct(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))), EDGES_EACH)
    mark = None
    while n:
        seen = (n, *edges.agg(F.expr("bit_xor(xxhash64(u, v))"), F.sum("v")).first())
        if seen == mark:
            break
        mark, few = seen, max(1, -(-2 * n // EDGES_EACH))
        by_larger = edges.groupBy("u").agg(F.min("v").alias("m"))
        by_smaller = edges.groupBy("v").agg(F.count("*").alias("members"))
        least = by_smaller.join(by_larger.withColumnRenamed("u", "v"), "v", "left")
        large = spread_join(edges, least, ["v"], n)
        large = _distinct(large.select("u", F.coalesce("m", "v").alias("v")).coalesce(few)).coalesce(few)
        if n > SMALL:  # several joins follow; few edges are computed again
            large, n = settled(large, EDGES_EACH)
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("members"))
        small = spread_join(large, least, ["u"], n).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges, n = settled(_distinct(small.unionByName(least.select("u", F.col("m").alias("v"))).coalesce(few)), EDGES_EACH)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
