"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlight.llm.common import BROADCAST_ROWS, cut


def _star(edges: DataFrame, large: bool, small: bool) -> DataFrame:
    """Each node links its neighbours to the least node it sees.

    large: only larger neighbours move; else the smaller ones and the node itself do.
    The least neighbour comes from an aggregate with partial sums, not from a list of
    neighbours, so that a node with very many links needs no large task memory. small says
    that the least neighbours, a row a node, may be broadcast.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("w")).select(F.col("u").alias("u2"), F.least("u", "w").alias("m"))
    joined = both.join(F.broadcast(least) if small else least, F.col("u") == F.col("u2"))
    if large:
        moved = joined.filter(F.col("v") > F.col("u")).select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        moved = joined.select(F.col("m").alias("a"), F.col("v").alias("b")).unionAll(least.select(F.col("m").alias("a"), F.col("u2").alias("b")))
    return moved.filter("a <> b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node with a link to another; root is the least node reachable.

    Nodes are longs. Self links are dropped. Each step is a few shuffles of the edges and
    the number of steps grows with the logarithm of the longest path; lineage is cut after
    every step. A graph of at most BROADCAST_ROWS nodes saves some of the shuffles.
    """
    now = cut(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    sign = None
    while True:
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == sign:
            break
        sign, small = new, 2 * new[0] <= BROADCAST_ROWS  # an edge has two nodes
        now = cut(_star(_star(now, True, small), False, small))
    stars = now.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return stars.unionAll(stars.select(F.col("root").alias("node"), "root").distinct())
