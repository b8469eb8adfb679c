"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum, combined before the shuffle, and a join of the edges with it, written to the shared folder.
Edges of a hub, a node with more than one in ``skew.SHARE`` of them, are joined where they are, with a broadcast of fewer than
``skew.SHARE`` hubs, so neither a component nor the edges of a hub have to fit into one task, and of both the driver sees counts
and the names of hubs alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantlake.llm import runtime, skew


def _with_least(edges: DataFrame, total: int) -> DataFrame:
    """Edges with ``m``, the smallest of the node ``a`` and its neighbours."""
    least = edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return skew.lookup(edges, least, "a", total)


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _with_least(both, 2 * total).filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    moved = _with_least(down, total)
    own = down.groupBy("a").agg(F.min("b").alias("b"))
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(own)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge; root is the smallest node of its component.  Edges are (a, b) as longs.

    Edges from a node to itself count for nothing; repeated edges and an empty table are allowed.
    """
    with runtime.Scratch(edges.sparkSession) as scratch:
        now = scratch.write(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        state = None
        while True:
            new = now.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
            if (new["n"], new["x"]) == state:
                return runtime.materialize(now.select(F.col("a").alias("node"), F.col("b").alias("root")), "roots")
            state = (new["n"], new["x"])
            large = scratch.write(_large_star(now, new["n"]).distinct(), "stars")
            small = scratch.write(_small_star(large, new["n"]).filter("a != b").distinct(), "edges")
            scratch.drop(now)
            scratch.drop(large)
            now = small
