"""Connected components of a stored link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleargrain.session import stage


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in the stored links (a, b), both bigint; root is the component's smallest node.

    Large and small stars in turn: each link is moved to the smallest neighbour of one of its ends, so the number of links
    never grows and long chains halve. Every round is a written table; rounds stop when the links stay as they are.
    """
    edges = stage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before, state = None, _state(edges)
    while state != before and state[0]:
        near = _both_ways(edges)
        least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = near.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stage(large.unionByName(least.filter("m < a").select("a", F.col("m").alias("b"))).distinct(), "links")
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stage(small.unionByName(down.select("a", F.col("m").alias("b"))).distinct(), "links")
        before, state = state, _state(edges)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
