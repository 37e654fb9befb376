"""Connected components by alternating large-star and small-star, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import Scratch


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """Beside each edge (u, v) the least m of u and its neighbours.

    The least ones are dealt out anew (u + 0), so that the join has two plain exchanges and the
    runtime can split a node with very many edges.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select((F.col("u") + 0).alias("of"), F.least("u", "m").alias("m"))
    return edges.join(least, F.col("u") == F.col("of")).select("u", "v", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least_neighbour(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    starred = _least_neighbour(edges)
    return starred.select("u", F.col("m").alias("v")).union(
        starred.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, component (its least node) for links(a, b); nodes without a link to another are left out.

    Each round is written, so lost executors cost no more than a round. It ends when a round leaves
    the edges as they are, told by their number and the sum of their hashes.
    """
    edges = scratch.save(
        links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now, turn = state(edges), 0
    while now[0]:
        turn += 1
        # a third of the rows may leave one node: small-star reads what large-star wrote
        large = scratch.save(_large_star(edges), f"{name}-{turn}-large")
        after = scratch.save(_small_star(large), f"{name}-{turn}")
        before, now = now, state(after)
        scratch.drop(f"{name}-{turn - 1}", f"{name}-{turn}-large")
        edges = after
        if now == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
