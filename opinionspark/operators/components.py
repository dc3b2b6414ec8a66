"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.checkpoints import checkpoint


def _with_minimum(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the smallest v of each u.

    The minimum is combined before the shuffle. It is joined back instead of
    computed in a window, so a node with a third of all edges can be split.
    """
    smallest = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(smallest, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every greater neighbour of a node to the node's smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    linked = _with_minimum(both).filter(F.col("v") > F.col("u"))
    return linked.select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link every smaller neighbour of a node, and the node, to the smallest one."""
    found = _with_minimum(edges)
    pairs = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
    return found.select(F.inline(pairs)).filter(F.col("u") > F.col("v")).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node of an edge with the smallest node it reaches.

    Alternating large-star and small-star steps end after about log² of the
    longest path. Each round is checkpointed, so the plan stays short and
    lost executors cost one round at most.
    """
    current = checkpoint(
        edges.filter(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    seal = _seal(current)
    while True:
        current = checkpoint(_small_star(_large_star(current)))
        after = _seal(current)
        if after == seal:
            break
        seal = after
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _seal(edges: DataFrame) -> tuple:
    """Three numbers that change whenever the edge set does."""
    mixed = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(mixed), F.bit_xor(F.xxhash64(mixed, "u"))).first())
