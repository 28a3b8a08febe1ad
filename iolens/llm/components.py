"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from iolens.llm.common import stored


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node that is not the smallest of its component.

    ``edges`` has two long columns; nulls, loops and repeats are ignored. Each round replaces
    the edges by at most as many, written to the shared folder; the number of rounds grows with
    the logarithm of the longest path. No edges give no rows.
    """
    pairs = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
    known = F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    current = stored(pairs.where(known).distinct(), "edges")
    before = _signature(current)
    while before[0]:
        current = stored(_small_star(_large_star(current)), "edges")
        after = _signature(current)
        if after == before:
            break
        before = after
    return current.select(F.col("hi").alias("node"), F.col("lo").alias("component"))


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Join each larger neighbour of a node to the smallest node next to it."""
    # stored, so that the join can split the edges of a hub
    smaller = stored(edges.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m")), "smaller")
    # the larger neighbours of u are the edges whose low end is u; its smallest is below u if it has one
    moved = edges.join(smaller, edges["lo"] == smaller["u"], "left")
    return moved.select("hi", F.coalesce("m", "lo").alias("lo")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Join each smaller neighbour of a node, and the node, to the smallest of them."""
    smallest = edges.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
    joined = edges.join(smallest, edges["hi"] == smallest["u"])
    inner = joined.where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return smallest.select(F.col("u").alias("hi"), F.col("m").alias("lo")).union(inner).distinct()
