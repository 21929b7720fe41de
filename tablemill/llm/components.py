"""Connected components over a distributed edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.llm.common import drop, tidied, written


@tidied
def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) edges to (id, component): every node that has an edge, with the least node it reaches.

    Each round halves the distance to the least node at least, so rounds grow with the logarithm
    of the longest path. A round shuffles two longs an edge, minima are combined before the
    shuffle, and each round's edges are written, so the lineage stays short. The minima are written
    too: the joins then read two plain shuffles, and the edges of a hub can be dealt to many tasks.
    Edges from a node to itself and rows with nulls are ignored; an empty input gives an empty result.
    """
    cur = written(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    seen = _mark(cur)
    while seen[0]:
        both = cur.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            cur.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        least = written(both.groupBy("u").agg(F.min("v").alias("m")))
        large = written(both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.least("u", "m").alias("b")).distinct())
        down = written(large.groupBy("a").agg(F.min("b").alias("m")))
        small = (
            large.join(down, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        ).union(down)
        new = written(small.distinct())
        for gone in (cur, least, large, down):
            drop(gone)
        cur, before, seen = new, seen, _mark(new)
        if seen == before:
            break
    return cur.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
        cur.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free hash of the edges: equal marks mean that a round changed nothing."""
    row = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
    return row[0], row[1]
