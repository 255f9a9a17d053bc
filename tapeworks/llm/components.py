"""Connected components of a graph of ids, as rounds of joins over kept edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import keep


def components(edges: DataFrame) -> DataFrame:
    """(u, v) longs -> (node, component): the least node reachable, for every node that has an edge to another.

    Each round first hangs every larger neighbour on a node's least neighbour, then every smaller one, so that trees
    become stars in a number of rounds that grows with the logarithm of the graph's size. A round's edges never
    outnumber the ones before; minima are combined before the shuffle, and joins leave a hub's edges to skew splitting.
    """
    linked = F.col("u") != F.col("v")
    state = keep(edges.filter(linked).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(state)
    while mark[0]:
        both = state.union(state.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter(linked).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        state = keep(small.filter(linked).distinct())
        before, mark = mark, _mark(state)
        if mark == before:
            break
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).union(state.select("v", "v").distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
