"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is a minimum per node, combined before the shuffle, and one equi-join back to the edges, which
adaptive execution may split for a node of very many edges; no neighbour list is ever gathered.  The
edges are written to the shared folder after each round, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """large: nodes above u hang on the least neighbour of u.  small: nodes below u, and u, hang on it."""
    if large:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges  # a > b
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = near.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``a, b`` bigint edges in any direction -> ``node, root``: for each node that has an edge the least node
    that it can reach."""
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = F.struct(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a")))
    before = e.agg(state.alias("s")).first().s
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        e = materialize(_star(_star(e, True), False), "edges")
        after = e.agg(state.alias("s")).first().s
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
