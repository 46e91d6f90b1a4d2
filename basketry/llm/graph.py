"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm._spark import Scratch


def components(edges: DataFrame, scratch: Scratch, rounds: int | None = None, max_rounds: int = 60) -> DataFrame:
    """Of edges (a, b): node, component (the smallest node reachable), for nodes that have an edge to another; a table named "components" in scratch.

    In a large-star step every node links its greater neighbours to its smallest one, in a
    small-star step the smaller ones; both are sums by key that combine before the
    shuffle. Rounds go on until nothing changes, about the logarithm of the longest chain
    in number. Each round's edges are written to the shared folder, never collected. Null
    ends and edges of a node to itself are left out.

    With rounds, it ends after so many: nodes of one component may have several names then,
    but nodes of different ones never share one.
    """
    edges = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = scratch.save(edges, "edges")
    seen = None
    for _ in range(rounds or max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(joined.select("u", F.col("m").alias("v")))
        edges = scratch.save(small.distinct(), "edges")
        if rounds:
            continue
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        if not rounds:
            raise RuntimeError("components have not settled")
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")))
    found = scratch.save(ends.groupBy("node").agg(F.min("component").alias("component")), "components")
    scratch.drop("edges")
    return found
