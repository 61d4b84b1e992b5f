"""Connected components of a graph of any size: alternating large and small stars.

Each round is two pre-aggregated minima and two joins on edges; rounds grow with the
logarithm of a component's diameter. The edge list is written to the shared folder
after every round, which cuts the lineage and survives lost executors. A vertex with
very many edges is one side of a join that adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.plans.sizing import materialize

MAX_ROUNDS = 60


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.expr("coalesce(sum(cast(hash(big, small) as bigint)), 0)")).first()
    return row[0], row[1]


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """node long, component long (the smallest node reachable) of every node that has an edge.

    Edges are undirected; loops, repeats and nulls are dropped. Nodes without a proper
    edge are not listed: they are components of their own.
    """
    edges = materialize(
        edges.select(F.greatest(left, right).alias("big"), F.least(left, right).alias("small"))
        .filter(F.col("big") > F.col("small")).distinct(),
        "edges",
    )
    state = _state(edges)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        ends = edges.unionByName(edges.select(F.col("small").alias("big"), F.col("big").alias("small")))
        least = ends.groupBy(F.col("big").alias("node")).agg(F.min("small").alias("low"))
        least = least.select("node", F.least("node", "low").alias("low"))
        large = edges.join(least, edges.small == least.node).select("big", F.col("low").alias("small")).distinct()
        first = large.groupBy(F.col("big").alias("node")).agg(F.min("small").alias("low"))
        joined = large.join(first, large.big == first.node)
        stars = joined.select(
            F.explode(F.array(F.struct(F.col("big"), F.col("low").alias("small")),
                              F.struct(F.col("small").alias("big"), F.col("low").alias("small")))).alias("e")
        ).select("e.*").filter("big > small").distinct()
        edges = materialize(stars, "edges")
        after = _state(edges)
        if after == state:
            break
        state = after
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("big").alias("node"), F.col("small").alias("component")).unionByName(
        edges.select(F.col("small").alias("node"), F.col("small").alias("component")).distinct()
    )
