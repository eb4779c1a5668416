"""Connected components and bounded walks over per-page edge tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioframe.plans.greedy import split_by_size
from folioframe.plans.sweeps import Joined, sweep
from folioframe.session import cut_lineage

# Edges of one group that a task joins in a pass; larger groups take rounds of joins.
SWEEP_LIMIT = 200_000


def both_ways(edge: DataFrame, by: Sequence[str], a: str, b: str) -> DataFrame:
    one = edge.select(*by, F.col(a).alias("src"), F.col(b).alias("dst"))
    return one.unionByName(edge.select(*by, F.col(b).alias("src"), F.col(a).alias("dst")))


def components(node: DataFrame, edge: DataFrame, by: Sequence[str], node_id: str, a: str, b: str) -> DataFrame:
    """``component``: smallest node id reachable from each node.

    The edges of an ordinary group are joined in one pass, after one shuffle. Larger groups, and a graph without groups, take rounds: every round sends each label to the smallest label next to it, follows those pointers twice and contracts
    the edges; what is left shrinks geometrically, so rounds grow with the logarithm of the longest chain.
    """
    if by:
        edge = cut_lineage(edge.select(*by, F.col(a).alias("one"), F.col(b).alias("other")))
        usual, crowded = split_by_size(edge, by, SWEEP_LIMIT)
        kind = T.StructType([T.StructField(n, edge.schema["one"].dataType) for n in ("_node", "component")])
        found = sweep(usual, by, [], Joined, kind)
        if crowded is not None:
            ends = crowded.select(*by, F.explode(F.array("one", "other")).alias("_node")).distinct()
            found = found.unionByName(_labels(ends, crowded, by, "_node", "one", "other"))
        state = node.select(*by, node_id).join(found.withColumnRenamed("_node", node_id), [*by, node_id], "left").withColumn("component", F.coalesce("component", node_id))
    else:
        state = _labels(node, edge, by, node_id, a, b)
    return node.join(state, [*by, node_id])


def _labels(node: DataFrame, edge: DataFrame, by: Sequence[str], node_id: str, a: str, b: str) -> DataFrame:
    """``component`` of each node, in rounds."""
    live = cut_lineage(both_ways(edge, by, a, b).distinct())
    maps = []
    while not live.isEmpty():
        low = live.groupBy(*by, "src").agg(F.min("dst").alias("_d")).select(*by, "src", F.least("src", "_d").alias("to"))
        for _ in range(2):
            up = low.select(*by, F.col("src").alias("to"), F.col("to").alias("_next"))
            low = low.join(up, [*by, "to"]).select(*by, "src", F.col("_next").alias("to"))
        low = cut_lineage(low)
        maps.append(low)
        there = low.select(*by, F.col("src").alias("dst"), F.col("to").alias("_to"))
        live = cut_lineage(live.join(low, [*by, "src"]).join(there, [*by, "dst"]).where(F.col("to") != F.col("_to")).select(
            *by, F.col("to").alias("src"), F.col("_to").alias("dst")).distinct())
    state = node.select(*by, node_id, F.col(node_id).alias("component"))
    for low in maps:
        step = low.select(*by, F.col("src").alias("component"), F.col("to").alias("_to"))
        state = state.join(step, [*by, "component"], "left").select(*by, node_id, F.coalesce("_to", "component").alias("component"))
    return state
