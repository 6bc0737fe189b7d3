"""Connected components by repeated contraction, all of it in DataFrame joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; two nodes are connected exactly if their roots are equal.

    Each round sends every node to the least of itself and its neighbours in a hashed order, renames the edges by that and
    drops loops and repeats. In a hashed order a constant share of the nodes vanishes in a round whatever the shape, so the
    rounds are logarithmic and the tables shrink fast. The edges of a hub meet one row of the map, so AQE can split them;
    the minimum per node is combined before its shuffle. Nothing comes to the driver but the emptiness of the edges.
    """
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
    edges = scratch.stage(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), rank("b").alias("o")).unionByName(edges.select(F.col("b").alias("node"), rank("a").alias("o")))
        least = both.groupBy("node").agg(F.min("o").alias("o")).select("node", F.least(rank("node"), F.col("o")).getField("id").alias("to"))
        maps.append(least := scratch.stage(least, f"map{len(maps)}"))
        named = edges.join(least.select(F.col("node").alias("a"), F.col("to").alias("a2")), "a")
        named = named.join(least.select(F.col("node").alias("b"), F.col("to").alias("b2")), "b").where("a2 <> b2")
        old, edges = edges, scratch.stage(named.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "edges")
        scratch.drop(old)
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = maps.pop()
    while maps:
        out = maps.pop().join(out.select(F.col("node").alias("to"), F.col("to").alias("_root")), "to", "left").select("node", F.coalesce("_root", "to").alias("to"))
    return out.select("node", F.col("to").alias("root"))
