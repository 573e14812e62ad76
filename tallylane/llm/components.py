"""Connected components of an edge table by alternating stars, with checkpoints between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallylane.llm.shared import materialise


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Columns `node` and `component` (smallest node reachable) for every node of an edge.

    Large-star links each larger neighbour of a node to the smallest one, small-star does so for the
    smaller neighbours; both are one aggregation and one join on the node, and the edge table never
    grows.  Rounds end when a round changes nothing (logarithmic in the component size); not converging
    in `max_rounds` is an error, never a partial answer.  An edge-free table gives an empty result.
    """
    links = materialise(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    before = None
    for _ in range(max_rounds):
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = materialise(small.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        state = links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum((F.xxhash64("u", "v") % 1000003))).first()
        if state == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
