"""Connected components of a graph of any size, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelflow.plans.staging import stage


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node of the component of every node that has an edge.

    ``edges(u, v)`` may repeat, go either way and be of any ordered type. A round joins every node's larger
    neighbours, then its smaller ones, to the smallest neighbour; about log(n) rounds leave stars. Hubs are
    reduced by aggregation before they are joined back, and each round is written to the checkpoint folder.
    """
    edges = stage(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        # After the large star all edges lead from a node to a smaller one.
        large = stage(large.distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stage(small.unionByName(low.withColumnRenamed("m", "v")).distinct(), "small")
        mark = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = mark
