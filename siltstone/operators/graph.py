"""Connected components of links, without a task that sees a whole one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.sources.shared import fixed


def components(edges: DataFrame) -> DataFrame:
    """node, label: the lowest node of its connected component, for every node of edges (u, v).

    Large-star and small-star steps alternate until every component is a star around its lowest node. The least neighbours are
    written before they are joined, so that the edges of a node with very many can be split between tasks.
    """
    edges = fixed(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = fixed(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least")
        large = fixed(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large-stars")
        down = fixed(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        new = fixed(small.where("u <> v").distinct(), "edges")
        # Done when every node has one edge, to a node that has none.
        n, nodes = new.agg(F.count("*"), F.count_distinct("u")).first()
        if n == nodes and new.join(new.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count() == 0:
            break
        edges = new
    return new.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(new.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
