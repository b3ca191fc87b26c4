"""Connected components of a graph of links, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchpost.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for nodes that have an edge. Large-star and small-star rounds."""
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("m")))  # a table, so that the join below may split a node with very many edges
        large = written(both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(down, "a")
        small = joined.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b"))).distinct()
        after = written(small)
        moved = after.join(edges, ["a", "b"], "left_anti").take(1)
        gone = edges.join(after, ["a", "b"], "left_anti").take(1)
        edges = after
        if not moved and not gone:
            return edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
