"""Connected components of a graph by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.session import durable

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of undirected edges (u, v); a component is named by its smallest node.

    Loops, repeated edges and null ends are ignored. Every round cuts its lineage in the shared folder. The number of rounds
    grows with the logarithm of the longest path; a graph that has not settled after MAX_ROUNDS raises an error.
    """
    rows = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    rows = durable(rows)
    mark = None
    for _ in range(MAX_ROUNDS):
        both = rows.unionByName(rows.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.where("m < u").select("u", F.col("m").alias("v")))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        rows = durable(small.where("u <> v").distinct())
        now = rows.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            heads = rows.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
            return rows.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(heads)
        mark = now
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
