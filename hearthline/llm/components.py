"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a grouped minimum and a join on the node, so a node with very many edges is pre-aggregated before its
shuffle and its join partition can be split. Each round is written to the shared folder, which ends the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import saved


def _star(df: DataFrame, large: bool) -> DataFrame:
    """df: edges (u, v) with u > v."""
    if large:
        df = df.union(df.select("v", "u"))
    least = df.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = df.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the least node reachable, for every node that has an edge to another. edges: two columns of longs, either way round."""
    a, b = edges.columns
    df = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    df = saved(df, "edges")
    mark = None
    for _ in range(max_rounds):
        stars = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if stars == mark or not stars["n"]:
            return df.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = stars
        df = saved(_star(_star(df, True), False), "edges")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
