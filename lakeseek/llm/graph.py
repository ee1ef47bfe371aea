"""Connected components of an edge table by alternating large and small stars, every round cut by a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeseek.llm.common import drop_table, materialise


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of ``edges`` (u bigint, v bigint), root the smallest node of its component.

    The minimum of a node's neighbours is a partial aggregation joined back, so a hub's edges never need to meet in one task.
    Raises if the components are not whole after ``max_rounds`` (each round about halves the depth).
    """
    now = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialise(large, "large-star")
        drop_table(now)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        # the edges after a large star go from larger to smaller nodes
        small = large.join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        now = materialise(small, "small-star")
        drop_table(large)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        seen = state
    raise RuntimeError(f"components are not whole after {max_rounds} rounds")
