"""Connected components of an edge table, by alternating large-star and small-star contractions.

Neither the edges nor the labels reach the driver, only two sums a round. A node with very many neighbours is a key of partial
aggregates and of one join, which Spark can split; its neighbours are never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import checkpointed


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v). For each u with least neighbour or itself m: links its larger (large) or smaller (small) neighbours, and itself, to m."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (its least node) of every node of edges (u, v); nodes without an edge are not listed."""
    now = checkpointed(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u") != F.col("v")).distinct())
    before = None
    for _ in range(most_rounds):
        now = checkpointed(_star(_star(now, True), False))
        sums = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sums == before:
            break
        before = sums
    else:
        raise RuntimeError(f"no end after {most_rounds} rounds")
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
