"""Connected components of a large edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save


def connected_components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Rows (node, root) for every node of ``edges`` (u, v) that isn't itself the least of its component.

    Only edges move: every round counts, takes minima and joins on a node, so a
    node with very many edges is pre-aggregated and split like any skewed key.
    Rounds grow with the logarithm of the longest chain. An empty edge table has
    no rows.
    """
    links = save(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    seen = None
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        links = save(both.join(least, "u").where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), name)
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        moved = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = save(moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), name)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
