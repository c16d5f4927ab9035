"""Connected components of a graph kept in tables: alternating large and small stars, two joins a round, staged each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.workspace import drop_staged, stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: neighbours above a node go to the least of its neighbourhood. Small: the node and its neighbours below do."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = both.filter(F.col("v") < F.col("u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    met = both.join(least, "u")
    out = met.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")) if large else met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v"))


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node it is connected with), for the nodes of ``edges`` (u, v) that are not their own root."""
    now, before = stage(edges.filter(F.col("u") != F.col("v")).select("u", "v").distinct(), "edges"), None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = tuple(mark)
        after = stage(_star(_star(now, True), False).distinct(), "edges")
        drop_staged(now)
        now = after
