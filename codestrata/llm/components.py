"""Connected components of an edge list, wholly distributed: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.common import drop, save


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step. ``edges`` (u, v) has u > v. Hubs are met by map-side minima and by joins that AQE can split."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = moved.unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u > v").distinct()


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("sum(cast(xxhash64(u, v) as decimal(38,0)))")).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge to another; the component is its smallest node.

    ``edges`` has integer columns a and b; loops, repeats and either direction are fine. No edges give no rows.
    """
    now = save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "edges")
    seen = _digest(now)
    while True:
        large = save(_star(now, True), "large")
        before, now = now, save(_star(large, False), "small")
        drop(before, large)
        new = _digest(now)
        if new == seen:
            break
        seen = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
