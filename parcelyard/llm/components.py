"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``links``; component is the smallest node it reaches.

    Each step is written to the shared folder; nothing but two numbers reaches the driver. Links of a node with itself
    count for nothing else than naming the node; repeated links count once. No links give no rows.
    """
    both = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = common.table(both.filter("u <> v").distinct())
    before = _mark(edges)
    while before[0]:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = near.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = common.table(small)
        after = _mark(edges)
        if after == before:
            break
        before = after
    ends = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    roots = ends.select(F.col("component").alias("node"), "component").distinct()
    alone = both.filter("u = v").select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    return ends.unionByName(roots).unionByName(alone).groupBy("node").agg(F.min("component").alias("component"))
