"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge; edges has two long columns.

    component is the least node reachable. Self-loops, repeated edges and either direction are fine; null ends are
    ignored. Each round is two joins on pre-aggregated minima, written to the shared folder; rounds grow with the
    logarithm of the longest path. A star of many leaves is one key; minima are written before they are joined, so Spark
    can split that key's side of the join."""
    a, b = edges.columns
    e = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
    e = stage(e.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct(), "edges")
    seen = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        above = e.select(F.col("v").alias("u"), F.col("u").alias("far"))  # a node and those of greater number
        large = stage(above.join(least.hint("merge"), "u").select(F.col("far").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low = stage(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low.hint("merge"), "u")
        e = small.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).union(
            low.select("u", F.col("m").alias("v"))
        )
        e = stage(e.where("u <> v").distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
