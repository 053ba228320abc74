"""Connected components of pairs by alternating star rounds, with nothing but joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.runtime import materialize


def components(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, head) of every node in a pair; head is the least node. Null ends and self pairs count for nothing."""
    edges = materialize(pairs.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        last, edges = edges, materialize(small, "stars")
        now = edges.count()
        if now == before and edges.join(last, ["u", "v"], "left_anti").isEmpty():  # as many edges and none of them new
            return edges.select(F.col("u").alias("node"), F.col("v").alias("head")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("head")).distinct())
        before = now
