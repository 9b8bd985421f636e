"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (a long, b long) that has another one; component: its smallest node.

    Each round links nodes to the smallest neighbour they know, with aggregations and equi-joins only, and ends in the
    shared folder; rounds grow with the logarithm of the longest path. Loops and repeated edges are allowed.
    """
    pairs = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = stored(pairs)
    seen = None
    while True:
        both = pairs.union(pairs.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least, "a").select(F.col("b").alias("x"), F.col("least"), F.col("a"))
        small = small.select(F.explode(F.array(F.struct(F.col("x").alias("a"), F.col("least").alias("b")), F.struct("a", F.col("least").alias("b")))).alias("e"))
        pairs = stored(small.select("e.*").filter("a <> b").distinct())
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    tops = pairs.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(tops)
