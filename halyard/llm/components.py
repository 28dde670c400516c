"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm.common import checkpointed


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) to (node, component): the smallest node reachable, for every node that has a link to another.

    Large-star and small-star steps in turn, until the links are stars around their components' smallest nodes. A step
    is an aggregate and a join; no list of neighbours is gathered. Null ends and loops are ignored.
    """
    up = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    edges = checkpointed(links.where("a is not null and b is not null and a <> b").select(*up).distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("w")).agg(F.least(F.col("w"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        smaller = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        met = large.join(smaller, F.col("u") == F.col("w"))
        small = met.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = checkpointed(small.select("e.u", "e.v").where("u <> v").distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.unionByName(roots)
