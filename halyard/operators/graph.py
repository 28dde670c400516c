"""A graph: vertices (id) and a bag of edges (src, dst); and graphs from relational tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    """``vertices`` has a unique long ``id``; ``edges`` has long ``src`` and ``dst``, and may have attributes.

    Edges are a bag: repeated ones weigh. Their ends need not be vertices: messages to unknown ids are dropped.
    """

    vertices: DataFrame
    edges: DataFrame

    def checked(self) -> Graph:
        """Raise if a vertex id occurs twice or is null."""
        bad = self.vertices.groupBy("id").count().where("count > 1 or id is null").limit(1).collect()
        if bad:
            raise ValueError(f"vertex id is not unique: {bad[0]['id']}")
        return self

    def out_degrees(self) -> DataFrame:
        """(id, deg): the length of every vertex's edge list."""
        counts = self.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("deg"))
        return self.vertices.select("id").join(counts, "id", "left").select("id", F.coalesce("deg", F.lit(0)).alias("deg"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def purchase(spark: SparkSession, sf_dir: str, back: bool = False) -> Graph:
    """Customers (2k) point at the suppliers (2k + 1) they bought from; ``back`` adds arcs from even suppliers."""
    customers = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 2).alias("id"))
    suppliers = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 2 + 1).alias("id"))
    bought = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    arcs = bought.select((F.col("o_custkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst")).distinct()
    if back:
        arcs = arcs.unionByName(arcs.where(F.col("dst") % 4 == 1).select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return Graph(customers.unionByName(suppliers), arcs)


def copurchase(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts, joined both ways when one order has both."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    other = items.select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("dst"))
    pairs = items.join(other, F.col("l_orderkey") == F.col("o")).where("l_partkey <> dst")
    arcs = pairs.select(F.col("l_partkey").alias("src"), "dst").distinct()
    return Graph(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")), arcs)
