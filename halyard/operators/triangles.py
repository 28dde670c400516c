"""Degrees, their broadcast to neighbours, and triangle counting on degree-ordered edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.operators.graph import Graph

QUOTA = 10


def neighbour_degrees(graph: Graph) -> DataFrame:
    """(id, nbs): for every vertex the (nb, deg) of those that list it, in order of nb."""
    degree = graph.edges.groupBy(F.col("src").alias("nb")).agg(F.count("*").alias("deg"))
    told = graph.edges.join(degree, F.col("src") == F.col("nb")).groupBy(F.col("dst").alias("id"))
    lists = told.agg(F.array_sort(F.collect_list(F.struct("nb", "deg"))).alias("nbs"))
    empty = F.array().cast("array<struct<nb:bigint,deg:bigint>>")
    return graph.vertices.select("id").join(lists, "id", "left").select("id", F.coalesce("nbs", empty).alias("nbs"))


def oriented(graph: Graph) -> DataFrame:
    """(lo, hi, dlo, dhi): each edge from its smaller to its larger end by (degree, id). A hub keeps few edges."""
    degree = graph.edges.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("d"))
    first = degree.select(F.col("v").alias("a"), F.col("d").alias("dlo"))
    second = degree.select(F.col("v").alias("b"), F.col("d").alias("dhi"))
    met = graph.edges.join(first, F.col("src") == F.col("a")).join(second, F.col("dst") == F.col("b"))
    up = F.struct("dlo", "src") < F.struct("dhi", "dst")
    return met.where(up).select(F.col("src").alias("lo"), F.col("dst").alias("hi"), "dlo", "dhi")


def adjacency(edges: DataFrame) -> DataFrame:
    """(v, nbs): the larger neighbours of every vertex that has any, sorted; at most about sqrt(2 * edges) of them."""
    return edges.groupBy(F.col("lo").alias("v")).agg(F.sort_array(F.collect_set("hi")).alias("nbs"))


def wedges(edges: DataFrame) -> DataFrame:
    """(lo, mid, hi): pairs of a vertex's larger neighbours, mid below hi in the order of the edges."""
    a = edges.select("lo", F.col("hi").alias("mid"), F.col("dhi").alias("dm"))
    b = edges.select(F.col("lo").alias("l"), "hi", "dhi")
    return a.join(b, F.col("lo") == F.col("l")).where(F.struct("dm", "mid") < F.struct("dhi", "hi")).select("lo", "mid", "hi")


def closed(edges: DataFrame) -> DataFrame:
    """Wedges whose ends are joined: the triangles as rows."""
    other = edges.select(F.col("lo").alias("x"), F.col("hi").alias("y"))
    return wedges(edges).join(other, (F.col("mid") == F.col("x")) & (F.col("hi") == F.col("y")), "left_semi")


def edge_triangles(edges: DataFrame) -> DataFrame:
    """(lo, mid, n): per edge the triangles it is the smaller side of, by intersecting its ends' neighbour lists.

    Lists cross the network once for each edge; wedges, of which there are many more, are never made.
    """
    lists = adjacency(edges)
    mine, theirs = lists.select(F.col("v").alias("a"), F.col("nbs").alias("na")), lists.select(F.col("v").alias("b"), F.col("nbs").alias("nb"))
    met = edges.select("lo", F.col("hi").alias("mid")).distinct().join(theirs, F.col("mid") == F.col("b")).join(mine, F.col("lo") == F.col("a"))
    return met.select("lo", "mid", F.size(F.array_intersect("na", "nb")).cast("long").alias("n"))


def triangle_counts(graph: Graph, owner: str = "mid") -> DataFrame:
    """(id, triangles) for every vertex, counted at the middle ("mid") or the smallest ("lo") corner of each triangle."""
    counts = edge_triangles(oriented(graph)).groupBy(F.col(owner).alias("id")).agg(F.sum("n").alias("triangles"))
    return graph.vertices.select("id").join(counts, "id", "left").select("id", F.coalesce("triangles", F.lit(0)).alias("triangles"))


def request_rounds(graph: Graph, quota: int = QUOTA) -> DataFrame:
    """(id, deg, requests, rounds): pairs a vertex asks about, and the odd supersteps it takes at quota * deg a step."""
    edges = oriented(graph)
    out = edges.groupBy(F.col("lo").alias("id"), F.col("dlo").alias("deg")).agg(F.count("*").alias("k"))
    pairs = F.floor(F.col("k") * (F.col("k") - 1) / 2).cast("long")
    asked = out.select("id", "deg", pairs.alias("requests"))
    return asked.withColumn("rounds", F.ceil(F.col("requests") / (F.lit(quota) * F.col("deg"))).cast("long"))


def request_steps(graph: Graph, quota: int = QUOTA) -> DataFrame:
    """(step, requests): what is asked in each odd superstep under the quota."""
    pages = request_rounds(graph, quota).where("rounds > 0").withColumn("page", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rounds"))))
    own = F.least(F.lit(quota) * F.col("deg"), F.col("requests") - (F.col("page") - 1) * quota * F.col("deg"))
    return pages.groupBy((2 * F.col("page") - 1).alias("step")).agg(F.sum(own).alias("requests"))
