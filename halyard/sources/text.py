"""Adjacency-list text: readers, writers, and a cache of parsed graphs.

A line is ``id<TAB>n nb1 ... nbn``, or with degrees ``id<TAB>n nb1 deg1 ... nbn degn``. The id ends at the first tab;
the rest is split on runs of blanks. Blank lines are skipped. Only the first n neighbours count.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.operators.graph import Graph


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(value) of one or more files or folders; a missing one is an error."""
    return spark.read.text(list(paths))


def _fields(lines: DataFrame, width: int) -> DataFrame:
    """(id, n, rest): rest has the n * width numbers after the count."""
    line = lines.where(F.trim(F.regexp_replace("value", "[\t\r]", " ")) != "")
    value = F.regexp_replace("value", "\r", "")
    rest = F.filter(F.split(F.regexp_replace(F.regexp_replace(value, "^[^\t]*\t?", ""), "\t", " "), " +"), lambda x: x != "")
    parsed = line.select(F.trim(F.substring_index(value, "\t", 1)).cast("bigint").alias("id"), rest.alias("rest"))
    n = F.coalesce(F.try_element_at("rest", F.lit(1)).cast("bigint"), F.lit(0))
    return parsed.select("id", n.alias("n"), F.slice("rest", F.lit(2), (n * width).cast("int")).alias("rest"))


def parse_adjacency(lines: DataFrame) -> Graph:
    """Vertices and the bag of their listed edges."""
    found = _fields(lines, 1)
    edges = found.select(F.col("id").alias("src"), F.explode("rest").alias("nb")).select("src", F.col("nb").cast("bigint").alias("dst"))
    return Graph(found.select("id"), edges)


def parse_degree_pairs(lines: DataFrame) -> Graph:
    """Vertices with ``deg`` (their n), and edges with ``dst_deg``. Of a truncated line, pairs that are missing give no
    edge, and a degree that is missing is null."""
    found = _fields(lines, 2)
    number = lambda i: F.try_element_at("rest", (i + 1).cast("int")).cast("bigint")
    at = F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n").cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    pairs = F.transform(at, lambda i: F.struct(number(2 * i).alias("dst"), number(2 * i + 1).alias("dst_deg")))
    edges = found.select(F.col("id").alias("src"), F.explode(pairs).alias("e")).select("src", "e.dst", "e.dst_deg").where("dst is not null")
    return Graph(found.select("id", F.col("n").alias("deg")), edges)


def oriented_pairs(graph: Graph) -> DataFrame:
    """(id, nbs): of a graph with degrees, each vertex's larger neighbours by (degree, id), sorted so."""
    mine = graph.vertices.select("id", "deg")
    up = graph.edges.join(mine, F.col("src") == F.col("id")).where(F.struct("deg", "src") < F.struct("dst_deg", "dst"))
    lists = up.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("dst_deg", "dst"))).alias("nbs"))
    return mine.select("id").join(lists, "id", "left")


def adjacency_lines(graph: Graph) -> DataFrame:
    """(value): a line for each vertex, neighbours in order."""
    lists = graph.edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("nbs"))
    nbs = F.coalesce("nbs", F.array().cast("array<bigint>"))
    line = F.concat_ws("\t", F.col("id"), F.concat_ws(" ", F.size(nbs), nbs.cast("array<string>")))
    return graph.vertices.select("id").join(lists, "id", "left").select(line.alias("value"))


def degree_lines(degrees: DataFrame) -> DataFrame:
    """(value): a line for each vertex of ``neighbour_degrees``."""
    pairs = F.transform("nbs", lambda x: F.concat_ws(" ", x["nb"], x["deg"]))
    return degrees.select(F.concat_ws("\t", F.col("id"), F.concat_ws(" ", F.size("nbs"), pairs)).alias("value"))


def rank_lines(state: DataFrame, value: str = "pr") -> DataFrame:
    return state.select(F.format_string("%d\t%f", "id", value).alias("value"))


def count_lines(counts: DataFrame, value: str = "triangles") -> DataFrame:
    return counts.select(F.format_string("%d\t%d", "id", value).alias("value"))


def ordered_lines(df: DataFrame, content: Column | str, order: str | None = None) -> DataFrame:
    """(value): content, after its order number if there is one."""
    content = F.col(content) if isinstance(content, str) else content
    return df.select((F.concat_ws(" ", F.col(order), content) if order else content).alias("value"))


def write_lines(lines: DataFrame, path: str, force: bool = False, max_records: int = 0) -> None:
    """Write (value) as text; an existing path is an error unless ``force``."""
    lines.write.mode("overwrite" if force else "errorifexists").option("maxRecordsPerFile", max_records).text(path)


def import_text(spark: SparkSession, source: str, target: str, force: bool = False) -> None:
    """Copy text from one store to another."""
    write_lines(spark.read.text(source), target, force)


def cached_graph(spark: SparkSession, path: str, cache: str) -> Graph:
    """The graph of ``path``, parsed once: kept as Parquet under a name that follows from the input files' state."""
    jvm = spark.sparkContext._jvm
    source = jvm.org.apache.hadoop.fs.Path(path)
    store = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in store.listStatus(source))
    name = hashlib.sha256(repr(files).encode()).hexdigest()[:24]
    folder = jvm.org.apache.hadoop.fs.Path(f"{cache}/{name}")
    there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = jvm.org.apache.hadoop.fs.Path(f"{cache}/{name}/edges/_SUCCESS")
    if not there.exists(done):
        graph = parse_adjacency(read_lines(spark, path))
        graph.vertices.write.mode("overwrite").parquet(f"{cache}/{name}/vertices")
        graph.edges.repartition("src").write.mode("overwrite").parquet(f"{cache}/{name}/edges")
    return Graph(spark.read.parquet(f"{cache}/{name}/vertices"), spark.read.parquet(f"{cache}/{name}/edges"))


def placement(df: DataFrame) -> DataFrame:
    """(file, partition, n): which task read how many rows of which file."""
    return df.groupBy(F.input_file_name().alias("file"), F.spark_partition_id().alias("partition")).agg(F.count("*").alias("n"))
