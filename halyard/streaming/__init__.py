"""Adjacency lines as a stream: degrees and edge counts kept up to date while files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.sources.text import parse_adjacency


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value) of the text files that arrive under ``path``."""
    return spark.readStream.format("text").load(path)


def stream_degrees(lines: DataFrame) -> DataFrame:
    """(id, deg): running out-degrees, for output mode "complete" or "update"."""
    edges = parse_adjacency(lines).edges
    return edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("deg"))
