"""Text formats, sorting, scalar helpers and streams."""

import pytest
from pyspark.sql import functions as F

from halyard import functions as fn
from halyard.operators import sorting
from halyard.sources import text
from halyard.streaming import stream_degrees, stream_lines


def lines(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


def test_grammar(spark):
    g = text.parse_adjacency(lines(spark, "1\t3  2   2 3  ", "", "2\t0", "   ", "3\t1 1\r", "4\t1 7 8"))
    assert sorted(r["id"] for r in g.vertices.collect()) == [1, 2, 3, 4]
    assert sorted(tuple(r) for r in g.edges.collect()) == [(1, 2), (1, 2), (1, 3), (3, 1), (4, 7)]


def test_round_trip_and_cache(spark, tmp_path):
    g = text.parse_adjacency(lines(spark, "1\t2 2 3", "2\t0", "3\t1 1"))
    place = f"file://{tmp_path}/lines"
    text.write_lines(text.adjacency_lines(g), place)
    with pytest.raises(Exception, match="(?i)exists"):
        text.write_lines(text.adjacency_lines(g), place)
    text.write_lines(text.adjacency_lines(g), place, force=True)
    again = text.cached_graph(spark, place, f"file://{tmp_path}/cache")
    assert sorted(map(tuple, again.edges.collect())) == [(1, 2), (1, 3), (3, 1)]
    text.write_lines(lines(spark, "1\t1 2"), place, force=True)
    assert text.cached_graph(spark, place, f"file://{tmp_path}/cache").edges.count() == 1
    text.import_text(spark, place, f"file://{tmp_path}/copy")
    assert text.read_lines(spark, place, f"file://{tmp_path}/copy").count() == 2
    assert text.placement(text.read_lines(spark, place)).agg(F.sum("n")).first()[0] == 1
    with pytest.raises(Exception, match="(?i)exist"):
        text.read_lines(spark, f"file://{tmp_path}/nowhere").count()


def test_order_numbers(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"), F.col("id").alias("v"))
    got = sorting.number_records(df, "k")
    assert got.where("k <> ord").count() == 0
    assert [r["k"] for r in sorting.sort_records(df, "k").collect()] == list(range(1000))
    assert sorting.number_records(df.where("false"), "k").count() == 0
    ties = spark.createDataFrame([(1,), (1,), (None,), (0,)], "k int")
    assert sorted(r["ord"] for r in sorting.number_records(ties, F.col("k").asc_nulls_last()).collect()) == [0, 1, 2, 3]


def test_helpers(spark):
    row = spark.range(1).select(fn.key_owner(F.lit(-7), 4).alias("a"), fn.flag(3).alias("b"), fn.has_flag(F.lit(8), 3).alias("c"), fn.without_flag(F.lit(9), 3).alias("d"), fn.tuple_owner(4, F.lit(1), F.lit(2)).alias("e")).first()
    assert (row["a"], row["b"], row["c"], row["d"]) == (3, 8, True, 1)
    assert 0 <= row["e"] < 4


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("1\t2 2 3\n2\t1 1\n")
    query = stream_degrees(stream_lines(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("degrees").start()
    try:
        query.processAllAvailable()
        assert {tuple(r) for r in spark.table("degrees").collect()} == {(1, 2), (2, 1)}
    finally:
        query.stop()
