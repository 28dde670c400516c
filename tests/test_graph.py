"""Goldens, brute force and faults for the graph engine."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from halyard.operators import escape, triangles
from halyard.operators.graph import Graph
from halyard.operators.pagerank import pagerank, pagerank_program
from halyard.plans import programs
from halyard.plans.loop import InjectedFault, run
from halyard.plans.program import VertexProgram
from halyard.plans.snapshots import Snapshots
from halyard.sources import text


def lines(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


def graph(spark, vertices, edges):
    return Graph(spark.createDataFrame([(v,) for v in vertices], "id long"), spark.createDataFrame(edges, "src long, dst long"))


def ranks(result):
    return {r["id"]: r["pr"] for r in result.state.collect()}


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        (("1\t2 2 3", "2\t1 3", "3\t0"), {1: 0.19757597883790193, 2: 0.2815434776603495, 3: 0.5208805435017485}),
        (("1\t2 2 99", "2\t1 1"), {1: 0.222037, 2: 0.169366}),
        (("1\t3 2 2 3", "2\t1 1", "3\t1 1"), {1: 0.521959, 2: 0.302027, 3: 0.176014}),
        (("7\t0",), {7: 1.0}),
    ],
)
def test_pagerank_goldens(spark, rows, want):
    got = ranks(pagerank(text.parse_adjacency(lines(spark, *rows))))
    assert got == pytest.approx(want, abs=1e-6)


def test_second_step(spark):
    result = pagerank(text.parse_adjacency(lines(spark, "1\t2 2 3", "2\t1 3", "3\t0")), max_steps=2)
    assert ranks(result) == pytest.approx({1: 0.144444, 2: 0.286111, 3: 0.569444}, abs=1e-6)


def test_empty_graph(spark):
    empty = graph(spark, [], [])
    assert pagerank(empty).state.count() == 0
    assert triangles.triangle_counts(empty).count() == 0


def test_duplicate_vertex(spark):
    with pytest.raises(ValueError, match="not unique"):
        pagerank(graph(spark, [1, 1], [(1, 1)]))


def test_metrics_and_text(spark):
    result = pagerank(graph(spark, [1, 2, 3], [(1, 2), (2, 3), (1, 3)]))
    rows = result.metrics().orderBy("step").collect()
    assert [(r["msgs_sent"], r["active"]) for r in rows] == [(3, 3)] * 9 + [(0, 0)]
    assert {r[0].count("\t") for r in text.rank_lines(result.state).collect()} == {1}


UNDIRECTED = ("1\t2 2 3", "2\t3 1 3 4", "3\t3 1 2 4", "4\t3 2 3 5", "5\t1 4")


def test_degree_broadcast_and_triangles(spark):
    g = text.parse_adjacency(lines(spark, *UNDIRECTED))
    got = {r[0] for r in text.degree_lines(triangles.neighbour_degrees(g)).collect()}
    assert got == {"1\t2 2 3 3 3", "2\t3 1 2 3 3 4 3", "3\t3 1 2 2 3 4 3", "4\t3 2 3 3 3 5 1", "5\t1 4 3"}
    counts = lambda owner: {r["id"]: r["triangles"] for r in triangles.triangle_counts(g, owner).collect()}
    assert counts("mid") == {1: 0, 2: 1, 3: 1, 4: 0, 5: 0}
    assert counts("lo") == {1: 1, 2: 1, 3: 0, 4: 0, 5: 0}
    assert triangles.request_rounds(g).agg(F.max("rounds")).first()[0] == 1
    again = text.parse_degree_pairs(text.degree_lines(triangles.neighbour_degrees(g)))
    assert {tuple(r) for r in again.vertices.collect()} == {(1, 2), (2, 3), (3, 3), (4, 3), (5, 1)}


@pytest.mark.parametrize("seed", range(3))
def test_random_triangles(spark, seed):
    rng = random.Random(seed)
    n = 18
    pairs = {p for p in itertools.combinations(range(n), 2) if rng.random() < 0.35}
    g = graph(spark, range(n), [(a, b) for p in pairs for a, b in (p, p[::-1])])
    want = sum({(a, b), (b, c), (a, c)} <= pairs for a, b, c in itertools.combinations(range(n), 3))
    totals = [triangles.triangle_counts(g, o).agg(F.sum("triangles")).first()[0] for o in ("mid", "lo")]
    assert totals == [want, want]
    edges = triangles.oriented(g)
    assert triangles.closed(edges).count() == want
    found = {(r["lo"], r["mid"]): r["n"] for r in triangles.edge_triangles(edges).collect() if r["n"]}
    assert sum(found.values()) == want
    asked = {r["step"]: r["requests"] for r in triangles.request_steps(g, 1).collect()}
    assert sum(asked.values()) == triangles.wedges(edges).count()


def test_star_and_complete(spark):
    star = graph(spark, range(6), [(a, b) for k in range(1, 6) for a, b in ((0, k), (k, 0))])
    assert triangles.triangle_counts(star).agg(F.sum("triangles")).first()[0] == 0
    whole = graph(spark, range(5), [(a, b) for a in range(5) for b in range(5) if a != b])
    assert triangles.triangle_counts(whole).agg(F.sum("triangles")).first()[0] == 10


def test_rank_sums_to_one(spark):
    rng = random.Random(4)
    got = ranks(pagerank(graph(spark, range(20), [(rng.randrange(15), rng.randrange(20)) for _ in range(60)])))
    assert sum(got.values()) == pytest.approx(1)


def test_hops_wake_and_force(spark):
    g = graph(spark, range(6), [(0, 1), (1, 2), (2, 3), (5, 0)])
    result = run(g, programs.hops(0))
    assert {r["id"]: r["hops"] for r in result.state.collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: None, 5: None}
    assert result.steps[-1]["msgs_sent"] == 0
    assert {r["runs"] for r in run(g, programs.wake_counter(3)).state.collect()} == {4}
    assert len(run(g, programs.stopped_counter(5)).steps) == 5


@pytest.mark.parametrize("heavy", [False, True])
def test_resume(spark, tmp_path, heavy):
    rng = random.Random(1)
    g = graph(spark, range(30), [(rng.randrange(25), rng.randrange(30)) for _ in range(90)])
    place = f"file://{tmp_path}/s"
    with pytest.raises(InjectedFault):
        run(g, pagerank_program(), snapshots=Snapshots(place, 5, heavy), fail_after=7)
    assert Snapshots(place).committed(spark) == [5]
    resumed = run(g, pagerank_program(), snapshots=Snapshots(place, 5, heavy), resume=True)
    assert ranks(resumed) == pytest.approx(ranks(pagerank(g)), abs=1e-12)
    assert [s["step"] for s in resumed.steps] == list(range(1, 11))


def test_rerun_in_one_folder(spark, tmp_path):
    """A second run's snapshot of the same step stays; another program or graph is refused."""
    place = f"file://{tmp_path}/r"
    g = graph(spark, range(30), [(a, (a * 7 + k) % 30) for a in range(25) for k in range(3)])
    for fails in (7, 6):
        with pytest.raises(InjectedFault):
            run(g, pagerank_program(), snapshots=Snapshots(place, 5), fail_after=fails)
        assert Snapshots(place).committed(spark) == [5]
    assert len([f for f in (tmp_path / "r").iterdir() if f.name.startswith("step=")]) == 1
    resumed = run(g, pagerank_program(), snapshots=Snapshots(place, 5), resume=True)
    assert ranks(resumed) == pytest.approx(ranks(pagerank(g)), abs=1e-12)
    for other, program in ((g, pagerank_program(9)), (graph(spark, range(30), [(1, 2)]), pagerank_program())):
        with pytest.raises(ValueError, match="another run"):
            run(other, program, snapshots=Snapshots(place, 5), resume=True)


def test_log_is_pruned(spark, tmp_path):
    place = f"file://{tmp_path}/l"
    g = graph(spark, range(9), [(a, (a * 2) % 9) for a in range(9)])
    for fails, there in ((3, [1, 2, 3]), (8, [5, 6, 7, 8])):
        with pytest.raises(InjectedFault):
            run(g, pagerank_program(), snapshots=Snapshots(place, 5, log=True), resume=True, fail_after=fails)
        assert Snapshots(place).committed(spark) == there
    resumed = run(g, pagerank_program(), snapshots=Snapshots(place, 5, log=True), resume=True)
    assert [s["step"] for s in resumed.steps] == list(range(1, 11))
    assert ranks(resumed) == pytest.approx(ranks(pagerank(g)), abs=1e-12)


def test_short_lineage(spark):
    g = graph(spark, range(12), [(a, (a * 5 + 1) % 12) for a in range(12)] + [(3, 4)])
    assert ranks(run(g, pagerank_program(), cut=2)) == pytest.approx(ranks(pagerank(g)), abs=1e-12)
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_truncated_degree_line(spark):
    g = text.parse_degree_pairs(lines(spark, "1\t2 2 3 5", "2\t1 1 2", "3\t4"))
    assert sorted(map(tuple, g.edges.collect())) == [(1, 2, 3), (1, 5, None), (2, 1, 2)]


def test_vetoed_snapshots(spark, tmp_path):
    import dataclasses

    place = f"file://{tmp_path}/v"
    program = dataclasses.replace(pagerank_program(), checkpointable=lambda step: step % 2 == 1)
    run(graph(spark, [1, 2], [(1, 2), (2, 1)]), program, snapshots=Snapshots(place, 2))
    assert Snapshots(place).committed(spark) == [9]


def test_edge_attributes_and_max(spark):
    g = Graph(spark.createDataFrame([(k,) for k in range(4)], "id long"), spark.createDataFrame([(0, 1, 5), (1, 2, 7), (0, 2, 20)], "src long, dst long, eval long"))
    near = F.col("msg").isNotNull() & (F.col("dist").isNull() | (F.col("msg") < F.col("dist")))
    shortest = VertexProgram(
        init=lambda n: {"dist": F.when(F.col("id") == 0, 0).cast("long"), "fresh": F.lit(False)},
        update=lambda s: {"fresh": F.col("dist").isNotNull()} if s.number == 1 else {"dist": F.when(near, F.col("msg")).otherwise(F.col("dist")), "fresh": near},
        message=lambda s: F.col("dist") + F.col("eval"), combine=F.min, sends=lambda s: F.col("fresh"), halt=lambda s: F.lit(True),
    )
    assert {r["id"]: r["dist"] for r in run(g, shortest).state.collect()} == {0: 0, 1: 5, 2: 12, 3: None}


def test_pandas_step(spark):
    import pandas as pd

    def count(vertices, sent):
        return pd.DataFrame({"id": vertices["id"], "n": vertices["id"].map(sent["dst"].value_counts()).fillna(0).astype("int64")})

    state = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    sent = spark.createDataFrame([(1,), (1,), (3,), (9,)], "dst long")
    assert {tuple(r) for r in escape.pandas_step(state, sent, count, "id long, n long", 2).collect()} == {(1, 2), (2, 0), (3, 1)}


def test_closed_wedges_makes_no_wedges(spark, sf_dir, monkeypatch):
    """Triangles by edge come from neighbour lists, not from wedges that cross the network."""
    from halyard import queries

    want = triangles.closed(triangles.oriented(queries.copurchase(spark, sf_dir))).groupBy("lo", "mid").agg(F.count("*").alias("n"))
    want = sorted(map(tuple, want.collect()))
    monkeypatch.setattr(triangles, "wedges", None)
    assert sorted(map(tuple, queries.closed_wedges(spark, sf_dir).collect())) == want != []
