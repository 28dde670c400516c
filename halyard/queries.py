"""The graph operators as registered queries on the driver's tables, and SQL that gives the same rows."""

from __future__ import annotations

import dataclasses

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard import functions as fn
from halyard import streaming
from halyard.operators import escape, sorting, triangles
from halyard.operators.graph import Graph, copurchase, purchase, table
from halyard.operators.pagerank import pagerank, pagerank_program
from halyard.plans import programs
from halyard.plans.loop import InjectedFault, run
from halyard.plans.program import Fold, VertexProgram, folding
from halyard.plans.snapshots import Snapshots
from halyard.plans.storage import scratch
from halyard.sources import text

PLACES = 9


def _ranks(state: DataFrame) -> DataFrame:
    return state.select("id", F.round("pr", PLACES).alias("pr"))


def pagerank_10(spark, sf_dir):
    return _ranks(pagerank(purchase(spark, sf_dir)).state)


def pagerank_back(spark, sf_dir):
    return _ranks(pagerank(purchase(spark, sf_dir, back=True)).state)


def pagerank_dangling_mass(spark, sf_dir):
    steps = pagerank(purchase(spark, sf_dir, back=True)).steps
    rows = [(s["step"], s["agg"]["dangling"]) for s in steps]
    return spark.createDataFrame(rows, "step int, dangling double").select("step", F.round("dangling", PLACES).alias("dangling"))


def pagerank_text(spark, sf_dir):
    text.write_lines(text.rank_lines(pagerank(purchase(spark, sf_dir)).state), path := scratch(spark, "ranks"))
    return text.read_lines(spark, path)


def _orphans(spark, sf_dir) -> Graph:
    graph = purchase(spark, sf_dir, back=True)
    return Graph(graph.vertices.where("id % 6 <> 0"), graph.edges)


def pagerank_orphan_edges(spark, sf_dir):
    return _ranks(pagerank(_orphans(spark, sf_dir)).state)


def superstep_metrics(spark, sf_dir):
    return pagerank(purchase(spark, sf_dir)).metrics().select("step", "msgs_sent", "active")


def degree_count(spark, sf_dir):
    return copurchase(spark, sf_dir).out_degrees()


def degree_broadcast(spark, sf_dir):
    return text.degree_lines(triangles.neighbour_degrees(copurchase(spark, sf_dir)))


def orient_edges(spark, sf_dir):
    return triangles.oriented(copurchase(spark, sf_dir))


def wedges(spark, sf_dir):
    return triangles.wedges(triangles.oriented(copurchase(spark, sf_dir))).groupBy("lo").agg(F.count("*").alias("wedges"))


def closed_wedges(spark, sf_dir):
    return triangles.edge_triangles(triangles.oriented(copurchase(spark, sf_dir))).where("n > 0")


def triangles_mid(spark, sf_dir):
    return triangles.triangle_counts(copurchase(spark, sf_dir), "mid")


def triangles_min(spark, sf_dir):
    return triangles.triangle_counts(copurchase(spark, sf_dir), "lo")


def triangle_total(spark, sf_dir):
    return triangles.edge_triangles(triangles.oriented(copurchase(spark, sf_dir))).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("triangles"))


def triangle_request_rounds(spark, sf_dir):
    return triangles.request_rounds(copurchase(spark, sf_dir))


def triangle_request_steps(spark, sf_dir):
    return triangles.request_steps(copurchase(spark, sf_dir))


def triangle_supersteps(spark, sf_dir):
    return triangles.request_rounds(copurchase(spark, sf_dir)).agg((2 * F.coalesce(F.max("rounds"), F.lit(0)) + 1).alias("supersteps"))


def inbox_collect(spark, sf_dir):
    graph = purchase(spark, sf_dir)
    sent = escape.scatter(graph.edges, graph.out_degrees(), [F.col("deg")], ["deg"])
    return escape.inboxes(sent, "deg").select("dst", "n", F.array_join(F.col("msgs").cast("array<string>"), " ").alias("msgs"))


def combine_sum(spark, sf_dir):
    graph = purchase(spark, sf_dir)
    return escape.scatter(graph.edges, graph.out_degrees(), [F.col("deg")], ["deg"]).groupBy("dst").agg(F.sum("deg").alias("total"))


def deliver_known(spark, sf_dir):
    graph = _orphans(spark, sf_dir)
    sent = escape.scatter(graph.edges, graph.out_degrees(), [F.col("deg")], ["deg"])
    return sent.join(graph.vertices, F.col("dst") == F.col("id"), "left_semi").groupBy("dst").agg(F.count("*").alias("n"))


def active_filter(spark, sf_dir):
    return run(purchase(spark, sf_dir, back=True), programs.hops(0)).state.select("id", "hops")


def wake_all(spark, sf_dir):
    return run(purchase(spark, sf_dir, back=True), programs.wake_counter(3)).state.select("id", "runs")


def force_terminate(spark, sf_dir):
    return run(purchase(spark, sf_dir, back=True), programs.stopped_counter(5)).state.select("id", "runs")


def or_flags(spark, sf_dir):
    edges = purchase(spark, sf_dir).edges
    flags = edges.groupBy("dst").agg(F.bit_or(fn.flag((F.col("src") % 7).cast("int"))).alias("flags"))
    return flags.select("dst", F.col("flags").cast("long").alias("flags"), fn.has_flag("flags", 4).alias("has_4"), fn.without_flag("flags", 4).cast("long").alias("without_4"))


def vertex_owner(spark, sf_dir):
    return purchase(spark, sf_dir).vertices.select(fn.key_owner("id", 16).alias("worker")).groupBy("worker").agg(F.count("*").alias("n"))


def range_sort_order(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("value", "event_id")
    return sorting.number_records(events, "value", "event_id").select("event_id", "ord")


def range_sort_text(spark, sf_dir):
    events = sorting.number_records(table(spark, sf_dir, "events").select("value", "event_id", "event_type"), "value", "event_id")
    lines = text.ordered_lines(events, F.concat_ws(" ", "event_id", "event_type"), "ord")
    text.write_lines(lines, path := scratch(spark, "sorted"))
    return text.read_lines(spark, path)


def adjacency_parse(spark, sf_dir):
    text.write_lines(text.adjacency_lines(purchase(spark, sf_dir, back=True)), path := scratch(spark, "adjacency"))
    return text.parse_adjacency(text.read_lines(spark, path)).edges


def adjacency_cached(spark, sf_dir):
    text.write_lines(text.adjacency_lines(purchase(spark, sf_dir)), path := scratch(spark, "adjacency"))
    cache = scratch(spark, "graphs")
    text.cached_graph(spark, path, cache)
    return text.cached_graph(spark, path, cache).out_degrees()


def degree_pairs_parse(spark, sf_dir):
    lines = text.degree_lines(triangles.neighbour_degrees(copurchase(spark, sf_dir)))
    text.write_lines(lines, path := scratch(spark, "degrees"))
    graph = text.parse_degree_pairs(text.read_lines(spark, path))
    lists = text.oriented_pairs(graph)
    return lists.select("id", F.concat_ws(" ", F.transform("nbs", lambda x: F.concat_ws(":", x["dst_deg"], x["dst"]))).alias("nbs"))


def _resumed(spark, sf_dir, heavy: bool) -> DataFrame:
    graph, path = purchase(spark, sf_dir), scratch(spark, "snapshots")
    try:
        run(graph, pagerank_program(), snapshots=Snapshots(path, 5, heavy), fail_after=7)
    except InjectedFault:
        pass
    return _ranks(run(graph, pagerank_program(), snapshots=Snapshots(path, 5, heavy), resume=True).state)


def checkpoint_lw_resume(spark, sf_dir):
    return _resumed(spark, sf_dir, False)


def checkpoint_hw_resume(spark, sf_dir):
    return _resumed(spark, sf_dir, True)


def _degree_sums(vertices: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
    met = sent.groupby("dst")["deg"].agg(["size", "sum"]) if len(sent) else pd.DataFrame({"size": [], "sum": []})
    own = vertices[["id"]].join(met, on="id").fillna(0)
    return own.rename(columns={"size": "n", "sum": "total"}).astype("int64")


def udf_program(spark, sf_dir):
    graph = copurchase(spark, sf_dir)
    sent = escape.scatter(graph.edges, graph.out_degrees(), [F.col("deg")], ["deg"])
    return escape.pandas_step(graph.vertices, sent, _degree_sums, "id long, n long, total long")


def checkpoint_rerun(spark, sf_dir):
    """Two runs fail in one folder, the second after a snapshot of the same step; a third resumes."""
    graph, path = purchase(spark, sf_dir), scratch(spark, "snapshots")
    for fails in (7, 6):
        try:
            run(graph, pagerank_program(), snapshots=Snapshots(path, 5), fail_after=fails)
        except InjectedFault:
            pass
    return _ranks(run(graph, pagerank_program(), snapshots=Snapshots(path, 5), resume=True).state)


def checkpoint_log_resume(spark, sf_dir):
    """The log of states after the snapshot lets a run resume from the step it failed in."""
    graph, path = purchase(spark, sf_dir), scratch(spark, "snapshots")
    try:
        run(graph, pagerank_program(), snapshots=Snapshots(path, 5, log=True), fail_after=7)
    except InjectedFault:
        pass
    store = Snapshots(path, 5, log=True)
    state = run(graph, pagerank_program(), snapshots=store, resume=True).state
    return _ranks(state).withColumn("resumed_from", F.lit(7 if store.committed(spark)[0] == 5 else None).cast("int"))


def checkpoint_veto(spark, sf_dir):
    path = scratch(spark, "snapshots")
    program = dataclasses.replace(pagerank_program(), checkpointable=lambda step: step % 2 == 1)
    run(purchase(spark, sf_dir), program, snapshots=Snapshots(path, 2))
    return spark.createDataFrame([(k,) for k in Snapshots(path).committed(spark)], "step int")


def superstep_totals(spark, sf_dir):
    return pagerank(purchase(spark, sf_dir)).totals().select("steps", "msgs_sent", "delivered", "inboxes")


def user_fold(spark, sf_dir):
    """A global aggregate and a combiner that are folds of one's own: the largest id of odd degree; products mod 1009."""
    odd = Fold(
        value=lambda step: F.when(F.col("deg") % 2 == 1, F.col("id")), zero=F.lit(-1).cast("long"),
        step=lambda acc, v: F.greatest(acc, v), merge=lambda a, b: F.greatest(a, b),
    )
    program = VertexProgram(
        init=lambda n: {"prod": F.lit(1).cast("long"), "odd": F.lit(0).cast("long")},
        update=lambda s: {} if s.number == 1 else {"prod": F.coalesce("msg", F.lit(1)), "odd": F.lit(s.agg["odd"]).cast("long")},
        message=lambda s: F.col("id") % 1009 + 1, combine=folding(F.lit(1).cast("long"), lambda acc, m: acc * m % 1009),
        sends=lambda s: F.lit(s.number == 1), halt=lambda s: F.lit(s.number == 2), folds={"odd": odd},
    )
    return run(purchase(spark, sf_dir), program).state.select("id", "prod", "odd")


def edge_attributes(spark, sf_dir):
    """Messages that use an edge's attribute."""
    graph = purchase(spark, sf_dir)
    graph = Graph(graph.vertices, graph.edges.withColumn("eval", (F.col("src") + F.col("dst")) % 7))
    program = VertexProgram(
        init=lambda n: {"total": F.lit(0).cast("long")}, update=lambda s: {"total": F.coalesce("msg", F.lit(0))}, message=lambda s: F.col("id") * F.col("eval"),
        sends=lambda s: F.lit(s.number == 1), halt=lambda s: F.lit(s.number == 2),
    )
    return run(graph, program).state.select("id", "total")


def tuple_owner(spark, sf_dir):
    """Every edge has one of the workers, and few workers have none."""
    owner = purchase(spark, sf_dir).edges.select(fn.tuple_owner(16, "src", "dst").alias("w"))
    return owner.agg(F.count("*").alias("n"), F.min((F.col("w") >= 0) & (F.col("w") < 16)).alias("valid"), (F.count_distinct("w") > 8).alias("spread"))


def uniform_sample(spark, sf_dir):
    return table(spark, sf_dir, "events").where(fn.sampled(0.1, 7, F.col("event_id"))).select("event_id")


def sort_splitters(spark, sf_dir):
    """Ranges cut by a sample: their number, and whether each holds between half and twice its share of the keys."""
    events = table(spark, sf_dir, "events").select("value")
    cuts = sorting.splitters(events, "value", 8, rate=0.5).agg(F.sort_array(F.collect_list("value")).alias("cuts"))  # seven numbers
    part = F.size(F.filter("cuts", lambda c: c <= F.col("value")))
    sizes = events.crossJoin(F.broadcast(cuts)).groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    share = F.sum("n") / 8
    return sizes.agg(F.count("*").alias("parts"), ((F.min("n") > share / 2) & (F.max("n") < 2 * share)).alias("even"))


def multiple_inputs(spark, sf_dir):
    graph, paths = purchase(spark, sf_dir), [scratch(spark, "left"), scratch(spark, "right")]
    for k, path in enumerate(paths):
        own = graph.vertices.where(F.col("id") % 2 == k)
        text.write_lines(text.adjacency_lines(Graph(own, graph.edges)), path)
    return text.parse_adjacency(text.read_lines(spark, *paths)).out_degrees()


def path_checks(spark, sf_dir):
    """Which uses of paths are errors."""
    there, rows = scratch(spark, "there"), []
    lines = spark.createDataFrame([("1\t0",)], "value string")
    text.write_lines(lines, there)
    cases = {"missing input": lambda: text.read_lines(spark, f"{there}-not").count(), "existing output": lambda: text.write_lines(lines, there), "forced output": lambda: text.write_lines(lines, there, force=True)}
    for name, use in cases.items():
        try:
            use()
            rows.append((name, False))
        except AnalysisException:
            rows.append((name, True))
    return spark.createDataFrame(rows, "name string, fails boolean")


def import_text(spark, sf_dir):
    source, target = scratch(spark, "source"), scratch(spark, "target")
    text.write_lines(text.adjacency_lines(purchase(spark, sf_dir)), source)
    text.import_text(spark, source, target)
    return text.parse_adjacency(text.read_lines(spark, target)).edges


def split_report(spark, sf_dir):
    """Rows that tasks read, by file: together all of the table, each file's rows once."""
    report = text.placement(table(spark, sf_dir, "lineitem"))
    return report.groupBy("file").agg(F.sum("n").alias("n")).agg(F.sum("n").alias("n"), F.count("*").alias("files"))


def degree_text(spark, sf_dir):
    """Adjacency lines read, every degree told to the neighbours, and written as lines."""
    text.write_lines(text.adjacency_lines(copurchase(spark, sf_dir)), path := scratch(spark, "adjacency"))
    graph = text.parse_adjacency(text.read_lines(spark, path))
    text.write_lines(text.degree_lines(triangles.neighbour_degrees(graph)), out := scratch(spark, "degrees"))
    return text.read_lines(spark, out)


def stream_degrees(spark, sf_dir):
    """Out-degrees of adjacency lines that arrive as files, one at a time."""
    text.write_lines(text.adjacency_lines(purchase(spark, sf_dir)).repartition(3), path := scratch(spark, "adjacency"))
    out = scratch(spark, "degrees")
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", 1).load(path)
    told = streaming.stream_degrees(lines).writeStream.outputMode("complete").trigger(availableNow=True)
    told.option("checkpointLocation", scratch(spark, "stream")).foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(out)).start().awaitTermination()
    return spark.read.parquet(out)


QUERIES = {
    f.__name__: f
    for f in (
        pagerank_10, pagerank_back, pagerank_dangling_mass, pagerank_text, pagerank_orphan_edges, superstep_metrics, degree_count,
        degree_broadcast, orient_edges, wedges, closed_wedges, triangles_mid, triangles_min, triangle_total, triangle_request_rounds,
        triangle_request_steps, triangle_supersteps, inbox_collect, combine_sum, deliver_known, active_filter, wake_all, force_terminate,
        or_flags, vertex_owner, range_sort_order, range_sort_text, adjacency_parse, adjacency_cached, degree_pairs_parse,
        checkpoint_lw_resume, checkpoint_hw_resume, udf_program, checkpoint_rerun, checkpoint_log_resume, checkpoint_veto, superstep_totals,
        user_fold, edge_attributes, tuple_owner, uniform_sample, sort_splitters, multiple_inputs, path_checks, import_text, split_report,
        degree_text, stream_degrees,
    )
}

PURCHASE = """v AS (SELECT c_custkey * 2 AS id FROM customer UNION ALL SELECT s_suppkey * 2 + 1 FROM supplier),
e AS (SELECT DISTINCT o_custkey * 2 AS src, l_suppkey * 2 + 1 AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
BACK = PURCHASE.replace("e AS (", "f AS (") + ",\ne AS (SELECT src, dst FROM f UNION ALL SELECT dst, src FROM f WHERE dst % 4 = 1)"
ORPHANS = BACK.replace("v AS (", "u AS (") + ",\nv AS (SELECT id FROM u WHERE id % 6 <> 0)"
COPURCHASE = """v AS (SELECT p_partkey AS id FROM part),
e AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey WHERE a.l_partkey <> b.l_partkey),
d AS (SELECT src AS id, count(*) AS deg FROM e GROUP BY src)"""
ORIENTED = COPURCHASE + """,
o AS (SELECT src AS lo, dst AS hi, x.deg AS dlo, y.deg AS dhi FROM e JOIN d x ON src = x.id JOIN d y ON dst = y.id WHERE (x.deg, src) < (y.deg, dst))"""
WEDGES = ORIENTED + """,
w AS (SELECT a.lo, a.hi AS mid, b.hi FROM o a JOIN o b ON a.lo = b.lo WHERE (a.dhi, a.hi) < (b.dhi, b.hi))"""
TRIANGLES = WEDGES + """,
t AS (SELECT w.lo, w.mid, w.hi FROM w JOIN o ON w.mid = o.lo AND w.hi = o.hi)"""
ROUNDS = ORIENTED + """,
r AS (SELECT lo AS id, dlo AS deg, (count(*) * (count(*) - 1) // 2)::BIGINT AS requests FROM o GROUP BY lo, dlo),
q AS (SELECT id, deg, requests, ceil(requests / (10 * deg))::BIGINT AS rounds FROM r)"""


def _pagerank_sql(graph: str, last: str, rounds: int = 10) -> str:
    """Chained steps; the last dangling mass and ranks are in r1, r2, ..."""
    own = "deg AS MATERIALIZED (SELECT v.id, count(e.src) AS deg FROM v LEFT JOIN e ON v.id = e.src GROUP BY v.id), c AS (SELECT count(*)::DOUBLE AS n FROM v)"
    steps = ["r1 AS MATERIALIZED (SELECT deg.id, deg, 1.0::DOUBLE / n AS pr FROM deg, c)"]
    for k in range(2, rounds + 1):
        p = f"r{k - 1}"
        steps.append(
            f"r{k} AS MATERIALIZED (SELECT deg.id, deg.deg, 0.15::DOUBLE / n + 0.85::DOUBLE * (coalesce(s, 0) + (SELECT coalesce(sum(pr), 0) FROM {p} WHERE deg = 0) / n) AS pr "
            f"FROM deg CROSS JOIN c LEFT JOIN (SELECT dst, sum(pr / deg) AS s FROM {p} JOIN e ON {p}.id = e.src GROUP BY dst) m ON deg.id = m.dst)"
        )
    return f"WITH {graph},\n{own},\n" + ",\n".join(steps) + "\n" + last


RANKS = "SELECT id, round(pr, 9) AS pr FROM r10"
PAIRS = "SELECT {} FROM e JOIN (SELECT src AS s, count(*) AS deg FROM e GROUP BY src) ON e.src = s JOIN v ON e.src = v.id"
ORACLE_SQL = {
    "pagerank_10": _pagerank_sql(PURCHASE, RANKS),
    "pagerank_back": _pagerank_sql(BACK, RANKS),
    "pagerank_dangling_mass": _pagerank_sql(BACK, " UNION ALL ".join(f"SELECT {k}::INT AS step, round(coalesce(sum(pr), 0), 9) AS dangling FROM r{k} WHERE deg = 0" for k in range(1, 11))),
    "pagerank_text": _pagerank_sql(PURCHASE, "SELECT printf('%d', id) || chr(9) || printf('%.6f', pr) AS value FROM r10"),
    "pagerank_orphan_edges": _pagerank_sql(ORPHANS, RANKS),
    "superstep_metrics": f"WITH {PURCHASE} SELECT step::INT AS step, CASE WHEN step < 10 THEN (SELECT count(*) FROM e) ELSE 0 END::BIGINT AS msgs_sent, CASE WHEN step < 10 THEN (SELECT count(*) FROM v) ELSE 0 END::BIGINT AS active FROM range(1, 11) t(step)",
    "degree_count": f"WITH {COPURCHASE} SELECT v.id, coalesce(deg, 0) AS deg FROM v LEFT JOIN d ON v.id = d.id",
    "degree_broadcast": f"WITH {COPURCHASE} SELECT v.id::VARCHAR || chr(9) || concat_ws(' ', count(src), string_agg(src::VARCHAR || ' ' || deg::VARCHAR, ' ' ORDER BY src)) AS value FROM v LEFT JOIN (SELECT dst, src, deg FROM e JOIN d ON src = id) m ON v.id = dst GROUP BY v.id",
    "orient_edges": f"WITH {ORIENTED} SELECT lo, hi, dlo, dhi FROM o",
    "wedges": f"WITH {WEDGES} SELECT lo, count(*) AS wedges FROM w GROUP BY lo",
    "closed_wedges": f"WITH {TRIANGLES} SELECT lo, mid, count(*) AS n FROM t GROUP BY lo, mid",
    "triangles_mid": f"WITH {TRIANGLES} SELECT v.id, count(t.mid) AS triangles FROM v LEFT JOIN t ON v.id = t.mid GROUP BY v.id",
    "triangles_min": f"WITH {TRIANGLES} SELECT v.id, count(t.lo) AS triangles FROM v LEFT JOIN t ON v.id = t.lo GROUP BY v.id",
    "triangle_total": f"WITH {TRIANGLES} SELECT count(*) AS triangles FROM t",
    "triangle_request_rounds": f"WITH {ROUNDS} SELECT id, deg, requests, rounds FROM q",
    "triangle_request_steps": f"WITH {ROUNDS}, p AS (SELECT *, unnest(range(1, rounds + 1)) AS page FROM q) SELECT 2 * page - 1 AS step, sum(least(10 * deg, requests - (page - 1) * 10 * deg))::BIGINT AS requests FROM p GROUP BY page",
    "triangle_supersteps": f"WITH {ROUNDS} SELECT 2 * coalesce(max(rounds), 0) + 1 AS supersteps FROM q",
    "inbox_collect": f"WITH {PURCHASE}, m AS ({PAIRS.format('dst, deg')}) SELECT dst, count(*) AS n, string_agg(deg::VARCHAR, ' ' ORDER BY deg) AS msgs FROM m GROUP BY dst",
    "combine_sum": f"WITH {PURCHASE}, m AS ({PAIRS.format('dst, deg')}) SELECT dst, sum(deg)::BIGINT AS total FROM m GROUP BY dst",
    "deliver_known": f"WITH {ORPHANS} SELECT dst, count(*) AS n FROM e WHERE src IN (SELECT id FROM v) AND dst IN (SELECT id FROM v) GROUP BY dst",
    "active_filter": f"WITH RECURSIVE {BACK}, h AS (SELECT 0::BIGINT AS id, 0::BIGINT AS hops UNION SELECT dst, hops + 1 FROM h JOIN e ON h.id = e.src WHERE hops < 12) SELECT v.id, min(hops) AS hops FROM v LEFT JOIN h ON v.id = h.id GROUP BY v.id",
    "wake_all": f"WITH {BACK} SELECT id, 4::BIGINT AS runs FROM v",
    "force_terminate": f"WITH {BACK} SELECT id, 5::BIGINT AS runs FROM v",
    "or_flags": f"WITH {PURCHASE}, b AS (SELECT dst, bit_or(1::BIGINT << (src % 7)::INT) AS flags FROM e GROUP BY dst) SELECT dst, flags, flags & 16 <> 0 AS has_4, flags & ~16::BIGINT AS without_4 FROM b",
    "vertex_owner": f"WITH {PURCHASE} SELECT abs(id) % 16 AS worker, count(*) AS n FROM v GROUP BY 1",
    "range_sort_order": "SELECT event_id, row_number() OVER (ORDER BY value, event_id) - 1 AS ord FROM events",
    "range_sort_text": "SELECT concat_ws(' ', row_number() OVER (ORDER BY value, event_id) - 1, event_id, event_type) AS value FROM events",
    "adjacency_parse": f"WITH {BACK} SELECT src, dst FROM e",
    "adjacency_cached": f"WITH {PURCHASE} SELECT v.id, count(e.src) AS deg FROM v LEFT JOIN e ON v.id = e.src GROUP BY v.id",
    "degree_pairs_parse": f"WITH {ORIENTED} SELECT v.id, coalesce(string_agg(dhi::VARCHAR || ':' || hi::VARCHAR, ' ' ORDER BY dhi, hi), '') AS nbs FROM v LEFT JOIN o ON v.id = o.lo GROUP BY v.id",
    "checkpoint_lw_resume": _pagerank_sql(PURCHASE, RANKS),
    "checkpoint_hw_resume": _pagerank_sql(PURCHASE, RANKS),
    "checkpoint_rerun": _pagerank_sql(PURCHASE, RANKS),
    "checkpoint_log_resume": _pagerank_sql(PURCHASE, "SELECT id, round(pr, 9) AS pr, 7::INT AS resumed_from FROM r10"),
    "checkpoint_veto": "SELECT 9::INT AS step",
    "superstep_totals": f"WITH {PURCHASE} SELECT 10::INT AS steps, 9 * count(*) AS msgs_sent, 9 * count(*) AS delivered, 9 * count(DISTINCT dst) AS inboxes FROM e",
    "user_fold": f"WITH RECURSIVE {PURCHASE}, g AS (SELECT dst, list(src % 1009 + 1) AS ms FROM e GROUP BY dst), "
    "d AS (SELECT v.id, count(e.src) AS deg FROM v LEFT JOIN e ON v.id = e.src GROUP BY v.id) "
    "SELECT v.id, coalesce(list_reduce(list_prepend(1::BIGINT, ms), lambda a, m: a * m % 1009), 1)::BIGINT AS prod, (SELECT max(id) FROM d WHERE deg % 2 = 1) AS odd FROM v LEFT JOIN g ON v.id = dst",
    "edge_attributes": f"WITH {PURCHASE} SELECT v.id, coalesce(sum(src * ((src + dst) % 7)), 0)::BIGINT AS total FROM v LEFT JOIN e ON v.id = dst GROUP BY v.id",
    "tuple_owner": f"WITH {PURCHASE} SELECT count(*) AS n, true AS valid, true AS spread FROM e",
    "uniform_sample": "SELECT event_id FROM events WHERE ('0x' || substr(md5('7:' || event_id), 1, 8))::BIGINT / 4294967296.0 < 0.1",
    "sort_splitters": "SELECT 8::BIGINT AS parts, true AS even",
    "multiple_inputs": f"WITH {PURCHASE} SELECT v.id, count(e.src) AS deg FROM v LEFT JOIN e ON v.id = e.src GROUP BY v.id",
    "path_checks": "SELECT * FROM (VALUES ('missing input', true), ('existing output', true), ('forced output', false)) t(name, fails)",
    "import_text": f"WITH {PURCHASE} SELECT src, dst FROM e",
    "split_report": "SELECT count(*)::BIGINT AS n, 1::BIGINT AS files FROM lineitem",
    "degree_text": f"WITH {COPURCHASE} SELECT v.id::VARCHAR || chr(9) || concat_ws(' ', count(src), string_agg(src::VARCHAR || ' ' || deg::VARCHAR, ' ' ORDER BY src)) AS value FROM v LEFT JOIN (SELECT dst, src, deg FROM e JOIN d ON src = id) m ON v.id = dst GROUP BY v.id",
    "stream_degrees": f"WITH {PURCHASE} SELECT src AS id, count(*) AS deg FROM e GROUP BY src",
    "udf_program": f"WITH {COPURCHASE} SELECT v.id, count(e.src) AS n, coalesce(sum(deg), 0)::BIGINT AS total FROM v LEFT JOIN e ON v.id = e.dst LEFT JOIN d ON e.src = d.id GROUP BY v.id",
}
