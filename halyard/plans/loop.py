"""The superstep loop: one Spark action for each step.

A step joins the messages to the vertices, updates those that are active or got messages, and keeps the new state in
memory and on disk, partitioned and sorted by id as the edges are by source. So a step moves nothing but messages, which
are combined before their shuffle and never stored. Global aggregates, flags and counters are read by the action that
computes the state. Every ``cut`` steps, or where a snapshot is taken, the state is written and the lineage ends there:
an executor that is lost costs its partitions of at most that many steps.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.operators.graph import Graph
from halyard.plans.program import Fold, Step, VertexProgram
from halyard.plans.snapshots import Snapshots
from halyard.plans.storage import checkpointed, fixed_partitions, opaque, persisted

METRICS = "step int, msgs_sent long, active long, force boolean, wake boolean, delivered long, inboxes long, seconds double"
#: Vertices, or partial results, that one fold takes.
FOLD = 4096


class InjectedFault(RuntimeError):
    """Raised by the test hook."""


@dataclass
class RunResult:
    """The final state, and per step its counters, flags, aggregates and seconds. ``seconds`` has the run's parts: load
    (graph, or snapshot on resuming), supersteps, snapshots."""

    state: DataFrame
    steps: list[dict]
    seconds: dict[str, float] = field(default_factory=dict)

    def metrics(self) -> DataFrame:
        """Per superstep: messages sent (before combining), active vertices, flags; messages that arrived at the step's
        beginning and the vertices that got any (combined messages); seconds."""
        names = [c.split()[0] for c in METRICS.split(", ")]
        return self.state.sparkSession.createDataFrame([tuple(s[k] for k in names) for s in self.steps], METRICS)

    def totals(self) -> DataFrame:
        """One row: steps, and the sums of messages sent, delivered, combined, and seconds by part."""
        total = lambda k: sum(s[k] for s in self.steps)
        row = (len(self.steps), total("msgs_sent"), total("delivered"), total("inboxes"), *(self.seconds.get(k, 0.0) for k in PARTS))
        return self.state.sparkSession.createDataFrame([row], "steps int, msgs_sent long, delivered long, inboxes long, " + ", ".join(f"{k}_sec double" for k in PARTS))


PARTS = ("load", "supersteps", "snapshots")


def messages(state: DataFrame, edges: DataFrame, program: VertexProgram, step: Step) -> DataFrame:
    """(dst, msg, msg_cnt): what the vertices that computed in ``step`` send, combined by destination."""
    senders = state.where(F.col("computed") & (F.col("deg") > 0) & program.sends(step))
    sent = senders.join(edges, senders["id"] == edges["src"]).select("dst", program.message(step).alias("m"))
    return sent.groupBy("dst").agg(program.combine(F.col("m")).alias("msg"), F.count("*").alias("msg_cnt"))


def advanced(state: DataFrame, inbox: DataFrame | None, program: VertexProgram, step: Step, wake: bool) -> DataFrame:
    """The state after one superstep, and ``got``, each vertex's messages. Messages to unknown ids find no vertex and are dropped."""
    if inbox is None:
        met = state.withColumns({"msg": F.lit(None).cast("double"), "msg_cnt": F.lit(0).cast("long")})
    else:
        met = state.join(inbox, state["id"] == inbox["dst"], "left").drop("dst").withColumn("msg_cnt", F.coalesce("msg_cnt", F.lit(0)))
    runs = F.lit(True) if wake else F.col("active") | (F.col("msg_cnt") > 0)
    met = met.withColumn("computed", runs)
    values = {c: F.when(F.col("computed"), new.cast(state.schema[c].dataType)).otherwise(F.col(c)) for c, new in program.update(step).items()}
    kept = [values.get(c, F.col(c)).alias(c) for c in state.columns if c not in ("active", "computed", "got")]
    halts = program.halt(step)
    active = F.when(F.col("computed"), ~halts).otherwise(F.lit(False)).alias("active")
    return met.select(*kept, active, "computed", F.col("msg_cnt").alias("got"))


def folded(state: DataFrame, fold: Fold, step: Step, n: int) -> object:
    """A program's own global aggregate, in groups of some ``FOLD`` vertices, whose results meet in groups again."""
    size = max(1, -(-n // FOLD))
    bucket = lambda k: F.pmod(F.col("__b"), F.lit(k)).alias("__b")
    own = state.select(F.xxhash64("id").alias("__b"), fold.value(step).alias("__v")).groupBy(bucket(size))
    some = own.agg(F.aggregate(F.collect_list("__v"), fold.zero, fold.step).alias("__v"))
    while size > 1:
        size = -(-size // FOLD)
        some = some.groupBy(bucket(size)).agg(F.aggregate(F.collect_list("__v"), fold.zero, fold.merge).alias("__v"))
    row = some.first()
    return row["__v"] if row else None


def run(
    graph: Graph, program: VertexProgram, max_steps: int = 100_000, snapshots: Snapshots | None = None, resume: bool = False, fail_after: int | None = None, cut: int = 10
) -> RunResult:
    """Run until no vertex is active and no message was sent, a vertex forces the end, or ``max_steps`` are done."""
    spark = graph.edges.sparkSession
    began = time.time()
    # A fixed number, so that every step's joins find edges and state partitioned and sorted alike.
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    edges = persisted(graph.edges.repartition(parts, "src").sortWithinPartitions("src"))
    try:
        with fixed_partitions(spark):
            return _Run(graph, edges, program, parts, cut, snapshots).go(max_steps, resume, fail_after, began)
    finally:
        try:
            if snapshots:
                snapshots.wait()
        finally:
            edges.unpersist()


class _Run:
    def __init__(self, graph: Graph, edges: DataFrame, program: VertexProgram, parts: int, cut: int, snapshots: Snapshots | None):
        self.graph, self.edges, self.program, self.parts, self.cut, self.snapshots = graph, edges, program, parts, cut, snapshots
        self.spark, self.held = edges.sparkSession, []

    def placed(self, state: DataFrame) -> DataFrame:
        return state.repartition(self.parts, "id").sortWithinPartitions("id")

    def kept(self, state: DataFrame, columns: dict[str, Column]) -> tuple[DataFrame, dict]:
        """``state`` computed and held, and what ``columns`` aggregate over it. The one held before goes."""
        state = persisted(state)
        got = state.agg(*(c.alias(k) for k, c in columns.items())).first().asDict()
        if self.snapshots:  # which may still write the one before
            self.snapshots.wait()
        self.held, before = [state], self.held
        for old in before:
            old.unpersist()
        return opaque(state), got

    def start(self) -> tuple[DataFrame, int]:
        counts = self.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("deg"))
        n = self.graph.checked().vertices.count()
        first = self.graph.vertices.join(counts, "id", "left").withColumn("deg", F.coalesce("deg", F.lit(0)))
        state = first.withColumns(dict(self.program.init(n)))
        active = F.lit(True) if self.program.initially_active is None else self.program.initially_active
        state = state.withColumn("active", active).withColumn("computed", F.lit(False)).withColumn("got", F.lit(0).cast("long"))
        return self.kept(self.placed(state), {"n": F.count("*")})[0], n

    def identity(self) -> dict:
        """What a snapshot belongs to: the program's name, and a print of the graph."""
        total = lambda *c: F.sum(F.xxhash64(*c).cast("decimal(38,0)")).cast("string")
        v, e = self.graph.vertices.agg(F.count("*"), total("id")).first(), self.edges.agg(F.count("*"), total(*self.edges.columns)).first()
        return {"program": self.program.name, "vertices": list(v), "edges": list(e)}

    def go(self, max_steps: int, resume: bool, fail_after: int | None, began: float) -> RunResult:
        program, edges, snapshots = self.program, self.edges, self.snapshots
        found = None
        if snapshots:
            snapshots.identity = self.identity()
            snapshots.check(self.spark)
            found = snapshots.load(self.spark) if resume else None
        if found:
            step = Step(found.step, found.num_vertices, found.agg)
            steps, wake, last = found.steps, found.wake, found.snapshot
            state, _ = self.kept(self.placed(found.state), {"n": F.count("*")})
            inbox = found.inbox if found.inbox is not None else (messages(state, edges, program, step) if steps[-1]["msgs_sent"] else None)
        else:
            state, n = self.start()
            step, steps, inbox, wake, last = Step(0, n), [], None, False, 0
        seconds = {"load": time.time() - began, "supersteps": 0.0, "snapshots": 0.0}
        since = 0
        while step.num_vertices and step.number < max_steps:
            if steps and (steps[-1]["force"] or not (steps[-1]["active"] or steps[-1]["msgs_sent"] or wake)):
                break
            began = time.time()
            step = Step(step.number + 1, step.num_vertices, step.agg)
            sends = F.col("computed") & (F.col("deg") > 0) & program.sends(step)
            watched = {
                "msgs_sent": F.coalesce(F.sum(F.when(sends, F.col("deg"))), F.lit(0)), "active": F.sum(F.col("active").cast("long")),
                "force": F.coalesce(F.bool_or(F.col("computed") & program.force_terminate(step)), F.lit(False)), "wake": F.coalesce(F.bool_or(F.col("computed") & program.wake_all(step)), F.lit(False)),
                "delivered": F.sum("got"), "inboxes": F.count_if(F.col("got") > 0),
            }
            watched |= {f"agg_{k}": f(step) for k, f in program.aggregates.items()}
            state, got = self.kept(advanced(state, inbox, program, step, wake), watched)
            agg = {k: got[f"agg_{k}"] for k in program.aggregates} | {k: folded(state, f, step, step.num_vertices) for k, f in program.folds.items()}
            step = Step(step.number, step.num_vertices, agg)
            wake = got["wake"]
            inbox = messages(state, edges, program, step) if got["msgs_sent"] else None
            goes_on = not got["force"] and (got["active"] or got["msgs_sent"] or wake) and step.number < max_steps
            counters = ("msgs_sent", "active", "force", "wake", "delivered", "inboxes")
            steps.append({"step": step.number, **{k: got[k] for k in counters}, "seconds": time.time() - began, "agg": agg})
            seconds["supersteps"] += steps[-1]["seconds"]
            since += 1
            if snapshots and goes_on and program.checkpointable(step.number):
                due = step.number - last >= snapshots.interval
                if due or snapshots.log:
                    began, last = time.time(), step.number if due else last
                    if since < self.cut:
                        snapshots.begin(step, state, inbox, steps, wake, log=not due)
                    else:  # what is written ends the lineage
                        state, _ = self.kept(self.placed(snapshots.save(step, state, inbox, steps, wake, log=not due)), {"n": F.count("*")})
                        inbox, since = messages(state, edges, program, step) if got["msgs_sent"] else None, 0
                    seconds["snapshots"] += time.time() - began
            if goes_on and since >= self.cut:
                state = checkpointed(state)
                inbox, since = messages(state, edges, program, step) if got["msgs_sent"] else None, 0
            if fail_after == step.number:
                raise InjectedFault(f"after step {step.number}")
        return RunResult(checkpointed(state.drop("got")), steps, seconds)
