"""PageRank with redistribution of the mass of dangling vertices."""

from __future__ import annotations

from pyspark.sql import functions as F

from halyard.operators.graph import Graph
from halyard.plans.loop import RunResult, run
from halyard.plans.program import Step, VertexProgram

DAMPING = 0.85


def pagerank_program(rounds: int = 10, damping: float = DAMPING) -> VertexProgram:
    """``rounds`` supersteps: the first sets 1/N, each other one applies the sum of messages and last step's dangling mass."""

    def update(step: Step) -> dict:
        if step.number == 1:
            return {"pr": F.lit(1.0 / step.num_vertices)}
        spread = (step.agg["dangling"] or 0.0) / step.num_vertices
        return {"pr": F.lit((1 - damping) / step.num_vertices) + F.lit(damping) * (F.coalesce("msg", F.lit(0.0)) + F.lit(spread))}

    return VertexProgram(
        init=lambda n: {"pr": F.lit(0.0)},
        update=update,
        message=lambda step: F.col("pr") / F.col("deg"),
        sends=lambda step: F.lit(step.number < rounds),
        halt=lambda step: F.lit(step.number >= rounds),
        aggregates={"dangling": lambda step: F.sum(F.when(F.col("deg") == 0, F.col("pr")).otherwise(0.0))},
        name=f"pagerank {rounds} {damping}",
    )


def pagerank(graph: Graph, rounds: int = 10, **options) -> RunResult:
    return run(graph, pagerank_program(rounds), **options)
