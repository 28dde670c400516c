"""Small vertex programs: reachability, and the loop's control flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from halyard.plans.program import Step, VertexProgram


def hops(source: int) -> VertexProgram:
    """``hops`` from ``source``, null where it is not reached. Vertices halt at once; messages wake them."""
    nearer = F.col("msg").isNotNull() & (F.col("hops").isNull() | (F.col("msg") < F.col("hops")))

    def update(step: Step) -> dict:
        if step.number == 1:
            return {"fresh": F.col("hops").isNotNull()}
        return {"hops": F.when(nearer, F.col("msg")).otherwise(F.col("hops")), "fresh": nearer}

    return VertexProgram(
        init=lambda n: {"hops": F.when(F.col("id") == source, F.lit(0).cast("long")), "fresh": F.lit(False)},
        update=update, message=lambda step: F.col("hops") + 1, combine=F.min,
        sends=lambda step: F.col("fresh"), halt=lambda step: F.lit(True), initially_active=F.col("id") == source,
    )


def wake_counter(wakes: int) -> VertexProgram:
    """How often each vertex ran: all halt at once, and some vertex wakes all for ``wakes`` steps."""
    return VertexProgram(
        init=lambda n: {"runs": F.lit(0).cast("long")}, update=lambda step: {"runs": F.col("runs") + 1}, message=lambda step: F.col("runs"),
        sends=lambda step: F.lit(False), halt=lambda step: F.lit(True), wake_all=lambda step: F.lit(step.number <= wakes),
    )


def stopped_counter(last: int) -> VertexProgram:
    """How often each vertex ran: none halts, and some vertex forces the end in step ``last``."""
    return VertexProgram(
        init=lambda n: {"runs": F.lit(0).cast("long")}, update=lambda step: {"runs": F.col("runs") + 1}, message=lambda step: F.col("runs"),
        sends=lambda step: F.lit(False), force_terminate=lambda step: F.lit(step.number >= last),
    )
