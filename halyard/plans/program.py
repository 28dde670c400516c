"""Vertex programs as column expressions.

A program's functions get a ``Step`` and return expressions over the vertex's columns: ``id``, ``deg`` (length of its
edge list), its value columns, ``active``, and in ``update`` and ``halt`` also ``msg`` (the combined messages, null
without any) and ``msg_cnt``. ``message`` may also use the edge's columns. Messages are a function of the new state, so
they can always be made again from a snapshot of the state alone; a program whose messages need more says so in
``checkpointable``. Snapshots carry the program's ``name``, and are not taken over by another one.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Step:
    """What every vertex sees: the superstep from 1 on, the number of vertices, last step's global aggregates."""

    number: int
    num_vertices: int
    agg: Mapping[str, object] = field(default_factory=dict)


Expression = Callable[[Step], Column]


@dataclass(frozen=True)
class Fold:
    """A global aggregate of one's own: ``step`` takes a vertex's ``value`` into an accumulator that starts as ``zero``,
    ``merge`` joins two of them, in any order. Next step's functions find the result in ``Step.agg``."""

    value: Expression
    zero: Column
    step: Callable[[Column, Column], Column]
    merge: Callable[[Column, Column], Column]


def folding(zero: Column, step: Callable[[Column, Column], Column]) -> Callable[[Column], Column]:
    """A combiner of one's own, for ``combine``. Unlike Spark's aggregates it gathers a destination's messages first."""
    return lambda messages: F.aggregate(F.collect_list(messages), zero, step)


@dataclass(frozen=True)
class VertexProgram:
    init: Callable[[int], Mapping[str, Column]]
    update: Callable[[Step], Mapping[str, Column]]
    message: Expression
    combine: Callable[[Column], Column] = F.sum
    sends: Expression = lambda step: F.lit(True)
    halt: Expression = lambda step: F.lit(False)
    aggregates: Mapping[str, Expression] = field(default_factory=dict)
    force_terminate: Expression = lambda step: F.lit(False)
    wake_all: Expression = lambda step: F.lit(False)
    initially_active: Column | None = None
    checkpointable: Callable[[int], bool] = lambda step: True
    folds: Mapping[str, Fold] = field(default_factory=dict)
    name: str = ""
