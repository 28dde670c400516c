"""Vertex programs in pandas, for updates that no column expression can state.

State and inbox meet in buckets of ids, as many as make some ``BUCKET_ROWS`` rows of both a bucket, so that one Python
call handles many vertices and its frames stay bounded however many there are. Messages should be combined before
wherever a hot vertex gets more than a bucket's rows.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.plans.storage import checkpointed

BUCKET_ROWS = 50_000


def pandas_step(state: DataFrame, inbox: DataFrame, fn: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, buckets: int | None = None) -> DataFrame:
    """``fn(vertices, messages)`` for each bucket of ``state`` (id, ...) and ``inbox`` (dst, ...)."""
    if buckets is None:
        state, inbox = checkpointed(state), checkpointed(inbox)
        buckets = max(1, -(-(state.count() + inbox.count()) // BUCKET_ROWS))
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(buckets)).alias("bucket")
    left, right = state.select("*", bucket("id")).groupBy("bucket"), inbox.select("*", bucket("dst")).groupBy("bucket")
    return left.cogroup(right).applyInPandas(lambda a, b: fn(a.drop(columns="bucket"), b.drop(columns="bucket")), schema)


def scatter(edges: DataFrame, state: DataFrame, message, columns: list[str]) -> DataFrame:
    """(dst, *columns): one message along each edge; a vertex sends none to many."""
    return edges.join(state, F.col("src") == F.col("id")).select("dst", *[c.alias(n) for c, n in zip(message, columns, strict=True)])


def inboxes(messages: DataFrame, column: str) -> DataFrame:
    """(dst, msgs, n): every destination's messages, sorted."""
    return messages.groupBy("dst").agg(F.sort_array(F.collect_list(column)).alias("msgs"), F.count("*").alias("n"))
