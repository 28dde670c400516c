"""What the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.plans.storage import checkpoint_dir, checkpointed, scratch

__all__ = ["checkpoint_dir", "checkpointed", "scratch"]

#: A word: a run of anything but ASCII white space (Java, RE2 and Python read it alike).
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"


#: Rows of one or two numbers that a broadcast may hold; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000
#: Texts that a task of 3 and 8 reads and sends to Python at a time. Spark's 4096 and 10,000 bound rows, not bytes, and long texts fill
#: an executor with them.
TEXT_ROWS = 64


def sized(df: DataFrame) -> DataFrame:
    """``df``, which should be checkpointed and narrow, marked for broadcasting if a count shows that it is small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def kept_table(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: for wide rows of which later steps read parts."""
    path = scratch(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def rows_at_once(spark: SparkSession, rows: int = TEXT_ROWS) -> Iterator[None]:
    """Within it, what runs reads Parquet and sends rows to Python ``rows`` at a time, so that an executor holds so many for
    each task, however wide they are."""
    names = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"
    before = [spark.conf.get(name) for name in names]
    for name in names:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        for name, value in zip(names, before, strict=True):
            spark.conf.set(name, value)


def whole_text(text: str | Column = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def uniform(*key: Column | int | str) -> Column:
    """A number in [0, 1) that follows from ``key`` alone."""
    parts = [k if isinstance(k, Column) else F.lit(k) for k in key]
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 53)) / F.lit(float(1 << 53))).cast("double")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def same(a: DataFrame, b: DataFrame, columns: list[str]) -> Column:
    """Null-safe equality of two frames' columns."""
    return reduce(lambda x, y: x & y, (a[c].eqNullSafe(b[c]) for c in columns))
