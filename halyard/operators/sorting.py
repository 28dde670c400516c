"""Distributed sort with global order numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.functions import sampled
from halyard.plans.storage import checkpointed


def splitters(df: DataFrame, key: str, parts: int, rate: float = 0.01, seed: int = 1) -> DataFrame:
    """(part, key): the lower ends of ``parts`` ranges of about equal size, from a uniform sample of the keys.

    Quantiles of the sample are merged as sketches, so no task sorts it.
    """
    some = df.where(sampled(rate, seed, key))
    at = [k / parts for k in range(1, parts)]
    cut = some.agg(F.percentile_approx(key, at, 10_000).alias("cuts"))
    return cut.select(F.posexplode("cuts").alias("part", key)).select((F.col("part") + 1).alias("part"), key)


def sort_records(df: DataFrame, *keys: Column | str, parts: int | None = None) -> DataFrame:
    """Range-partitioned by sampled splitters and sorted within partitions: partition order is the global order."""
    parts = parts or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)


def number_records(df: DataFrame, *keys: Column | str, name: str = "ord", parts: int | None = None) -> DataFrame:
    """``df`` with each row's 0-based place in the order of ``keys``, without a single-task window.

    A partition's first number is the sum of the sizes before it; only a row for each partition reaches the driver.
    The order is repeatable where the keys are unique.
    """
    placed = checkpointed(sort_records(df, *keys, parts=parts).withColumn("__at", F.monotonically_increasing_id()))
    part, within = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    starts, total = [], 0
    for p in sorted(sizes):
        starts.append((p, total))
        total += sizes[p]
    if not starts:
        return placed.withColumn(name, F.lit(0).cast("long")).drop("__at")
    first = df.sparkSession.createDataFrame(starts, "__p long, __first long")  # a row for each partition
    out = placed.withColumn("__p", part).join(F.broadcast(first), "__p")
    return out.withColumn(name, F.col("__first") + within).drop("__p", "__first", "__at")
