"""Where intermediate results are kept, so that they outlive an executor."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. Where it is unset, a folder of our own in local
    mode; on a cluster that would scatter the data over its machines, so it is an error there."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="halyard-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder; its lineage ends there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def persisted(df: DataFrame) -> DataFrame:
    """``df`` marked for caching; lost blocks are computed again from its lineage."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def opaque(df: DataFrame) -> DataFrame:
    """``df``, which should be persisted, as a source of its own: plans built on it neither repeat its plan nor forget how
    it is partitioned and sorted. What ``checkpoint`` does after it has written; here the lineage stays."""
    spark = df.sparkSession
    execution = spark.sparkContext._jvm.org.apache.spark.sql
    source = getattr(getattr(execution.execution, "LogicalRDD$"), "MODULE$")
    plan = source.fromDataset(df._jdf.queryExecution().toRdd(), df._jdf, False)
    return DataFrame(execution.classic.Dataset.ofRows(spark._jsparkSession, plan), spark)


@contextmanager
def fixed_partitions(spark: SparkSession) -> Iterator[None]:
    """Exchanges keep their number of partitions, so that persisted data stay partitioned alike."""
    name = "spark.sql.adaptive.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Delete this application's part of the shared folder, once none of its results is needed any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(checkpoint_dir(spark))
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
