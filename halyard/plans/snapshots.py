"""Snapshots that a run can be resumed from.

A light one holds the state alone: messages are made again from it. A heavy one also holds the pending messages. With
``log`` the state of every step between snapshots is kept as well, so that a run resumes from the last step; a snapshot
prunes the log. Data are written first, to a folder that no other save uses, and the manifest last, as one file that is
renamed into place: its presence commits the snapshot. What was committed before is deleted after that, and only that.
Saves run beside the next superstep; the loop waits for one only where it needs it done. Manifests say which program and graph they belong to; a folder with another's is refused. All paths go through Hadoop's
file systems, so the folder may be in any store that Spark writes to.
"""

from __future__ import annotations

import json
import time
import uuid
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from halyard.plans.program import Step


@dataclass
class Loaded:
    step: int
    num_vertices: int
    agg: dict
    wake: bool
    steps: list[dict]
    state: DataFrame
    inbox: DataFrame | None
    snapshot: int


class Snapshots:
    def __init__(self, path: str, interval: int = 100_000, heavy: bool = False, log: bool = False):
        self.path, self.interval, self.heavy, self.log = path.rstrip("/"), interval, heavy, log
        self.write_seconds: list[float] = []
        self.waited = 0.0
        self._pending: Future | None = None
        self.identity: dict | None = None
        self.last = 0

    def _store(self, spark: SparkSession):
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _manifests(self, spark: SparkSession) -> list[str]:
        """Names of committed saves, oldest first: step, time, and a number of their own."""
        jvm, store = self._store(spark)
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        names = [f.getPath().getName() for f in store.listStatus(folder)] if store.exists(folder) else []
        found = [n[9:-5] for n in names if n.startswith("manifest-") and n.endswith(".json")]
        return sorted(found, key=lambda n: int(n.split("-")[1]))

    def committed(self, spark: SparkSession) -> list[int]:
        return sorted(int(n.split("-")[0]) for n in self._manifests(spark))

    def _read(self, spark: SparkSession, name: str) -> dict:
        return json.loads("".join(r[0] for r in spark.read.text(f"{self.path}/manifest-{name}.json", wholetext=True).collect()))

    def check(self, spark: SparkSession) -> None:
        """Raise if the folder has another program's or graph's snapshots."""
        for name in self._manifests(spark)[-1:]:
            if self.identity != (theirs := self._read(spark, name)["identity"]):
                raise ValueError(f"{self.path} has snapshots of another run: {theirs}")

    def begin(self, step: Step, state: DataFrame, inbox: DataFrame | None, steps: list[dict], wake: bool, log: bool = False) -> None:
        """``save`` beside what the caller does next."""
        self.wait()
        pool = ThreadPoolExecutor(1)
        self._pending = pool.submit(self.save, step, state, inbox, list(steps), wake, log)
        pool.shutdown(wait=False)

    def wait(self) -> None:
        """Until the save that was begun is committed; its error is raised here."""
        pending, self._pending, began = self._pending, None, time.time()
        if pending:
            pending.result()
            self.waited += time.time() - began

    def save(self, step: Step, state: DataFrame, inbox: DataFrame | None, steps: list[dict], wake: bool, log: bool = False) -> DataFrame:
        """Write and commit; the state as it was written. What was there before goes, but for the log's entries."""
        began, spark = time.time(), state.sparkSession
        before = [] if log else self._manifests(spark)
        self.last = self.last if log else step.number
        name = f"{step.number}-{time.time_ns()}-{uuid.uuid4().hex[:12]}"
        place = f"{self.path}/step={name}"
        state.write.parquet(f"{place}/state")
        if heavy := self.heavy and inbox is not None and not log:
            inbox.write.parquet(f"{place}/inbox")
        schemas = {"state": state.schema.json()} | ({"inbox": inbox.schema.json()} if heavy else {})
        manifest = {"step": step.number, "num_vertices": step.num_vertices, "agg": dict(step.agg), "wake": wake, "steps": steps, "snapshot": self.last, "schemas": schemas, "identity": self.identity}
        jvm, store = self._store(spark)
        part, final = (jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}") for n in (f"part-{name}", f"manifest-{name}.json"))
        out = store.create(part, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not store.rename(part, final):
            raise OSError(f"{final.toString()} could not be committed")
        for old in before:
            store.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest-{old}.json"), False)
            store.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/step={old}"), True)
        self.write_seconds.append(time.time() - began)
        return spark.read.schema(state.schema).parquet(f"{place}/state")

    def load(self, spark: SparkSession) -> Loaded | None:
        """The save that was committed last."""
        from pyspark.sql.types import StructType

        names = self._manifests(spark)
        if not names:
            return None
        m = self._read(spark, names[-1])
        read = lambda part: spark.read.schema(StructType.fromJson(json.loads(m["schemas"][part]))).parquet(f"{self.path}/step={names[-1]}/{part}")
        self.last = m["snapshot"]
        return Loaded(m["step"], m["num_vertices"], m["agg"], m["wake"], m["steps"], read("state"), read("inbox") if "inbox" in m["schemas"] else None, m["snapshot"])
