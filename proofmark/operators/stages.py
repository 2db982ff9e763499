"""Stages of a run: each is worked out once into a table, timed, and counted while it is written.

A stored stage is a barrier: filters of later stages don't enter the expressions
of earlier ones, several readers share one computation, and a lost executor costs
tasks of one stage rather than the whole plan.  Counts come from metrics that
are observed in the writing tasks themselves, so they take no pass of their own.
"""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

TIMINGS = "place int, stage string, elapsed_ms double, n_rows long, metrics map<string,double>"


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one of our own only for a local master without that setting."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='proofmark-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path


class Stages:
    """The stages of one run, in the order in which they are stored; as a context it deletes their tables at its end, but for those kept."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.root = f"{folder or shared_folder(spark)}/run-{uuid.uuid4().hex}"
        self.done: list[tuple[int, str, float, int, dict[str, float]]] = []
        self.kept: set[str] = set()

    def __enter__(self) -> Stages:
        return self

    def __exit__(self, *_: object) -> None:
        for name in {stage for _, stage, *_ in self.done} - self.kept:
            self.forget(name)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def store(self, name: str, df: DataFrame, keep: bool = False, **metrics: Column) -> DataFrame:
        """Writes a stage and reads it back.

        ``metrics`` are numeric aggregates by name, observed while it is written.  The
        last operator of the plan that is written counts, so a task that runs again
        counts once.  ``keep`` leaves the table to those who read the result later.
        """
        if any(stage == name for _, stage, *_ in self.done):
            raise ValueError(f"the run has a stage {name} already")
        seen = Observation(f"{name}-{uuid.uuid4().hex}")
        watched = df.observe(seen, F.count(F.lit(1)).alias("n_rows"), *(m.cast("double").alias(k) for k, m in metrics.items()))
        began = time.perf_counter()
        watched.write.parquet(self.path(name))
        elapsed = 1000 * (time.perf_counter() - began)
        got = dict(seen.get)
        self.done.append((len(self.done), name, elapsed, got.pop("n_rows"), got))
        if keep:
            self.kept.add(name)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def timings(self) -> DataFrame:
        """One row per stage: its place, the milliseconds that it took, its rows and other metrics."""
        return self.spark.createDataFrame(self.done, TIMINGS)

    def overall_ms(self) -> float:
        return sum(elapsed for _, _, elapsed, *_ in self.done)

    def forget(self, name: str) -> None:
        """Deletes a stage's table, which no later plan reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
