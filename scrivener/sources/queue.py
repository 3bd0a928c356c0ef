"""A durable queue of work: tasks are tried in rounds until each is done or has failed often enough.

A round takes the tasks that are waiting and due, works on them in one Spark job, and commits what came
of all of them at once by renaming one folder, so that a round that dies leaves nothing and is tried again: every
task is done once, or dead after `most` attempts. A failed task waits `2 ** attempts` rounds before it is due again
and goes behind the others. Spark's own retries are for lost executors; these are for work that answers badly.
Of two runners one commits a round, the other finds it taken and works on the next.

Tasks have a unique `task` and any other columns; nulls and repeats of a task are refused. The file system must
rename atomically. What the queue writes are rows; the driver sees counts alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import renamed

#: Attempts after which a task is dead.
MOST = 4


class Queue:
    """Tasks, done results and failures below `path`."""

    def __init__(self, spark: SparkSession, path: str, most: int = MOST):
        self.spark, self.path, self.most = spark, path, most

    def _fs(self):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        return hadoop, hadoop(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _rounds(self) -> list[int]:
        hadoop, fs = self._fs()
        return sorted(int(f.getPath().getName().removeprefix("round=")) for f in fs.globStatus(hadoop(f"{self.path}/rounds/round=*")) or [])

    def put(self, tasks: DataFrame) -> None:
        """The queue's tasks, once."""
        n, distinct = tasks.agg(F.count("*"), F.count_distinct("task")).first()
        if n != distinct:
            raise ValueError("every task needs a name of its own")
        tasks.write.mode("error").parquet(f"{self.path}/tasks")

    def tasks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/tasks")

    def outcomes(self) -> DataFrame | None:
        """(task, result, failure, round) of every attempt that was committed; None before the first."""
        rounds = self._rounds()
        return self.spark.read.option("basePath", f"{self.path}/rounds").parquet(*[f"{self.path}/rounds/round={r}" for r in rounds]) if rounds else None

    def waiting(self) -> DataFrame:
        """The tasks that are neither done nor dead, with `attempts` and the round they are `due` in."""
        found = self.outcomes()
        if found is None:
            return self.tasks().withColumns({"attempts": F.lit(0).cast("long"), "due": F.lit(0).cast("long")})
        tried = found.groupBy(F.col("task").alias("tried_")).agg(F.count("*").alias("attempts"), F.max("round").alias("last_"), F.max(F.col("failure").isNull()).alias("done_"))
        rows = self.tasks().join(tried, F.col("task") == F.col("tried_"), "left").filter(~F.coalesce("done_", F.lit(False)) & (F.coalesce("attempts", F.lit(0)) < self.most))
        due = F.coalesce(F.col("last_") + F.pow(F.lit(2), F.col("attempts")), F.lit(0)).cast("long")
        return rows.withColumns({"attempts": F.coalesce("attempts", F.lit(0)).cast("long"), "due": due}).drop("tried_", "last_", "done_")

    def step(self, work: Callable[[DataFrame], DataFrame]) -> int | None:
        """One round: `work` gives (task, result, failure) for rows of waiting tasks, with a null failure where
        it went well. The number of tasks that were due; None if another runner has committed the round."""
        number = max(self._rounds(), default=-1) + 1
        waiting = self.waiting()
        first = waiting.agg(F.min("due")).first()[0]
        if first is None:
            return 0
        # a pause in which nothing is due is over at once
        number = max(number, first)
        staged = f"{self.path}/staged-{uuid.uuid4().hex}"
        work(waiting.filter(F.col("due") <= number)).select("task", F.col("result").cast("string"), F.col("failure").cast("string")).write.parquet(staged)
        hadoop, fs = self._fs()
        fs.mkdirs(hadoop(f"{self.path}/rounds"))
        to = f"{self.path}/rounds/round={number}"
        return self.spark.read.parquet(to).count() if renamed(self.spark, staged, to) else None

    def run(self, work: Callable[[DataFrame], DataFrame]) -> int:
        """Rounds until no task is waiting; how many this runner committed."""
        rounds = 0
        while (n := self.step(work)) != 0:
            rounds += n is not None
        return rounds

    def done(self) -> DataFrame:
        """(task, result, attempts)."""
        found = self.outcomes()
        counts = found.groupBy("task").agg(F.max("result").alias("result"), F.count("*").alias("attempts"), F.max(F.col("failure").isNull()).alias("done"))
        return counts.filter("done").drop("done")

    def dead(self) -> DataFrame:
        """(task, failure, attempts): tasks that failed `most` times, with their last failure."""
        found = self.outcomes()
        counts = found.groupBy("task").agg(F.max_by("failure", "round").alias("failure"), F.count("*").alias("attempts"), F.max(F.col("failure").isNull()).alias("done"))
        return counts.filter(~F.col("done") & (F.col("attempts") >= self.most)).drop("done")
