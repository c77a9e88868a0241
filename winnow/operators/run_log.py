"""The log of a run: steps that are done once, and batches scored in waves of which each is committed.

A step is a folder of a run's log; Spark's own mark of a written folder says that it is complete. A run that is started
again reads complete steps and repeats the others, torn ones included. A wave of batches is two steps: its first batch
alone, then all others at once. So a provider that is out is met by one request of a wave and left out by the rest, and
by all waves after it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.operators import funnel_ops
from winnow.operators.funnel_ops import Provider
from winnow.operators.log import Files


class Steps:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.files = spark, Files(spark, path)

    def complete(self, name: str) -> bool:
        return self.files.exists(f"{name}/_SUCCESS")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.files.path}/{name}")

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """What make() gives, written; or, if that was complete before, read."""
        if not self.complete(name):
            make().write.mode("overwrite").parquet(f"{self.files.path}/{name}")
        return self.read(name)

    def all(self, prefix: str) -> DataFrame | None:
        """The complete steps of that prefix in one."""
        names = [n for n in self.files.names() if n.startswith(prefix) and self.complete(n)]
        return reduce(DataFrame.unionByName, map(self.read, names)) if names else None


def in_waves(
    steps: Steps, batches: DataFrame, providers: Sequence[Provider], wave: int = 256, parallel: int = 8, wait: float = 20.0, sleep: Callable[[float], None] = time.sleep
) -> Iterator[tuple[int, DataFrame]]:
    """(number of the step, answers of its batches), as they are committed. batches: rows by a dense `batch` from 0."""
    total = batches.agg(F.max("batch")).first()[0]
    dead: set[str] = set()
    for first in range(0, 0 if total is None else total + 1, wave):
        for half, lo, hi in ((0, first, first), (1, first + 1, min(first + wave - 1, total))):
            if hi < lo:
                continue
            number = 2 * (first // wave) + half
            mine = batches.where(F.col("batch").between(lo, hi)).repartition(min(parallel, hi - lo + 1), "batch")
            known = tuple(sorted(dead))
            answered = steps.once(f"answers-{number:06d}", lambda: funnel_ops.scored_by(mine, providers, known, wait, sleep).withColumn("saved_at", F.current_timestamp()))  # noqa: B023
            dead |= {r.p for r in answered.select(F.explode("dead").alias("p")).distinct().collect()}
            yield number, answered


MATCHES = ("job_id", "score", "why_fits", "watch_out", "recommendation", "batch", "saved_at")


def matches(answered: DataFrame) -> DataFrame:
    """What answers say: a row per posting and answer, with the batch and when it was saved."""
    items = answered.where("answer is not null").select("batch", "saved_at", F.explode(funnel_ops.decode_response(F.col("answer"))).alias("x"))
    return items.select(F.col("x.id").alias("job_id"), F.col("x.score").cast("int").alias("score"), "x.why_fits", "x.watch_out", "x.recommendation", "batch", "saved_at")


def checkpoints(answered: DataFrame, total: int) -> DataFrame:
    """A row per answered batch: its number from 1, of how many, how many answers it holds and when it was complete."""
    n = F.coalesce(F.size(funnel_ops.decode_response(F.col("answer"))), F.lit(0))
    return answered.where("answer is not null").select((F.col("batch") + 1).alias("batch"), F.lit(total).cast("long").alias("of"), n.cast("long").alias("count"), F.col("saved_at").alias("completed_at"))
