"""The funnel over a stream of postings: every micro-batch is triaged against the state of all before it.

A batch's verdicts go to a directory named by its id, then one delta to the state, under that id. A batch reads the events
of its own ids only and writes what it brings, so its cost follows the batch. One that is repeated after a failure writes
its directory again, from the same state, unless its delta is there: then only the offset was lost and it is left alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from winnow.operators import funnel_ops
from winnow.operators.log import SeenLog
from winnow.plans import funnel
from winnow.plans.rules import RulePack


def run(postings: DataFrame, pack: RulePack, seen: SeenLog, out: str, checkpoint: str, name: str = "stream") -> StreamingQuery:
    """Start a run over all that is there (availableNow); rows of `out` carry the batch id as partition."""
    version = pack.fingerprint()

    def one(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if seen.done(name) >= batch_id:
            return

        def written(df: DataFrame) -> DataFrame:
            df.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
            return spark.read.schema(df.schema).parquet(f"{out}/batch={batch_id}")

        # Of rows that repeat an id, the first by all that a gate reads; equal ones are one.
        first = funnel_ops.keep_first(batch, F.col("id"), ["title", "company", "description", "url"]).dropDuplicates(["id"])
        stages = funnel.triage(first, seen.read(batch.select("id")), pack, written)
        kept = stages.best.where("passed_gate and recommend")
        seen.mark(kept, stages.rejected, version, F.current_timestamp(), (name, batch_id))

    return postings.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
