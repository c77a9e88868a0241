"""Streams over several batches: state that grows by deltas, and state that expires."""

from __future__ import annotations

from pyspark.sql import functions as F

from winnow import queries as q
from winnow.operators.log import SeenLog
from winnow.schema import conform
from winnow.streaming import expiring, funnel_stream


def test_funnel_stream_over_batches_gives_the_batch(spark, sf, tmp_path):
    """Six files, one a batch, with ids that come again: verdicts are those of one batch, each id is judged once."""
    rows = conform(q.postings(spark, sf).where("id < 60").withColumn("n", F.col("id").cast("int") % 6))
    for k in range(6):
        again = F.col("id").cast("int") % 6 <= k
        rows.where(again).coalesce(1).write.parquet(f"file://{tmp_path}/in/{k}")

    def run():
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
        seen = SeenLog(spark, f"file://{tmp_path}/seen", buckets=2)
        funnel_stream.run(stream, q.PACK, seen, f"file://{tmp_path}/out", f"file://{tmp_path}/offsets").awaitTermination()
        return seen

    seen = run()
    cols = ("id", "role", "score", "passed_gate", "recommend")
    one = q.score.best(rows, q.PACK).select(*cols)
    out = spark.read.parquet(f"file://{tmp_path}/out").select(*cols)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, one.collect()))
    final = {r.id for r in seen.read().where("prefilter_version is null").collect()}
    assert final == {r.id for r in one.where("passed_gate and recommend").collect()} and seen.read().count() == one.count()
    commits = len(seen.commits())
    rows.where("id < 5").coalesce(1).write.parquet(f"file://{tmp_path}/in/7")
    assert len(run().commits()) == commits + 1 and spark.read.parquet(f"file://{tmp_path}/out").count() == one.count()


def test_expiring_state_is_bounded(spark, tmp_path):
    """Forty days of events, a file a day: no event of a key and day twice, and the state holds a few days only."""
    day = lambda d: spark.range(30).select(F.timestamp_seconds(F.lit(86400 * d) + F.col("id") * 2000).alias("ts"), (F.col("id") % 10).alias("user"))
    for d in range(40):
        day(d).coalesce(1).write.parquet(f"file://{tmp_path}/in/{d:02d}")
    schema = day(0).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
    query = expiring.run(rows, ["user"], "ts", f"file://{tmp_path}/out", f"file://{tmp_path}/offsets")
    query.awaitTermination()
    out = spark.read.parquet(f"file://{tmp_path}/out")
    assert out.count() == 400 == out.select("user", "span_start").distinct().count()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert len(held) > 30 and max(held) <= 50
