"""The delta log against SQL over all its events, and what it writes."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tests.conftest import rows_of
from winnow.operators.log import CacheLog, SeenLog

SEEN_SQL = """
WITH e AS (SELECT *, max(seq) FILTER (WHERE op = 'drop') OVER (PARTITION BY id) AS since FROM events),
live AS (SELECT * FROM e WHERE op <> 'drop' AND (since IS NULL OR seq > since))
SELECT id, arg_min(source, seq) AS source, arg_max(seq, {'final': op = 'verdict', 'seq': seq}) AS at,
  CASE WHEN bool_or(op = 'verdict') THEN 'final' ELSE arg_max(version, seq) END AS version
FROM live GROUP BY id
"""


def test_seen_log_equals_sql_over_all_events(spark, tmp_path):
    """Verdicts, rejections and drops over many commits; merged in tiers on the way."""
    log, rng, events = SeenLog(spark, f"file://{tmp_path}/seen", buckets=4), np.random.default_rng(3), []
    for seq in range(1, 25):
        ids = [f"i{k}" for k in sorted(set(rng.integers(0, 60, 20).tolist()))]
        if seq % 7 == 0:
            log.forget(spark.createDataFrame([(i,) for i in ids], "id string"))
            events += [(seq, i, "drop", None, None) for i in ids]
        else:
            rows = spark.createDataFrame([(i, f"s{seq}", "t", "u") for i in ids], "id string, source string, title string, url string")
            split = F.substring("id", 2, 9).cast("int") % 3 == seq % 3
            assert log.mark(rows.where(split), rows.where(~split), f"v{seq % 2}", F.timestamp_seconds(F.lit(seq)), ("batch", seq))
            assert not log.mark(rows, None, "v", F.timestamp_seconds(F.lit(99)), ("batch", seq))  # repeated after a failure
            events += [(seq, i, "verdict" if int(i[1:]) % 3 == seq % 3 else "reject", f"s{seq}", f"v{seq % 2}") for i in ids]
        if seq % 4 == 0:
            con = duckdb.connect()
            con.register("events", pd.DataFrame(events, columns=["seq", "id", "op", "source", "version"]))
            found = log.read().select("id", "source", F.unix_seconds("seen_at").alias("at"), F.coalesce("prefilter_version", F.lit("final")).alias("version"))
            assert rows_of(found.toPandas()) == rows_of(con.execute(SEEN_SQL).df())
            some = found.where("id < 'i3'").select("id")
            assert log.read(some).count() == some.count()
    assert log.done("batch") == 24 and max(map(len, log.pieces().values())) <= 9


def test_a_commit_writes_what_it_brings(spark, tmp_path):
    """Bytes of a small commit don't follow the table; merging costs a bounded number of rewrites of a row."""
    log = CacheLog(spark, f"file://{tmp_path}/cache", buckets=4)
    rows = lambda lo, n: spark.range(lo, lo + n).select(F.sha2(F.col("id").cast("string"), 256).alias("job_id"), F.col("id").cast("int").alias("score"), F.lit("v").alias("scoring_version"))
    log.append(rows(0, 40_000))
    first = sum(log.commits()[0]["bytes"].values())
    written = 0
    for k in range(30):
        log.append(rows(40_000 + 50 * k, 50))
        c = [c for c in log.commits() if c["seq"] > 1]
        written = max(written, *(sum(x["bytes"].values()) for x in c))
    assert written < first / 8  # no commit and no merge came near the size of the table
    assert log.read().count() == 41_500 and log.read().where("score >= 40000").count() == 1_500
    assert len(log.commits()) < 20  # replaced ones are gone
    log.append(rows(0, 10).withColumn("score", F.lit(-1)))
    assert log.read(rows(0, 20).select("job_id")).where("score = -1").count() == 10


def test_empty_log(spark, tmp_path):
    log = SeenLog(spark, f"file://{tmp_path}/none")
    assert log.read().count() == 0 and log.compact() == 0 and log.done("x") == -1
    rows = spark.createDataFrame([], "id string, source string, title string, url string")
    log.mark(rows, rows, "v", F.current_timestamp(), ("x", 0))
    assert log.read().count() == 0 and log.done("x") == 0
