"""Every registered query of the engine against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows_of
from winnow import queries as q
from winnow.operators import funnel_ops


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_same_rows_as_sql(spark, sf, duck, name):
    ours, theirs = q.QUERIES[name](spark, sf).toPandas(), duck.execute(q.SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours) == rows_of(theirs)


def test_ranked_batches_take_every_row(spark):
    n = 100_007
    rows = spark.range(0, n, 1, 7).select((F.col("id") * 7919 % n).alias("id"), F.lit(1).alias("score"))
    got = funnel_ops.ranked_batches(rows, 5, [F.desc("score"), "id"])
    assert got.columns == ["id", "score", "batch"]
    assert got.count() == n and got.where(F.col("batch") != F.floor(F.col("id") / 5)).count() == 0
    assert funnel_ops.ranked_batches(rows.where("false"), 5, ["id"]).count() == 0


def test_stream_gives_what_the_batch_gives(spark, sf):
    assert q.QUERIES["stream_funnel"](spark, sf).select("id").distinct().count() == spark.read.parquet(f"{sf}/conversations.parquet").count()


def test_entry_and_guard(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
