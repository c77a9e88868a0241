"""Reports of one scan against the reports that scan the verdicts each."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from winnow.operators import reports


@pytest.mark.parametrize("n", [0, 1, 2, 3, 500])
def test_told_equals_the_single_reports(spark, n):
    rng = np.random.default_rng(n)
    rows = [(f"s{i % 3}", bool(p), bool(p and s > 40), int(s) if p else 0, ["no word"] if not p else ["+10 x"]) for i, (p, s) in enumerate(zip(rng.integers(0, 3, n) > 0, rng.integers(0, 101, n), strict=True))]
    best = spark.createDataFrame(rows, "source string, passed_gate boolean, recommend boolean, score int, reasons array<string>")
    got = reports.told(reports.summary(best)).first()
    s, c, t = reports.spread(best.where("passed_gate")).first(), reports.cutoffs(best).first(), reports.totals(best).first()
    assert (got.least, got.median, got.most) == (s.least, s.median, s.most)
    assert [got[f"at_least_{x}"] for x in (55, 50, 45, 40)] == list(c) and (got.total, got.passed, got.recommended) == tuple(t)
    assert {f"{10 * i:02d}-{10 * i + 9:02d}": x for i, x in enumerate(got.by_ten) if x} == {r.band: r.n for r in reports.deciles(best).collect()}
    halves = [reports.summary(best.where(F.col("source") == x)) for x in ("s0", "s1", "s2")]
    assert reports.told(reports.merged(*halves)).first() == got


def test_counters_come_with_the_write(spark, tmp_path):
    best = spark.range(100).select((F.col("id") % 3 == 0).alias("passed_gate"), (F.col("id") % 6 == 0).alias("recommend"), F.col("id").cast("int").alias("score"))
    seen, counters = reports.observed(best)
    seen.write.parquet(f"file://{tmp_path}/best")
    assert counters.get == {"total": 100, "passed": 34, "recommended": 17, "most": 99}


def test_numbered_rows_are_made_once(spark):
    """The sample for the ranges' bounds made all rows a first time."""
    from pyspark.sql import functions as F

    from winnow.tables import numbered

    made = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def key(x):
        made.add(1)
        return x * 7 % 11

    rows = numbered(spark.range(50).select("id", key("id").alias("k")), [F.desc("k"), "id"], "place").collect()
    assert made.value == 50
    assert [r.id for r in sorted(rows, key=lambda r: r.place)] == sorted(range(50), key=lambda x: (-(x * 7 % 11), x)) and sorted(r.place for r in rows) == list(range(1, 51))
