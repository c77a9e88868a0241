"""Hits by the index against the terms unrolled in the plan."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from winnow.functions import terms as tm
from winnow.operators import catalog

ODD = [
    "c++", ".net", "node.js", "full-stack", "full-*", "re*", "a b", "the cat", "b c d", " lead ", "café", "na", "é", "++", "-x", "#cv", "e-mail", "x.y*", "of the", "lorem ipsum dolor", "ops.", ".a.",
    "п", "опыт*", "c#", "*", "", "re*", "team lead", "1", "10 years", "(us)", "a-", "-", "$", "one", "on*",
]
PIECES = ["c++", ".net", "node.js", "full-stack", "full", "stack", "re", "rest", "a", "b", "c", "d", "the", "cat", "bathe", "cats", "café", "cafés", "naïve", "-x", "#cv", "e-mail", "x.y", "x.yz", "of", "lorem", "ipsum", "dolor", "ops", ".", "опыта", "c#", "team", "leader", "1", "10", "years", "(us)", "a-b", "-", "$", "one", "onto", "_one", "one_"]


def test_hits_equal_the_unrolled_form(spark):
    rng = np.random.default_rng(11)
    texts = ["".join(f"{p}{rng.choice([' ', ' ', '', '\n', ', '])}" for p in rng.choice(PIECES, rng.integers(0, 14))).lower() for _ in range(400)] + ["", None]
    texts += [form.format(t.rstrip("*")) for t in ODD for form in ("x {} y", "x{}y", "{}y", "x {}", "é{}")]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    listed = spark.createDataFrame([(t, i) for i, t in enumerate(ODD)], "term string, ord int")
    found = {r.id: r.hits for r in catalog.hits(rows, listed).collect()}
    terms = [t for t in dict.fromkeys(ODD) if t not in ("", "*")]
    plain = {r.id: r.h for r in rows.select("id", tm.hits(F.coalesce("text", F.lit("")), terms).alias("h")).collect()}
    assert found == plain and {t for h in plain.values() for t in h} == set(terms)


def test_large_index_is_shuffled(spark, monkeypatch):
    monkeypatch.setattr(catalog, "SMALL", 10)
    rows = spark.range(50).select("id", F.concat(F.lit("word"), "id", F.lit(" and more")).alias("text"))
    listed = spark.range(5000).select(F.concat(F.lit("word"), "id").alias("term"), F.col("id").cast("int").alias("ord"))
    plan = catalog.hits(rows, listed)
    assert all(r.hits == [f"word{r.id}"] for r in plan.collect()) and catalog.hits(rows.where("false"), listed).count() == 0


def test_a_small_index_shuffles_no_text(spark):
    """Texts of which none, one or thousands of words meet the index stay in their tasks, in batches of any size."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = spark.range(600).select("id", F.when(F.col("id") % 3 > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.col("id") % 97), lambda i: F.concat(F.lit("w"), i.cast("string"))), " ")).alias("text"))
        listed = spark.range(97).select(F.explode(F.array(F.concat(F.lit("w"), "id"), F.concat(F.lit("w"), "id", F.lit(" w"), F.col("id") + 1))).alias("term"), F.col("id").cast("int").alias("ord"))
        plan = catalog.hits(rows, listed)
        assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
        got = {r.id: r.hits for r in plan.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = lambda i: [t for k in range(i % 97 + 1) for t in (f"w{k}", f"w{k} w{k + 1}") if k < i % 97 or " " not in t]
    assert got == {i: want(i) if i % 3 else [] for i in range(600)}


def test_texts_are_scanned_whole(spark):
    """Each text was cut into words, and every phrase of which one word was met was verified by itself."""
    rows = spark.createDataFrame([(1, "one of the two"), (2, None), (3, "of the")], "id int, text string")
    listed = spark.createDataFrame([("of the", 1), ("the two", 0), ("on", 2), ("on*", 3)], "term string, ord int")
    plan = catalog.hits(rows, listed)
    assert "regexp" not in plan._jdf.queryExecution().optimizedPlan().toString()
    assert {r.id: r.hits for r in plan.collect()} == {1: ["the two", "of the", "on*"], 2: [], 3: ["of the"]}


def test_parts_of_texts(spark, monkeypatch):
    """Texts longer than a part, empty ones and many in a part."""
    monkeypatch.setattr(catalog, "BYTES", 40)
    monkeypatch.setattr(catalog, "TEXTS", 3)
    texts = ["", "x" * 39 + " the cat", "the cat", "", "cat" * 30, "th", "e cat", "the c", "at", None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    listed = spark.createDataFrame([("the cat", 0), ("cat", 1)], "term string, ord int")
    assert [r.hits for r in catalog.hits(rows, listed).orderBy("id").collect()] == [[], ["the cat", "cat"], ["the cat", "cat"], [], [], [], ["cat"], [], [], [], []]
