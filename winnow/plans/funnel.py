"""The funnel: sources -> unseen -> gates and scores -> collapse -> enrich and rescore -> batches -> scorer -> cards.

Everything up to the scorer is one lazy plan. A run writes what several consumers read as steps of its log and commits
state in two phases, as it goes: all unseen postings that aren't sent to the scorer are rejections under the pack's
fingerprint (gates, scores, near-duplicates, those that fail once their page is read); postings with a cached score, and
then all of each answered batch, have a final verdict, whatever the answer says about them. A batch without an answer is
left unmarked and comes up again. A run that is started again under its name goes on where it was stopped.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.functions import text as tx
from winnow.operators import funnel_ops, gates, run_log, score, state
from winnow.operators.funnel_ops import Provider
from winnow.operators.log import CacheLog, SeenLog
from winnow.plans.rules import RulePack
from winnow.schema import conform


@dataclass
class Stages:
    """DataFrames of one run; `unseen` and `best` are read by several consumers."""

    unseen: DataFrame
    best: DataFrame
    candidates: DataFrame
    rejected: DataFrame
    near_miss: DataFrame


def place(postings: DataFrame) -> Column:
    """Where a posting stands in the input: by `ordinal`, if it has that column, else by its id."""
    return F.col("ordinal") if "ordinal" in postings.columns else F.col("id")


def triage(postings: DataFrame, seen: DataFrame, pack: RulePack, materialise: Callable[[DataFrame], DataFrame] = lambda df: df) -> Stages:
    """From postings to candidates and rejections. materialise(df) may write df and read it back."""
    fresh = state.unseen(postings, seen, pack.fingerprint())
    best = materialise(score.best(fresh, pack))
    passed = best.where("passed_gate and recommend")
    candidates = funnel_ops.collapse(passed, [place(best), F.col("id")]).dropDuplicates(["id"])
    rejected = best.where("not (passed_gate and recommend)")
    return Stages(fresh, best, candidates, rejected, funnel_ops.near_misses(best))


def vacancy(url: Column) -> Column:
    return F.regexp_extract(url, r"/vacancy/(\d+)", 1)


def enrich(candidates: DataFrame, pages: DataFrame, pack: RulePack, source: str, most: int = 120) -> tuple[DataFrame, DataFrame]:
    """The first `most` candidates of one source get the full text of their page (url, text, and bytes if known) after
    their own description, which holds region and pay, and are judged again; the rest pass.

    Returns (those that still pass, statistics: attempted, enriched, failed, downloaded bytes, chars, rate, healthy)."""
    picked = candidates.where(F.col("source") == source).orderBy(place(candidates), "id").limit(most).withColumn("_n", F.nullif(vacancy(F.col("url")), F.lit("")))
    size = F.col("bytes") if "bytes" in pages.columns else F.octet_length("text")
    full = pages.select(vacancy(F.col("url")).alias("_n"), F.nullif(F.col("text"), F.lit("")).alias("_full"), size.cast("long").alias("_bytes")).where("_n <> ''")
    got = picked.join(full.groupBy("_n").agg(F.max("_full").alias("_full"), F.max("_bytes").alias("_bytes")), "_n", "left")
    both = tx.description(F.concat_ws("\n", F.col("description"), F.col("_full")))
    longer = got.withColumn("description", F.when(F.col("_full").isNotNull(), both).otherwise(F.col("description")))
    plain = [c for c in candidates.columns if c not in ("role", "ord", "passed_gate", "score", "recommend", "reasons")]
    again = score.best(longer.select(*plain), pack).where("passed_gate and recommend")
    untouched = candidates.join(picked.select("id"), "id", "left_anti")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    stats = got.agg(F.count("*").alias("attempted"), F.count("_full").alias("enriched"), total("_bytes").alias("downloaded"), total(F.length("_full")).alias("chars"))
    rate, healthy = funnel_ops.enrich_health(F.col("attempted"), F.col("enriched"))
    return untouched.select(*candidates.columns).unionByName(again.select(*candidates.columns)), stats.withColumns({"failed": F.col("attempted") - F.col("enriched"), "rate": rate, "healthy": healthy})


def batched(misses: DataFrame, size: int = 5) -> DataFrame:
    """Postings to score in dense batches, best first: id, record, score, batch."""
    record = tx.as_record(F.col("title"), F.col("company"), F.col("salary_min"), F.col("salary_max"), F.col("salary_currency"), F.col("location"), F.col("is_remote"), F.col("tags"), F.col("description"))
    record = F.concat(record, tx.schedule_note(gates.shift_mode(tx.normal(F.col("description")))))
    return funnel_ops.ranked_batches(misses.withColumn("record", record), size, [F.desc("score"), "id"]).select("id", "record", "score", "batch")


RESULT = ("id", "score", "why_fits", "watch_out", "recommendation")


def deliver(results: DataFrame, postings: DataFrame, threshold: int = 55) -> DataFrame:
    """Results over the threshold with their posting, near-duplicates collapsed once more, best first."""
    rows = results.where(F.col("score") >= threshold).join(postings.drop("score"), "id")
    return funnel_ops.collapse(rows, [-F.col("score"), F.col("id")]).orderBy(F.desc("score"), "origin", "id")


def counters(unseen: DataFrame, candidates: DataFrame, answered: DataFrame) -> DataFrame:
    """The run's counters as one row, with the cause of an empty result."""
    none = F.col("answer").isNull()
    a = answered.agg(
        F.count("*").alias("batches"), F.count_if(none).alias("failed_batches"), F.coalesce(F.sum(F.when(none, F.col("size"))), F.lit(0)).alias("unscored"),
        F.coalesce(F.max(F.size("dead") > 0), F.lit(False)).cast("int").alias("switched"), F.max_by("provider", F.when(~none, F.col("batch"))).alias("provider"),
    )
    row = unseen.agg(F.count("*").alias("unseen")).crossJoin(candidates.agg(F.count("*").alias("prefiltered"))).crossJoin(a)  # one row each
    return row.withColumn("cause", funnel_ops.zero_cause())


@dataclass
class Run:
    """What a run delivers: postings to send, its counters, the health of enrichment, and its log of matches and
    checkpoints."""

    delivered: DataFrame
    counters: DataFrame
    health: DataFrame
    matches: DataFrame
    checkpoints: DataFrame


def run(
    postings: DataFrame, pages: DataFrame, seen: SeenLog, cache: CacheLog, pack: RulePack, providers: Sequence[Provider], version: str, now: Column, log: str, name: str,
    threshold: int = 55, source: str = "hh.ru", size: int = 5, wave: int = 256, wait: float = 20.0, sleep: Callable[[float], None] = time.sleep,
) -> Run:
    """One run from postings to deliveries. log: a folder that all executors share; name: the run's; version: that of the
    scoring, for the cache. Scores go to the cache and verdicts to the state wave by wave."""
    spark = postings.sparkSession
    steps = run_log.Steps(spark, f"{log}/{name}")
    best = steps.once("best", lambda: triage(postings, seen.read(postings.select("id")), pack).best)
    passed = best.where("passed_gate and recommend")
    candidates = steps.once("candidates", lambda: funnel_ops.collapse(passed, [place(best), F.col("id")]).dropDuplicates(["id"]))
    still, health = enrich(candidates, pages, pack, source)
    sent, health = steps.once("sent", lambda: still), steps.once("health", lambda: health)
    seen.mark(None, best.join(sent.select("id"), "id", "left_anti"), pack.fingerprint(), now, (f"{name}/rejected", 0))

    hits = steps.once("hits", lambda: state.split_cached(sent.select("id"), cache.read(sent.select(F.col("id").alias("job_id"))), version)[0].select(*RESULT))
    seen.mark(sent.join(hits.select("id"), "id", "left_semi"), None, pack.fingerprint(), now, (f"{name}/cached", 0))
    batches = steps.once("batches", lambda: funnel_ops.grouped(batched(sent.join(hits.select("id"), "id", "left_anti"), size)))
    for number, answered in run_log.in_waves(steps, batches, providers, wave, spark.sparkContext.defaultParallelism, wait, sleep):
        told = run_log.matches(answered)
        cache.append(told.withColumns({"matched_at": now, "scoring_version": F.lit(version)}), (f"{name}/scores", number))
        done = answered.where("answer is not null").select(F.explode("ids").alias("id")).distinct()
        seen.mark(sent.join(done, "id", "left_semi"), None, pack.fingerprint(), now, (f"{name}/verdicts", number))

    answers = steps.all("answers-")
    if answers is None:
        answers = spark.createDataFrame([], funnel_ops.ANSWERS + ", saved_at timestamp")
    asked = answers.select("batch", F.explode("ids").alias("id"))
    told = run_log.matches(answers)
    fresh = told.withColumnRenamed("job_id", "id").join(asked, ["batch", "id"]).select(*RESULT).dropDuplicates(["id"])
    results = steps.once("results", lambda: funnel_ops.final_order(hits, fresh))
    delivered = steps.once("delivered", lambda: deliver(results, conform(sent), threshold))
    n = batches.count()
    return Run(delivered.orderBy(F.desc("score"), "origin", "id"), counters(best, candidates, answers), health, told, run_log.checkpoints(answers, n))
