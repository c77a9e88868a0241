"""Funnel reports: aggregations over one verdict table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def per_source(postings: DataFrame) -> DataFrame:
    return postings.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.trim(F.coalesce("description", F.lit(""))) == "").alias("empty")).orderBy(F.desc("n"), "source")


def reason_sets(verdicts: DataFrame) -> DataFrame:
    """Postings that fail for every role, counted by the sorted set of their first reasons."""
    each = verdicts.groupBy("id").agg(F.max("passed_gate").alias("any"), F.array_join(F.array_sort(F.collect_set(F.get("reasons", F.lit(0)))), " | ").alias("reason"))
    return each.where(~F.col("any")).groupBy("reason").agg(F.count("*").alias("n"))


def most_common(counted: DataFrame, key: str, n: int = 12) -> DataFrame:
    """The n largest counts, smaller keys first among equals."""
    return counted.orderBy(F.desc("n"), key).limit(n)


def spread(best: DataFrame) -> DataFrame:
    return best.agg(F.min("score").alias("least"), F.median("score").alias("median"), F.max("score").alias("most"))


def cutoffs(best: DataFrame, levels: tuple[int, ...] = (55, 50, 45, 40)) -> DataFrame:
    return best.agg(*[F.count_if(F.col("score") >= x).alias(f"at_least_{x}") for x in levels])


def deciles(best: DataFrame) -> DataFrame:
    lo = (F.floor(F.col("score") / 10) * 10).cast("int")
    return best.groupBy(F.format_string("%02d-%02d", lo, lo + 9).alias("band")).agg(F.count("*").alias("n"))


def totals(best: DataFrame) -> DataFrame:
    return best.agg(F.count("*").alias("total"), F.count_if("passed_gate").alias("passed"), F.count_if("recommend").alias("recommended"))


def active_sources(postings: DataFrame) -> DataFrame:
    return postings.select("source").distinct()


def saturated(rows: DataFrame, query: str, cap: int = 20) -> DataFrame:
    """Queries whose first page is full and that are worth a second pass."""
    return rows.groupBy(query).agg(F.count("*").alias("n")).where(F.col("n") >= cap)


def checkpoints(batched: DataFrame) -> DataFrame:
    return batched.groupBy("batch").agg(F.count("*").alias("n"))


def digest(items: DataFrame, now, days: int = 7, n: int = 8) -> DataFrame:
    """Items (when, feed, title, link) of the last days or without a date, one per link, newest first."""
    fresh = items.where(F.col("when").isNull() | (F.col("when") >= now - F.make_dt_interval(F.lit(days))))
    # struct order puts a null date first; its maximum is the newest dated row
    one = fresh.groupBy("link").agg(F.max(F.struct("when", "feed", "title")).alias("x")).select("x.*", "link")
    return one.orderBy(F.desc_nulls_last("when"), "link").limit(n)


# --- one scan for all reports of a verdict table ---

#: Scores are whole numbers from 0 to 100.
SCORES = 101


KEYS = ("source", "passed_gate", "recommend", "score")


def summary(best: DataFrame) -> DataFrame:
    """Best verdicts -> a small table of counts by source, passed, recommended and score: one combining aggregate, after
    which every report reads at most sources x 2 x SCORES rows. Tables of this form can be added up."""
    return best.groupBy(*KEYS).agg(F.count("*").alias("n"))


def merged(*summaries: DataFrame) -> DataFrame:
    """One summary of several, of runs or days."""
    rows = reduce(DataFrame.unionByName, summaries)
    return rows.groupBy(*KEYS).agg(F.sum("n").alias("n"))


def histogram(counts: Column) -> Column:
    """The counts of the scores from 0 on, as an array, from a map of those that occur."""
    return F.transform(F.sequence(F.lit(0), F.lit(SCORES - 1)), lambda s: F.coalesce(F.try_element_at(counts, s), F.lit(0).cast("long")))


def told(summed: DataFrame, levels: tuple[int, ...] = (55, 50, 45, 40)) -> DataFrame:
    """One row of all reports: totals, exact least, median and most of the passed, cutoffs and counts by ten."""
    n, passed = F.col("n"), F.col("passed_gate")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("long"))
    each = summed.groupBy("score").agg(F.sum("n").alias("a"), total(F.when(passed, n)).alias("p"), total(F.when(F.col("recommend"), n)).alias("r"))
    by_score = lambda c: F.map_from_entries(F.collect_list(F.struct("score", c)))  # noqa: E731  at most SCORES of them
    sums = each.agg(by_score("a").alias("a_of"), by_score("p").alias("p_of"), total("a").alias("total"), total("p").alias("passed"), total("r").alias("recommended"))
    sums = sums.withColumns({"all": histogram(F.col("a_of")), "h": histogram(F.col("p_of"))})
    # Scores come after one another: the k-th lowest is the first score whose running count reaches k.
    upto = F.transform(F.sequence(F.lit(1), F.lit(SCORES)), lambda i: F.aggregate(F.slice("h", F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + x))
    rows = sums.withColumn("_upto", upto)
    nth = lambda k: F.array_position(F.transform("_upto", lambda x: x >= k), True) - 1
    some = F.col("passed") > 0
    low, high = nth(F.floor((F.col("passed") + 1) / 2)), nth(F.floor((F.col("passed") + 2) / 2))
    above = lambda x: F.aggregate(F.slice("all", x + 1, SCORES), F.lit(0).cast("long"), lambda a, y: a + y)
    band = lambda lo: F.aggregate(F.slice("all", lo + 1, 10), F.lit(0).cast("long"), lambda a, y: a + y)
    return rows.select(
        "total", "passed", "recommended", F.when(some, nth(F.lit(1))).cast("int").alias("least"), F.when(some, (low + high) / 2).alias("median"), F.when(some, nth(F.col("passed"))).cast("int").alias("most"),
        *[above(x).alias(f"at_least_{x}") for x in levels], F.array(*[band(lo) for lo in range(0, SCORES, 10)]).alias("by_ten"),
    )


def observed(best: DataFrame, name: str = "funnel") -> tuple[DataFrame, Observation]:
    """The table with counters that are filled by whatever writes it, without a scan of their own."""
    o = Observation(name)
    seen = best.observe(o, F.count(F.lit(1)).alias("total"), F.count_if("passed_gate").alias("passed"), F.count_if("recommend").alias("recommended"), F.max("score").alias("most"))
    return seen, o
