"""Keyed state: seen postings with versions, the score cache, the application tracker. Upserts of whole tables are joins;
the logs of log.py write deltas.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnow.schema import conform


def unseen(postings: DataFrame, seen: DataFrame, version: str | None = None, key: str = "id") -> DataFrame:
    """Postings without a final verdict (null version) or a rejection under this version; without a version, any
    row counts as seen. A left anti join: the state is projected to its key, so AQE may broadcast it if small."""
    held = seen if version is None else seen.where(F.col("prefilter_version").isNull() | (F.col("prefilter_version") == version))
    return postings.join(held.select(F.col("id").alias(key)).distinct(), key, "left_anti")


def _upsert(old: DataFrame, new: DataFrame, key: str, value) -> DataFrame:
    """Full outer join on the key; value(column) gives the merged column from o.* and n.*."""
    o, n = old.alias("o"), new.dropDuplicates([key]).alias("n")
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    return both.select(*[value(c).alias(c) for c in old.columns])


def _side(c: str, take_new: Column) -> Column:
    return F.when(take_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))


def mark_verdict(seen: DataFrame, postings: DataFrame, now: Column) -> DataFrame:
    """Final verdicts: inserted, or an earlier rejection upgraded; seen_at is refreshed, other columns keep."""
    new = conform(postings.withColumns({"seen_at": now, "prefilter_version": F.lit(None).cast("string")}), T.StructType(seen.schema.fields))
    fresh = F.col("n.id").isNotNull()

    def value(c: str) -> Column:
        return _side(c, fresh) if c in ("seen_at", "prefilter_version") else F.when(F.col("o.id").isNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))

    return _upsert(seen, new, "id", value)


def mark_rejected(seen: DataFrame, postings: DataFrame, version: str, now: Column) -> DataFrame:
    """Provisional rejections: inserted or refreshed, but a final verdict is never downgraded."""
    new = conform(postings.withColumns({"seen_at": now, "prefilter_version": F.lit(version)}), T.StructType(seen.schema.fields))
    final = F.col("o.id").isNotNull() & F.col("o.prefilter_version").isNull()

    def value(c: str) -> Column:
        if c in ("seen_at", "prefilter_version"):
            return _side(c, F.col("n.id").isNotNull() & ~final)
        return F.when(F.col("o.id").isNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))

    return _upsert(seen, new, "id", value)


def replace_rows(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Insert or replace by key: the new row wins."""
    return old.join(new.select(key), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def insert_absent(old: DataFrame, new: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The table with the rows whose key it lacked, and new with `inserted` saying which those were."""
    known = old.select(F.col(key).alias("_k")).distinct()
    told = new.dropDuplicates([key]).join(known, F.col(key) == F.col("_k"), "left").withColumn("inserted", F.col("_k").isNull()).drop("_k")
    return old.unionByName(told.where("inserted").select(*old.columns)), told


def requeue(seen: DataFrame, ids: DataFrame, apply: bool = False) -> tuple[DataFrame, DataFrame]:
    """Forget ids so that they come up again; a dry run by default. Also counts before, matched and after."""
    kept = seen.join(ids.select("id"), "id", "left_anti").select(*seen.columns)
    before = seen.agg(F.count("*").alias("before"))
    matched = seen.join(ids.select("id"), "id", "left_semi").agg(F.count("*").alias("matched"))
    counts = before.crossJoin(matched).withColumn("after", F.col("before") - (F.col("matched") if apply else F.lit(0)))  # one row each
    return (kept if apply else seen), counts


def split_cached(postings: DataFrame, cache: DataFrame, version: str | None = None, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(hits with the cached result, misses): a hit needs the scoring version, unless none is given."""
    valid = cache if version is None else cache.where(F.col("scoring_version") == version)
    hits = postings.join(valid.withColumnRenamed("job_id", key), key)
    return hits, postings.join(valid.select(F.col("job_id").alias(key)), key, "left_anti")


def applications_recent(applications: DataFrame, limit: int = 20) -> DataFrame:
    return applications.orderBy(F.desc("applied_at"), "job_id").limit(limit)


def application_stats(applications: DataFrame, now: Column, stale_days: int = 14) -> DataFrame:
    """total, last7 and stale (no answer for stale_days) from one scan."""
    at = F.col("applied_at")
    return applications.agg(
        F.count("*").alias("total"), F.count_if(at >= now - F.expr("INTERVAL 7 DAYS")).alias("last7"),
        F.count_if((F.col("status") == "applied") & (at < now - F.make_dt_interval(F.lit(stale_days)))).alias("stale"),
    ).withColumn("stale_days", F.lit(stale_days))
