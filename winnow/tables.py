"""Tables of a shared folder, sums over parts and numbering of rows in a total order."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_local_default: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local mode."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local_default:
        _local_default.append(tempfile.mkdtemp(prefix="winnow-"))
    return f"file://{_local_default[0]}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table of the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/winnow-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._stash_path = path
    return back


def prefix_sums(parts: DataFrame, part: str, total: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Sum of `total` over the smaller values of `part`, per keys, as column `base`.

    Two levels, so that no window holds more than 1024 rows of a key at the first level and one row
    per 1024 at the second.
    """
    k = list(keys)
    chunked = parts.withColumn("_chunk", F.floor(F.col(part) / 1024))
    before = W.rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    inner = chunked.withColumn("_in", F.coalesce(F.sum(total).over(before.partitionBy(*k, "_chunk").orderBy(part)), zero))
    outer = chunked.groupBy(*k, "_chunk").agg(F.sum(total).alias("_sum"))
    outer = outer.withColumn("_out", F.coalesce(F.sum("_sum").over(before.partitionBy(*k).orderBy("_chunk")), zero)).drop("_sum")
    on = [inner[c].eqNullSafe(outer[c]) for c in (*k, "_chunk")]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return inner.join(outer, cond).select(*(inner[c] for c in k), inner[part], (inner["_in"] + outer["_out"]).alias("base"))


def numbered(rows: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """rows with their place by order, from 1, as column `name`: the place within a range of the order plus the rows of
    the ranges before. Rows are stashed, as the sample for the ranges' bounds reads all of them; so are the ranges, whose
    bounds another run needn't repeat."""
    ranged = stash(stash(rows, "unranged").repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    base = prefix_sums(ranged.groupBy("_part").agg(F.count("*").alias("_rows")), "_part", "_rows")
    inner = ranged.withColumn("_n", F.row_number().over(W.partitionBy("_part").orderBy(*order)))
    return inner.join(F.broadcast(base), "_part").withColumn(name, F.col("base") + F.col("_n")).select(*rows.columns, name)
