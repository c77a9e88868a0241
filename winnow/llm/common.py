"""Shared folder tables, size-checked broadcasts, memos of tasks and byte tokens used by the operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.tables import prefix_sums, shared_root, stash

#: Rows and serialised bytes that a side may have to be broadcast; larger sides are joined by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 32 << 20
#: Bytes that a task's memo holds before it starts anew; they bound memory and never change a result.
MEMO_BYTES = 24 << 20
#: About what an entry takes besides its key and value: two objects' heads and a slot of the table.
ENTRY_BYTES = 180

#: Buckets per doubling of a count, and rows of a lookup table that go to every worker, those of the largest counts.
BANDS, ROOM = 8, 100_000

__all__ = ["prefix_sums", "shared_root", "stash"]


class Memo(dict):
    """f of a text or bytes key, remembered by one task until `room` bytes are held."""

    def __init__(self, f: Callable, room: int = MEMO_BYTES):
        super().__init__()
        self.f, self.room, self.held = f, room, 0

    def __missing__(self, key):
        out = self.f(key)
        self.put(key, out)
        return out

    def has_room(self, keys) -> bool:
        return self.held + sum(map(len, keys)) * 3 + len(keys) * ENTRY_BYTES <= self.room

    def put(self, key, out) -> None:
        self.held += ENTRY_BYTES + len(key) + (len(out) if isinstance(out, bytes) else 0)
        if self.held > self.room:
            self.clear()
            self.held = ENTRY_BYTES
        self[key] = out

    def clear(self) -> None:
        super().clear()
        self.held = 0


@contextmanager
def task_memos(*memos: dict) -> Iterator[None]:
    """Empties the memos when a task ends and hands free memory back, as the worker process lives on."""
    try:
        yield
    finally:
        for m in memos:
            m.clear()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)


def unstash(df: DataFrame) -> None:
    """Delete a stashed table that nothing will read again."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stash_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def tidy(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files and broadcasts of plans that nothing refers to any more, which it does when
    the driver's garbage is collected."""
    gc.collect()
    spark._jvm.System.gc()


def small(df: DataFrame, written: DataFrame | None = None, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most that many rows and the written form of the stashed table it comes from
    at most BROADCAST_BYTES, else as it is (then a shuffle join). `written` is that table, if df is a selection of its
    columns and rows; all columns are of fixed width.
    """
    held = (df if written is None else written).__dict__.get("_stash_path")
    if held is None:
        raise TypeError("the size of a table that isn't stashed is unknown")
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(held)
    size = path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return F.broadcast(df) if size <= BROADCAST_BYTES and df.count() <= rows else df


def two_hashes(col, names=("h1", "h2")):
    """128 bits from two independently seeded 64-bit hashes."""
    return F.xxhash64(col).alias(names[0]), F.xxhash64(F.lit(7), col).alias(names[1])


def bands_of(table: DataFrame, n: str, rows: Column | None = None) -> list:
    """The table's rows (or another sum that stands for them) by the size of n."""
    return table.groupBy(F.floor(F.log2(n) * BANDS).alias("band")).agg((F.count("*") if rows is None else rows).alias("rows"), F.sum(n).alias("n"), F.min(n).alias("least")).collect()


def threshold_of(bands: list, room: int) -> int:
    """The count that at most `room` rows reach, or at most `room` of what was summed for them."""
    threshold = None
    for b in sorted(bands, key=lambda b: -b.band):
        room -= b.rows
        if room < 0:
            break
        threshold = b.least
    if threshold is None:  # not even the top band fits
        threshold = 1 + max((b.least for b in bands), default=0) * 2
    return threshold


def lookup(rows: DataFrame, on: str, table: DataFrame, keep: bool = False) -> DataFrame:
    """rows with the values of table (key, n, value..., the first never null) at key = `on`: those that have one, or
    with `keep` all. At most ROOM rows of the largest counts are broadcast, the rest is a shuffle join of keys with
    small counts, so that no key with a large part of the rows meets in one task."""
    threshold = threshold_of(bands_of(table, "n"), ROOM)
    values = [c for c in table.columns if c not in ("key", "n")]
    side = lambda which: table.where(which).select(F.col("key").alias(on), *[F.col(c).alias(f"_{c}") for c in values])
    found = rows.join(F.broadcast(side(F.col("n") >= threshold)), on, "left")
    some = F.col(f"_{values[0]}").isNotNull()
    rest = found.where(~some).select(*rows.columns).join(side(F.col("n") < threshold), on, "left" if keep else "inner")
    return found.where(some).unionByName(rest)
