"""Keyed state as a log of deltas: a commit writes its own rows, readers merge, neighbouring deltas are merged in tiers.

A log is a folder. Commit n has a directory of Parquet files, dealt to buckets by the key's hash, and then a small JSON
file that makes it valid and says which buckets it touched and how large they are. So what a commit writes follows its own
rows, never the table. A bucket with more than `most` pieces has its newest ones merged as far back as each is at most twice
as large as all newer ones together: a row is rewritten a logarithmic number of times. Pieces that a merge replaced are
deleted by the merge after it, so that readers that began before it end well.

A commit may carry a name and a number (of a stream's batch, of a run's wave); one that isn't higher than the last of
that name is left alone, so repeating after a failure changes nothing. One writer at a time: a second one that takes the
same number fails, as the JSON file is created and never overwritten.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnow.schema import CACHE, SEEN, conform

#: Of an event: its commit, whether it voids all before it, and whether no row is left.
MARKS = T.StructType([T.StructField("_seq", T.LongType()), T.StructField("_reset", T.BooleanType()), T.StructField("_gone", T.BooleanType())])
#: Gives the merged columns of a key's events: (names of the columns but the key) -> aggregates.
Merge = Callable[[list[str]], dict[str, Column]]


def newest_wins(columns: list[str]) -> dict[str, Column]:
    """Insert or replace: the last event's columns."""
    return {c: F.max_by(c, F.col("_seq")) for c in columns}


def verdict_wins(columns: list[str]) -> dict[str, Column]:
    """Seen state: the first event's columns, but seen_at and prefilter_version of the last verdict (version null) or else
    the last rejection; so a verdict is never downgraded and refreshes its time."""
    kept = [c for c in columns if c not in ("seen_at", "prefilter_version")]
    last = F.struct(F.col("prefilter_version").isNull(), "_seq")
    first = {c: F.min_by(c, F.col("_seq")) for c in kept}
    return first | {c: F.max_by(c, last) for c in ("seen_at", "prefilter_version")}


class Files:
    """What the log needs of Hadoop's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self._new = path.rstrip("/"), spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._new(path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._text = spark._jvm.org.apache.commons.io.IOUtils

    def at(self, name: str):
        return self._new(f"{self.path}/{name}")

    def names(self, folder: str = "") -> list[str]:
        at = self.at(folder) if folder else self._new(self.path)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.at(name))

    def size(self, name: str) -> int:
        return self.fs.getContentSummary(self.at(name)).getLength()

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return self._text.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        stream = self.fs.create(self.at(name), False)
        stream.write(bytearray(text.encode()))
        stream.close()

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


class DeltaLog:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str = "id", merge: Merge = newest_wins, buckets: int = 32):
        self.spark, self.schema, self.key, self.merge, self.buckets = spark, schema, key, merge, buckets
        self.files = Files(spark, path)
        self.columns = [f.name for f in schema.fields if f.name != key]
        self.stored = T.StructType([*schema.fields, *MARKS.fields])

    def commits(self) -> list[dict]:
        return [json.loads(self.files.read(n)) for n in self.files.names() if n.endswith(".json")]

    def done(self, name: str) -> int:
        """The highest number committed under that name, -1 if none."""
        return max((c["names"].get(name, -1) for c in self.commits()), default=-1)

    # --- writing ---

    def _write(self, events: DataFrame, commits: list[dict], name: tuple[str, int] | None = None, since: dict[str, int] | None = None) -> None:
        seq = 1 + max((c["seq"] for c in commits), default=0)
        folder = f"c{seq:010d}-{uuid.uuid4().hex[:8]}"
        rows = conform(events.withColumn("_seq", F.coalesce("_seq", F.lit(seq))), self.stored)
        rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))
        rows.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.files.path}/{folder}")
        found = {n.removeprefix("_bucket="): self.files.size(f"{folder}/{n}") for n in self.files.names(folder) if n.startswith("_bucket=")}
        names: dict[str, int] = {}
        for c in commits:
            for k, v in c["names"].items():
                names[k] = max(v, names.get(k, -1))
        if name:
            names[name[0]] = name[1]
        told = {"seq": seq, "folder": folder, "bytes": found, "since": {b: (since or {}).get(b, seq) for b in {**found, **(since or {})}}, "names": names}
        self.files.create(f"{seq:010d}.json", json.dumps(told))

    def append(self, rows: DataFrame, name: tuple[str, int] | None = None, most: int = 8) -> bool:
        """Put rows, one event per key; False if that was committed before. Keys that come twice count once."""
        commits = self.commits()
        if name and max((c["names"].get(name[0], -1) for c in commits), default=-1) >= name[1]:
            return False
        one = conform(rows, self.schema).groupBy(self.key).agg(F.min(F.struct(*self.columns)).alias("_row")).select(self.key, "_row.*")
        self._write(one.select("*", F.lit(None).cast("long").alias("_seq"), F.lit(False).alias("_reset"), F.lit(False).alias("_gone")), commits, name)
        self.compact(most)
        return True

    def forget(self, ids: DataFrame, name: tuple[str, int] | None = None) -> None:
        """Drop keys; a later row of such a key starts anew."""
        gone = conform(ids.select(self.key).distinct(), self.schema)
        self._write(gone.select("*", F.lit(None).cast("long").alias("_seq"), F.lit(True).alias("_reset"), F.lit(True).alias("_gone")), self.commits(), name)

    # --- reading ---

    def pieces(self, commits: list[dict] | None = None) -> dict[str, list[dict]]:
        """Per bucket its live pieces, oldest first: those that no later piece replaces."""
        out: dict[str, list[dict]] = {}
        for c in sorted(self.commits() if commits is None else commits, key=lambda c: c["seq"]):
            for b, since in c["since"].items():
                held = [p for p in out.get(b, []) if p["seq"] < since]
                out[b] = [*held, {"seq": c["seq"], "bytes": c["bytes"].get(b, 0), "path": f"{self.files.path}/{c['folder']}/_bucket={b}" if b in c["bytes"] else None}]
        return out

    def _events(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], self.stored)
        return self.spark.read.schema(self.stored).parquet(*paths)

    def merged(self, events: DataFrame) -> DataFrame:
        """One event per key: what its events from the last reset on come to. A commit has one event of a key."""
        since = F.max(F.when(F.col("_reset"), F.col("_seq"))).over(W.partitionBy(self.key))
        live = events.withColumn("_since", since).where(F.col("_since").isNull() | (F.col("_seq") >= F.col("_since")))
        # A dropped row is an event by itself only if it is the last; then nothing of it is read.
        live = live.withColumn("_last", F.max("_seq").over(W.partitionBy(self.key))).where(~F.col("_gone") | (F.col("_seq") == F.col("_last")))
        was_reset = F.max(F.col("_since").isNotNull()).alias("_reset")
        rows = live.groupBy(self.key).agg(*[e.alias(c) for c, e in self.merge(self.columns).items()], F.max("_seq").alias("_seq"), was_reset, F.max("_gone").alias("_gone"))
        return rows.select(*[f.name for f in self.stored.fields])

    def read(self, only: DataFrame | None = None) -> DataFrame:
        """The table, or its rows whose key is in `only`, which then are the only ones that are merged."""
        events = self._events([p["path"] for ps in self.pieces().values() for p in ps if p["path"]])
        if only is not None:
            events = events.join(only.select(self.key).distinct(), self.key, "left_semi")
        return self.merged(events).where(~F.col("_gone")).select(*[f.name for f in self.schema.fields])

    # --- merging ---

    def compact(self, most: int = 8) -> int:
        """Merge the newest pieces of buckets that have more than `most`; returns how many buckets that were."""
        commits = self.commits()
        chosen: dict[str, list[dict]] = {}
        whole = []
        for b, pieces in self.pieces(commits).items():
            if len(pieces) <= most:
                continue
            n, held = 1, pieces[-1]["bytes"]
            while n < len(pieces) and (pieces[-n - 1]["bytes"] <= 2 * held or n < 2):
                held += pieces[-n - 1]["bytes"]
                n += 1
            chosen[b] = pieces[-n:]
            if n == len(pieces):
                whole.append(int(b))
        if not chosen:
            return 0
        self._vacuum(commits)
        events = self.merged(self._events([p["path"] for ps in chosen.values() for p in ps if p["path"]]))
        # With the oldest piece in it, nothing is left before the merged rows that a reset could void.
        oldest = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).isin(whole) if whole else F.lit(False)
        events = events.where(~(oldest & F.col("_gone"))).withColumn("_reset", F.col("_reset") & ~oldest)
        self._write(events, self.commits(), since={b: ps[0]["seq"] for b, ps in chosen.items()})
        return len(chosen)

    def _vacuum(self, commits: list[dict]) -> None:
        """Delete commits none of whose pieces is live, but for the newest, whose names count."""
        live = {p["seq"] for ps in self.pieces(commits).values() for p in ps} | {max(c["seq"] for c in commits)}
        for c in commits:
            if c["seq"] not in live:
                self.files.delete(f"{c['seq']:010d}.json")
                self.files.delete(c["folder"])


class SeenLog(DeltaLog):
    """Seen postings: verdicts and provisional rejections under a fingerprint."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 32):
        super().__init__(spark, path, SEEN, "id", verdict_wins, buckets)

    def mark(self, verdicts: DataFrame | None, rejected: DataFrame | None, version: str, now: Column, name: tuple[str, int] | None = None) -> bool:
        """One commit of both; an id in both has a verdict."""
        told = [df.select("id", "source", "title", "url", now.alias("seen_at"), F.lit(v).cast("string").alias("prefilter_version")) for df, v in ((verdicts, None), (rejected, version)) if df is not None]
        if len(told) == 2:
            told = [told[0].unionByName(told[1].join(told[0].select("id"), "id", "left_anti"))]
        return self.append(told[0], name)


class CacheLog(DeltaLog):
    """Scores by posting: the last one counts."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 32):
        super().__init__(spark, path, CACHE, "job_id", newest_wins, buckets)
