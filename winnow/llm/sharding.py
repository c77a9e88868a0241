"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing.

Groups are rows of equal text (a null text counts as empty). Differencing runs as a tree: groups are dealt
by hash to nodes of about `fan` groups; each node repeatedly combines the two partial partitions with the
largest spread, the larger sums of one meeting the smaller of the other, down to one partial partition; the
nodes' partial partitions are combined by the same rule one level up, until one is left. No task sees more
than one node, and the number of levels grows with the logarithm of the input.

Defined cases: a group larger than a fair share fills a shard of its own; an empty table gives an empty
table; rows that repeat a doc_id are separate rows; null doc_ids are kept; texts of any length count whole; equally
large groups or partitions are taken in the order of their hashes; further columns don't pass and may have any name.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.common import prefix_sums, small, stash, two_hashes


def difference(partitions: list[list[int]], shards: int) -> list[list[int]]:
    """Combine partial partitions by differencing; returns for each of them the final shard of each of its slots."""
    nodes: list[tuple] = [(i,) for i in range(len(partitions))]
    orders, heap = [], []
    for i, sums in enumerate(partitions):
        order = sorted(range(shards), key=lambda s: -sums[s])
        vec = [sums[s] for s in order]
        orders.append(order)
        heap.append((vec[-1] - vec[0], i, vec))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heap[0]
        both = [p + q for p, q in zip(x, reversed(y), strict=True)]
        order = sorted(range(shards), key=both.__getitem__, reverse=True)
        least = both[order[-1]]
        nodes.append((a, b, order))
        heapq.heapreplace(heap, (least - both[order[0]], len(nodes) - 1, [both[s] - least for s in order]))
    result: list[list[int]] = [[] for _ in partitions]
    todo = [(heap[0][1], list(range(shards)))] if heap else []
    while todo:
        n, labels = todo.pop()
        if len(nodes[n]) == 1:
            result[n] = [0] * shards
            for place, slot in enumerate(orders[n]):
                result[n][slot] = labels[place]
        else:
            a, b, order = nodes[n]
            mine = [0] * shards
            for place, slot in enumerate(order):
                mine[slot] = labels[place]
            todo += [(a, mine), (b, mine[::-1])]
    return result


def _difference_node(shards: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["k1", "k2", "slot"], ignore_index=True)
        new = pdf.k1.ne(pdf.k1.shift()) | pdf.k2.ne(pdf.k2.shift())
        node = (new.cumsum() - 1).tolist()
        sums = [[0] * shards for _ in range(int(new.sum()))]
        for n, s, b in zip(node, pdf.slot.tolist(), pdf.bytes.tolist(), strict=True):
            sums[n][s] += b
        at = difference(sums, shards)
        return pdf[["k1", "k2", "slot"]].assign(to=[at[n][s] for n, s in zip(node, pdf.slot.tolist(), strict=True)])

    return run


def _level(items: DataFrame, parents: int, shards: int) -> DataFrame:
    """items (k1, k2, slot, bytes) -> also parent and `to`, the slot in the parent's partial partition."""
    dealt = items.withColumn("parent", F.pmod("k1", F.lit(parents)))
    return dealt.groupBy("parent").applyInPandas(_difference_node(shards), "k1 long, k2 long, slot int, to int").withColumn("parent", F.pmod("k1", F.lit(parents)))


def balance(groups: DataFrame, shards: int = 16, fan: int = 1024) -> DataFrame:
    """groups (h1, h2, bytes) -> (h1, h2, shard)."""
    n = groups.count()
    parents = max(1, -(-n // fan))
    items = groups.select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), F.lit(0).alias("slot"), "bytes")
    placed = stash(_level(items, parents, shards), "shard-level")
    found = placed.select(F.col("k1").alias("h1"), F.col("k2").alias("h2"), "parent", F.col("to").alias("shard"))
    sums = placed.join(items, ["k1", "k2", "slot"])
    while parents > 1:
        nodes = stash(sums.groupBy(F.col("parent").alias("k1"), F.lit(0).cast("long").alias("k2"), F.col("to").alias("slot")).agg(F.sum("bytes").alias("bytes")), "shard-nodes")
        parents = -(-parents // fan)
        placed = stash(_level(nodes, parents, shards), "shard-level")
        step = placed.select(F.col("k1").alias("_node"), F.col("slot").alias("_slot"), F.col("to").alias("_to"), F.col("parent").alias("_parent"))
        found = found.join(small(step, placed), (F.col("parent") == F.col("_node")) & (F.col("shard") == F.col("_slot"))).select(
            "h1", "h2", F.col("_parent").alias("parent"), F.col("_to").alias("shard")
        )
        sums = placed.join(nodes, ["k1", "k2", "slot"])
    return found.drop("parent")


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the task's number and each row's number among the task's rows of its shard."""
    part, seen = TaskContext.get().partitionId(), {}
    for batch in batches:
        nth = []
        for s in batch.column("shard").to_pylist():
            nth.append(seen.get(s, 0))
            seen[s] = nth[-1] + 1
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array([part] * batch.num_rows, pa.int64()), pa.array(nth, pa.int64())], names=[*batch.schema.names, "_part", "_nth"]
        )


def shard_by_bytes(docs: DataFrame, shards: int = 16, fan: int = 1024) -> DataFrame:
    """doc_id, size (UTF-8 bytes + 1), text_crc32, shard, and slot: the row's place in its shard, without gaps."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *two_hashes(text))
    rows = stash(rows, "shard-rows")
    groups = stash(rows.groupBy("h1", "h2").agg(F.sum("size").alias("bytes")), "shard-groups")
    dealt = rows.join(balance(groups, shards, fan), ["h1", "h2"]).drop("h1", "h2")
    schema = "doc_id long, size long, text_crc32 long, shard int, _part long, _nth long"
    numbered = stash(dealt.select("doc_id", "size", "text_crc32", "shard").mapInArrow(_number, schema), "shard-slots")
    counts = numbered.groupBy("_part", "shard").agg((F.max("_nth") + 1).alias("n"))
    base = stash(prefix_sums(counts, "_part", "n", ("shard",)), "shard-bases")
    return numbered.join(small(base), ["_part", "shard"]).select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("_nth")).alias("slot"))
