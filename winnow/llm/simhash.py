"""SimHash near-duplicates by a range join of segment bit counts.

Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; the hashes of all shingles of `ngram` words, repeats included,
vote on the 64 bits of a fingerprint: a bit is 1 if it is set in over half of them. A text of fewer words is one shingle;
one without words has fingerprint zero. Fingerprints that differ in at most 2 bits are linked.

A fingerprint is embedded as the bit counts of its segments. One differing bit moves one count by one, so the Manhattan
distance of two embeddings never exceeds the number of differing bits, and a pair within 2 bits lies within Manhattan
distance 2. On the grid of counts, two points at distance 2 or less have a point in common that is at most one step from
both: every fingerprint goes to its own cell and to the cells one step up or down, and all pairs in question share a cell.
There they are compared exactly, and a cell hands on at most one link per row: what its links join.

A cell of more than `CELL` rows isn't compared: the fingerprints in it go on to a grid of segments half as long (8, 4, 2,
then 1 bit). At one bit a segment, a cell is a fingerprint with one bit flipped: it holds 65 rows at most. So no cell is
unbounded, however alike the texts are, and no pair is lost.

Equal fingerprints are one row of the join with their number and smallest doc_id. Defined cases: rows that repeat a doc_id
are one node that links the fingerprints of its texts, and get the same component; a null doc_id takes no part (component
null); a null text is empty; empty texts share fingerprint zero and are linked like any other; texts of any length count
whole; further columns don't pass and may have any name; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.common import lookup, stash, task_memos
from winnow.llm.components import components

#: Rows of a cell that are compared with each other; larger cells go on to shorter segments.
CELL = 512
#: Bits of a segment, from grid to grid.
SEGMENTS = (8, 4, 2, 1)
RADIUS = 2
FETCH, VOTES = 1024, 8192


def fingerprint(text: bytes | None, ngram: int) -> int:
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    n = max(1, len(words) - ngram + 1)
    ends = ends[-n:]
    set_bits = np.zeros(64, np.int64)
    for lo in range(0, n, VOTES):
        cut = [joined[a:b] for a, b in zip(starts[lo : min(lo + VOTES, n)].tolist(), ends[lo : lo + VOTES].tolist(), strict=True)]
        h = np.fromiter(map(xxhash.xxh64_intdigest, cut, repeat(42)), np.uint64, len(cut))
        set_bits += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view("<u8")[0])


def _fingerprints(ngram: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_memos():
            for whole in batches:
                for lo in range(0, whole.num_rows, FETCH):
                    batch = whole.slice(lo, FETCH)
                    found = np.array([fingerprint(t, ngram) for t in batch.column("text").cast(pa.binary()).to_pylist()], np.uint64)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "print"])

    return run


def fingerprints(docs: DataFrame, ngram: int = 3) -> DataFrame:
    """doc_id and its fingerprint as a signed long, a row per row of docs."""
    return docs.select("doc_id", "text").mapInArrow(_fingerprints(ngram), "doc_id long, print long")


def embedding(prints: np.ndarray, bits: int) -> np.ndarray:
    """(rows, segments) of bit counts."""
    lanes = (prints.view(np.uint64)[:, None] >> np.arange(0, 64, bits, dtype=np.uint64)) & np.uint64((1 << bits) - 1)
    return np.bitwise_count(lanes)


def cells(prints: np.ndarray, bits: int) -> np.ndarray:
    """(rows, 1 + 2 * segments) of cells: the embedding's own point and those one step away, hashed from counts by a sum
    of a random weight per segment, so that a step adds or takes a weight."""
    weights = np.random.default_rng(64 + bits).integers(1 << 63, 1 << 64, 64 // bits, np.uint64) | np.uint64(1)
    own = (embedding(prints, bits).astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64)
    return np.concatenate([own[:, None], own[:, None] + weights, own[:, None] - weights], axis=1)


def _cells(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, FETCH):
                prints = whole.column("print").slice(lo, FETCH).to_numpy(zero_copy_only=False)
                at = cells(prints, bits)
                yield pa.RecordBatch.from_arrays([pa.array(at.ravel().view(np.int64)), pa.array(np.repeat(prints, at.shape[1]))], names=["cell", "print"])

    return run


def near_pairs(cell: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the pairs of a cell within the radius; rows are in the order of their cells."""
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    at, step = np.arange(len(cell) - 1), 1
    while True:
        at = at[at + step < len(cell)]
        at = at[cell[at] == cell[at + step]]
        if not len(at):
            return np.concatenate(left), np.concatenate(right)
        close = at[np.bitwise_count(prints[at] ^ prints[at + step]) <= RADIUS]
        left.append(close)
        right.append(close + step)
        step += 1


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n places the least place that the pairs (i, j) join it with."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], least)
        np.minimum.at(new, label[j], least)
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of cells that come one after another; the last cell of a batch waits for the next one."""
    held = [np.empty(0, np.int64), np.empty(0, np.uint64)]

    def found(cell: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        i, j = near_pairs(cell, prints)
        label = spanning(len(cell), i, j)
        at = np.flatnonzero(label != np.arange(len(cell)))
        return pa.RecordBatch.from_arrays([pa.array(prints[at].view(np.int64)), pa.array(prints[label[at]].view(np.int64))], names=["a", "b"])

    for batch in batches:
        cell = np.concatenate([held[0], batch.column("cell").to_numpy(zero_copy_only=False)])
        prints = np.concatenate([held[1], batch.column("print").to_numpy(zero_copy_only=False).view(np.uint64)])
        if len(cell):
            cut = int(np.argmax(cell == cell[-1]))
            held = [cell[cut:], prints[cut:]]
            yield found(cell[:cut], prints[:cut])
    yield found(*held)


def links(prints: DataFrame) -> DataFrame:
    """prints: distinct longs `print` -> links (a, b) that join all that are within the radius, through others or not."""
    found, rest = None, prints
    for bits in SEGMENTS:
        keyed = rest.mapInArrow(_cells(bits), "cell long, print long")
        sizes = keyed.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
        if bits > 1:
            # Few: a grid has at most 17 to 65 rows a fingerprint, and each of these cells takes more than CELL of them.
            crowded = stash(sizes.where(F.col("n") > CELL), "crowded")
            full = bool(crowded.head(1))
        else:
            full = False
        if full:
            table = crowded.select(F.col("cell").alias("key"), "n", F.lit(True).alias("crowded"))
            marked = stash(lookup(keyed, "cell", table, keep=True), "marked")
            dealt = marked.where("_crowded is null").select("cell", "print")
            rest = stash(marked.where("_crowded").select("print").distinct(), "crowded-prints")
        else:
            dealt = keyed
        near = stash(dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(_links, "a long, b long").distinct(), "near")
        found = near if found is None else found.unionAll(near)
        if not full:
            return found
    return found


def near_duplicates(docs: DataFrame, ngram: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable), a row per row of docs."""
    rows = stash(fingerprints(docs, ngram), "simhash")
    known = rows.where(F.col("doc_id").isNotNull())
    prints = stash(known.groupBy("print").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")), "prints")
    # A doc_id of several texts links their fingerprints.
    several = known.groupBy("doc_id").agg(F.min("print").alias("a"), F.max("print").alias("z")).where("a < z")
    repeated = known.join(several.select("doc_id", "a"), "doc_id").select("a", F.col("print").alias("b"))
    comp = components(links(prints.select("print")).unionAll(repeated))
    labelled = stash(prints.join(comp.select(F.col("a").alias("print"), F.col("b").alias("comp")), "print", "left").withColumn("comp", F.coalesce("comp", "print")), "labelled")
    smallest = labelled.groupBy("comp").agg(F.count("*").alias("n"), F.min("least").alias("least"))
    table = stash(smallest.select(F.col("comp").alias("key"), "n", "least"), "smallest")
    by_print = lookup(labelled.select("print", "n", "comp"), "comp", table).select(F.col("print").alias("key"), "n", F.col("_least").alias("component_id"))
    out = lookup(known, "print", stash(by_print, "component-of")).select("doc_id", "print", F.col("_component_id").alias("component_id"))
    out = out.unionByName(rows.where(F.col("doc_id").isNull()).select("doc_id", "print", F.lit(None).cast("long").alias("component_id")))
    return out.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
