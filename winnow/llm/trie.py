"""Prefix trie of conversations, built family by family and merged once.

Conversations share first turns by their base: conversation c starts with the first turns of conversation c - c % 5, so a
base and those that start with it are a family. A family's rows are dealt to one task and pass it as a stream, the base
first; the task holds the base's first turns and the family's small trie, in which equal nodes are one row with their
members counted. Only these rows are shuffled by node and merged to the trie of all.

A node is a sequence of turns; its name is 128 bits chained from turn to turn. Of every node, its smallest member is its
owner. What one conversation owns is the end of its path, as an owner of a node owns all nodes below it that it passes.
Sums over subtrees follow from this without any walk from level to level, in a second pass of the families that knows per
conversation c the bytes T(c) of the turns before those it owns (all its turns, if it owns none) and whether it owns a
childless node: a node's leaves are its members of the latter kind; what it saves is, over its other members than the
owner, T(c) less the bytes of the turns before the node, that is every member's turns from the node on that are others'.

At scale: the rows of both passes are narrow (hashes and lengths, no texts) and a task holds `HELD` nodes at most before it
hands them on. A conversation's path is a chain, so its narrow rows pass in one task. Root, common first turns and ends
of many copies meet as counted rows; ids of an end are joined piece by piece in ranges of ids.

Defined cases: a null role or text is empty; rows go by turn (null first), rows of one turn by role, by the first 64
characters of the text, then by the text's hash; rows of a null conv_id are left out; a negative id's base is that of SQL's
remainder; texts of any length count whole; further columns don't pass and may have any name; an empty table gives an
empty table.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.common import lookup, stash

#: Conversations of a family, and the most turns that one starts with, which also says how many: crc32 of its id.
FAMILY, HEADS = 5, 9
#: Nodes that a task holds before it hands them on, and ids of an end that are joined to one piece.
HELD, PIECE = 50_000, 4096
#: Odd factors of a node's name.
CHAIN = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
MASK = (1 << 64) - 1
ROOT = bytes(16)

NODES = "node binary, parent binary, depth long, least long, n long, bytes long, above long, ends boolean"
SUMS = "node binary, t long, leaves long"


def heads_of(conv_id: int) -> int:
    """How many turns a conversation takes from its base."""
    return zlib.crc32(str(conv_id).encode()) % HEADS


def narrow(conversations: DataFrame) -> DataFrame:
    """base, conv_id and, per turn, what its order and its node need."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    c = F.col("conv_id").cast("long")
    return conversations.where(F.col("conv_id").isNotNull()).select(
        (c - c % FAMILY).alias("base"), c.alias("conv_id"), "turn", role.alias("role"), F.left(text, F.lit(64)).alias("head"),
        F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit(7), role, text).alias("h2"), F.octet_length(text).cast("long").alias("bytes"),
    )


class _Path:
    """A conversation's rebuilt path: name of the node it has come to, its depth and bytes."""

    def __init__(self, conv_id: int, base: list[tuple[int, int, int]] | None):
        """base: the first turns of its base; None for a base itself."""
        self.conv_id, self.depth, self.total, self.node = conv_id, 0, 0, ROOT
        self.skip = 0 if base is None else heads_of(conv_id)
        self.borrowed = [] if base is None else base[: self.skip]

    def step(self, h1: int, h2: int, size: int) -> tuple[bytes, bytes, int, int]:
        """The next node: its name, its parent's, its bytes and those above it."""
        parent, above = self.node, self.total
        a, b = int.from_bytes(parent[:8], "little"), int.from_bytes(parent[8:], "little")
        a, b = (a * CHAIN[0] + h1 + 1) & MASK, (b * CHAIN[1] + h2 + 1) & MASK
        self.node = a.to_bytes(8, "little") + b.to_bytes(8, "little")
        self.depth, self.total = self.depth + 1, self.total + size
        return self.node, parent, size, above

    def start(self) -> Iterator[tuple[bytes, bytes, int, int]]:
        for turn in self.borrowed:
            yield self.step(*turn)

    def row(self, h1: int, h2: int, size: int) -> Iterator[tuple[bytes, bytes, int, int]]:
        if self.skip:
            self.skip -= 1
        else:
            yield self.step(h1, h2, size)


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Steps of the conversations of families that come one after another, bases first: (path, step or None for the root,
    facts of its family's conversations), and (path, "end", facts) after the last one of each."""
    family, base, facts, path = None, [], {}, None
    columns = ("base", "conv_id", "h1", "h2", "bytes", "owned_from", "before", "leaf")
    for batch in batches:
        for b, c, h1, h2, size, *fact in zip(*(batch.column(k).to_pylist() for k in columns), strict=True):
            if path is not None and (c != path.conv_id or b != family):
                yield path, "end", facts
                path = None
            if b != family:
                family, base, facts = b, [], {}
            if fact[0] is not None:
                facts[c] = fact
                continue
            if path is None:
                path = _Path(c, None if c == b else base)
                yield path, None, facts
                for step in path.start():
                    yield path, step, facts
            if c == b and len(base) < HEADS - 1:
                base.append((h1, h2, size))
            for step in path.row(h1, h2, size):
                yield path, step, facts
    if path is not None:
        yield path, "end", facts


def _table(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    types = {"binary": pa.binary(), "long": pa.int64(), "boolean": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], types[t]) for k, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


def _family_tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of family tries (ends false), and a row per conversation for the node it ends at: its id as `least`, the bytes
    of its path as `above` (ends true)."""
    nodes, ends = {}, []
    for path, step, _ in _paths(batches):
        if step == "end":
            ends.append((path.node, None, path.depth, path.conv_id, 1, 0, path.total, True))
            if len(nodes) + len(ends) >= HELD:
                yield _table(NODES, [(*v, False) for v in nodes.values()] + ends)
                nodes, ends = {}, []
            continue
        name, parent, size, above = step or (ROOT, None, 0, 0)
        if name in nodes:
            v = nodes[name]
            v[3], v[4] = min(v[3], path.conv_id), v[4] + 1
        else:
            nodes[name] = [name, parent, path.depth, path.conv_id, 1, size, above]
            if len(nodes) >= HELD:
                yield _table(NODES, [(*v, False) for v in nodes.values()])
                nodes = {}
    yield _table(NODES, [(*v, False) for v in nodes.values()] + ends)


def _family_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per node of family tries: T summed over the members that don't own it, and its members that own a childless node."""
    sums: dict[bytes, list[int]] = {}
    for path, step, facts in _paths(batches):
        if step == "end":
            continue
        owned_from, before, leaf = facts[path.conv_id]
        v = sums.setdefault(path.node, [0, 0])
        v[0] += before if path.depth < owned_from else 0
        v[1] += leaf
        if len(sums) >= HELD:
            yield _table(SUMS, [(k, *v) for k, v in sums.items()])
            sums = {}
    yield _table(SUMS, [(k, *v) for k, v in sums.items()])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of the ids of ends: node, first id of the piece, and the ids joined by commas."""
    for batch in batches:
        nodes, ids = batch.column("node").to_pylist(), batch.column("id").to_pylist()
        out, lo = [], 0
        for hi in range(1, len(ids) + 1):
            if hi == len(ids) or nodes[hi] != nodes[lo] or hi - lo == PIECE:
                out.append((nodes[lo], ids[lo], ",".join(map(str, ids[lo:hi]))))
                lo = hi
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.binary()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.string())], names=["node", "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the pieces of a node, which come one after another."""
    now, digest, out = None, None, []
    for batch in batches:
        for node, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if node != now:
                if now is not None:
                    out.append((now, digest.hexdigest()))
                now, digest = node, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.binary()), pa.array([r[1] for r in out], pa.string())], names=["node", "ends_sha256"])
        out = []
    if now is not None:
        out.append((now, digest.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.binary()), pa.array([r[1] for r in out], pa.string())], names=["node", "ends_sha256"])


def ends_of(ends: DataFrame) -> DataFrame:
    """node and the digest of the ids that end there, ascending and joined by commas."""
    pieces = ends.select("node", F.col("least").alias("id")).repartitionByRange("node", "id").sortWithinPartitions("node", "id").mapInArrow(_joined, "node binary, first long, ids string")
    return pieces.repartition("node").sortWithinPartitions("node", "first").select("node", "ids").mapInArrow(_hashed, "node binary, ends_sha256 string")


FACTS = ("owned_from long", "before long", "leaf boolean")
STEPS = ("base", "conv_id", "h1", "h2", "bytes")


def _dealt(rows: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Families one after another in their tasks: facts, the base's rows, the rows of the others."""
    empty = [F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in FACTS]
    dealt = rows.select("*", *empty)
    if facts is not None:
        dealt = dealt.unionByName(facts, allowMissingColumns=True)
    order = [F.col("owned_from").isNull(), F.col("conv_id") != F.col("base"), F.col("conv_id"), *[F.col(k).asc_nulls_first() for k in ("turn", "role", "head", "h1", "h2")]]
    return dealt.repartition("base").sortWithinPartitions("base", *order).select(*STEPS, *[f.split()[0] for f in FACTS])


def trie(conversations: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) -> a row per node: conv_id (its smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens (bytes, over its subtree) and ends_sha256."""
    rows = narrow(conversations)
    families = stash(_dealt(rows).mapInArrow(_family_tries, NODES), "families")
    ends = families.where("ends")
    one = [F.first(c).alias(c) for c in ("parent", "depth", "bytes", "above")]
    merged = stash(families.where("not ends").groupBy("node").agg(*one, F.min("least").alias("conv_id"), F.sum("n").alias("n_convs")), "nodes")
    children = merged.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = stash(merged.join(children, "node", "left").fillna(0, "n_children"), "counted-nodes")

    owned = nodes.groupBy("conv_id").agg(F.min(F.struct("depth", "above")).alias("own"), F.max(F.col("n_children") == 0).alias("leaf"))
    paths = ends.select(F.col("least").alias("conv_id"), F.col("depth").alias("len"), F.col("above").alias("total")).join(owned, "conv_id", "left")
    facts = paths.select(
        (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), "conv_id",
        F.coalesce("own.depth", F.col("len") + 1).alias("owned_from"), F.coalesce("own.above", "total").alias("before"), F.coalesce("leaf", F.lit(False)).alias("leaf"),
    )
    sums = _dealt(rows, facts).mapInArrow(_family_sums, SUMS).groupBy("node").agg(F.sum("t").alias("t"), F.sum("leaves").alias("n_leaves"))
    out = nodes.join(sums, "node").join(ends_of(ends), "node", "left")
    out = out.withColumn("saved_tokens", F.col("t") - (F.col("n_convs") - 1) * F.col("above"))
    known = stash(out.select("node", "parent", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")), "trie")
    parents = nodes.where("n_children > 0").select(F.col("node").alias("key"), F.col("n_children").alias("n"), "conv_id")
    columns = ("conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    below = lookup(known.where("parent is not null"), "parent", parents).select(*columns, F.col("_conv_id").alias("parent_conv_id"))
    return below.unionByName(known.where("parent is null").select(*columns, F.lit(None).cast("long").alias("parent_conv_id")))
