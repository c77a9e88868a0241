"""MinHash near-duplicates by a multi-index Hamming join.

Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z. A document's set holds its distinct shingles of `ngram`
words, or its whole word sequence as one if it has fewer words; without words the set is empty and the
document is linked with nothing. Documents are linked if 100 * intersection >= percent * union.

Sets become signatures of `symbols` b-bit minima (b = 16). A signature is split into chunks of `width`
symbols. If two signatures differ in at most chunks * (errors + 1) - 1 symbols, some chunk differs in at
most `errors` (pigeonhole); so each chunk is indexed once for every choice of `errors` symbols left out,
and all pairs within that radius share a key. With 48 symbols of width 4 and one error the radius is 23;
two sets of similarity 0.85 differ in more with a probability of about 1e-8, of similarity 0.8 of 4e-6.

A key's documents aren't paired with each other. Every one is compared with one pivot of the key, its first
in one shuffled order of all documents, so that keys of the same documents have the same pivot; the confirmed
links give components. Keys whose documents still lie in
different components are then compared in blocks of bounded size, only across components and each pair only
at the first key it shares; a block hands on no more links than rows. So no link between components is lost
and no group of copies is expanded. Links are confirmed on full sets.
Equal sets are found by a 128-bit fingerprint first and are represented by their smallest doc_id.

Defined cases: rows that repeat a doc_id are separate texts of one node and get the same component; a null
doc_id takes no part (component null, kept true); a null text is an empty set; texts of any length count whole; further columns don't pass and may have any name; an empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.llm.common import lookup, small, stash, task_memos
from winnow.llm.components import components

FETCH, KEYED = 2048, 512
#: A block of a key that is compared in full holds about so many rows, by signatures and by full sets, and bytes of sets.
FLAG_ROWS, LINK_ROWS, LINK_BYTES = 2048, 1024, 16 << 20
#: Any odd number: ids are ordered by their exclusive or with it.
SHUFFLED = 0x5BD1E9955BD1E995


@dataclass(frozen=True)
class Plan:
    """symbols, width and errors as above; ngram and percent define the links."""

    ngram: int = 5
    percent: int = 80
    symbols: int = 48
    width: int = 4
    errors: int = 1

    @property
    def radius(self) -> int:
        return self.symbols // self.width * (self.errors + 1) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None, ngram: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(w) - ngram + 1)
    h = np.zeros(n, np.uint64)
    for j in range(min(ngram, len(w))):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[j : j + n]
    return np.unique(mixed(h))


@lru_cache(maxsize=4)
def factors(symbols: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(0, 1 << 32, (symbols, 1), np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, (symbols, 1), np.uint32)


def signature(h: np.ndarray, symbols: int) -> np.ndarray:
    """16 bits of each of the minima under `symbols` maps of a 32-bit hash."""
    a, b = factors(symbols)
    x = (h >> np.uint64(32)).astype(np.uint32)
    least = np.full(symbols, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(x), 4096):
        y = x[None, lo : lo + 4096] * a
        y += b
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        np.minimum(least, y.min(axis=1), out=least)
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype("<u2")


def _fingerprints(plan: Plan) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_memos():
            for whole in batches:
                for lo in range(0, whole.num_rows, FETCH):
                    batch = whole.slice(lo, FETCH)
                    sizes, f1, f2, sigs = [], [], [], []
                    for t in batch.column("text").cast(pa.binary()).to_pylist():
                        h = shingles(t, plan.ngram)
                        sizes.append(len(h))
                        f1.append(int(h.sum(dtype=np.uint64)))
                        f2.append(int(mixed(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)))
                        sigs.append(signature(h, plan.symbols).tobytes() if len(h) else None)
                    longs = [pa.array(np.array(f, np.uint64).view(np.int64)) for f in (f1, f2)]
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), *longs, pa.array(sigs, pa.binary())], names=["doc_id", "n_shingles", "h1", "h2", "sig"])

    return run


def fingerprints(docs: DataFrame, plan: Plan) -> DataFrame:
    """doc_id, n_shingles, h1, h2 (of the set) and sig (null for an empty set)."""
    return docs.select("doc_id", "text").mapInArrow(_fingerprints(plan), "doc_id long, n_shingles long, h1 long, h2 long, sig binary")


def chunk_keys(sigs: np.ndarray, plan: Plan) -> np.ndarray:
    """(rows, keys) of 64-bit keys: a chunk's number, the symbols left out and a packing of those kept."""
    kept = list(combinations(range(plan.width), plan.width - plan.errors))
    if len(kept[0]) > 3:
        raise ValueError("a key packs at most three symbols: raise errors or lower width")
    wide = sigs.astype(np.uint64).reshape(len(sigs), -1, plan.width)
    keys = np.empty((len(sigs), wide.shape[1], len(kept)), np.uint64)
    for m, which in enumerate(kept):
        k = np.arange(wide.shape[1], dtype=np.uint64) * np.uint64(len(kept)) + np.uint64(m)
        k = np.broadcast_to(k, wide.shape[:2])
        for j in which:
            k = (k << np.uint64(16)) | wide[:, :, j]
        keys[:, :, m] = k
    return mixed(keys.reshape(len(sigs), -1)).view(np.int64)


def _keys(plan: Plan) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, KEYED):
                batch = whole.slice(lo, KEYED)
                sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), "<u2").reshape(-1, plan.symbols)
                keys = chunk_keys(sigs, plan)
                ids = np.repeat(batch.column("doc_id").to_numpy(zero_copy_only=False), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids)], names=["key", "id"])

    return run


def _near(radius: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(batch.num_rows, -1) for c in ("sig_a", "sig_b"))
                yield batch.select(["a", "b"]).filter(pa.array((x != y).sum(axis=1) <= radius))

    return run


def within_radius(pairs: DataFrame, sigs: DataFrame, plan: Plan) -> DataFrame:
    """The pairs (a, b) whose signatures differ in at most the plan's radius."""
    withs = pairs.join(sigs.select(F.col("doc_id").alias("a"), F.col("sig").alias("sig_a")), "a")
    withs = withs.join(sigs.select(F.col("doc_id").alias("b"), F.col("sig").alias("sig_b")), "b")
    return withs.mapInArrow(_near(plan.radius), "a long, b long").distinct()


def _confirm(plan: Plan) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, bytes], np.ndarray] = {}

        def of(i: int, text: bytes | None) -> np.ndarray:
            at = i, xxhash.xxh3_128_digest(text or b"")  # rows that repeat an id may differ in text
            if at not in known:
                if sum(map(len, known.values())) > 2_000_000 or len(known) > 64:
                    known.clear()
                known[at] = shingles(text, plan.ngram)
            return known[at]

        with task_memos(known):
            for whole in batches:
                for lo in range(0, whole.num_rows, 256):
                    batch = whole.slice(lo, 256)
                    keep = []
                    for i, j, s, t in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("text_a").cast(pa.binary()).to_pylist(), batch.column("text_b").cast(pa.binary()).to_pylist(), strict=True):
                        x, y = of(i, s), of(j, t)
                        both = len(np.intersect1d(x, y, assume_unique=True))
                        keep.append(100 * both >= plan.percent * (len(x) + len(y) - both))
                    yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def confirmed(pairs: DataFrame, docs: DataFrame, plan: Plan) -> DataFrame:
    """The pairs that are links, by their full sets. pairs is a stashed table."""
    ids = stash(pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select(F.col("b").alias("doc_id"))).distinct(), "pair-ids")
    texts = stash(docs.select("doc_id", "text").join(small(ids), "doc_id", "left_semi"), "pair-texts")
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    return both.mapInArrow(_confirm(plan), "a long, b long").distinct()


def _met(sig: np.ndarray, key: int, comp: np.ndarray, side: np.ndarray, plan: Plan) -> Iterator[tuple[int, np.ndarray]]:
    """Per row outside the block's largest component the rows of other components that it meets here.

    Met are rows within the radius, of the other side where two blocks meet, and only if `key` is the first key
    that both share, so that a pair is looked at once.
    """
    keys = chunk_keys(sig, plan)
    at = (keys == key).argmax(axis=1)
    labels, n = np.unique(comp, return_counts=True)
    for i in np.flatnonzero(comp != labels[n.argmax()]):
        other = comp != comp[i] if side[i] == 2 else (comp != comp[i]) & (side != side[i])
        near = np.flatnonzero(other & ((sig != sig[i]).sum(axis=1) <= plan.radius))
        yield int(i), near[(keys[near] == keys[i]).argmax(axis=1) == at[i]]


def _flag(plan: Plan) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The rows of a block that meet any."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sig = np.frombuffer(b"".join(pdf.sig), "<u2").reshape(len(pdf), -1)
        flagged = np.zeros(len(pdf), bool)
        for i, near in _met(sig, pdf.key.iloc[0], pdf.comp.to_numpy(), pdf.side.to_numpy(), plan):
            flagged[near] = True
            flagged[i] |= bool(len(near))
        return pdf.loc[flagged, ["key", "id"]]

    return run


def _link(plan: Plan) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Links of a block by full sets: as many as it takes to join what they connect, fewer than its rows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sig = np.frombuffer(b"".join(pdf.sig), "<u2").reshape(len(pdf), -1)
        comp, ids = pdf.comp.to_numpy().copy(), pdf.id.to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in pdf["set"]]
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        _, code = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum(sizes)
        holds = np.zeros(int(code.max()) + 1, bool)
        found = []
        for i, near in _met(sig, pdf.key.iloc[0], pdf.comp.to_numpy(), pdf.side.to_numpy(), plan):
            near = near[comp[near] != comp[i]]
            if not len(near):
                continue
            mine = code[ends[i] - sizes[i] : ends[i]]
            holds[mine] = True
            both = np.array([np.count_nonzero(holds[code[ends[j] - sizes[j] : ends[j]]]) for j in near])
            holds[mine] = False
            for j in near[100 * both >= plan.percent * (sizes[i] + sizes[near] - both)]:
                if comp[j] != comp[i]:
                    found.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
                    comp[comp == comp[j]] = comp[i]
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return run


def _in_blocks(members: DataFrame, blocks: Column) -> DataFrame:
    """members (key, id, ...) dealt to `blocks` (an aggregate over a key's rows); every two blocks of a key meet in
    one group (key, lo, hi). side: 2 if both are the same block, else 0 in the lower and 1 in the upper one."""
    sizes = members.groupBy("key").agg(F.greatest(F.ceil(blocks), F.lit(1)).cast("long").alias("blocks"), F.count("*").alias("n"))
    m = lookup(members, "key", stash(sizes, "block-counts")).withColumnRenamed("_blocks", "blocks").withColumn("mine", F.pmod(F.xxhash64("id", "key"), F.col("blocks")))
    m = m.withColumn("theirs", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    m = m.withColumn("lo", F.least("mine", "theirs")).withColumn("hi", F.greatest("mine", "theirs"))
    return m.withColumn("side", F.when(F.col("lo") == F.col("hi"), 2).when(F.col("mine") == F.col("lo"), 0).otherwise(1)).drop("blocks", "mine", "theirs")


def _sets(plan: Plan) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_memos():
            for whole in batches:
                for lo in range(0, whole.num_rows, 256):
                    batch = whole.slice(lo, 256)
                    sets = [shingles(t, plan.ngram).tobytes() for t in batch.column("text").cast(pa.binary()).to_pylist()]
                    yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.binary())], names=["id", "set"])

    return run


def across(members: DataFrame, sigs: DataFrame, comp: DataFrame, docs: DataFrame, plan: Plan) -> DataFrame:
    """Links (a, b) between different components of documents that share a key: members is (key, id).

    First the members that meet any are flagged by signatures, then only these meet again with their full sets.
    A group hands on at most its rows, never its pairs.
    """
    label = comp.select(F.col("a").alias("id"), F.col("b").alias("comp"))
    m = members.join(label, "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp"))
    open_keys = stash(m.groupBy("key").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.count("*").alias("n")).where("least < most"), "open-keys")
    m = lookup(m, "key", open_keys.select("key", "n", "least")).select("key", "id", "comp")
    m = stash(m.join(sigs.select(F.col("doc_id").alias("id"), "sig"), "id"), "open")
    flagged = stash(_in_blocks(m, F.count("*") / FLAG_ROWS).groupBy("key", "lo", "hi").applyInPandas(_flag(plan), "key long, id long").distinct(), "flagged")
    ids = stash(flagged.select("id").distinct(), "flagged-ids")
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(small(ids), "id", "left_semi")
    sets = stash(texts.mapInArrow(_sets(plan), "id long, set binary"), "sets")
    full = stash(m.join(flagged, ["key", "id"]).join(sets, "id"), "open-sets")
    blocks = F.greatest(F.count("*") / LINK_ROWS, F.sum(F.octet_length("set")) / LINK_BYTES)
    return _in_blocks(full, blocks).groupBy("key", "lo", "hi").applyInPandas(_link(plan), "a long, b long")


def near_duplicates(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:  # noqa: B008
    """doc_id, n_shingles, component_id (the smallest doc_id reachable) and kept, a row per row of docs."""
    prints = stash(fingerprints(docs, plan), "prints")
    real = prints.where(F.col("sig").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "sig", F.struct("n_shingles", "h1", "h2").alias("set"))
    # The sets of most copies are looked up apart, so that no task meets all copies of one text.
    sets = stash(real.groupBy(F.col("set").alias("key")).agg(F.count("*").alias("n"), F.min("doc_id").alias("rep")), "sets")
    copies = stash(lookup(real, "set", sets).select("doc_id", F.col("_rep").alias("rep"), "sig"), "copies")
    reps = stash(copies.where("doc_id = rep").select("doc_id", "sig").dropDuplicates(["doc_id", "sig"]), "reps")
    # A doc_id of several texts links their sets.
    same_id = copies.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b")
    repeated = copies.join(same_id.select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))

    keys = reps.mapInArrow(_keys(plan), "key long, id long")
    mask = F.lit(SHUFFLED)
    pivots = keys.groupBy("key").agg(F.min(F.col("id").bitwiseXOR(mask)).alias("least"), F.count("*").alias("n")).where("n >= 2")
    pivots = stash(pivots.select("key", "n", F.col("least").bitwiseXOR(mask).alias("pivot"), (F.col("n") > 2).alias("more")), "pivots")
    members = stash(lookup(keys, "key", pivots).select("key", "id", F.col("_pivot").alias("pivot"), F.col("_more").alias("more")), "members")
    stars = members.where("id <> pivot").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()
    links = stash(confirmed(stash(within_radius(stars, reps, plan), "stars"), docs, plan), "links")
    edges = links.unionAll(repeated)
    comp = components(edges)
    more = stash(across(members.where("more").select("key", "id"), reps, comp, docs, plan), "across")
    if more.head(1):
        comp = components(edges.unionAll(more))
    label = comp.select(F.col("a").alias("rep"), F.col("b").alias("comp"))
    by_doc = copies.select("doc_id", "rep").join(label, "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("comp", "rep")).alias("comp"))
    out = prints.select("doc_id", "n_shingles").join(by_doc, "doc_id", "left")
    component = F.coalesce("comp", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
