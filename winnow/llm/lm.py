"""Language-model scores from a probabilistic suffix tree over words.

Tokens are words `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z, then one end per document; every distinct word is
a symbol of its own, known by its 64-bit hash. The root's distribution is (c + 0.5) / (N + 0.5 (V + 1)). The
probability of a token is that after the longest retained context of up to `depth` tokens before it; before a
text stands one end, and no context reaches further back.

The tree: a pair (context s, next token w) is kept if it occurs at least `least` times in the training part, a fixed
count, so the tree grows with the input. With n(s) the context's count, K the number of its kept pairs, T their sum
and q the distribution of its longest retained suffix, s is retained if its own distribution diverges from q:
sum of n ln(n / n(s) / q(w)) over the kept pairs, plus (n(s) - T) ln((n(s) - T) / n(s) / (1 - sum of their q)) for
all other tokens, is at least half of K ln(n(s)), a minimum-description-length test. Its distribution is smoothed with
q: (n + (K + n(s) - T) q(w)) / (n(s) + K), n being 0 for pairs that aren't kept. So a context changes a token's
log-probability by a value of the pair, or by one of the context if the pair isn't kept, and a score is the base
score plus values that are looked up by the last one to `depth` + 1 tokens at every place.

Pairs are counted level by level. Of a longer pair only those places are counted whose two shorter parts are kept
themselves (bitmaps of a fixed size let others pass now and then; the counts decide). A task combines equal pairs of
its own and hands them on packed by bucket, a bucket's groups are bounded and of pairs by hash, so no frequent word
or context meets in one task. Contexts, pairs and values are tables, joined by key; rows of the largest counts are
broadcast, at most a fixed number, the rest is shuffled. Between tasks, runs of the commonest words go as two bytes a
word instead of their keys, compressed; any other run goes as its key.

All counts cover the whole training part. Words with a count of at least the threshold that leaves at most
`head` words go to the workers; all others, and what the tree holds beyond its most frequent rows, are looked up by
bucket: chunks of rows ask a bucket of the table with packed keys and get sums back, one slice of the documents after
another.

Defined cases: a null text is the end alone; without training rows every count is 0 and the tree is empty;
rows that repeat a doc_id are scored row by row; a null doc_id is held out; a text of any length is scored whole;
an empty table gives an empty table; further columns don't matter, whatever their names. Equally frequent words or
pairs need no order: all of a count are treated alike.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.common import ROOM, bands_of, lookup, stash, task_memos, threshold_of, tidy, unstash

#: The end's id, that of an empty word.
END = np.uint64(xxhash.xxh3_64_intdigest(b""))
FETCH = 1024
#: Tokens whose pairs a task combines at a time; bytes of packed pairs, and of packed lookups, that a bucket holds at about.
CHUNK, PAIR_BYTES, LOOKUP_BYTES = 1_000_000, 4 << 20, 24 << 20
#: log2 of a bitmap's bits, 4 MB, and the most that a large table makes of it, 32 MB.
BITS, MOST_BITS = 25, 28
#: Slices of the documents that are scored one after another, and training tokens from which on there is one more.
SLICES, SLICE_TOKENS = 4, 4_000_000
#: Words that have a code of two bytes.
CODES = 1 << 16
STEP = np.uint64(0x9E3779B97F4A7C15)


def ids_of(text: bytes | None) -> np.ndarray:
    """Ids of a text's tokens after one end."""
    words = (text or b"").lower().split()
    out = np.full(len(words) + 2, END, np.uint64)
    out[1:-1] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return out


def chunks_of(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[np.ndarray]]:
    """The ids of a task's texts, so many tokens at a time."""
    texts, held = [], 0
    for batch in batches:
        for lo in range(0, batch.num_rows, FETCH):
            for t in batch.column("text").slice(lo, FETCH).cast(pa.binary()).to_pylist():
                texts.append(ids_of(t))
                held += len(texts[-1])
                if held >= size:
                    yield texts
                    texts, held = [], 0
    if texts:
        yield texts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with task_memos():
        for texts in chunks_of(batches, 2 * CHUNK):
            keys, n = np.unique(np.concatenate([t[1:] for t in texts]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["key", "n"])


@dataclass
class Vocabulary:
    """tokens N and distinct V of the training part; keys and logs of the frequent words, sorted; the log of a word
    that isn't known; the keys of the words that have codes, sorted."""

    tokens: int
    distinct: int
    threshold: int
    keys: np.ndarray
    logs: np.ndarray
    unknown: float
    coded: np.ndarray


def columns_of(df: DataFrame, *kinds: type) -> list[np.ndarray]:
    """A bounded table's columns on the driver, by Arrow: as rows they take there more than ten times the memory."""
    with task_memos():
        found = df.toArrow()
        return [found.column(c).to_numpy().astype(k if k is np.float64 else np.int64).view(k) for c, k in zip(df.columns, kinds, strict=True)]


def vocabulary(training: DataFrame, head: int) -> tuple[Vocabulary, DataFrame]:
    """Counts over all training texts, as a table (key, n, logp) and what the workers need of them."""
    counts = stash(training.select("text").mapInArrow(_count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "word-counts")
    bands = bands_of(counts, "n")
    threshold, tokens, distinct = threshold_of(bands, head), sum(b.n for b in bands), sum(b.rows for b in bands)
    whole = tokens + 0.5 * (distinct + 1)
    words = counts.withColumn("logp", F.log10((F.col("n") + 0.5) / F.lit(whole)))
    words._stash_path = counts._stash_path
    keys, n, logs = columns_of(words.where(F.col("n") >= threshold).select("key", "n", "logp"), np.uint64, np.int64, np.float64)
    order = np.argsort(keys)
    coded = np.sort(keys[n >= max(threshold, threshold_of(bands, CODES))])
    return Vocabulary(tokens, distinct, threshold, keys[order], logs[order], math.log10(0.5 / whole), coded), words


def grams(ids: np.ndarray, longest: int) -> list[np.ndarray]:
    """At k - 1 the keys of the k tokens up to each place. They hold where a text has so many."""
    found = [ids]
    for _ in range(1, longest):
        key = ids.copy()
        key[1:] += STEP * found[-1][:-1]
        found.append(key)
    return found


def places_of(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token ids of all texts, each after one end, the row of each and its place in the text."""
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    ids = np.concatenate(texts) if texts else np.empty(0, np.uint64)
    return ids, np.repeat(np.arange(len(n)), n), np.arange(len(ids)) - np.repeat(np.cumsum(n) - n, n)


def bitmap(keys: DataFrame, rows: int) -> np.ndarray:
    """Two bits for each of so many keys, at its top and its low bits; the table is doubled while keys fill an eighth."""
    size = BITS
    while size < MOST_BITS and rows * 8 > 1 << size:
        size += 1
    places = F.explode(F.array(F.shiftrightunsigned("key", 64 - size), F.col("key").bitwiseAND(F.lit((1 << size) - 1))))
    at, bits = columns_of(keys.select(places.alias("i")).groupBy(F.shiftright("i", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(i & 63 as int)))").alias("bits")), np.int64, np.uint64)
    found = np.zeros(1 << (size - 6), np.uint64)
    found[at] = bits
    return found


def may_have(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    size = len(bits).bit_length() + 5
    out = np.ones(len(keys), bool)
    for shift in (64 - size, 0):
        some = np.flatnonzero(out)
        at = keys[some] >> np.uint64(shift) & np.uint64((1 << size) - 1)
        out[some] = (bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return out


def found_at(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in sorted keys, and which of them hold what is asked."""
    if not len(keys):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return at, keys[at] == asked


class Index:
    """Sorted keys by their top bits; where several share these, by search."""

    def __init__(self, keys: np.ndarray):
        slot = (keys >> np.uint64(44)).astype(np.int64)
        self.keys, self.first, self.crowded = keys, np.zeros(1 << 20, np.uint32), np.bincount(slot, minlength=1 << 20) > 1
        self.first[slot] = np.arange(len(keys))

    def find(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return found_at(self.keys, asked)
        slot = asked >> np.uint64(44)
        at = self.first[slot]
        here = self.keys[at] == asked
        some = np.flatnonzero(self.crowded[slot] & ~here)
        at[some], here[some] = found_at(self.keys, asked[some])
        return at, here


def codes_of(ids: np.ndarray, coded: Index, longest: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The tokens' codes; at k - 1 whether all of the k tokens up to a place have one."""
    code, has = coded.find(ids)
    runs = [has]
    for _ in range(1, longest):
        run = has.copy()
        run[1:] &= runs[-1][:-1]
        runs.append(run)
    return code.astype(np.uint16), runs


def planes(values: np.ndarray) -> bytes:
    """The bytes of numbers: all first ones, all second ones and so on, which compress better."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def of_planes(blob: bytes, kind: type, n: int, at: int = 0) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8, n * size, at).reshape(size, n).T).view(kind).reshape(n)


def keys_of_codes(codes: list[np.ndarray], coded: np.ndarray) -> list[np.ndarray]:
    """Keys of the first token, the first two and so on, the farthest one first."""
    keys = [coded[codes[0]]]
    for c in codes[1:]:
        keys.append(coded[c] + STEP * keys[-1])
    return keys


def squeezed(parts: list[bytes]) -> tuple[bytes, int]:
    """Bytes put together, compressed, and how many they were."""
    whole = b"".join(parts)
    return pa.compress(whole, "zstd", asbytes=True), len(whole)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """By the low half of a mixed key, as the top bits are the bitmap's."""
    return ((keys * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the keys by bucket, and where each bucket ends in it."""
    at = bucket_of(keys, buckets)
    order = np.argsort(at, kind="stable")
    return order, np.concatenate([[0], np.cumsum(np.bincount(at, minlength=buckets))])


def _pairs(shared, length: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Contexts of that length and next tokens, equal ones combined: per bucket packed contexts, tokens and counts, first
    pairs with codes for both, then for the context, for the token, for none; and how many there are of each."""

    def packed(texts: list[np.ndarray], coded: Index) -> pa.RecordBatch:
        bits = shared.value[0]
        ids, _, place = places_of(texts)
        keys = grams(ids, length)
        at = np.flatnonzero(place >= length)
        at = at[may_have(bits, keys[-1][at - 1])]  # both shorter parts may be kept
        at = at[may_have(bits, keys[-1][at])]
        pair, first, n = np.unique(ids[at] + STEP * keys[-1][at - 1], return_index=True, return_counts=True)
        at, n, bucket = at[first], n.astype(np.uint32), bucket_of(pair, buckets)
        code, runs = codes_of(ids, coded, length)
        kind = 2 * ~runs[-1][at - 1] + ~runs[0][at]
        # equal contexts' (else tokens') codes side by side
        order = np.argsort((bucket << 2 | kind) << 16 | np.where(kind < 2, code[at - 1], np.where(kind == 2, code[at], 0)))
        at, n = at[order], n[order]
        ends = np.concatenate([[0], np.cumsum(np.bincount(bucket << 2 | kind, minlength=4 * buckets))]).tolist()
        full, blobs, sizes = [], [], []
        for b in range(buckets):
            e = ends[4 * b : 4 * b + 5]
            if e[0] < e[4]:
                ctx, other, word, rest = at[e[0] : e[2]] - 1, at[e[2] : e[4]] - 1, (at[e[0] : e[1]], at[e[2] : e[3]]), (at[e[1] : e[2]], at[e[3] : e[4]])
                parts = [planes(code[ctx - k]) for k in range(length - 1, -1, -1)] + [planes(keys[-1][other])] + [planes(code[w]) for w in word] + [planes(ids[w]) for w in rest]
                blob, size = squeezed([*parts, planes(n[e[0] : e[4]])])
                full.append(b)
                blobs.append(blob)
                sizes.append((*(e[k + 1] - e[k] for k in range(4)), size))
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(sizes, pa.list_(pa.int64())), pa.array(blobs, pa.binary())], names=["bucket", "sizes", "pairs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_memos():
            coded = Index(shared.value[1])
            for texts in chunks_of(batches, CHUNK):
                yield packed(texts, coded)

    return run


def _kept(shared, length: int, least: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Pairs of a bucket that occur at least so many times."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        with task_memos():
            coded, found = shared.value[1], []
            for (both, context, token, none, size), blob in zip(pdf.sizes, pdf.pairs, strict=True):
                blob, at = pa.decompress(blob, int(size), "zstd", asbytes=True), 0

                def read(kind: type, m: int) -> np.ndarray:
                    nonlocal at
                    at += m * np.dtype(kind).itemsize
                    return of_planes(blob, kind, m, at - m * np.dtype(kind).itemsize)  # noqa: B023  read at once

                ctx = keys_of_codes([read(np.uint16, both + context) for _ in range(length)], coded)[-1]
                other = read(np.uint64, token + none)
                words = [coded[read(np.uint16, m)] for m in (both, token)]
                rest = [read(np.uint64, m) for m in (context, none)]
                ctx, word = np.concatenate([ctx, other]), np.concatenate([words[0], rest[0], words[1], rest[1]])
                found.append((word + STEP * ctx, ctx, read(np.uint32, both + context + token + none)))
            key, ctx, n = map(np.concatenate, zip(*found, strict=True))
            order = np.argsort(key)
            key = key[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            total = np.add.reduceat(n[order], first, dtype=np.int64)
            at = first[total >= least]
            key, ctx = key[at], ctx[order[at]]
            return pd.DataFrame({"key": key.view(np.int64), "ctx": ctx.view(np.int64), "word": (key - STEP * ctx).view(np.int64), "n": total[total >= least]})

    return run


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The token after the context's own shorter form. (Products wrap around, which a column's don't.)"""
    for batch in batches:
        word, suffix = (batch.column(c).to_numpy().view(np.uint64) for c in ("short", "suffix"))
        yield batch.set_column(batch.schema.get_field_index("short"), "short", pa.array((word + STEP * suffix).view(np.int64)))


def grow(training: DataFrame, words: DataFrame, depth: int, least: int, vocab: Vocabulary) -> DataFrame:
    """(key, n, value) of the last tokens at a place: what the log10 probability gains by the kept pair that they are,
    and what that of the next token gains (loses) by the retained context that they are."""
    spark, parts, spent = training.sparkSession, [], []
    # the end before a text counts as a context once a text, no more often than the end after it
    below = words.where(F.col("n") >= least).select("key", "n", "logp", F.lit(0).cast("long").alias("short"))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-vocab.tokens * 16 // PAIR_BYTES))
    for length in range(1, depth + 1):
        shared = spark.sparkContext.broadcast((bitmap(below, below.count()), vocab.coded))
        packed = training.select("text").mapInArrow(_pairs(shared, length, buckets), "bucket long, sizes array<long>, pairs binary")
        pairs = raw = stash(packed.groupBy("bucket").applyInPandas(_kept(shared, length, least), "key long, ctx long, word long, n long"), "pairs")
        shared.destroy()
        # the pair without its farthest token is the token alone, or the context's own shorter form with the token
        pairs = lookup(pairs, "ctx", below.select("key", "n", F.col("n").alias("total"), F.col("short").alias("suffix")))
        pairs = pairs.select("key", "ctx", "n", F.col("_total").alias("total"), F.col("word").alias("short"), F.col("_suffix").alias("suffix"))
        if length > 1:
            pairs = pairs.mapInArrow(_short, pairs.schema)
        under = lookup(pairs, "short", below.select("key", "n", "logp")).select("key", "ctx", "short", "n", "total", F.col("_logp").alias("under"))
        held = stash(under, "held-pairs")
        unstash(raw)
        n, t, kinds = F.col("n"), F.col("total"), F.col("kinds")
        sums = held.groupBy("ctx").agg(
            F.max("total").alias("total"), F.sum("n").alias("seen"), F.count("*").alias("kinds"), F.sum(n * (F.log("n") - F.log("total") - math.log(10) * F.col("under"))).alias("gain"),
            F.sum(F.pow(F.lit(10.0), F.col("under"))).alias("mass"),
        )
        rest = t - F.col("seen")
        gain = F.col("gain") + F.when(rest > 0, rest * (F.log(rest) - F.log(t) - F.log(F.greatest(1 - F.col("mass"), F.lit(1e-12))))).otherwise(0.0)
        tested = sums.where(gain >= 0.5 * kinds * F.log(t)).select(F.col("ctx").alias("key"), F.col("total").alias("n"), (t + kinds).alias("whole"), (kinds + rest).alias("free"))
        tested = stash(tested, "contexts")
        parts.append(tested.select("key", "n", F.log10(F.col("free") / F.col("whole")).alias("value")))
        own = F.log10((n + F.col("_free") * F.pow(F.lit(10.0), F.col("under"))) / F.col("_whole"))
        known = lookup(held, "ctx", tested, keep=True)
        logp = F.coalesce(own, F.col("under"))
        below = stash(known.select("key", "n", logp.alias("logp"), "short", (own - F.col("under") - F.log10(F.col("_free") / F.col("_whole"))).alias("value")), "levels")
        unstash(held)
        spent += [tested, below]
        parts.append(below.where("value is not null").select("key", "n", "value"))
        del packed, pairs, raw, under, held, sums, known
        tidy(spark)
    tree = stash(reduce(DataFrame.unionAll, parts).groupBy("key").agg(F.max("n").alias("n"), F.sum("value").alias("value")), "tree")
    for held in spent:
        unstash(held)
    return tree


ASKED = "chunk long, bucket long, sizes binary, asked binary, own binary"


def ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _score(shared, depth: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per chunk of rows and bucket what must be looked up, with the number of the row of each in its chunk: packed codes
    of one token, of two and so on, then keys; and per chunk its rows with the sums of what is known here (rare words as unknown ones), packed and dealt to
    one of the buckets. Rare words' buckets come after the tree's."""

    def scored(batch: pa.RecordBatch, chunk: int, known_words: Index, head: Index, coded: Index) -> pa.RecordBatch:
        vocab, bits, _, values = shared.value
        rows = batch.num_rows
        ids, row, place = places_of([ids_of(t) for t in batch.column("text").cast(pa.binary()).to_pylist()])
        token = np.flatnonzero(place >= 1)
        at, known = known_words.find(ids[token])
        n, heads = np.bincount(row[token], minlength=rows), np.bincount(row[token][known], minlength=rows)
        base = np.bincount(row[token][known], vocab.logs[at[known]], rows) + (n - heads) * vocab.unknown
        rare = token[~known]
        last = np.zeros(len(ids), bool)
        last[np.cumsum(n + 1) - 1] = True
        code, runs = codes_of(ids, coded, depth + 1)
        outer, sets, others, of = np.zeros(rows), [], [], []
        for k, keys in enumerate(grams(ids, depth + 1)):
            where = np.flatnonzero((place >= k) & ~(last & (k == 0)))  # no token follows the last
            where = where[may_have(bits, keys[where])]
            at, here = head.find(keys[where])
            outer += np.bincount(row[where[here]], values[at[here]], rows)
            where = where[~here]
            plain = runs[k][where]
            sets.append((keys[where[plain]], [code[where[plain] - j] for j in range(k, -1, -1)], row[where[plain]]))
            others.append(keys[where[~plain]])
            of.append(row[where[~plain]])
        sets.append((np.concatenate(others), [np.concatenate(others)], np.concatenate(of)))
        own = pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(n), pa.array(heads), pa.array(base), pa.array(outer)], names=["doc_id", "held_out", "n", "heads", "base", "outer"])
        none = (np.empty(0, np.uint64), [np.empty(0, np.uint16)], np.empty(0, np.int64))
        dealt, blobs = [], [[], []]
        for first, kinds in ((0, sets), (buckets, [none] * (depth + 1) + [(ids[rare], [ids[rare]], row[rare])])):
            cut = []
            for key, columns, who in kinds:  # by bucket, and within one by row
                order, ends = by_bucket(key, buckets)
                cut.append(([c[order] for c in columns], who[order].astype(np.uint16), ends))
            for b in np.flatnonzero(sum(np.diff(ends) for _, _, ends in cut)):
                parts = [(columns, who, slice(ends[b], ends[b + 1])) for columns, who, ends in cut]
                blob, size = squeezed([planes(x[at]) for columns, who, at in parts if at.stop > at.start for x in (*columns, who)])
                dealt.append(int(b) + first)
                blobs[0].append(np.array([*(at.stop - at.start for _, _, at in parts), size], np.int64).tobytes())
                blobs[1].append(blob)
        dealt.append(chunk % (2 * buckets))
        return pa.RecordBatch.from_arrays(
            [pa.array([chunk] * len(dealt), pa.int64()), pa.array(dealt, pa.int64()), *(pa.array([*x, None], pa.binary()) for x in blobs), pa.array([None] * (len(dealt) - 1) + [ipc(own)], pa.binary())],
            names=["chunk", "bucket", "sizes", "asked", "own"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 24
        with task_memos():
            vocab, _, head, _ = shared.value
            indexes = [Index(x) for x in (vocab.keys, head, vocab.coded)]
            for whole in batches:
                for lo in range(0, whole.num_rows, FETCH):
                    yield scored(whole.slice(lo, FETCH), chunk, *indexes)
                    chunk += 1

    return run


def _with_bucket(buckets: int, first: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = bucket_of(batch.column("key").to_numpy().view(np.uint64), buckets) + first
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("value"), pa.array(at)], names=["key", "value", "bucket"])

    return run


def _shelf(pdf: pd.DataFrame) -> pd.DataFrame:
    """A bucket of the table, packed in order of the keys."""
    keys = pdf.key.to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    blob, size = squeezed([planes(keys[order]), pdf.value.to_numpy(np.float64)[order].tobytes()])
    return pd.DataFrame({"bucket": [pdf.bucket.iloc[0]], "size": [size], "held": [blob]})


def _asked(sizes: bytes, blob: bytes, coded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys that are asked for, and the row of each."""
    *counts, size = np.frombuffer(sizes, np.int64).tolist()
    blob, at, keys, rows = pa.decompress(blob, size, "zstd", asbytes=True), 0, [], []
    for k, m in enumerate(counts):
        if not m:
            continue
        if k < len(counts) - 1:
            keys.append(keys_of_codes([of_planes(blob, np.uint16, m, at + 2 * m * j) for j in range(k + 1)], coded)[-1])
            at += 2 * m * (k + 1)
        else:
            keys.append(of_planes(blob, np.uint64, m, at))
            at += 8 * m
        rows.append(of_planes(blob, np.uint16, m, at))
        at += 2 * m
    return np.concatenate(keys), np.concatenate(rows)


def _look(shared, buckets: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Per chunk the sums of the values that its rows ask this bucket for, and how many words were found; and the rows of
    the chunks that were dealt to it."""

    def run(asked: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        keys, values, out = np.empty(0, np.uint64), np.empty(0), []
        for size, held in zip(table["size"], table.held, strict=True):  # one row, or none
            held = pa.decompress(held, int(size), "zstd", asbytes=True)
            keys, values = of_planes(held, np.uint64, len(held) // 16), np.frombuffer(held, np.float64, offset=len(held) // 2)
        for chunk, bucket, sizes, blob, own in zip(asked.chunk, asked.bucket, asked.sizes, asked.asked, asked.own, strict=True):
            if own is not None:
                out.append((chunk, False, b"", b"", b"", own))
                continue
            of_key, row = _asked(sizes, blob, shared.value[0].coded)
            at, some = found_at(keys, of_key)
            row = row[some]
            if not len(row):
                continue
            rows, words = np.unique(row), bucket >= buckets
            sums, n = np.bincount(row, values[at[some]]), np.bincount(row)
            out.append((chunk, words, rows.tobytes(), sums[rows].tobytes(), n[rows].astype(np.int64).tobytes() if words else b"", None))
        return pd.DataFrame(out, columns=["chunk", "words", "rows", "sums", "n", "own"]).astype({"chunk": "int64", "words": "bool"})

    return run


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    """A chunk's rows with the sums over all buckets."""
    own = pa.ipc.open_stream(next(x for x in pdf.own if x is not None)).read_all()
    n_tokens, known, base, outer = (own.column(c).to_numpy() for c in ("n", "heads", "base", "outer"))

    def total(words: bool, column: str, kind: type) -> np.ndarray:
        part = pdf[pdf.words == words]
        return np.bincount(np.frombuffer(b"".join(part.rows), np.uint16), np.frombuffer(b"".join(part[column]), kind), len(base))

    base = base + total(True, "sums", np.float64)
    ids = pd.array(own.column("doc_id").to_pylist(), "Int64")
    known = known + total(True, "n", np.int64).astype(np.int64)
    return pd.DataFrame({"doc_id": ids, "held_out": own.column("held_out").to_pylist(), "n_tokens": n_tokens, "n_known": known, "base_score": base, "score": base + outer + total(False, "sums", np.float64)})


def score(docs: DataFrame, head: int = 100_000, depth: int = 3, least: int = 8) -> DataFrame:
    """docs (doc_id, text, held_out; learnt from where not held_out) -> doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score (by single words) and score (by the tree), in log10.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", "held_out")
    training = docs.where(~F.col("held_out"))
    vocab, words = vocabulary(training, head)
    tidy(spark)
    tree = grow(training, words, depth, least, vocab)

    tidy(spark)
    bands = bands_of(tree, "n")
    threshold = threshold_of(bands, ROOM)
    keys, values = columns_of(tree.where(F.col("n") >= threshold).select("key", "value"), np.uint64, np.float64)
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast((vocab, bitmap(tree, sum(b.rows for b in bands)), keys[order], values[order]))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-vocab.tokens * 16 // LOOKUP_BYTES))
    schema = "key long, value double, bucket long"
    table = tree.where(F.col("n") < threshold).select("key", "value").mapInArrow(_with_bucket(buckets, 0), schema)
    rare = words.where(F.col("n") < vocab.threshold).select("key", (F.col("logp") - F.lit(vocab.unknown)).alias("value"))
    table = table.unionAll(rare.mapInArrow(_with_bucket(buckets, buckets), schema))
    table = stash(table.groupBy("bucket").applyInPandas(_shelf, "bucket long, size long, held binary"), "values")
    unstash(tree)
    unstash(words)
    del tree, words, rare
    # slice by slice, so that only one's lookups are on disk at a time; by value, as a row's place may change between reads
    slices, parts = max(1, min(SLICES, vocab.tokens // SLICE_TOKENS)), []
    for k in range(slices):
        tidy(spark)
        own = docs if slices == 1 else docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(slices)) == k)
        asked = own.mapInArrow(_score(shared, depth, buckets), ASKED)
        sums = asked.groupBy("bucket").cogroup(table.groupBy("bucket")).applyInPandas(_look(shared, buckets), "chunk long, words boolean, rows binary, sums binary, n binary, own binary")
        parts.append(stash(sums.groupBy("chunk").applyInPandas(_added, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"), "scores"))
        del own, asked, sums
    unstash(table)
    del table
    tidy(spark)
    return reduce(DataFrame.unionAll, parts).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(vocab.tokens).cast("long").alias("train_tokens"), "base_score", "score")
