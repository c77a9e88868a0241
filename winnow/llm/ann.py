"""Nearest neighbours by randomly rotated one-bit codes.

Rows are dealt to coarse lists by their nearest centre; the centres are fitted on a bounded sample of rows
(`sample`), every row is assigned. A row is taken relative to its list's centre, rotated by a fixed random rotation
and kept as the signs of its coordinates (packed bits) with two correction scalars: its distance to the centre and
the inner product of its unit vector with its code. A query's inner product with a row is estimated from the bits
alone; the estimate's error is below `bound` / sqrt(dim - 1) * sqrt(1 / f^2 - 1) but for a small probability, f being
the second scalar.

A search has three passes. The first meets a query with the codes of its nearest lists, in groups of a bounded number
of rows, and hands on per query and group the SHORT * k rows of the smallest estimates; merged, the SHORT * k best of a query
are measured exactly, and the k-th smallest distance is the query's bound. The second meets it with the codes of all
lists that may hold a row within that bound (by the triangle inequality, from the distance to the centre and the
largest reach) and picks the rows whose lower end doesn't exceed the bound: a packed list of ids per query and group.
The third brings the vectors that any query of a group picked to that group, once for all its queries, measures the picked ones
and hands on those within the bound. So the bounds choose which lists are read and what is reranked, a vector moves
once per block of queries at most, and rows handed on are few per query and group, however many were measured.

Groups are of one list and one block of it; queries go to them in blocks too. So no list, however full, and no
vector, however often repeated, makes a group larger than a block.

Defined cases: vectors that are null, zero, hold null or non-finite components, or have another length than
the commonest valid one (the longer among equally common) take no part, neither as queries nor as candidates; null
ids neither. Rows that repeat an id are one candidate with the nearest of its vectors, and never a candidate of
their own id. Ties go to the smaller id: rows at the bound itself are reranked. With fewer than k candidates all are
returned; an empty table gives an empty table. Further columns don't pass and may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from winnow.llm.common import small, stash

#: Rows and queries of a group at about, rows that fit the centres at about, rounds of fitting, and rows of a list at least.
BLOCK, QUERY_BLOCK, SAMPLE, ROUNDS, LEAST = 8192, 512, 20_000, 8, 512
#: Lists that a query meets first, and more as long as they hold fewer rows than so many times k.
FIRST, ENOUGH = 4, 20
#: Rows of the first pass that are measured for a query's bound, as a multiple of k.
SHORT = 4
FETCH = 4096


def rotation(dim: int, seed: int = 8) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def valid(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(axis=1)[:, None] + (y**2).sum(axis=1)[None, :] - 2 * x @ y.T, 0)


def fit_centres(x: np.ndarray, lists: int, seed: int = 9) -> np.ndarray:
    """Centres of the sample by a few rounds of k-means; a list that loses its rows keeps its centre."""
    lists = max(1, min(lists, len(x)))
    at = x[np.random.default_rng(seed).choice(len(x), lists, replace=False)].copy()
    for _ in range(ROUNDS):
        near = squares(x, at).argmin(axis=1)
        for i in np.unique(near):
            at[i] = x[near == i].mean(axis=0)
    return at


def _vectors(column: pa.Array) -> np.ndarray:
    """Rows of a column of lists of one length, in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _encode(centres: np.ndarray, turn: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (id, vector) -> id, list, code (packed signs), reach (distance to the centre) and match (inner product with the code)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, FETCH):
                batch = whole.slice(lo, FETCH)
                x = _vectors(batch.column("vector"))
                near = squares(x, centres).argmin(axis=1)
                around = x - centres[near]
                reach = np.sqrt((around**2).sum(axis=1))
                unit = around @ turn / np.where(reach > 0, reach, 1)[:, None]
                bits = np.packbits(unit > 0, axis=1)
                match = np.abs(unit).sum(axis=1) / np.sqrt(x.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(near, pa.int32()), pa.array([b.tobytes() for b in bits], pa.binary()), pa.array(reach), pa.array(match)],
                    names=["id", "list", "code", "reach", "match"],
                )

    return run


def estimates(code: np.ndarray, reach: np.ndarray, match: np.ndarray, query: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated squared distances of rotated queries (relative to the centre) to coded rows, and half widths of their intervals."""
    dim = query.shape[1]
    bits = np.unpackbits(code, axis=1, count=dim).astype(np.float32)
    norm = np.sqrt((query**2).sum(axis=1))
    unit = query / np.where(norm > 0, norm, 1)[:, None]
    dots = (2 * (unit.astype(np.float32) @ bits.T).astype(np.float64) - unit.sum(axis=1)[:, None]) / np.sqrt(dim)
    f = np.where(match > 0, match, 1)
    scale = 2 * norm[:, None] * reach[None, :]
    error = bound / np.sqrt(max(dim - 1, 1)) * np.sqrt(np.maximum(1 / f**2 - 1, 0))
    # the last term covers the rounding of the estimate itself
    return norm[:, None] ** 2 + reach[None, :] ** 2 - scale * dots / f, scale * error + 1e-5 * (scale + norm[:, None] ** 2 + reach[None, :] ** 2)


def _nearest_lists(size: np.ndarray, rows: int) -> Callable:
    """The nearest lists: FIRST of them, or more until they hold so many rows."""

    def which(far: np.ndarray, limit: np.ndarray) -> np.ndarray:
        order = np.argsort(np.where(size > 0, far, np.inf), axis=1)
        before = np.cumsum(size[order], axis=1) - size[order]
        take = ((np.arange(len(size)) < FIRST) | (before < rows)) & (size[order] > 0)
        out = np.zeros(far.shape, bool)
        np.put_along_axis(out, order, take, axis=1)
        return out

    return which


def _lists_within(size: np.ndarray, radius: np.ndarray) -> Callable:
    """The lists that may hold a row within a query's bound."""

    def which(far: np.ndarray, limit: np.ndarray) -> np.ndarray:
        return (far * (1 - 1e-6) - radius[None, :] * (1 + 1e-6) <= limit[:, None]) & (size > 0)

    return which


def _dealt(centres: np.ndarray, which: Callable) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Queries (id, raw, limit) with each list that they meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, QUERY_BLOCK):
                batch = whole.slice(lo, QUERY_BLOCK)
                q = np.frombuffer(b"".join(batch.column("raw").to_pylist()), "<f8").reshape(batch.num_rows, -1)
                i, j = np.nonzero(which(np.sqrt(squares(q, centres)), batch.column("limit").to_numpy()))
                met = batch.select(["id", "raw", "limit"]).take(pa.array(i))
                yield pa.RecordBatch.from_arrays([*met.columns, pa.array(j, pa.int32())], names=["id", "raw", "limit", "list"])

    return run


def _group(centres: np.ndarray, turn: np.ndarray, bound: float, then: Callable) -> Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """then(group, own ids, raw queries, limits, row ids, estimates, half widths) on 64 queries of a group at a time."""

    def run(group: tuple, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = [then(group, np.empty(0, np.int64), np.empty(0, object), np.empty(0), np.empty(0, np.int64), np.empty((0, 0)), np.empty((0, 0)))]
        if len(queries) and len(rows):
            code = np.frombuffer(b"".join(rows.code), np.uint8).reshape(len(rows), -1)
            q = (np.frombuffer(b"".join(queries.raw), "<f8").reshape(len(queries), -1) - centres[group[0]]) @ turn
            ids, own, raw, limit = rows.id.to_numpy(), queries.id.to_numpy(), queries.raw.to_numpy(), queries.limit.to_numpy()
            for lo in range(0, len(q), 64):
                part = slice(lo, lo + 64)
                near, half = estimates(code, rows.reach.to_numpy(), rows.match.to_numpy(), q[part], bound)
                near[own[part, None] == ids[None, :]] = np.inf  # its own id is infinitely far
                out.append(then(group, own[part], raw[part], limit[part], ids, near, half))
        return pd.concat(out)

    return run


def _shortest(short: int) -> Callable:
    """A group's rows of the smallest estimates of every query, of different ids."""

    def then(group, own, raw, limit, ids, near, half) -> pd.DataFrame:
        if near.shape[1] > 4 * short and len(np.unique(ids)) == len(ids):
            few = np.argpartition(near, short, axis=1)[:, :short]
            near, ids = np.take_along_axis(near, few, axis=1), ids[few]
        else:
            ids = np.broadcast_to(ids, near.shape)
        found = pd.DataFrame({"query_id": np.repeat(own, near.shape[1]), "id": ids.ravel(), "near": near.ravel()})
        found = found[np.isfinite(found.near)].sort_values("near").drop_duplicates(["query_id", "id"])
        return found.groupby("query_id").head(short)[["query_id", "id", "near"]]

    return then


PICKED = "list int, block int, qblock int, query_id long, raw binary, limit double, ids binary, wanted array<long>"


def _picked(group, own, raw, limit, ids, near, half) -> pd.DataFrame:
    """Per query the packed ids of the rows whose lower end doesn't exceed its bound, sorted, and a row of the ids that any picked."""
    within = ((near - half) <= limit[:, None] ** 2) & np.isfinite(near)
    rows = [(*group, o, r, at, np.unique(ids[w]).tobytes(), None) for o, r, at, w in zip(own, raw, limit, within, strict=True) if w.any()]
    if rows:
        rows.append((*group, None, None, None, None, np.unique(ids[within.any(axis=0)])))
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in PICKED.split(", ")])
    return out.astype({"query_id": "Int64", "limit": "Float64"})


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - y) ** 2).sum(axis=1))


def _measured(picked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    """Exact distances of a group's picked rows, as far as they lie within the bound; a row without vec_id counts all."""
    ids, found, counts = rows.id.to_numpy(np.int64), [], []
    x = np.frombuffer(b"".join(rows.raw), "<f8").reshape(len(rows), -1) if len(rows) else np.empty((0, 0))
    for own, raw, limit, packed in zip(picked.query_id, picked.raw, picked.limit, picked.ids, strict=True):
        asked = np.frombuffer(packed, np.int64)
        place = np.minimum(np.searchsorted(asked, ids), len(asked) - 1)
        at = np.flatnonzero(asked[place] == ids)
        far = distances(x[at], np.frombuffer(raw, "<f8"))
        close = far <= limit * (1 + 1e-12)
        found.append((np.full(close.sum(), own, np.int64), ids[at][close], far[close]))
        counts.append(len(at))
    own, vec, far = (np.concatenate([f[i] for f in found]) if found else np.empty(0) for i in range(3))
    hits = pd.DataFrame({"query_id": own.astype(np.int64), "vec_id": pd.array(vec.astype(np.int64), "Int64"), "score": far, "n": np.int64(0)})
    counted = pd.DataFrame({"query_id": picked.query_id.to_numpy(np.int64), "vec_id": pd.array([None] * len(counts), "Int64"), "score": np.nan, "n": np.array(counts, np.int64)})
    return pd.concat([hits, counted])


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distances of pairs (query_id, id, raw, asked)."""
    for batch in batches:
        if batch.num_rows:
            x, q = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<f8").reshape(batch.num_rows, -1) for c in ("raw", "asked"))
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("id"), pa.array(distances(x, q))], names=["query_id", "id", "score"])


def _raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = _vectors(batch.column("vector"))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([v.tobytes() for v in x], pa.binary())], names=["id", "raw"])


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, bound: float = 1.5, id_col: str = "vec_id", vector_col: str = "embedding", lists: int = 512, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (Euclidean distance) of the k nearest rows of every query row, and
    reranked, the number of rows that its bounds chose, whose exact distance was computed."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks")).where(F.col("id").isNotNull() & valid(F.col("vector")))
    sizes = rows.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, reranked long")
    dim, n = sizes[0].dim, sizes[0].n
    rows = rows.where(F.size("vector") == dim)
    share = min(1.0, sample / n)
    picked = rows.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 20)) < share * (1 << 20)).select("vector").limit(2 * sample)
    fitted = np.array([r.vector for r in picked.collect()], np.float64).reshape(-1, dim)
    centres = fit_centres(fitted, min(lists, max(1, n // LEAST))) if len(fitted) else np.zeros((1, dim))
    turn = rotation(dim)

    coded = stash(rows.select("id", "vector").mapInArrow(_encode(centres, turn), "id long, list int, code binary, reach double, match double"), "codes")
    held = coded.groupBy("list").agg(F.count("*").alias("n"), F.max("reach").alias("reach")).collect()  # a row per list
    size, radius = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    for r in held:
        size[r["list"]], radius[r["list"]] = r.n, r.reach
    raw = rows.select("id", "vector").mapInArrow(_raw, "id long, raw binary")
    asking = stash(rows.where("asks").select("id", "vector").mapInArrow(_raw, "id long, raw binary"), "asking")

    def pairs(queries: DataFrame, which: Callable, then: Callable, schema: str) -> DataFrame:
        left = stash(queries.mapInArrow(_dealt(centres, which), "id long, raw binary, limit double, list int"), "asked-lists")
        asked = left.groupBy("list").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("qblocks")).collect()
        counts = spark.createDataFrame([(r["list"], r.qblocks, int(-(-size[r["list"]] // BLOCK))) for r in asked], "list int, qblocks int, blocks int")
        upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        by_hash = lambda c, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(c)).cast("int")
        left = left.join(F.broadcast(counts), "list").withColumn("qblock", by_hash("qblocks", 7)).withColumn("block", upto("blocks")).drop("qblocks", "blocks")
        right = coded.join(F.broadcast(counts), "list").withColumn("block", by_hash("blocks", 5)).withColumn("qblock", upto("qblocks")).drop("qblocks", "blocks")
        on = ["list", "block", "qblock"]
        return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInPandas(_group(centres, turn, bound, then), schema)

    asked_by = asking.select(F.col("id").alias("query_id"), F.col("raw").alias("asked"))
    short = pairs(asking.withColumn("limit", F.lit(0.0)), _nearest_lists(size, ENOUGH * k), _shortest(SHORT * k), "query_id long, id long, near double")
    place = lambda by: F.row_number().over(W.partitionBy("query_id").orderBy(by, "id"))
    short = short.groupBy("query_id", "id").agg(F.min("near").alias("near")).withColumn("r", place("near")).where(F.col("r") <= SHORT * k)
    both = short.select("query_id", "id").join(raw, "id").join(asked_by, "query_id")
    exact = both.mapInArrow(_exact, "query_id long, id long, score double").groupBy("query_id", "id").agg(F.min("score").alias("score"))
    limits = stash(exact.withColumn("r", place("score")).where(F.col("r") == k).select(F.col("query_id").alias("id"), F.col("score").alias("limit")), "limits")
    bounded = asking.join(small(limits), "id", "left").withColumn("limit", F.coalesce("limit", F.lit(float("inf"))))

    picked = stash(pairs(bounded, _lists_within(size, radius), _picked, PICKED), "picked")
    group = ["list", "block", "qblock"]
    wanted = picked.where("query_id is null").select(*group, F.explode("wanted").alias("id")).distinct().join(raw, "id")
    asked = picked.where("query_id is not null").select(*[F.col(c).alias(c) for c in group], "query_id", "raw", "limit", "ids")  # attributes of its own
    measured = asked.groupBy(*group).cogroup(wanted.groupBy(*group)).applyInPandas(_measured, "query_id long, vec_id long, score double, n long")
    best = measured.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"), F.sum("n").alias("n"))
    order = W.partitionBy("query_id").orderBy(F.col("vec_id").isNull(), "score", "vec_id")
    ranked = best.withColumns({"rank": F.row_number().over(order), "reranked": F.sum("n").over(W.partitionBy("query_id"))}).where((F.col("rank") <= k) & F.col("vec_id").isNotNull())
    return ranked.select("query_id", "rank", "vec_id", "score", "reranked")
