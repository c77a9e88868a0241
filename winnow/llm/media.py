"""Content-defined chunking of media payloads.

A payload (a text's UTF-8 bytes with zero bytes up to a positive multiple of 64) becomes a media file: a
44-byte WAV header for 8-bit mono samples and the payload as samples. Payloads are cut by a rolling gear hash
over the last 32 bytes: a cut stands where its high bits are zero, at least `least` and at most `most` bytes
after the one before, about 190 bytes on average. So equal passages give equal chunks wherever they stand, also
those of a few lines; the header, which holds the file's length, is kept apart from the chunks.

Chunk digests (128 bits of BLAKE2b) are deduplicated by Spark joins on digests alone: a count by a 64-bit hash
leaves those that may occur more than once, and of each digest that does, the smallest (document, position) owns the
bytes. Rows of a frequent digest meet its owner by a broadcast of a fixed number of rows, never in one task. The store keeps a row per document: the ordered
digests and lengths, the header, the bytes of the chunks that it owns, which of these it lends and how often the rarest
that it borrows occurs. To read a document back, the most frequent borrowed chunks, of a fixed number of bytes at most,
go to all readers, so that no other digest holds more than about a thousandth of what is asked for; the rest is fetched by
a join on the digest, and only documents that need a chunk of these move, each with its own bytes as one compressed
piece, as they are stored. Every chunk is checked against its digest and every file against its SHA-256, before the samples are read.

Defined cases: a null text counts as empty (64 zero bytes); rows that repeat a doc_id are separate texts;
rows that repeat doc_id and text are stored and read alike, each with its bytes; a null doc_id owns and
refers like any other; equal texts give equal values; texts of any length are stored whole; further columns don't pass and may have any
name; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.common import ENTRY_BYTES, bands_of, lookup, small, stash, threshold_of, unstash

RATE, UNIT, HEADER, DIGEST = 8000, 64, 44, 16
FETCH = 512
#: Bytes of the most frequent borrowed chunks that go to every reader, at every size of the input: about a thousand chunks.
HOT_BYTES = 1 << 18


@dataclass(frozen=True)
class Cuts:
    """Sizes of chunks in bytes; a cut's chance at a byte is 2^-bits."""

    least: int = 64
    bits: int = 7
    most: int = 1024


@lru_cache(maxsize=1)
def gears() -> np.ndarray:
    return np.random.default_rng(31).integers(0, 1 << 32, 256, np.uint32)


def payload_of(text: bytes | None) -> bytes:
    text = text or b""
    return text + bytes(-len(text) % UNIT if text else UNIT)


def header_of(payload: bytes) -> bytes:
    """8-bit mono samples."""
    return b"RIFF" + struct.pack("<I", HEADER - 8 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(payload))


def wav(payload: bytes) -> bytes:
    return header_of(payload) + payload


def samples(media: bytes) -> bytes:
    """The samples of a stored file, found by its chunks' lengths."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while media[at : at + 4] != b"data":
        at += 8 + struct.unpack_from("<I", media, at + 4)[0]
    return media[at + 8 : at + 8 + struct.unpack_from("<I", media, at + 4)[0]]


def cut(payload: bytes, cuts: Cuts) -> list[int]:
    """The ends of a payload's chunks."""
    h = gears()[np.frombuffer(payload, np.uint8)]
    for span in (1, 2, 4, 8, 16):  # h[i] = sum of gear[byte i - j] << j over the last 32 bytes
        h[span:] += h[:-span] << np.uint32(span)
    marks = np.flatnonzero(h >> np.uint32(32 - cuts.bits) == 0) + 1
    ends, start, n, i = [], 0, len(payload), 0
    while n - start > cuts.least:
        i = int(np.searchsorted(marks, start + cuts.least))
        end = min(int(marks[i]) if i < len(marks) else n, start + cuts.most, n)
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return ends


def _chunks(payload: bytes, cuts: Cuts) -> list[bytes]:
    ends = cut(payload, cuts)
    return [payload[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def digest_of(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=DIGEST).digest()


def _digests(cuts: Cuts) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, FETCH):
                batch = whole.slice(lo, FETCH)
                row, place, size, digest = [], [], [], []
                for i, t in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                    for j, c in enumerate(_chunks(payload_of(t), cuts)):
                        row.append(i)
                        place.append(j)
                        size.append(len(c))
                        digest.append(digest_of(c))
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("thash").take(at), pa.array(place, pa.int32()), pa.array(size, pa.int32()), pa.array(digest, pa.binary())], names=["id", "thash", "place", "size", "digest"])

    return run


#: The written form: digests, lengths and a bit a chunk (whether it is the document's own) end to end, and the own chunks'
#: bytes as one compressed piece.
PACKED = "id long, thash long, n_bytes long, media_sha256 string, header binary, digests binary, lengths binary, own binary, body binary, foreign array<int>, lent array<int>, fewest long"
#: The same with its chunks apart.
STORE = "id long, thash long, n_bytes long, media_sha256 string, header binary, digests array<binary>, lengths array<int>, chunks array<binary>, lent array<int>, fewest long"


def _store(cuts: Cuts) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for whole in batches:
            for lo in range(0, whole.num_rows, FETCH):
                batch = whole.slice(lo, FETCH)
                size, media_sha, packed = [], [], {k: [] for k in ("header", "digests", "lengths", "own", "body")}
                for t, foreign in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("foreign").to_pylist(), strict=True):
                    payload, other = payload_of(t), set(foreign or ())
                    parts = _chunks(payload, cuts)
                    size.append(len(t or b""))
                    media_sha.append(hashlib.sha256(wav(payload)).hexdigest())
                    packed["header"].append(header_of(payload))
                    packed["digests"].append(b"".join(map(digest_of, parts)))
                    packed["lengths"].append(np.fromiter(map(len, parts), np.uint32, len(parts)).tobytes())
                    packed["own"].append(np.packbits([j not in other for j in range(len(parts))]).tobytes())
                    packed["body"].append(codec.compress(b"".join(c for j, c in enumerate(parts) if j not in other), asbytes=True))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("thash"), pa.array(size, pa.int64()), pa.array(media_sha, pa.string()), *(pa.array(x, pa.binary()) for x in packed.values()), *(batch.column(c) for c in ("foreign", "lent", "fewest"))],
                    names=["id", "thash", "n_bytes", "media_sha256", *packed, "foreign", "lent", "fewest"],
                )

    return run


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[list[bytes], list[int], list[bytes | None]]]:
    """Digests, lengths and own chunks (None for others') of packed documents."""
    codec = pa.Codec("zstd")
    for d, n, o, body in zip(*(batch.column(c).to_pylist() for c in ("digests", "lengths", "own", "body")), strict=True):
        lengths = np.frombuffer(n, np.uint32).astype(np.int64)
        own = np.unpackbits(np.frombuffer(o, np.uint8), count=len(lengths)).astype(bool)
        ends = np.cumsum(np.where(own, lengths, 0)).tolist()
        held = codec.decompress(body, ends[-1], asbytes=True) if ends[-1] else b""
        chunks = [held[a:b] if mine else None for a, b, mine in zip([0, *ends], ends, own.tolist(), strict=False)]
        yield [d[i : i + DIGEST] for i in range(0, len(d), DIGEST)], lengths.tolist(), chunks


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for lo in range(0, whole.num_rows, FETCH):
            batch = whole.slice(lo, FETCH)
            digests, lengths, chunks = zip(*_parts(batch), strict=True)
            columns = {"digests": pa.array(digests, pa.list_(pa.binary())), "lengths": pa.array(lengths, pa.list_(pa.int32())), "chunks": pa.array(chunks, pa.list_(pa.binary()))}
            names = [c.split()[0] for c in STORE.split(", ")]
            yield pa.RecordBatch.from_arrays([columns[c] if c in columns else batch.column(c) for c in names], names=names)


def _lent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chunks that documents lend."""
    for whole in batches:
        for lo in range(0, whole.num_rows, FETCH):
            batch = whole.slice(lo, FETCH)
            found = [(digests[i], chunks[i]) for (digests, _, chunks), lent in zip(_parts(batch), batch.column("lent").to_pylist(), strict=True) for i in lent]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], names=["digest", "bytes"])


def store(docs: DataFrame, cuts: Cuts = Cuts()) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """docs (doc_id, text) -> the store (see STORE; chunks are null where another document owns them; a view of
    the table that is written, see PACKED), and the table of owners' shared chunks (id, thash, place, digest, size) with n, how often each occurs."""
    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("thash"), "text")
    seen = stash(rows.mapInArrow(_digests(cuts), "id long, thash long, place int, size int, digest binary"), "digests")
    hashed = seen.withColumn("head", F.xxhash64("digest"))
    repeated = stash(hashed.groupBy("head").agg(F.count("*").alias("n")).where("n > 1").select("head"), "repeated-heads")
    some = stash(hashed.join(small(repeated), "head", "left_semi").drop("head"), "repeated-digests")
    unstash(seen)
    unstash(repeated)
    # struct order: a null id stands before all others
    owners = some.groupBy("digest").agg(F.min(F.struct("id", "thash", "place")).alias("owner"), F.count("*").alias("n"), F.max("size").alias("size")).where("n > 1")
    owners = stash(owners, "owners")
    owned = lookup(some, "digest", owners.select(F.col("digest").alias("key"), "n", "owner", F.col("n").alias("held"))).withColumnRenamed("_owner", "owner")
    mine = F.col("id").eqNullSafe(F.col("owner.id")) & (F.col("thash") == F.col("owner.thash")) & (F.col("place") == F.col("owner.place"))
    places = lambda which: F.sort_array(F.collect_set(F.when(which, F.col("place"))))
    foreign = owned.groupBy("id", "thash").agg(places(~mine).alias("foreign"), places(mine).alias("lent"), F.min(F.when(~mine, F.col("_held"))).alias("fewest"))
    foreign = stash(foreign.withColumnsRenamed({"id": "fid", "thash": "fhash"}), "foreign")
    unstash(some)
    marked = rows.join(small(foreign, rows=500_000), F.col("id").eqNullSafe(F.col("fid")) & (F.col("thash") == F.col("fhash")), "left")
    kept = stash(marked.select("id", "thash", "text", "foreign", "lent", "fewest").mapInArrow(_store(cuts), PACKED), "media-store")
    unstash(foreign)
    view = kept.mapInArrow(_unpacked, STORE)
    view._packed = kept
    return view, owners.select("owner.id", "owner.thash", "owner.place", "digest", "size", "n")


def feature_of(payload: np.ndarray) -> str:
    """Samples, mean, zero crossings around 128 and peak of the samples, and the fullest of 16 level bands."""
    bands = np.bincount(payload >> 4, minlength=16)
    crossings = int(np.count_nonzero((payload[1:] >= 128) != (payload[:-1] >= 128)))
    return f"n={len(payload)};mean={payload.mean(dtype=np.float64):.4f};zc={crossings};peak={int(payload.max())};band={int(bands.argmax())}"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for lo in range(0, whole.num_rows, FETCH):
            batch = whole.slice(lo, FETCH)
            out: dict[str, list] = {k: [] for k in ("payload", "media_bytes", "media_sha256", "feature")}
            for header, digests, chunks, sha in zip(*(batch.column(c).to_pylist() for c in ("header", "digests", "chunks", "media_sha256")), strict=True):
                if any(c is None or digest_of(c) != d for d, c in zip(digests, chunks, strict=True)):
                    raise ValueError("a chunk is missing or differs from its digest")
                media = b"".join((header, *chunks))
                if (found := hashlib.sha256(media).hexdigest()) != sha:
                    raise ValueError("a file differs from its digest")
                payload = samples(media)
                out["payload"].append(payload)
                out["media_bytes"].append(len(media))
                out["media_sha256"].append(found)
                out["feature"].append(feature_of(np.frombuffer(payload, np.uint8)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("n_bytes"), pa.array([len(p) for p in out["payload"]], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in out["payload"]], pa.string()), pa.array([zlib.crc32(p[-64:]) for p in out["payload"]], pa.int64()), pa.array(out["media_bytes"], pa.int64()), pa.array(out["media_sha256"], pa.string()), pa.array(out["feature"], pa.string())],
                names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )


FILE = "id long, n_bytes long, media_sha256 string, header binary, digests array<binary>, chunks array<binary>"


def _filled(frequent: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Documents with what they borrow in its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, FETCH):
                batch = whole.slice(lo, FETCH)
                all_digests, all_chunks = [], []
                for (digests, _, chunks), got in zip(_parts(batch), batch.column("got").to_pylist(), strict=True):
                    for x in got or ():
                        chunks[x["place"]] = x["bytes"]
                    all_digests.append(digests)
                    all_chunks.append([frequent.value.get(d) if c is None else c for c, d in zip(chunks, digests, strict=True)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in ("id", "n_bytes", "media_sha256", "header")] + [pa.array(x, pa.list_(pa.binary())) for x in (all_digests, all_chunks)],
                    names=["id", "n_bytes", "media_sha256", "header", "digests", "chunks"],
                )

    return run


def whole_files(kept: DataFrame, owners: DataFrame, room: int = HOT_BYTES) -> DataFrame:
    """The files of a store as store() gives it (see FILE), with all bytes in place. At most `room` bytes of the most
    frequent borrowed chunks are broadcast."""
    packed = kept.__dict__.get("_packed")
    if packed is None:
        raise TypeError("not a store: pass what store() gives")
    threshold = threshold_of(bands_of(owners, "n", F.sum(F.col("size") + ENTRY_BYTES)), room)
    hot = F.broadcast(owners.where(F.col("n") >= threshold).select("digest"))
    lent = packed.where(F.size("lent") > 0).select("digests", "lengths", "own", "body", "lent").mapInArrow(_lent, "digest binary, bytes binary")
    top = lent.join(hot, "digest").dropDuplicates(["digest"]).toPandas()
    frequent = kept.sparkSession.sparkContext.broadcast({bytes(d): bytes(c) for d, c in zip(top["digest"], top["bytes"], strict=True)})
    # an id that may be null as two columns that aren't, so that grouping and joining share one shuffle
    row = [F.coalesce("id", F.lit(0).cast("long")).alias("row"), F.col("id").isNull().alias("none"), F.col("thash").alias("hash")]
    few = packed.where(F.col("fewest") < threshold)
    needs = few.select(*row, "digests", F.explode("foreign").alias("place")).withColumn("digest", F.substr("digests", F.col("place") * DIGEST + 1, F.lit(DIGEST))).drop("digests")
    # fewer than `threshold` documents ask for any of these
    rest = lent.join(hot, "digest", "left_anti").dropDuplicates(["digest"])
    got = needs.join(hot, "digest", "left_anti").join(rest, "digest").groupBy("row", "none", "hash").agg(F.collect_set(F.struct("place", "bytes")).alias("got"))
    file = ["id", "n_bytes", "media_sha256", "header", "digests", "lengths", "own", "body"]
    fetched = few.select(*row, *file).join(got, ["row", "none", "hash"], "left").select(*file, "got")
    near = packed.where(F.col("fewest").isNull() | (F.col("fewest") >= threshold)).select(*file, F.lit(None).cast(got.schema["got"].dataType).alias("got"))
    return near.unionByName(fetched).mapInArrow(_filled(frequent), FILE)


def read_back(kept: DataFrame, owners: DataFrame, room: int = HOT_BYTES) -> DataFrame:
    """Every document's digests and features, from the stored bytes."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return whole_files(kept, owners, room).mapInArrow(_read, schema)
