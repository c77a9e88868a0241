"""Concatenate and cut: documents as one token stream, cut into windows of `window` tokens.

Pass one tokenises and writes each document's ids with its place among its task's tokens. Prefix sums over
the tasks' totals give every document its global offset. Pass two cuts at the multiples of the window and
writes a boundary record per piece. Only the last sequence needs padding.

Words are tokenised once per worker and remembered: the tokenizer drops white space and splits at it, so the
ids of a text are the ids of its words in order. Texts with white space that Python and the tokenizer see
differently are tokenised whole.

Defined cases: a null text is an empty document of one end id; repeated and null doc_ids are separate
documents; texts of any length are packed whole, over as many sequences as they take; further columns don't pass and
may have any name; an empty table gives no piece. A file whose splitting differs (see PROBES) has its texts tokenised
whole.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.common import Memo, prefix_sums, small, stash, task_memos

#: Separators that str.split() cuts at, but the tokenizer doesn't, and zero-width marks that it may treat in its own way.
ODD = re.compile("[\x1c-\x1f\u180e\ufeff]")
#: Fixed: how the tokenizer splits a normalised text before its merges.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Texts that tell whether a file's own splitting is SPLIT's, between words and within them.
PROBES = ("it's  we'll don't", "ab12.5--x_y %$ a\nb\tc", "\u00e9t\u00e9 \u4e2d\u6587 \U0001f600!", "I'm (you're) 100% sure...")
FETCH = 4096
#: Bytes of a task's memos of words, and of parts of words that are split: the distinct words of some 25 MB of text.
WORD_ROOM, PIECE_ROOM = 96 << 20, 32 << 20
#: Printable ASCII that is neither a letter nor a digit: a run of it after letters is one piece.
MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())


def byte_letters() -> dict[int, int]:
    """Byte-level BPE's letter of each byte: printable Latin-1 stands for itself, the rest follow from 256 in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in set(plain))
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}


class WordIds:
    """Ids of words as little-endian 16-bit (or 32-bit) bytes, remembered by a task."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.letters, self.code = byte_letters(), "H" if self.kind.itemsize == 2 else "I"
        self.tokenize = self.tokenizer.model.tokenize
        self.normal = self.tokenizer.normalizer.normalize_str if self.tokenizer.normalizer else str
        self.by_words = self._same_by_words()
        self.renew()

    def _same_by_words(self) -> bool:
        """Whether the file splits as SPLIT and drops white space; if not, texts are tokenised whole."""
        self.renew()
        return all(b"".join(map(self.of_word, t.lower().split())) == self.encode(t) for t in PROBES)

    def renew(self) -> None:
        self.words, self.pieces = Memo(self.of_word, WORD_ROOM), Memo(self.of_piece, PIECE_ROOM)

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def of_piece(self, piece: str) -> bytes:
        letters = piece.encode().decode("latin-1").translate(self.letters)
        return self.of_letters(letters)

    def of_letters(self, letters: str) -> bytes:
        return array(self.code, [t.id for t in self.tokenize(letters)]).tobytes()

    def of_word(self, word: str) -> bytes:
        """Most words are letters, or letters and then marks: these need no splitting, and their letters no translation."""
        if "<|" in word:
            return self.encode(word)
        if word.isascii():
            word = word.lower()
            if word.isalpha():
                return self.of_letters(word)
            head = word.rstrip(MARKS)
            if head.isalpha():
                return self.words[head] + self.pieces[word[len(head) :]]
            pieces = SPLIT.findall(word)
        else:
            pieces = SPLIT.findall(self.normal(word))
        return self.of_piece(pieces[0]) if len(pieces) == 1 else b"".join(map(self.pieces.__getitem__, pieces))

    def of(self, text: str) -> bytes:
        if not self.by_words or ODD.search(text):
            return self.encode(text)
        return b"".join(map(self.words.__getitem__, (text.lower() if text.isascii() else text).split()))


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def _tokenise(path: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, at = word_ids(path), TaskContext.get().partitionId(), 0
        coder.renew()
        end = np.array([end_id], coder.kind).tobytes()
        with task_memos(coder.words, coder.pieces):
            for whole in batches:
                for lo in range(0, whole.num_rows, FETCH):
                    batch = whole.slice(lo, FETCH)
                    ids = [coder.of(t or "") + end for t in batch.column("text").to_pylist()]
                    n = np.fromiter(map(len, ids), np.int64, len(ids)) // coder.kind.itemsize
                    start = at + np.cumsum(n) - n
                    at += int(n.sum())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id"), pa.array([part] * len(ids), pa.int64()), pa.array(start), pa.array(n), pa.array(ids, pa.binary())],
                        names=["doc_id", "_part", "_start", "doc_tokens", "ids"],
                    )

    return run


def _cut(window: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g0 = batch.column("at").to_numpy(zero_copy_only=False)
            n = batch.column("doc_tokens").to_numpy(zero_copy_only=False)
            first, last = g0 // window, (g0 + n - 1) // window
            pieces = last - first + 1
            row = np.repeat(np.arange(len(n)), pieces)
            seq = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            lo, hi = np.maximum(g0[row], seq * window), np.minimum((g0 + n)[row], (seq + 1) * window)
            start = lo - g0[row]
            blobs = batch.column("ids").to_pylist()
            ids = [np.frombuffer(blobs[r], f"<u{width}", e - s, s * width).astype("<u4").tobytes() for r, s, e in zip(row.tolist(), start.tolist(), (hi - g0[row]).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(hi - lo), pa.array(ids, pa.binary()), pa.array(n[row]), pa.array(seq), pa.array(lo - seq * window)],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    width = word_ids(tokenizer_path).kind.itemsize
    schema = "doc_id long, _part long, _start long, doc_tokens long, ids binary"
    tokens = stash(docs.select("doc_id", "text").mapInArrow(_tokenise(tokenizer_path, end_id), schema), "tokens")
    totals = tokens.groupBy("_part").agg(F.sum("doc_tokens").alias("n"))
    base = stash(prefix_sums(totals, "_part", "n"), "token-bases")
    placed = tokens.join(small(base), "_part").select("doc_id", "doc_tokens", "ids", (F.col("base") + F.col("_start")).alias("at"))
    return placed.mapInArrow(_cut(window, width), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, n_tokens and ids of each sequence; a sequence never holds more than one window."""
    ordered = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("n_tokens"))
    joined = F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x.ids))
    return ordered.select("sequence_id", "n_tokens", joined.alias("ids"))


