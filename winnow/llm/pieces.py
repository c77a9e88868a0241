"""SentencePiece encoding and decoding by a streaming Viterbi.

Positions of the normalised text are read from left to right. Each keeps, of the pieces that end there, the
one on the best path, as a backpointer. No piece is longer than the longest of the model, so only a window of
that many positions can still be extended; whenever all backpointer paths from the window pass one boundary,
the ids up to it are committed and forgotten.

Which path is best depends on the model. A unigram model takes the largest sum of piece scores. A BPE model,
like the public file, takes the path that its merges produce: a piece may follow another if encoding the two
alone gives the two again, and then every position has one surviving path. (Its scores are merge ranks; the
path of the largest sum isn't what the library returns.) Text that no piece covers becomes byte pieces.

A boundary that no piece of the model can span, such as that before a space mark that follows another
character, is one where all paths converge; what stands between two such boundaries is remembered per worker.

Words that a batch brings in are solved in sorted order, so that the window of one goes on from what it shares with
the next. The model's normaliser must be the identity with a dummy prefix, as in the public file; others are refused.

Defined cases: a null text gives no id and decodes to an empty text; the space mark U+2581 itself reads back
as a space, as in the library; rows that repeat are encoded alike; texts of any length are encoded whole, in a window
of bounded size; further columns pass, but for text, ids, n_ids and decoded, which are replaced; an empty table gives
an empty table.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from winnow.llm.common import Memo, task_memos

MARK = "▁"
FETCH = 256
#: Pairs of pieces whose order is remembered per worker.
PAIRS = 200_000


class Model:
    """Pieces, scores and byte ids of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {names[i]: i for i in plain}
        self.scores = {i: sp.get_score(i) for i in plain}
        self.bytes = {int(names[i][3:5], 16): i for i in range(size) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.names = names
        self.longest = max(map(len, self.ids))
        # Merge ranks are whole numbers; log probabilities aren't.
        self.bpe = all(s.is_integer() for s in self.scores.values())
        #: Whether some piece spans a space mark after another character; if not, texts fall into words there.
        self.words_apart = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        self.texts = self._texts(sp, size)
        for probe in ("Ａ  é\u0301 \t x", " a  b "):
            if sp.decode(sp.encode(probe)) != probe:
                raise ValueError("the model's normaliser isn't the identity")

    def _texts(self, sp, size: int) -> list[bytes]:
        raw = {i: bytes([b]) for b, i in self.bytes.items()}
        silent = {i for i in range(size) if sp.is_control(i)}
        return [raw.get(i, b"" if i in silent else self.names[i].replace(MARK, " ").encode()) for i in range(size)]


def merged(text: str, model: Model) -> tuple[list[str], tuple[str, str] | None]:
    """The pieces that the model's merges make of a short text, from single characters, best pair first and
    leftmost among equals; and the two parts of the last merge."""
    parts, split = list(text), None
    while True:
        best, at = None, -1
        for i in range(len(parts) - 1):
            s = model.scores.get(model.ids.get(parts[i] + parts[i + 1], -1))
            if s is not None and (best is None or s > best):
                best, at = s, i
        if best is None:
            return parts, split
        split = parts[at], parts[at + 1]
        parts[at : at + 2] = [parts[at] + parts[at + 1]]


class Encoder:
    """The stream of a model, with its pieces as a trie; what stands between sure boundaries is remembered by task."""

    def __init__(self, model: Model):
        self.model = model
        self.worst = min(model.scores.values())
        #: The parts of the last merge of every piece that comes out of its own characters.
        self.sound: dict[str, tuple[str, str]] = {}
        if model.bpe:
            for p in model.ids:
                parts, split = merged(p, model)
                if split and parts == [p]:
                    self.sound[p] = split
        #: Pieces whose merges all come in the order of their ranks.
        self.steady: set[str] = set()
        for p in sorted(self.sound, key=len):
            if all(len(x) == 1 or x in self.steady and self.time_of(x) < self.time_of(p) for x in self.sound[p]):
                self.steady.add(p)
        #: Pieces by number (characters without a piece get one when they are met), their numbers and written ids.
        self.names, self.numbers, self.written = [""], {"": 0}, [b""]
        #: Whether a piece may follow another, by left number << 32 | right number.
        self.follows: dict[int, bool] = {}
        #: Pieces from their last character on. Each node: character -> (next node, number of the piece that starts there or 0).
        self.trie: dict = {}
        for p in model.ids if not model.bpe else self.sound:
            node = self.trie
            for c in p[:0:-1]:
                node = node.setdefault(c, [{}, 0])[0]
            node.setdefault(p[0], [{}, 0])[1] = self.number(p)
        self.ending = self.ending_by_merges if model.bpe else self.ending_by_sums
        self.newline = self.ids_bytes("\n") if not any("\n" in p for p in model.ids) else None
        self.renew()

    def renew(self) -> None:
        #: Ids by word: with a mark before it, or after a line end, which stands in the key.
        self.words, self.runs = Memo(lambda w: self.ids_bytes(MARK + w) if w[:1] != "\n" else self.newline + self.ids_bytes(w[1:])), Memo(self.ids_bytes)

    def number(self, piece: str) -> int:
        n = self.numbers.get(piece)
        if n is None:
            n = self.numbers[piece] = len(self.names)
            self.names.append(piece)
            self.written.append(array("I", self.ids_of(piece)).tobytes())
        return n

    def time_of(self, piece: str) -> float:
        """When merges form the piece: single characters stand from the start."""
        return -self.model.scores[self.model.ids[piece]] if len(piece) > 1 else -1.0

    def may_follow(self, left: str, right: str) -> bool:
        """Whether merges leave the boundary between two sound pieces alone.

        Undoing the later merge on either side again and again, no pair that ever faced each other across the
        boundary may have a merge that comes before the next one of either.
        """
        if not all(len(x) == 1 or x in self.steady for x in (left, right)) or left[-1] == right[0] == MARK:  # marks' merges have equal ranks
            return merged(left + right, self.model)[0] == [left, right]
        a, b, limit, of_right = left, right, float("inf"), False
        while True:
            cross = self.model.ids.get(a + b)
            rank = limit + 1 if cross is None else -self.model.scores[cross]
            if rank < limit or rank == limit and of_right:  # the leftmost of equal merges comes first
                return False
            if len(a) == len(b) == 1:
                return True
            if self.time_of(a) > self.time_of(b):
                limit, a, of_right = self.time_of(a), self.sound[a][1], False
            else:
                limit, b, of_right = self.time_of(b), self.sound[b][0], True

    def ids_of(self, piece: str) -> list[int]:
        """A piece's id, or byte pieces for a character without one."""
        i = self.model.ids.get(piece)
        if i is not None:
            return [i]
        if not self.model.bytes:
            return [self.model.unknown]
        return [self.model.bytes[b] for b in piece.encode()]

    def ending_by_merges(self, text: str, end: int, last: list[int], score: list[float], base: int) -> int:
        """Number of the piece that ends here: the only one that may follow the path to where it starts."""
        found, follows, at = self.trie.get(text[end - 1]), self.follows, end - 1 - base
        n = self.numbers.get(text[end - 1]) or self.number(text[end - 1])  # a character may always stand alone
        while True:
            if n:
                left = last[at]
                if not left:
                    return n
                ok = follows.get(left << 32 | n)
                if ok is None:
                    if len(follows) >= PAIRS:
                        follows.clear()
                    ok = follows[left << 32 | n] = self.may_follow(self.names[left], self.names[n])
                if ok:
                    return n
            at -= 1
            if found is None or at < 0:
                raise ValueError("no piece ends here")
            found = found[0].get(text[base + at])
            n = found[1] if found else 0

    def ending_by_sums(self, text: str, end: int, last: list[int], score: list[float], base: int) -> int:
        """Number of the piece on the path of the largest sum that ends here, the longest among equals; the sum joins
        `score`. An unknown character costs 10 more than the worst piece, as in the library."""
        node, model, chosen, top = self.trie, self.model, 0, float("-inf")
        for at in range(end - 1 - base, -1, -1):
            found = node.get(text[base + at])
            n, s = found[1] if found else 0, 0.0
            if n:
                s = model.scores[model.ids[self.names[n]]]
            elif at == end - 1 - base:
                n, s = self.number(text[base + at]), self.worst - 10
            if n and score[at] + s >= top:
                chosen, top = n, score[at] + s
            if found is None:
                break
            node = found[0]
        score.append(top)
        return chosen

    def stream(self, text: str) -> Iterator[int]:
        """Numbers of the pieces of the best path in order, each as soon as all paths of the window agree on it."""
        longest = self.model.longest
        # last holds, for every place of the window, the piece that ends there on its best path; score the path's sum
        base, last, score = 0, [0], [0.0]  # place `base` is a committed boundary

        def path(p: int) -> list[int]:
            done = []
            while p > base:
                done.append(last[p - base])
                p -= len(self.names[done[-1]])
            return done[::-1]

        for end in range(1, len(text) + 1):
            last.append(self.ending(text, end, last, score, base))
            if end - base >= 2 * longest and end < len(text):
                alive = range(end - longest + 1, end + 1)  # no piece steps over all of these
                passed: dict[int, int] = {}
                for p in alive:
                    while p > base:
                        passed[p] = passed.get(p, 0) + 1
                        p -= len(self.names[last[p - base]])
                common = max((p for p, n in passed.items() if n == len(alive)), default=base)
                yield from path(common)
                # The committed boundary keeps its piece: the next one must be able to follow it.
                last, score, base = last[common - base :], score[common - base :], common
        yield from path(len(text))

    def ids_bytes(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit."""
        return b"".join([self.written[i] for i in self.stream(text)])

    def learn(self, words: set[str]) -> None:
        """Remember the ids of new words. In sorted order, the window of one goes on from what it shares with the next."""
        last, score, before, new = [0], [0.0], "", words.difference(self.words)
        if not self.words.has_room(new):
            self.words.clear()
            new = words
        for text, word in sorted((w[1:] if w[:1] == "\n" else MARK + w, w) for w in new):
            if len(text) >= 2 * self.model.longest:
                self.words[word]  # beyond one window: by the stream
                continue
            same = 0
            for x, y in zip(before, text):  # noqa: B905  the shorter one ends it
                if x != y:
                    break
                same += 1
            del last[same + 1 :], score[same + 1 :]
            for end in range(same + 1, len(text) + 1):
                last.append(self.ending(text, end, last, score, 0))
            ids, p, before = [], len(text), text
            while p:
                ids.append(self.written[last[p]])
                p -= len(self.names[last[p]])
            ids = b"".join(reversed(ids))
            self.words.put(word, ids if word[:1] != "\n" else self.newline + ids)

    def words_of(self, text: str) -> list[str] | None:
        """The text's words as keys of `words`, if single spaces and line ends are sure boundaries in it: a piece spans
        neither, and a word at a later line's start has no mark."""
        if not self.model.words_apart or self.newline is None or MARK in text or "  " in text or text[:1] == " ":
            return None
        return text.replace("\n", " \n").split(" ") if text else []

    def encode_all(self, texts: list[str]) -> list[bytes]:
        split = list(map(self.words_of, texts))
        self.learn({w for words in split if words for w in words})
        return [self.by_runs(t) if words is None else b"".join(map(self.words.__getitem__, words)) for t, words in zip(texts, split, strict=True)]

    def by_runs(self, text: str) -> bytes:
        marked = MARK + text.replace(" ", MARK)
        if not self.model.words_apart:
            return self.ids_bytes(marked)
        return b"".join(map(self.runs.__getitem__, re.findall(f"{MARK}+[^{MARK}]*", marked)))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(Model(path))


def _encode(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        enc.renew()
        with task_memos(enc.words, enc.runs):
            for whole in batches:
                for lo in range(0, whole.num_rows, FETCH):
                    batch = whole.slice(lo, FETCH)
                    ids = enc.encode_all([t or "" for t in batch.column("text").to_pylist()])
                    keep = [c for c in batch.schema.names if c not in ("text", "ids", "n_ids")]
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(ids, pa.binary()), pa.array([len(i) // 4 for i in ids], pa.int64())], names=[*keep, "ids", "n_ids"])

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """docs without text, plus ids (little-endian unsigned 32-bit) and n_ids (they replace columns of these names)."""
    kept = [f for f in docs.schema.fields if f.name not in ("text", "ids", "n_ids")]
    schema = T.StructType([*kept, T.StructField("ids", T.BinaryType()), T.StructField("n_ids", T.LongType())])
    return docs.mapInArrow(_encode(path), schema)


def decoded(ids: np.ndarray, model: Model) -> str:
    text = b"".join(map(model.texts.__getitem__, ids.tolist()))
    return (text[1:] if text[:1] == b" " else text).decode("utf-8", "replace")


def _decode(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path).model
        for whole in batches:
            for lo in range(0, whole.num_rows, FETCH):
                batch = whole.slice(lo, FETCH)
                texts = [decoded(np.frombuffer(i or b"", "<u4"), model) for i in batch.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return run


def decode(coded: DataFrame, path: str) -> DataFrame:
    """coded plus `decoded`, the text of its ids (it replaces a column of that name)."""
    coded = coded.drop("decoded")
    return coded.mapInArrow(_decode(path), T.StructType([*coded.schema.fields, T.StructField("decoded", T.StringType())]))
