"""Language identification by word-first backoff.

A token is a maximal run of letters and letter-like numerals, in lower case. Known words add their log
frequency in each language. An unknown word backs off to its character n-grams, from the longest order down:
the first order with a known n-gram decides, with the mean log frequency of its known n-grams; a word
without any adds nothing.

The model is fitted on a bounded sample: about `docs_per_lang` labelled documents of each language and about
`chars_per_lang` characters, chosen by a hash of doc_id (whole texts). All words and n-grams that a language's sample
holds `least` times or more are known; there is no cap on their number, which the sample bounds. So the model grows with
the number of languages only; every language is learnt, and of each word or n-gram only the languages in which it was
seen so often are stored.

The score is the posterior of the best language after dividing the log odds by the square root of the number
of tokens, which keeps it below 1 for short texts.

Defined cases: a null text or one without a letter gives `und` with score 0; ties go to the language that
sorts first; without any labelled row every text is `und`; rows that repeat are predicted alike; a null
doc_id is never a training row; texts of any length are read whole; further columns pass, but for lang_pred and
score, which are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNKNOWN = "und"
TOKEN = re.compile(r"[^\W\d_]+")
ORDERS = (5, 4, 3, 2, 1)
#: Words by languages in a worker's memo before it starts anew.
MEMO_CELLS = 2_000_000
FETCH = 2048


@dataclass
class Rows:
    """Log frequencies by key and language: those of a key without any count, and what its counts add to them."""

    base: np.ndarray
    starts: np.ndarray
    langs: np.ndarray
    adds: np.ndarray

    def mean(self, keys: list[int]) -> np.ndarray:
        out = self.base.copy()
        for i in keys:
            at = slice(self.starts[i], self.starts[i + 1])
            out[self.langs[at]] += self.adds[at] / len(keys)
        return out


@dataclass
class Model:
    langs: list[str]
    words: dict[str, int]
    grams: dict[int, dict[str, int]]
    word_rows: Rows | None
    gram_rows: dict[int, Rows]


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def padded_grams(word: str, order: int) -> list[str]:
    w = f"<{word}>"
    return [w[i : i + order] for i in range(len(w) - order + 1)]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for lo in range(0, whole.num_rows, FETCH):
            batch = whole.slice(lo, FETCH)
            found: dict[str, Counter] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found.setdefault(lang, Counter()).update(tokens(text))
            rows = [(lang, w, n) for lang, c in found.items() for w, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array(list(x)) if rows else pa.array([], t) for x, t in zip(zip(*rows, strict=True) if rows else ((), (), ()), (pa.string(), pa.string(), pa.int64()), strict=True)], names=["lang", "word", "n"])


def _count_grams(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in pdfs:
        found: Counter = Counter()
        for lang, word, n in zip(pdf.lang, pdf.word, pdf.n, strict=True):
            for order in ORDERS:
                for g in padded_grams(word, order):
                    found[lang, order, g] += n
        yield pd.DataFrame([(a, b, c, n) for (a, b, c), n in found.items()], columns=["lang", "size", "gram", "n"])


def _log_rows(counts: list[tuple[str, str, int]], langs: list[str]) -> tuple[dict[str, int], Rows]:
    """Rows of log frequency with half a count added, by word or n-gram."""
    at, col = {k: i for i, k in enumerate(sorted({k for _, k, _ in counts}))}, {x: i for i, x in enumerate(langs)}
    key, lang = (np.array(x, np.int64) for x in ([at[k] for _, k, _ in counts], [col[x] for x, _, _ in counts]))
    n, order = np.array([c for *_, c in counts], np.float64), np.argsort(key, kind="stable")
    total = np.maximum(0.5 * len(at) + np.bincount(lang, n, len(langs)), 0.5)
    return at, Rows(np.log(0.5 / total), np.searchsorted(key[order], np.arange(len(at) + 1)), lang[order], np.log((n[order] + 0.5) / 0.5))


def fit(labelled: DataFrame, docs_per_lang: int = 1500, chars_per_lang: int = 30_000_000, least: int = 2) -> Model:
    """labelled: doc_id, text, lang without nulls. Two passes: rows and characters per language, then the sample's counts."""
    sizes = {r.lang: max(r.n / docs_per_lang, r.chars / chars_per_lang) for r in labelled.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], {}, {}, None, {})
    shares = labelled.sparkSession.createDataFrame([(x, 1 / max(1.0, n)) for x, n in sizes.items()], "lang string, share double")
    picked = labelled.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20)) < F.col("share") * (1 << 20))
    counted = picked.select("lang", "text").mapInArrow(_count_words, "lang string, word string, n long")
    counted = counted.groupBy("lang", "word").agg(F.sum("n").alias("n")).cache()
    word_counts = [(r.lang, r.word, r.n) for r in counted.where(F.col("n") >= least).collect()]
    gram_counts = counted.mapInPandas(_count_grams, "lang string, size int, gram string, n long").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))
    kept = [(r.lang, r.gram, r.n, r["size"]) for r in gram_counts.where(F.col("n") >= least).collect()]
    counted.unpersist()
    at, rows = _log_rows(word_counts, langs)
    orders = {order: _log_rows([x[:3] for x in kept if x[3] == order], langs) for order in ORDERS}  # each has frequencies of its own
    return Model(langs, at, {k: x for k, (x, _) in orders.items()}, rows, {k: r for k, (_, r) in orders.items()})


class WordRows(dict):
    """Memo from a token to a row of `rows`: its evidence for each language. Row 0: no letter at all."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.rows = np.zeros((1 << 8, len(model.langs)))
        self.used = 1

    def evidence(self, word: str) -> np.ndarray:
        m = self.model
        if (i := m.words.get(word)) is not None:
            return m.word_rows.mean([i])
        for order in ORDERS if m.grams else ():
            known = m.grams[order]
            if hits := [known[g] for g in padded_grams(word, order) if g in known]:
                return m.gram_rows[order].mean(hits)
        return np.zeros(len(m.langs))

    def __missing__(self, word: str) -> int:
        if not any(map(str.isalpha, word)):
            self[word] = 0
            return 0
        if self.used == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[self.used] = self.evidence(word)
        self[word] = i = self.used
        self.used += 1
        return i

    def predict(self, text: str | None) -> tuple[str, float]:
        if self.used * len(self.model.langs) > MEMO_CELLS:
            self.clear()
            self.used = 1
        words = tokens(text) if text else []
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        n = int(np.count_nonzero(at))
        if not n or not self.model.langs:
            return UNKNOWN, 0.0
        total = self.rows[at].sum(axis=0)
        best = int(total.argmax())
        odds = np.exp((total - total[best]) / np.sqrt(n))
        return self.model.langs[best], float(1 / odds.sum())


def _predict(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordRows(shared.value)
        for whole in batches:
            for lo in range(0, whole.num_rows, FETCH):
                batch = whole.slice(lo, FETCH)
                found = [memo.predict(t) for t in batch.column("text").to_pylist()]
                new = [pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score (which replace columns of these names)."""
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(_predict(shared), schema)


def held_out(doc_id: Column, parts: int, which: int) -> Column:
    """Whether crc32 of the id as text falls on the part that no model may learn from; a null id does."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == which, F.lit(True))


def training_rows(docs: DataFrame, parts: int = 4, which: int = 2) -> DataFrame:
    return docs.where(~held_out(F.col("doc_id"), parts, which) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
