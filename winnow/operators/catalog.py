"""Term hits, so that cost follows the texts and their hits, not the terms.

Up to `SMALL` terms go to all tasks, which find them by one scan of the texts' bytes (`functions/scan.py`): nothing is shuffled,
no text is cut into words, and phrases of common words cost no more than others.

More terms are joined by a shuffle, through an inverted index. There, every term has an anchor: something that each text with
that term has among its words (maximal runs of word characters).
A whole-word term is its first word; a stem of one word is a prefix of a word; a phrase, which may begin and end inside of
words, has a word of its own between two others, or a prefix of its last word or a suffix of its first one, whichever is longer, or three
characters of its only one. Texts give the words, and prefixes, suffixes and pieces of just the lengths that the index has;
the index gives the candidates, and only those whose anchor leaves something open are verified, against their own pattern.
Terms without a word character, and stems that begin with none, can't be anchored and are tested on every text; there are
`ODD_TERMS` of them at most.

Defined cases: a term listed twice counts once, at its first place; an empty term never matches; a null text has no hits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.functions import scan
from winnow.functions import terms as tm
from winnow.tables import stash

SMALL, ODD_TERMS = 200_000, 1000
RUNS = r"(?U)\w+"
#: Characters that index a phrase which lies inside of one word.
GRAM = 3
MET = "array<struct<ord:int,term:string,sure:boolean,pattern:string>>"


def _quoted(body: Column) -> Column:
    return F.regexp_replace(body, r"([^\p{L}\p{N}_\s])", r"\\$1")


def index(terms: DataFrame) -> DataFrame:
    """terms (term, ord) -> kind (w, p, s, g or null), key, term, ord, sure, pattern (null: the term as it is)."""
    one = terms.where("term <> '' and term <> '*'").groupBy("term").agg(F.min("ord").alias("ord"))
    stem = F.col("term").endswith("*")
    body = F.when(stem, F.expr("left(term, length(term) - 1)")).otherwise(F.col("term"))
    word = ~stem & F.col("term").rlike(f"^(?:{tm.TOKEN.pattern})$")
    rows = one.select("term", "ord", body.alias("body"), stem.alias("stem"), word.alias("word")).withColumn("runs", F.regexp_extract_all("body", F.lit(RUNS), F.lit(0)))
    n, runs = F.size("runs"), lambda i: F.get("runs", F.lit(i))
    starts, ends = F.col("body").rlike(r"(?U)^\w"), F.col("body").rlike(r"(?U)\w$")
    bounded = F.col("word") | F.col("stem")  # they begin at a word's beginning
    anchor = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    rows = rows.withColumn(
        "a",
        F.when(n == 0, None).when(bounded & ~starts, None)
        .when(bounded & (n == 1) & ends, F.when(F.col("word"), anchor("w", runs(0))).otherwise(anchor("p", runs(0))))
        .when(bounded | (~starts & ((n > 1) | ~ends)), anchor("w", runs(0)))
        .when((n > 2) | ((n == 2) & ~ends), anchor("w", runs(1)))
        .when((n == 2) & starts & (F.length(runs(0)) > F.length(runs(1))), anchor("s", runs(0))).when(n == 2, anchor("p", runs(1))).when(~starts, anchor("p", runs(0))).when(~ends, anchor("s", runs(0))).otherwise(anchor("g", F.left(runs(0), F.lit(GRAM)))),
    )
    sure = bounded & (n == 1) & starts & ends
    pattern = F.when(bounded, F.concat(F.lit(r"(?U)\b"), _quoted(F.col("body")), F.when(F.col("word"), r"\b").otherwise("")))
    return rows.select("a.kind", "a.key", "term", "ord", F.coalesce(sure, F.lit(False)).alias("sure"), pattern.alias("pattern"))


def keys(words: Column, lengths: dict[str, list[int]]) -> Column:
    """What words give of each kind, with the kind in front."""
    def cuts(kind: str, cut) -> list[Column]:
        return [F.transform(F.filter(words, lambda w: F.length(w) >= n), lambda w: F.concat(F.lit(f"{kind}:"), cut(w, n))) for n in lengths.get(kind, [])]  # noqa: B023

    found = [F.transform(words, lambda w: F.concat(F.lit("w:"), w)), *cuts("p", lambda w, n: F.left(w, F.lit(n))), *cuts("s", lambda w, n: F.right(w, F.lit(n)))]
    for n in lengths.get("g", []):
        pieces = F.transform(F.filter(words, lambda w: F.length(w) >= n), lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.concat(F.lit("g:"), F.substr(w, i, F.lit(n)))))  # noqa: B023
        found.append(F.flatten(pieces))
    return F.array_distinct(F.concat(*found))


#: Texts and bytes that are scanned together, if it is more than one text, and cells of what they hold.
TEXTS, BYTES, CELLS = 256, 1 << 22, 1 << 25
_word_codes: list[np.ndarray] = []


def word_codes(spark: SparkSession) -> np.ndarray:
    """Whether each code is a word character, as the engine's patterns have it; they are asked once."""
    if not _word_codes:
        some = [chr(c) for c in range(scan.CODES) if not 0xD800 <= c < 0xE000]
        rows = spark.createDataFrame([("".join(some[i : i + 8192]),) for i in range(0, len(some), 8192)], "s string")
        out = np.zeros(scan.CODES, bool)
        out[[ord(c) for r in rows.select(F.regexp_replace("s", r"(?U)\W", "")).collect() for c in r[0]]] = True
        _word_codes.append(out)
    return _word_codes[0]


def parts(ends: np.ndarray, texts: int) -> Iterator[tuple[int, int]]:
    """Runs of texts, of so many texts and BYTES at most, or one text; ends: where each text ends."""
    at = 0
    while at < len(ends):
        to = max(at + 1, min(at + texts, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BYTES, "right"))))
        yield at, to
        at = to


def scanned(known: list[str], scanner: scan.Scanner) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow: batches whose last column is the text -> the terms that it holds in its place. known:
    the scanner's terms in the order of hits."""
    texts = max(1, min(TEXTS, CELLS // max(len(known), 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(known, pa.string())
        for batch in batches:
            column = pc.fill_null(batch.column(batch.num_columns - 1).cast(pa.large_string()), "")
            _, offsets, data = column.buffers()
            offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
            data = np.frombuffer(data if data is not None else b"", np.uint8)[offsets[0] : offsets[-1]]
            ends = offsets[1:] - offsets[0]
            for at, to in parts(ends, texts):
                begin = int(ends[at - 1]) if at else 0
                row, term = np.divmod(scanner.find(data[begin : ends[to - 1]], ends[at:to] - begin).reshape(-1).nonzero()[0], max(len(known), 1))
                found = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(to - at + 1)).astype(np.int32)), names.take(pa.array(term)))
                yield pa.RecordBatch.from_arrays([*(c.slice(at, to - at) for c in batch.columns[:-1]), found], [*batch.schema.names[:-1], "hits"])

    return run


def met_by_join(texts: DataFrame, anchored: DataFrame, lengths: dict[str, list[int]], words: Column, key: str) -> DataFrame:
    """The same by a shuffle, for an index that is too large for a task."""
    rows = anchored.select(F.concat_ws(":", "kind", "key").alias("_key"), "term", "ord", "sure", "pattern")
    # A column of its own: named many times below, the words would else be looked for as often.
    given = texts.select(key, words.alias("_words")).select(key, keys(F.col("_words"), lengths).alias("_keys"))
    found = given.select(key, F.explode("_keys").alias("_key")).join(rows, "_key").groupBy(key).agg(F.collect_set(F.struct("ord", "term", "sure", "pattern")).alias("_met"))
    return texts.select(key, "text").join(found, key, "left").withColumn("_met", F.coalesce("_met", F.array().cast(MET)))


def hits(texts: DataFrame, terms: DataFrame, key: str = "id") -> DataFrame:
    """texts (key, text in lower case; a key each) and terms (term, ord) -> key and hits, the terms found, by ord."""
    known = stash(index(terms), "term-index")
    if known.count() > SMALL:
        return hits_by_join(texts, known, key)
    few = sorted((r.ord, r.term) for r in known.select("ord", "term").collect())
    asked = [(t.removesuffix("*"), tm.mode(t) != "phrase", tm.mode(t) == "word") for _, t in few]
    rows = texts.select(key, "text")
    run = scanned([t for _, t in few], scan.Scanner(asked, word_codes(texts.sparkSession)))
    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, hits array<string>")


def hits_by_join(texts: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The same for an index that is too large for a task: words meet it by a shuffle."""
    anchored = known.where("kind is not null")
    lengths: dict[str, list[int]] = {}
    for r in known.where("kind in ('p', 's', 'g')").select("kind", F.length("key").alias("n")).distinct().collect():  # as many as a term is long
        lengths.setdefault(r.kind, []).append(r.n)
    odd = [(r.term, r.ord, r.pattern) for r in known.where("kind is null").orderBy("ord").limit(ODD_TERMS + 1).collect()]
    if len(odd) > ODD_TERMS:
        raise ValueError(f"more than {ODD_TERMS} terms that no word can anchor")

    words = F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(RUNS), F.lit(0)))
    rows = met_by_join(texts, anchored, lengths, words, key)
    text = F.col("text")

    def holds(t: Column) -> Column:
        return t["sure"] | F.when(t["pattern"].isNull(), text.contains(t["term"])).otherwise(F.regexp_like(text, t["pattern"]))

    sure = F.transform(F.filter("_met", holds), lambda t: F.struct(t["ord"].alias("ord"), t["term"].alias("term")))
    tested = [F.when(text.contains(t) if p is None else text.rlike(p), F.struct(F.lit(o).alias("ord"), F.lit(t).alias("term"))) for t, o, p in odd]
    found = F.concat(sure, F.array_compact(F.array(*tested))) if tested else sure
    return rows.select(key, F.transform(F.array_sort(found), lambda t: t["term"]).alias("hits"))
