"""The corpus pipeline: language ID, line dedup, MinHash near-dedup, packing.

Every stage is a function (spark, docs, sf_dir) -> DataFrame over what its predecessor kept. Defined cases: a null or
empty text has no language and goes in the first stage; a document that loses all its lines has an empty text, is no
near copy of anything and is packed as an end alone; rows that repeat a doc_id are separate texts, of which near-dedup
keeps or drops all alike; null doc_ids pass every stage; texts of any length are taken whole; further columns, whatever
their names, pass unchanged up to the last stage; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.llm import langid, linededup, neardup, packing
from winnow.llm.common import stash
from winnow.llm.queries import table, tokenizer_file

#: A document is rejected if its language is unknown or less likely than this.
LEAST_SCORE = 0.5


def aside(docs: DataFrame, *names: str) -> tuple[DataFrame, list[Column]]:
    """docs with columns of these names under others, and the columns that select them under their own again."""
    free = "_" * (1 + max(map(len, docs.columns)))
    moved = {c: free + c for c in docs.columns if c.lower() in names}
    return docs.withColumnsRenamed(moved), [F.col(f"`{moved.get(c, c)}`").alias(c) for c in docs.columns]


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; the model is fitted on the labelled training rows of docs."""
    model = langid.fit(langid.training_rows(docs))
    plain, own = aside(docs, "lang_pred", "score")
    found = langid.identify(plain, model).where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return found.select(*own)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of at least 10 characters stay only in the smallest doc_id that holds them; n_chars follows the text."""
    plain, own = aside(docs, "n_lines", "n_dropped")
    cut = linededup.dedup_lines(plain, min_chars=10, min_docs=2)
    chars = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", chars).select(*own)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity 0.8 or more."""
    dropped = neardup.near_duplicates(docs, neardup.Plan(ngram=5, percent=80)).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(stash(dropped, "dropped"), "doc_id", "left_anti").select(*docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens with their ids (little-endian unsigned 32-bit)."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"), window=2048, end_id=1)


STAGES = [
    ("language_id", keep_known_language),
    ("line_dedup", drop_repeated_lines),
    ("minhash_dedup", drop_near_duplicates),
    ("packing", pack_windows),
]

#: The tokenizer can't be expressed in SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
