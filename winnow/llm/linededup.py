"""Line deduplication with DataFrame functions only.

Every text is split at \\n (null or empty: one empty line). A line's key is the line without ASCII white
space at both ends and with A-Z in lower case. Keys of at least `min_chars` code points that at least
`min_docs` documents hold lose all their lines except in the smallest doc_id that holds them; the other
lines are joined again by \\n in their order.

Defined cases: rows that repeat a doc_id count as one document for the counts and each keeps its own row;
rows with a null doc_id aren't counted and keep all their lines; a document that loses every line gets an
empty text; a null text that loses nothing stays null; further columns pass through untouched, whatever their names
(but for n_lines and n_dropped, which are replaced); lines and texts of any length are compared whole; an empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.common import lookup, stash, two_hashes

#: Fixed: ASCII white space, \x20 and \x09-\x0D.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(col):
    """A-Z only; pure ASCII takes the fast built-in."""
    return F.when(F.length(col) == F.octet_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def line_key(line):
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def hashed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """One narrow row per line that can be dropped: _row (the text's hash), doc_id, pos, h1, h2."""
    lines = docs.where(F.col("doc_id").isNotNull()).select(
        "doc_id", F.xxhash64("text").alias("_row"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line")
    )
    keyed = lines.select("doc_id", "_row", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return keyed.select("doc_id", "_row", "pos", *two_hashes(F.col("key")))


def repeated_keys(lines: DataFrame, min_docs: int) -> DataFrame:
    """Hashes held by at least min_docs documents (as key) with n, their lines or documents, and the smallest doc_id;
    counts are combined before the shuffle."""
    key = F.struct("h1", "h2").alias("key")
    if min_docs == 2:
        found = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
        return found.where("first_doc < last_doc").select(key, "n", "first_doc")
    pairs = lines.select("h1", "h2", "doc_id").distinct()
    return pairs.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where(F.col("n") >= min_docs).select(key, "n", "first_doc")


def without(lines, drops):
    """lines without the 0-based positions of the sorted array drops: the runs between them, in order."""
    return F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.size(drops)),
            lambda i: F.slice(
                lines,
                F.when(i == 0, 1).otherwise(F.get(drops, i - 1) + 2),
                F.coalesce(F.get(drops, i), F.size(lines)) - F.when(i == 0, 0).otherwise(F.get(drops, i - 1) + 1),
            ),
        )
    )


def dedup_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """docs with text cut as above, plus n_lines (before) and n_dropped, which replace columns of these names."""
    lines = stash(hashed_lines(docs, min_chars), "lines")
    keys = stash(repeated_keys(lines, min_docs), "line-keys")
    free = "_" * (2 + max(len(c) for c in docs.columns))  # before a name, it can't be a column of docs
    row, found, drops, split = (F.col(free + c) for c in ("row", "doc", "drops", "split"))
    dropped = (
        lookup(lines.select("doc_id", "_row", "pos", F.struct("h1", "h2").alias("key")), "key", keys).where(F.col("doc_id") > F.col("_first_doc"))
        .groupBy(F.col("doc_id").alias(free + "doc"), F.col("_row").alias(free + "found")).agg(F.array_sort(F.collect_set("pos")).alias(free + "drops"))
    )
    rows = docs.withColumn(free + "row", F.xxhash64("text"))
    out = rows.join(dropped, (rows["doc_id"] == found) & (row == F.col(free + "found")), "left")
    cut = F.when(drops.isNull(), F.col("text")).otherwise(F.array_join(without(split, drops), "\n"))
    kept = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    return out.withColumn(free + "split", F.split(F.coalesce("text", F.lit("")), "\n", -1)).select(
        *[cut.alias(c) if c == "text" else F.col(f"`{c}`") for c in kept], F.size(split).cast("long").alias("n_lines"), F.coalesce(F.size(drops), F.lit(0)).cast("long").alias("n_dropped"),
    )
