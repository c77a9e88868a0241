"""Matches with their offsets, and windows around them, as Column expressions.

`finditer` builds the offsets from the matches and the gaps between them, both from built-ins, so nothing
leaves the JVM. Patterns must not match the empty string. A row costs one scan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f) -> Column:
    """f(value) with the value found once; an expression that lambdas name is else found again for each of their calls."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


#: Of no match.
NONE = "array<struct<m:string,start:int,end:int>>"


#: Set around matches by one scan; a text that holds it is scanned twice, for the matches and for the gaps.
MARK = "\0"


def finditer(text: Column, pattern: str) -> Column:
    """array<struct<m string, start int, end int>> of the non-overlapping matches, 0-based."""
    zero = F.array().cast(NONE)

    def step(acc: Column, x: Column) -> Column:
        start = F.coalesce(F.try_element_at(acc, F.lit(-1)).end, F.lit(0)) + F.length(x["g"])
        return F.concat(acc, F.array(F.struct(x["m"].alias("m"), start.cast("int").alias("start"), (start + F.length(x["m"])).cast("int").alias("end"))))

    def spans(parts: Column) -> Column:
        gaps, found = F.filter(parts, lambda _, i: i % 2 == 0), F.filter(parts, lambda _, i: i % 2 == 1)
        pairs = F.filter(F.arrays_zip(gaps.alias("g"), found.alias("m")), lambda x: x["m"].isNotNull())  # the last gap ends no match
        return F.aggregate(pairs, zero, step)

    twice = F.flatten(F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda g, m: F.array(g, m)))
    once = F.split(F.regexp_replace(text, pattern, MARK + "$0" + MARK), MARK, -1)
    return let(F.when(text.contains(MARK), twice).otherwise(once), spans)


def cut(text: Column, start: Column, end: Column) -> Column:
    """text[start:end], 0-based, both clipped to the text's start."""
    lo = F.greatest(start, F.lit(0))
    return F.substr(text, lo + 1, F.greatest(end - lo, F.lit(0)))


def window(text: Column, span: Column, before: int, after: int) -> Column:
    return cut(text, span.start - before, span.end + after)


def first_at(text: Column, pattern: str) -> Column:
    """0-based start of the first match, -1 without one."""
    return F.regexp_instr(text, F.lit(pattern)) - 1


def first(text: Column, pattern: str) -> Column:
    return F.regexp_extract(text, pattern, 0)
