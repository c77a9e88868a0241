"""Whole elements of HTML as Column expressions: an element ends where its depth returns.

A page is cut in front of every opening and closing tag of the element's name, the pieces are scanned with a running depth,
and the element is what lies between its opening tag and the tag that brings the depth back to nought. Comments, scripts
and styles are taken out first. An element that is never closed goes to the end of the page. Angle brackets inside
attributes aren't told from tags.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ASIDE = r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>"


def once(value: Column, use) -> Column:
    """use(value) with the value computed once, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def cleaned(html: Column) -> Column:
    return F.regexp_replace(html, ASIDE, "")


def _element(pieces: Column, at: Column) -> Column:
    """The element whose opening tag begins piece `at`."""
    rest = F.slice(pieces, at + 1, F.size(pieces))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(False).alias("done"))

    def step(acc: Column, piece: Column) -> Column:
        depth = acc["depth"] + F.when(piece.startswith("</"), -1).otherwise(1)
        return F.when(acc["done"], acc).otherwise(F.struct(depth.alias("depth"), (acc["n"] + 1).alias("n"), (depth == 0).alias("done")))

    def cut(end: Column) -> Column:
        closing = F.regexp_extract(F.get(pieces, at + end["n"] - 1), r"^[^>]*>", 0)
        whole = F.concat(F.array_join(F.slice(pieces, at + 1, F.greatest(end["n"] - 1, F.lit(0))), ""), closing)
        return F.when(end["done"], whole).otherwise(F.array_join(rest, ""))

    return once(F.aggregate(rest, start, step), cut)


def _found(html: Column, name: Column, opening: str) -> Column:
    """array<string> of the elements of that name whose opening tag has the form."""
    pieces = F.split(cleaned(html), F.concat(F.lit("(?i)(?=</?"), name, F.lit(r"\b)")))

    def all_of(p: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: F.get(p, i).rlike(f"(?is)^{opening}"))
        return F.transform(at, lambda i: _element(p, i))

    return once(pieces, all_of)


def elements(html: Column, name: str, form: str = "") -> Column:
    """array<string>: all elements of a name, nested ones too, whose opening tag holds the form."""
    return _found(html, F.lit(name), rf"<{name}\b[^>]*{form}[^>]*>")


def first_with(html: Column, form: str) -> Column:
    """The first element of any name whose opening tag holds the form; null without one."""
    name = F.lower(F.regexp_extract(cleaned(html), rf"(?is)<([a-z][a-z0-9]*)\b[^>]*{form}[^>]*>", 1))
    opening = rf"<[a-z][a-z0-9]*\b[^>]*{form}[^>]*>"
    return F.when(name != "", F.get(_found(html, F.nullif(name, F.lit("")), opening), F.lit(0)))


def class_is(name: str) -> str:
    """The form of an opening tag one of whose classes is that."""
    return rf"\bclass\s*=\s*[\"'](?:[^\"']*\s)?{name}(?:\s[^\"']*)?[\"']"


def attribute_is(name: str, value: str) -> str:
    return rf"\b{name}\s*=\s*[\"']?{value}(?=[\"'\s>])[\"']?"


def inner(element: Column) -> Column:
    """An element without its own tags."""
    return F.regexp_replace(element, r"(?s)^<[^>]*>|</[^<>]*>$", "")
