"""Term lists compiled to Columns when the plan is built.

Three ways to match a term: `stem*` matches a word's beginning; one token of a-z, а-я, digits and hyphen a
whole word; anything else a substring. Patterns start with (?U), so word boundaries follow Unicode.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: what a whole-word term is made of.
TOKEN = re.compile(r"[a-zа-я0-9\-]+")


def quoted(text: str) -> str:
    """text as a literal of a Java pattern."""
    return re.sub(r"([^\w\s])", r"\\\1", text)


def mode(term: str) -> str:
    if term.endswith("*"):
        return "stem"
    return "word" if TOKEN.fullmatch(term) else "phrase"


def pattern(term: str) -> str:
    kind = mode(term)
    if kind == "phrase":
        return quoted(term)
    return r"\b" + (quoted(term[:-1]) if kind == "stem" else quoted(term) + r"\b")


def words(text: Column) -> Column:
    """Distinct maximal runs of word characters; those of ASCII need no look at Unicode's tables."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?U)(?=\w)[a-z0-9_]*\w*"), F.lit(0)))


def spaced(found: Column) -> Column:
    """words as one text, each between spaces, in which a word or stem is a substring."""
    return F.concat(F.lit(" "), F.array_join(found, " "), F.lit(" "))


@dataclass(frozen=True)
class Known:
    """A text's words, spaced, and those of them that are listed: what words a pack asks for is then found by one pass."""

    spaced: Column
    found: Column
    listed: frozenset[str]


def listed(known: Column, words: Iterable[str]) -> Column:
    """The distinct words of a text that are in a list."""
    return F.array_intersect(known, F.array(*map(F.lit, words)).cast("array<string>"))


def spaced_of(known: Column | Known) -> Column:
    return known.spaced if isinstance(known, Known) else known


def one_run(term: str) -> bool:
    """Whether a word or stem is a run of word characters, so that a text's words tell whether it matches."""
    return mode(term) != "phrase" and re.fullmatch(r"\w+", term.removesuffix("*")) is not None


def holds(text: Column, words: Sequence[str], known: Column | Known | None = None) -> Column:
    """Whether the text has one of the words as a substring; those that are runs of word characters are looked for in its
    distinct words, which are shorter."""
    out = F.lit(False)
    for w in words:
        out = out | (text if known is None or re.fullmatch(r"\w+", w) is None else spaced_of(known)).contains(w)
    return out


def _some(text: Column, worded: Sequence[str]) -> Column:
    """Whether a word or stem is a substring, without which its pattern matches nowhere."""
    return holds(text, [t.removesuffix("*") for t in worded])


def matches(text: Column, term: str, known: Column | Known | None = None) -> Column:
    """known: the text's words, spaced, or what is known of them."""
    if known is not None and one_run(term):
        if isinstance(known, Known) and term in known.listed:
            return F.array_contains(known.found, term)
        return spaced_of(known).contains(f" {term[:-1]}" if mode(term) == "stem" else f" {term} ")
    return text.contains(term) if mode(term) == "phrase" else _some(text, [term]) & text.rlike("(?U)" + pattern(term))


def any_of(text: Column, terms: Sequence[str], known: Column | Known | None = None) -> Column:
    """Whether any term matches: one alternation for words and stems that known doesn't tell, plain substring tests for the rest."""
    if not terms:
        return F.lit(False)
    told = [t for t in terms if known is not None and one_run(t)]
    worded = [t for t in terms if mode(t) != "phrase" and t not in told]
    found = [F.lit(False)]
    if worded:
        found = [_some(text, worded) & text.rlike("(?U)(?:" + "|".join(map(pattern, worded)) + ")")]
    for t in terms:
        if mode(t) == "phrase" or t in told:
            found.append(matches(text, t, known))
    out = found[0]
    for f in found[1:]:
        out = out | f
    return out


def hits(text: Column, terms: Sequence[str], known: Column | Known | None = None) -> Column:
    """The terms that match, in list order; each counts once."""
    if not terms:
        return F.array().cast("array<string>")
    none = "\0" * (1 + max(map(len, terms)))  # no term; removing it takes generated code, dropping nulls a lambda
    return F.array_remove(F.array(*[F.when(matches(text, t, known), F.lit(t)).otherwise(none) for t in terms]), none)


def count(text: Column, terms: Sequence[str], known: Column | Known | None = None) -> Column:
    """How many terms match: the size of hits, without the words."""
    out = F.lit(0)
    for t in terms:
        out = out + F.when(matches(text, t, known), 1).otherwise(0)
    return out


def first_hit(text: Column, terms: Sequence[str], known: Column | Known | None = None) -> Column:
    """The first term of the list that matches, or null."""
    return F.coalesce(*[F.when(matches(text, t, known), F.lit(t)) for t in terms], F.lit(None).cast("string"))


def tokens(text: Column) -> Column:
    """Distinct runs of word characters and hyphens of the text in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)[\w-]+"), F.lit(0)))


def unmatchable(terms: Sequence[str]) -> list[str]:
    """Terms with a star before their end: it stands for itself, so they hardly ever match; loaders warn of them."""
    return [t for t in terms if "*" in t[:-1]]
