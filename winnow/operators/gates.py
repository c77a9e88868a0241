"""Gates: role-independent flags of a posting, computed once, and the first reason that rejects it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.functions import patterns as P
from winnow.functions import spans, terms
from winnow.functions import text as tx

U = P.union


def years_asked(blob: Column, known: Column | terms.Known | None = None) -> Column:
    """Seven years or more: as a lower bound, or near a word about experience and none about the firm's past."""
    asked = F.exists(spans.finditer(blob, U(P.YEARS)), lambda m: _near(blob, m, 40).rlike(U(P.YEARS_ASKED)) & ~_near(blob, m, 40).rlike(U(P.YEARS_TOLD)))
    return _holds(blob, P.YEARS_HOLD, known) & (blob.rlike(U(P.YEARS_AT_LEAST)) | (blob.rlike(U(P.YEARS)) & asked))


def _holds(blob: Column, words: tuple[str, ...], known: Column | terms.Known | None = None) -> Column:
    """A cheap test before patterns all of whose matches hold one of the words; blob is in lower case."""
    return terms.holds(blob, words, known)


def _near(blob: Column, m: Column, span: int) -> Column:
    return spans.window(blob, m, span, span)


#: Where a line ends; one that ends in a colon heads the next one and goes on.
LINE_END = r"(?<!:[ \t]{0,3})\n"


def _near_in_line(blob: Column, m: Column, span: int) -> Column:
    """What surrounds a mention, up to the ends of its line."""
    head, tail = spans.cut(blob, m.start - span, m.start), spans.cut(blob, m.end, m.end + span)
    return F.concat(F.element_at(F.split(head, LINE_END, -1), -1), m.m, F.get(F.split(tail, LINE_END, -1), F.lit(0)))


def citizenship_asked(blob: Column, known: Column | terms.Known | None = None) -> Column:
    places = F.regexp_extract_all(blob, F.lit(U(P.RIGHT_TO_WORK)), F.lit(1))
    asked = blob.rlike(P.FLAGS + r"\b(?:" + "|".join(P.CITIZEN) + r")\b") | F.exists(places, lambda x: x.rlike(P.FLAGS + r"\b(?:" + "|".join(P.FOREIGN_PLACES) + r")\b"))
    return _holds(blob, P.CITIZEN_HOLD, known) & asked


def _one_of(known: Column, names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(known, F.array(*map(F.lit, names)))


def code_asked(blob: Column, known: Column | None = None) -> Column:
    """known: the text's words, or those of CODE_TOLD; they tell more cheaply which texts the patterns need not see."""
    if known is None:
        may = _holds(blob, P.CODE_HOLD) | (_holds(blob, P.CODE_VERBS) & _holds(blob, P.CODE_LANGUAGES))
    else:
        may = _one_of(known, P.CODE_WORDS) | _holds(blob, P.CODE_MARKS) | (_one_of(known, P.VERB_WORDS) & (_one_of(known, P.LANGUAGE_WORDS) | blob.contains("c++")))
    return may & blob.rlike(U(P.CODE))


def is_header(before: Column, mark: Column) -> Column:
    """Whether a mark of preference heads a section: it has a header's form and no linking verb before it."""
    return F.trim(mark).rlike(P.FLAGS + "^(?:" + "|".join(P.HEADER_FORM) + ")$") & ~F.right(before, F.lit(16)).rlike(P.FLAGS + P.LINK_BEFORE)


def optional_near(blob: Column, m: Column) -> Column:
    """Whether a mention is marked as a plus within 60 characters."""
    head, tail = spans.cut(blob, m.start - 60, m.start), spans.cut(blob, m.end, m.end + 60)
    plus = U(P.A_PLUS)
    mark, at = spans.first(tail, plus), spans.first_at(tail, plus)
    between = F.left(tail, F.greatest(at, F.lit(0)))
    after = tail.rlike(plus) & ~is_header(between, mark)
    other = between.rlike(P.language()) | between.rlike(U(P.OTHER_LANGUAGES))
    rest = F.substr(head, spans.first_at(head, plus) + F.length(spans.first(head, plus)) + 1)
    before = head.rlike(plus) & ~rest.rlike(P.SENTENCE_END)
    return F.when(after, between.rlike(P.FLAGS + P.LIST_GOES_ON) | ~other).otherwise(before)


def with_sections(blob: Column, f) -> Column:
    """f(spans of the headers of optional parts, those of required parts), which count only after an optional one."""
    none = F.array().cast(spans.NONE)
    found = F.filter(spans.finditer(blob, U(P.OPTIONAL_PART)), lambda s: is_header(spans.cut(blob, s.start - 16, s.start), s.m))
    required = lambda o: F.when(F.size(o) > 0, spans.finditer(blob, U(P.REQUIRED_PART))).otherwise(none)
    return spans.let(F.when(_holds(blob, P.OPTIONAL_HOLD), found).otherwise(none), lambda o: spans.let(required(o), lambda r: f(o, r)))


def in_optional_part(m: Column, optional: Column, required: Column) -> Column:
    last = lambda heads: F.coalesce(F.array_max(F.transform(F.filter(heads, lambda s: s.end <= m.start), lambda s: s.start)), F.lit(-1))
    return last(optional) > last(required)


def requirement(blob: Column, m: Column, span: int = 90) -> Column:
    """The mention with what surrounds it, cut at the nearest item's end on either side."""
    head, tail = F.split(spans.cut(blob, m.start - span, m.start), P.ITEM_END, -1), F.split(spans.cut(blob, m.end, m.end + span), P.ITEM_END, -1)
    return F.concat(F.element_at(head, -1), m.m, F.get(tail, F.lit(0)))


def english_mode(blob: Column, russian_terms: list[str], known: Column | terms.Known | None = None) -> Column:
    """How English is asked for: spoken, level_c, level_b, generic, written, or null."""
    only_optional = spans.let(spans.finditer(blob, U(P.RUSSIAN)), lambda ms: (F.size(ms) > 0) & F.forall(ms, lambda m: optional_near(blob, m)))
    russian = terms.any_of(blob, russian_terms, known) & ~only_optional & (blob.rlike(U(P.RUSSIAN_DESK)) | ~blob.rlike(U(P.BOTH_LANGUAGES)))

    def label(m: Column) -> Column:
        level = F.concat(m.m, F.lit(" "), spans.cut(blob, m.end, m.end + 30))
        kind = lambda near: F.when(near.rlike(U(P.SPOKEN)), "spoken").when(level.rlike(U(P.LEVEL_C)), "level_c").when(near.rlike(U(P.WRITTEN)), "written").otherwise("generic")
        return F.when(level.rlike(U(P.LEVEL_B)), "level_b").otherwise(spans.let(requirement(blob, m), kind))

    first = lambda labels: F.coalesce(*[F.when(F.array_contains(labels, k), F.lit(k)) for k in ("spoken", "level_c", "level_b", "generic", "written")])
    strict = lambda ms, o, r: F.filter(ms, lambda m: ~optional_near(blob, m) & ~in_optional_part(m, o, r))
    winner = lambda ms: with_sections(blob, lambda o, r: spans.let(F.transform(strict(ms, o, r), label), first))
    mentioned = spans.let(spans.finditer(blob, P.led(P.ENGLISH)), lambda ms: F.when(F.size(ms) > 0, F.when(~russian, winner(ms))))
    return F.when(_holds(blob, P.ENGLISH_HOLD, known), mentioned)


def foreign_language_asked(blob: Column, known: Column | None = None, found_words: Column | None = None) -> Column:
    """A language other than Russian and English, neither a plus nor in an optional part; Russian names need a word
    about language within 60 characters of their line. found_words: those of the known words that LANGUAGES has, if given."""
    def asked(m: Column, optional: Column, required: Column) -> Column:
        cyrillic = m.m.rlike("(?iu)[а-яё]")
        return ~optional_near(blob, m) & ~in_optional_part(m, optional, required) & (~cyrillic | _near_in_line(blob, m, 60).rlike(U(P.LANGUAGE_NEAR)))

    found = spans.let(spans.finditer(blob, P.language()), lambda ms: with_sections(blob, lambda o, r: F.exists(ms, lambda m: asked(m, o, r))))
    if known is None:
        return blob.rlike(P.language()) & found
    stems = "|".join(s.removesuffix(r"\w*") for s in P.LANGUAGE_STEMS)
    cyrillic = (F.octet_length(blob) != F.length(blob)) & blob.rlike("[а-яё]") & F.exists(known, lambda w: w.rlike(f"^(?:{stems})"))
    return (_one_of(known if found_words is None else found_words, P.LANGUAGES) | cyrillic) & found


def unreadable(blob: Column) -> Column:
    text = F.regexp_replace(blob, r"(?U)^\s+|\s+$", "")
    share = F.regexp_count(text, F.lit(P.UNREADABLE)) / F.length(text)
    # Each such character takes a byte more than one; most texts have too few bytes for the share. Branches, as what an
    # `and` holds more than once is found before its first part is known.
    more, least = F.octet_length(blob) - F.length(blob), F.length(F.btrim(blob, F.lit(P.WHITE)))
    few = (least < P.UNREADABLE_LENGTH) | (more < least * P.UNREADABLE_SHARE)
    return F.when(more < P.UNREADABLE_LENGTH * P.UNREADABLE_SHARE, False).otherwise(F.when(few, False).otherwise((F.length(text) >= P.UNREADABLE_LENGTH) & (share >= P.UNREADABLE_SHARE)))


def shift_mode(blob: Column, known: Column | terms.Known | None = None) -> Column:
    night, shifts = _holds(blob, P.NIGHT_HOLD, known), _holds(blob, P.SHIFTS_HOLD, known)
    return F.when(night & blob.rlike(U(P.NIGHT_RARE)), "occasional").when(night & blob.rlike(U(P.NIGHT)), "core").when(shifts & blob.rlike(U(P.SHIFTS)), "shift")


def place_rejects(blob: Column, relocation: list[str]) -> Column:
    """A `location:` line outside home and the relocation list, with no explicit remote phrase anywhere."""
    line = F.regexp_extract(blob, r"(?U)location:\s*([^\n]+)", 1)
    return blob.contains("location:") & (line != "") & ~tx.says_remote(blob) & ~line.rlike("(?iu)(?:" + "|".join(P.HOME_PLACES) + ")") & ~terms.any_of(line, relocation)


def listed_words(pack) -> frozenset[str]:
    """The words that are asked of a posting's blob."""
    lists = [pack.hard_exclude, pack.english_boost, pack.english_penalty, pack.entry, pack.remote, pack.relocation, pack.onsite, P.LANGUAGES, P.CODE_TOLD]
    lists += [x for r in pack.roles for x in (r.must_role, r.must_domain, r.titles_strong, r.titles_weak, r.keywords_boost, r.keywords_penalize)]
    return frozenset(t for x in lists for t in x if terms.mode(t) == "word" and terms.one_run(t))


def known_of(pack) -> terms.Known:
    """What flagged postings know of their blob's words."""
    return terms.Known(F.col("_words"), F.col("_found"), listed_words(pack))


def flagged(postings: DataFrame, pack) -> DataFrame:
    """postings (id, title, description, location) with the blob, every role-independent flag and each role's first reason.

    Flags are ordinary columns, staged in projections, so that no generated method grows too large, no pattern runs
    once per role and what isn't asked for is left out.
    """
    text = F.when(tx.blank(F.col("location")) != "", F.concat(tx.blank(F.col("description")), F.lit("\nLocation: "), F.col("location"))).otherwise(F.col("description"))
    staged = postings.withColumns({"_title": tx.normal(F.col("title")), "_blob": tx.blob(F.col("title"), text), "_tokens": terms.tokens(tx.blank(F.col("title")))})
    staged = staged.withColumn("_known", terms.words(F.col("_blob")))
    staged = staged.withColumns({"_words": terms.spaced(F.col("_known")), "_found": terms.listed(F.col("_known"), sorted(listed_words(pack)))})
    blob, tokens, known, found, told = F.col("_blob"), F.col("_tokens"), F.col("_known"), F.col("_found"), known_of(pack)
    has = lambda words: F.arrays_overlap(tokens, F.array(*map(F.lit, words)))
    staged = staged.withColumns({
        "_excluded": terms.first_hit(blob, pack.hard_exclude, told),
        "_avoided": terms.holds(blob, pack.avoid, told),
        "_leader": has(P.TITLE_EXCLUDED),
        "_dev": has(P.TITLE_DEV) & ~has(P.TITLE_OPS),
        "_finance": has(tuple(pack.finance_titles)) & ~has(P.TITLE_CRYPTO) if pack.finance_titles else F.lit(False),
        "_code": code_asked(blob, found),
        "_years": years_asked(blob, told),
        "_language": foreign_language_asked(blob, known, found),
        "_unreadable": unreadable(blob),
        "_citizen": citizenship_asked(blob, told),
        "_english": english_mode(blob, pack.english_boost, told),
        "_shift": shift_mode(blob, told),
    })
    staged = staged.withColumns({
        "_remote": terms.any_of(blob, pack.remote, told), "_reloc": terms.any_of(blob, pack.relocation, told), "_onsite": terms.any_of(blob, pack.onsite, told),
        "_place": place_rejects(blob, pack.relocation), "_penalty": terms.hits(blob, pack.english_penalty, told), "_penalties": terms.count(blob, pack.english_penalty, told),
        "_russian": terms.any_of(blob, pack.english_boost, told), "_entry": terms.any_of(blob, pack.entry, told),
    })
    return staged.withColumns({f"_reason{i}": first_reason(r, pack) for i, r in enumerate(pack.roles)})


def first_reason(role, pack) -> Column:
    """The first gate that fails for a role, in the fixed order, or null."""
    c, blob, told = F.col, F.col("_blob"), known_of(pack)
    gates = [
        F.when(c("_excluded").isNotNull(), F.concat(F.lit("hard-exclude: '"), c("_excluded"), F.lit("'"))),
        F.when(c("_avoided"), "avoided industry"),
        F.when(c("_leader"), "executive, developer or finance title"),
        F.when(c("_dev"), "developer title without operations context"),
        F.when(c("_finance"), "finance title without crypto context"),
        F.when(c("_code") & F.lit(role.name not in pack.code_exempt), "code required"),
        F.when(c("_years"), "seven or more years required"),
        F.when(c("_language"), "another language required"),
        F.when(c("_unreadable"), "unreadable script"),
        F.when(c("_citizen"), "citizenship or right to work required"),
        F.when(c("_english").isin(*pack.english_gates), F.concat(F.lit("English required: "), c("_english"))),
        F.when(c("_shift") == "core", "night shifts"),
        F.when(~terms.any_of(blob, role.must_role, told), "no word of the role"),
    ]
    if role.must_domain:
        gates.append(F.when(~terms.any_of(blob, role.must_domain, told), "no word of the domain"))
    return F.coalesce(*gates)
