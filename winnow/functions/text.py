"""Scalar text functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from winnow.schema import DESCRIPTION_CHARS

# Sampling lengths, marks, secret forms, remote words, formats of work, entities, headers, markers.
HEAD_CHARS, TAIL_CHARS, MIDDLE = 700, 800, "\n[…middle left out…]\n"  # the mark's wording is a choice of this library
MASK = "***REDACTED***"
SECRETS = (
    (r"/bot\d{6,}:[A-Za-z0-9_-]{20,}", "/bot" + MASK),
    (r"(?i)((?:api[_-]?key|token|access[_-]?token|secret|password|passwd)=)[^&\s\"']+", "$1" + MASK),
    (r"(?i)(Bearer\s+)[A-Za-z0-9._\-]{16,}", "$1" + MASK),
    (r"\b((?:csk|sk|pk|ghp|gho|xox[abps])[-_])[A-Za-z0-9]{16,}", "$1" + MASK),
)
REMOTE_PLACES = ("remote", "anywhere", "worldwide", "distributed", "удалён", "удален", "дистанцион")
ON_SITE = ("hybrid", "onsite", "on-site", "on site", "in office", "office")
REMOTE_PHRASES = (
    r"fully[\s-]remote|100%\s*remote|remote[\s-]first|work from anywhere|remote position|remote role|fully distributed|"
    r"полностью удалённ|полностью удаленн|удалённая работа|удаленная работа|удалённый формат|удаленный формат"
)
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
GENERIC_HEADERS = ("вакансия", "вакансии", "vacancy", "hiring", "job", "jobs", "job opening", "открыта вакансия", "новая вакансия", "we are hiring", "we're hiring")
POST_WORDS = (
    "ищем", "вакансия", "hiring", "vacancy", "job", "developer", "engineer", "разработчик", "backend", "frontend", "зарплата", "salary", "удалённо", "remote",
    "full-time", "part-time", "web3", "crypto", "blockchain", "defi", "operations", "qa", "specialist", "менеджер", "manager", "analyst", "аналитик",
)
RESUME_MARKS = (
    "резюме", "ищу работу", "ищу проект", "ищу вакансию", "в поиске работы", "готов взяться", "open to work", "looking for work", "#резюме", "#ищуработу",
    "#cv", "cv:", "ищу удаленную работу",
)
VACANCY_MARKS = ("ваканси", "hiring", "ищем", "требу", "we are looking", "we're looking")
PROMO_MARKS = ("sponsored", "sponsored job post", "promoted post", "#реклама", "реклама:", "на правах рекламы", "erid:", "партнёрский пост", "партнерский пост")
CHATTER = (
    "добрый день, друзья", "всем привет", "дорогие подписчики", "уважаемые подписчики", "отпуск окончен", "мы вернулись", "с возвращением", "напоминаем, что",
)
TITLE_CHARS, TITLE_LETTERS, NO_TITLE = 120, 8, "Job opening"


def blank(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def normal(col: Column) -> Column:
    """Lower case; Cyrillic а, в, с before 1 or 2 (and no further digit) become Latin, as in language levels."""
    low = out = F.lower(blank(col))
    for cyrillic, latin in zip("авс", "abc", strict=True):
        out = F.regexp_replace(out, cyrillic + "(?=[12](?![0-9]))", latin)
    return F.when(contains_any(low, tuple(c + d for c in "авс" for d in "12")), out).otherwise(low)


def blob(title: Column, text: Column) -> Column:
    return F.concat_ws(" ", normal(title), normal(text))


def same_key(company: Column, title: Column) -> Column:
    """Key of near-duplicates: case, punctuation, spacing and bracketed tails don't count."""
    out = F.concat_ws("|", normal(company), normal(title))
    out = F.regexp_replace(out, r"\([^)]*\)", " ")
    out = F.regexp_replace(out, r"(?U)[^\w|]+", " ")
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def head_and_tail(col: Column) -> Column:
    """A long text's beginning and end around a mark; requirements often stand last."""
    text = blank(col)
    return F.when(F.length(text) <= HEAD_CHARS + TAIL_CHARS, text).otherwise(F.concat(F.left(text, F.lit(HEAD_CHARS)), F.lit(MIDDLE), F.right(text, F.lit(TAIL_CHARS))))


def description(col: Column) -> Column:
    return F.left(blank(col), F.lit(DESCRIPTION_CHARS))


def redact(col: Column) -> Column:
    for form, mask in SECRETS:
        col = F.regexp_replace(col, form, mask)
    return col


def place_is_remote(location: Column) -> Column:
    return contains_any(F.lower(blank(location)), REMOTE_PLACES)


def says_remote(text: Column) -> Column:
    return blank(text).rlike(f"(?iu)(?:{REMOTE_PHRASES})")


def is_remote(location: Column, text: Column, workplace: Column, flag: Column) -> Column:
    """The board's workplace type decides; then the location, then an explicit phrase, then the flag."""
    kind = F.lower(F.trim(blank(workplace)))
    return F.when(kind != "", kind == "remote").when(place_is_remote(location), True).when(says_remote(text), True).otherwise(F.coalesce(flag, F.lit(False)))


def on_site_note(workplace: Column) -> Column:
    kind = F.lower(F.trim(blank(workplace)))
    return F.when(kind.isin(*ON_SITE), F.concat(F.lit("\nWork format: "), workplace, F.lit(" (on-site presence required)"))).otherwise("")


def schedule_note(mode: Column) -> Column:
    """A line on shifts for the scorer, whose sample of a long text may leave them out; mode as of gates.shift_mode."""
    told = {"core": "NIGHT SHIFTS are part of the regular working pattern.", "occasional": "the listing mentions occasional NIGHT SHIFTS (a few per month).", "shift": "rotating/shift work (no night shifts stated)."}
    return F.coalesce(*[F.when(mode == k, F.lit(f"\nSchedule: {v}")) for k, v in told.items()], F.lit(""))


def unescape(col: Column) -> Column:
    for entity, char in ENTITIES:
        col = F.replace(col, F.lit(entity), F.lit(char))
    return col


def plain(html: Column) -> Column:
    """Tags to spaces, runs of space to one, and entities last."""
    return unescape(F.trim(F.regexp_replace(F.regexp_replace(html, r"<[^>]+>", " "), r"(?U)\s+", " ")))


def without_tags(html: Column) -> Column:
    return F.trim(F.regexp_replace(html, r"<[^>]+>", ""))


def escape(col: Column) -> Column:
    """& first, then the angle brackets."""
    return F.replace(F.replace(F.replace(col, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def short_md5(*parts: Column) -> Column:
    return F.left(F.md5(F.concat_ws("_", *parts)), F.lit(12))


def as_record(title: Column, company: Column, low: Column, high: Column, currency: Column, location: Column, remote: Column, tags: Column, text: Column) -> Column:
    """A posting as lines for a scorer; lines without a value are left out."""
    some = lambda c: F.when(F.coalesce(c, F.lit(0)) != 0, c.cast("string")).otherwise("")
    pay = F.concat(F.lit("Salary: "), some(low), F.lit("–"), some(high), F.lit(" "), currency)
    return F.concat_ws(
        "\n", F.concat(F.lit("Title: "), title), F.concat(F.lit("Company: "), company),
        F.when((some(low) != "") | (some(high) != ""), pay), F.when(blank(location) != "", F.concat(F.lit("Location: "), location)),
        F.when(remote, F.lit("Remote: yes")), F.when(F.size(tags) > 0, F.concat(F.lit("Tags: "), F.array_join(tags, ", "))),
        F.lit("Description:"), head_and_tail(text),
    )


def clean_title(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, r"(?U)^[\W_]+", ""))


def letters(col: Column) -> Column:
    return F.length(F.regexp_replace(col, r"[^\p{L}]", ""))


def pick_title(lines: Column) -> Column:
    """First line with 8 letters that is neither tags only nor a generic header; else the first with a letter."""
    cleaned = F.transform(F.filter(lines, lambda x: ~F.trim(x).rlike(r"(?U)^(?:[#＃][\w\-]+[\s,;|·•]*)+$")), clean_title)
    told = F.filter(cleaned, lambda x: (letters(x) >= TITLE_LETTERS) & ~F.btrim(F.lower(x), F.lit(" :：-–—.!")).isin(*GENERIC_HEADERS))
    some = F.filter(F.transform(lines, clean_title), lambda x: letters(x) > 0)
    return F.left(F.coalesce(F.get(told, F.lit(0)), F.get(some, F.lit(0)), F.lit(NO_TITLE)), F.lit(TITLE_CHARS))


def post_kept(text: Column) -> Column:
    """A channel's post that mentions work and is neither a résumé nor a promotion."""
    low = F.lower(blank(text))
    head = F.left(low, F.lit(80))
    resume = contains_any(head, RESUME_MARKS) & ~contains_any(head, VACANCY_MARKS)
    promo = contains_any(low, PROMO_MARKS) | (contains_any(F.left(low, F.lit(120)), CHATTER) & ~contains_any(low, VACANCY_MARKS))
    return contains_any(low, POST_WORDS) & ~resume & ~promo


def currency_of(text: Column) -> Column:
    low = F.lower(text)
    return F.when(text.contains("$") | low.contains("usd"), "USD").when(low.contains("eur"), "EUR").otherwise("RUB")


def range_salary(text: Column) -> Column:
    """Whole numbers above 100, spaces inside allowed; the first two are the range: struct(low, high, currency)."""
    flat = F.replace(text, F.lit(" "), F.lit(" "))
    runs = F.transform(F.regexp_extract_all(flat, F.lit(r"[\d\s]+"), F.lit(0)), lambda x: F.regexp_replace(x, r"\s", "").try_cast("int"))
    big = F.filter(runs, lambda x: x > 100)
    return F.struct(F.get(big, F.lit(0)).alias("low"), F.get(big, F.lit(1)).alias("high"), currency_of(flat).alias("currency"))


def post_salary(text: Column) -> Column:
    """The first two numbers of a post; k counts thousands, plain numbers must lie in 500 to 50 million."""
    raw = F.slice(F.regexp_extract_all(text, F.lit(r"(?iu)\d[\d\s,.]*(?:k|тыс)?"), F.lit(0)), 1, 2)
    bare = F.transform(raw, lambda x: F.lower(F.regexp_replace(F.trim(x), "[ ,]", "")))

    def value(x: Column) -> Column:
        n = F.trim(x).try_cast("long")
        return F.when(x.endswith("k"), (F.regexp_replace(x, "k$", "").try_cast("double") * 1000).cast("long")).when(x.rlike(r"^\d+\s*$") & n.between(500, 50_000_000), n)

    found = F.array_compact(F.transform(bare, value))
    low = F.lower(text)
    money = F.when(low.contains("руб") | text.contains("₽"), "RUB").otherwise("USD")
    return F.struct(
        F.when(F.size(found) > 0, F.array_min(found)).alias("low"), F.when(F.size(found) > 1, F.array_max(found)).alias("high"), money.alias("currency")
    )


def dashed_salary(text: Column) -> Column:
    """`$50k–$80k`: split at the en dash, k stands for three zeros; the first and the last part, each null if it isn't
    a number, the last only after a sound first."""
    ends = F.transform(F.split(text, "–"), lambda x: F.replace(F.regexp_replace(F.trim(x), r"[$,]", ""), F.lit("k"), F.lit("000")).try_cast("double").try_cast("int"))
    low = F.get(ends, F.lit(0))
    return F.struct(low.alias("low"), F.when(low.isNotNull(), F.try_element_at(ends, F.lit(-1))).alias("high"))


def monthly(yearly: Column) -> Column:
    return F.floor(yearly / 12).cast("int")


def moment(text: Column) -> Column:
    """RFC 2822, then ISO 8601 (Z or offset), else null."""
    rfc = F.regexp_replace(text, r"^[A-Za-z]{3},\s*", "")
    return F.coalesce(F.try_to_timestamp(rfc, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(rfc, F.lit("d MMM yyyy HH:mm:ss z")), text.try_cast("timestamp"))


def band(score: Column) -> Column:
    return F.when(score >= 90, "🔥").when(score >= 80, "⭐").when(score >= 70, "✅").otherwise("👀")
