"""Fixed values of the posting gates: word sets and patterns, which results depend on."""

from __future__ import annotations

import re
from collections.abc import Iterable

#: Patterns run on text in lower case; Unicode classes for word boundaries, \n as the only line end.
FLAGS = "(?Ud)"

# Words of titles.
TITLE_EXCLUDED = (
    "ceo", "cto", "cfo", "coo", "cmo", "founder", "co-founder", "president", "трейдер", "trader", "руководитель",
    "solidity", "backend", "frontend", "fullstack", "full-stack", "auditor", "quant", "quantitative",
)
TITLE_DEV = ("developer", "programmer", "engineer", "devops", "architect", "разработчик", "программист")
TITLE_OPS = (
    "qa", "test", "testing", "tester", "operations", "ops", "support", "community", "relations", "automation", "rpa", "no-code", "low-code", "workflow",
    "тестировщик", "поддержка", "поддержки", "оператор", "сообщества",
)
FINANCE_TITLES = ("portfolio", "fund", "quant", "quantitative")
TITLE_CRYPTO = ("web3", "crypto", "blockchain", "defi", "digital")

# Languages other than Russian and English; Russian names as stems.
LANGUAGES = (
    "chinese", "mandarin", "cantonese", "deutsch", "german", "french", "français", "spanish", "español", "japanese", "korean", "portuguese", "arabic", "hindi",
    "italian", "dutch", "turkish", "greek", "vietnamese", "serbian", "croatian", "indonesian", "bahasa", "thai", "kazakh", "georgian", "armenian", "uzbek",
    "azerbaijani", "hebrew", "romanian", "bulgarian", "danish", "swedish", "norwegian", "finnish", "czech", "hungarian", "ukrainian", "belarusian",
)
LANGUAGE_STEMS = (
    r"польск\w*", r"немецк\w*", r"французск\w*", r"испанск\w*", r"китайск\w*", r"японск\w*", r"корейск\w*", r"арабск\w*", r"итальянск\w*", r"турецк\w*", r"греческ\w*", r"вьетнамск\w*", r"сербск\w*", r"индонезийск\w*",
    r"тайск\w*", r"казахск\w*", r"грузинск\w*", r"армянск\w*", r"узбекск\w*", r"украинск\w*", r"белорусск\w*", r"азербайджанск\w*", r"иврит\w*", r"румынск\w*", r"болгарск\w*", r"датск\w*", r"шведск\w*", r"норвежск\w*",
    r"финск\w*", r"чешск\w*", r"венгерск\w*", r"голландск\w*", r"нидерландск\w*",
)

# Patterns.
CODE = (
    r"\b(?:selenium|cypress|playwright|pytest|jest|mocha|appium|robot\s+framework)\b",
    r"\b(?:kubernetes|k8s|helm|terraform|ansible|ci/cd|jenkins|github\s+actions)\s+(?:experience|required|skills?|знани)",
    r"\b(?:write|develop|code|program|implement|build)\b.{0,40}\b(?:python|javascript|typescript|rust|golang|go|solidity|java|c\+\+)\b",
    r"\b(?:python|javascript|typescript|rust|golang|solidity)\b.{0,40}\b(?:developer|development|programming|coding|написани)\b",
    r"\bsmart\s+contract\s+(?:develop|creat|writ|build|deploy(?:ment)?)\b",
)
YEARS = r"\b(?:[7-9]|1\d|20)\+?\s*(?:years?|лет|года?|г\.)"
YEARS_AT_LEAST = r"\b(?:more\s+than|более\s+чем|свыше|at\s+least|не\s+менее|from|от|min(?:imum)?\.?)\s*(?:[7-9]|1\d|20)\+?\s*(?:years?|лет)"
YEARS_ASKED = ("experience", r"exp\.", "опыт", "стаж", "require", "minimum", r"min\.", r"at\s+least", r"не\s+менее", "professional", r"track\s+record", "proven", r"in\s+a\s+similar")
YEARS_TOLD = ("spent", "build", "built", "founded", "history", r"for\s+the\s+(?:last|past)", r"over\s+the\s+(?:last|past)", r"за\s+последн", "основан", r"we\s+have\s+been", r"our\s+journey")
CITIZEN = (
    "eu passport", "european passport", "eu citizenship", "eu citizen", "us citizen", "green card", "uk citizen", "british passport", "гражданство ес", "паспорт ес", "гражданство сша",
)
RIGHT_TO_WORK = r"(?:right to work|eligible to work|authoriz(?:ed|ation) to work|legally able to work)\s+in\s+(?:the\s+)?([a-zа-я\s]{2,20})"
FOREIGN_PLACES = (
    "eu", r"e\.u\.", "europe", "european union", "uk", "united kingdom", "us", r"u\.s\.", "usa", "united states", "schengen", "germany", "poland", "bulgaria", "portugal",
    "spain", "cyprus", "netherlands", "ireland", "france", "italy", "greece",
)
HOME_PLACES = (
    "росси", "russia", "москв", "moscow", "санкт", "петербург", "spb", "самар", "samara", "екатеринбург", "новосибирск", "казан", "нижний новгород", "краснодар", "снг",
    r"\bcis\b", "беларус", "belarus", "казахстан", "kazakhstan", "армени", "armenia", "удалён", "удален", "remote", "anywhere",
)
ENGLISH = (
    r"fluent\s+(?:\w+\s+){0,4}english", r"native\s+english", r"native[\s-]level\s+english",
    r"english\s+(?:at\s+)?(?:level\s+)?(?:b1|b2|c1|c2)\+?\b", r"\b(?:b1|b2|c1|c2)\+?\s+(?:level\s+)?english\b", r"\benglish\s+(?:fluency|proficiency)",
    r"fluency\s+in\s+(?:\w+\s+){0,3}english", r"proficien\w*\s+in\s+english", r"communicat\w*\s+skills?\s*\([^)]{0,90}english",
    r"(?:excellent|strong|advanced|high|professional|full|solid|great|good)\s+(?:command|proficiency|knowledge|level|standard|skills?)\s+(?:of|in)\s+(?:\w+\s+){0,4}english",
    r"(?:excellent|strong|advanced|professional)\s+(?:\w+\s+){0,3}english\b",
    r"(?:excellent|strong|advanced|high|professional|solid|great|good|effective)\s+(?:\w+\s+){0,5}communicat\w*(?:\s+skills?)?\s+(?:in|of)\s+english",
    r"communicat\w*\s+(?:effectively\s+)?in\s+english\b", r"(?:comfortable|confident|at\s+ease)\s+(?:\w+\s+){0,2}in\s+english\b",
    r"свободный\s+английск", r"уровень\s+носителя", r"английск\w*(?:\s+язык\w*)?\s*[-—:]?\s*(?:уровн\w*\s+|от\s+|не\s+ниже\s+)?[bc][12]\+?",
    r"свободное\s+владение\s+английск", r"отличное\s+владение\s+английск",
)
SPOKEN = (
    r"\b(?:spoken|verbal\w*|oral\w*|conversation\w*|speak\w*|phone|calls?|meetings?|video|negotiat\w*|presentation\w*|stand-?ups?)\b",
    r"устн\w*", r"разговорн\w*", r"переговор\w*", r"созвон\w*", r"звонк\w*",
)
WRITTEN = (r"\b(?:written|writing|correspondence|documentation)\b", r"письмен\w*", r"переписк\w*")
LEVEL_B, LEVEL_C = r"\bb[12]\+?\b", r"\bc[12]\+?\b"
RUSSIAN = (r"\brussian\w*", r"русск\w*", r"\bcis\b", r"\bснг\b")
RUSSIAN_DESK = (
    r"russian[\s-]speak\w*", r"russian\s+speakers?", r"\bcis\b", r"russian\s+desk", r"russian[\s-]language\s+(?:support|desk|team)", r"русскоязычн\w*", r"русскоговорящ\w*", r"\bснг\b",
)
BOTH_LANGUAGES = (
    r"english\s*(?:,|and|&|/|или|и)\s*(?:\w+\s+){0,2}russian", r"russian\s*(?:,|and|&|/|или|и)\s*(?:\w+\s+){0,2}english", r"англ\w*\s*(?:,|и|/)\s*русск", r"русск\w*\s*(?:,|и|/)\s*англ",
)
ITEM_END = r"[.•·\n]"
SENTENCE_END = r"[.;•·\n]"
LIST_GOES_ON = r"^\s*(?:and\s*/?\s*or|and|or|или|и)\s+"
A_PLUS = (
    r"(?:is|are|would\s+be|will\s+be|as)\s+a\s+plus", r"nice[\s-]to[\s-]have", "advantage", "beneficial", "preferred", "bonus", "плюсом", "преимуществ", "приветствуется", "желательно",
)
OPTIONAL_PART = (
    "preferred qualification", "preferred skill", r"nice[\s-]to[\s-]have", "bonus point", "good to have", "desirable", "advantageous", "will be a plus", "будет плюсом", "желательн",
    "приветствуется", "как преимущество",
)
REQUIRED_PART = ("requirements", "required qualification", "must have", "minimum qualification", "what you.{0,3}ll need", "essential", "обязательные требования", "требования:")
HEADER_FORM = (
    r"nice[\s-]to[\s-]have", r"preferred\s+qualification\w*", r"preferred\s+skill\w*", r"bonus\s+point\w*", r"good\s+to\s+have", "desirable", "advantageous", r"желательн\w*",
)
LINK_BEFORE = r"\b(?:is|are|was|were|be|been|will|would|it.s|это)\s*(?:an?|the)?\s*$"
OTHER_LANGUAGES = (r"(?:additional|other|second|further|extra|foreign)\s+languages?", r"(?:друг|дополнительн|иностранн)\w*\s+язык")
LANGUAGE_NEAR = ("язык", "владен", "знан", "уровн", "разговорн", "письменн", "носител", "общен", "speak", "fluen", "proficien", "native", "level", "[abc][12]")
UNREADABLE, UNREADABLE_SHARE, UNREADABLE_LENGTH = r"(?U)[^\x00-\x7F\x{400}-\x{4FF}\s]", 0.25, 200
NIGHT_RARE = (
    r"\d{1,2}\s*[-–—]?\s*\d{0,2}\s*night\s+shifts?\s+(?:per|a|/)\s*month", r"\d{1,2}\s*[-–—]?\s*\d{0,2}\s*ночн\w*\s+смен\w*\s+в\s+месяц", r"occasional\w*\s+night",
    r"иногда\s+ночн", r"редк\w*\s+ночн",
)
NIGHT = (
    r"ночн\w*\s+смен", r"ночн\w*\s+график", r"в\s+ночную\s+смену", r"работа\s+в\s+ночн\w*", r"ночн\w*\s+врем\w*\s+сут", r"night\s+shift", r"graveyard\s+shift",
    r"overnight\s+shift", r"сутки\s+через",
)
SHIFTS = (
    r"сменн\w*\s+график", r"график\w*\s+сменн", r"сменн\w*\s+работ", "посменн", r"shift\s+schedule", r"rotating\s+shifts?", r"rotational\s+shift", r"shift\s+work",
    r"(?:график|режим|schedule|shift)\D{0,20}\b[1-4]\s*/\s*[1-4]\b", r"\b[1-4]\s*/\s*[1-4]\b\D{0,20}(?:смен|shift|график)",
)
# End of the fixed values.

# Every match of the patterns above holds one of these words.
YEARS_HOLD = ("year", "лет", "год", "г.")
ENGLISH_HOLD = ("english", "английск", "носителя")
CODE_HOLD = (
    "selenium", "cypress", "playwright", "pytest", "jest", "mocha", "appium", "robot", "kubernetes", "k8s", "helm", "terraform", "ansible", "ci/cd", "jenkins", "github", "smart",
)
# Every match of a pattern of code has one of the marks or, as whole words, a verb and a language.
CODE_WORDS, CODE_MARKS = tuple(w for w in CODE_HOLD if w != "ci/cd"), ("ci/cd",)
VERB_WORDS = ("write", "develop", "code", "program", "implement", "build", "developer", "development", "programming", "coding", "написани")
LANGUAGE_WORDS = ("python", "javascript", "typescript", "rust", "golang", "go", "solidity", "java")
CODE_TOLD = CODE_WORDS + VERB_WORDS + LANGUAGE_WORDS
# Every mark that can head an optional part holds one of these.
OPTIONAL_HOLD = ("nice", "preferred", "bonus point", "good to have", "desirable", "advantageous", "желательн")
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
CODE_VERBS, CODE_LANGUAGES = ("write", "develop", "code", "program", "implement", "build", "coding", "написани"), ("python", "script", "rust", "go", "solidity", "java", "c++")
CITIZEN_HOLD = ("passport", "citizen", "green card", "to work", "гражданство", "паспорт")
NIGHT_HOLD = ("night", "ноч", "graveyard", "сутки")
SHIFTS_HOLD = ("смен", "shift", "график", "режим", "schedule")


def union(forms: tuple[str, ...] | str) -> str:
    """One pattern of alternatives, in order, with the common flags."""
    return FLAGS + ("(?:" + "|".join(forms) + ")" if not isinstance(forms, str) else forms)


def _begun(words: Iterable[str]) -> str:
    """A look ahead that their first two characters pass, and few others; one range for Cyrillic, as a class tries all its parts."""
    some = [sorted({w[i] for w in words}) for i in (0, 1)]
    return "(?=" + "".join("[" + "".join(c for c in x if c < "а") + ("а-я" if x[-1] >= "а" else "") + "]" for x in some) + ")"


def led(forms: tuple[str, ...]) -> str:
    """The union of forms that begin with a word, or one of some words, tried only where two characters fit, and then only
    those with that first one. Forms with another never match there, so the order of all others and the matches stay."""
    by_first: dict[str, list[str]] = {}
    pairs = set()
    for form in forms:
        edge, some, rest = re.fullmatch(r"(\\b)?(?:\(\?:([^()]*)\))?(.*)", form).groups(default="")
        words, rest = (some.split("|"), rest) if some else ([rest], "")
        if not all(re.match(r"\w\w(?![?*{])", w) for w in words):
            raise ValueError(f"no two characters to begin with: {form}")
        pairs.update(w[:2] for w in words)
        for c in dict.fromkeys(w[0] for w in words):
            by_first.setdefault(c, []).append(edge + "(?:" + "|".join(w for w in words if w[0] == c) + ")" + rest)
    return FLAGS + _begun(pairs) + "(?:" + "|".join(f"(?={c}[{''.join(sorted({p[1] for p in pairs if p[0] == c}))}])(?:{'|'.join(x)})" for c, x in by_first.items()) + ")"


def language() -> str:
    words = LANGUAGES + LANGUAGE_STEMS
    return FLAGS + _begun(words) + r"\b(?:" + "|".join(words) + r")\b"
