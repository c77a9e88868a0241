"""Rule packs: criteria as data."""

from __future__ import annotations

import hashlib
import inspect
import json
import warnings
from dataclasses import asdict, dataclass, field
from functools import cache

from winnow.functions import patterns, terms


@dataclass
class Role:
    name: str
    threshold: int = 42
    english_weight: float = 1.0
    must_role: list[str] = field(default_factory=list)
    must_domain: list[str] = field(default_factory=list)
    titles_strong: list[str] = field(default_factory=list)
    titles_weak: list[str] = field(default_factory=list)
    keywords_boost: list[str] = field(default_factory=list)
    keywords_penalize: list[str] = field(default_factory=list)
    keywords_penalize_title: list[str] = field(default_factory=list)
    senior_terms: list[str] = field(default_factory=list)


@dataclass
class RulePack:
    """Roles in order (the first wins ties), term lists common to them, and weights."""

    roles: list[Role]
    hard_exclude: list[str] = field(default_factory=list)
    english_gates: list[str] = field(default_factory=lambda: ["spoken", "generic"])
    english_penalty: list[str] = field(default_factory=list)
    english_boost: list[str] = field(default_factory=list)
    entry: list[str] = field(default_factory=list)
    remote: list[str] = field(default_factory=list)
    onsite: list[str] = field(default_factory=list)
    relocation: list[str] = field(default_factory=list)
    avoid: list[str] = field(default_factory=list)
    finance_titles: list[str] = field(default_factory=lambda: list(patterns.FINANCE_TITLES))
    code_exempt: list[str] = field(default_factory=lambda: ["ai_automation"])  # fixed: a role whose work is light scripting
    weights: dict[str, int] = field(default_factory=dict)

    #: Fixed: weights that a pack's own override.
    DEFAULT_WEIGHTS = {
        "gate_base": 10, "title_strong": 40, "title_weak": 20, "boost_each": 6, "boost_cap": 30, "penalize_each": -12, "penalize_cap": -36, "senior": -6,
        "remote": 10, "relocation": 8, "onsite": -30, "onsite_ru_desk": -10, "english_penalty_each": -14, "english_boost": 10, "english_written_only": -4,
        "english_level_b": -6, "english_level_c": -10, "entry": 8, "night_shift_occasional": -15, "shift_schedule": -8,
    }

    def __post_init__(self) -> None:
        self.weights = {**self.DEFAULT_WEIGHTS, **self.weights}
        dead = [t for r in self.roles for key, v in asdict(r).items() if isinstance(v, list) for t in terms.unmatchable(v)]
        if dead:
            warnings.warn(f"terms with a star inside match only literally: {dead}", stacklevel=2)

    @classmethod
    def from_dict(cls, d: dict, avoid: list[str] = (), **more: list[str]) -> RulePack:
        """A criteria document: global lists, weights and roles, as a mapping."""
        names = {f for f in Role.__dataclass_fields__ if f != "name"}
        roles = [Role(name, **{k: v for k, v in r.items() if k in names}) for name, r in d["roles"].items()]
        lists = {
            "hard_exclude": "global_hard_exclude", "english_penalty": "english_penalty", "english_boost": "english_boost", "entry": "entry_boost", "remote": "remote_boost",
            "onsite": "onsite_penalty", "relocation": "relocation_ok",
        }
        got = {k: list(d.get(v, [])) for k, v in lists.items()}
        return cls(roles, **got, english_gates=list(d.get("english_gate_levels", ["spoken", "generic"])), avoid=[a.lower() for a in avoid], **more, weights=dict(d.get("weights", {})))

    @classmethod
    def from_yaml(cls, path: str, **more) -> RulePack:
        import yaml

        with open(path, encoding="utf-8") as f:
            return cls.from_dict(yaml.safe_load(f), **more)

    def canonical(self) -> str:
        return json.dumps(asdict(self), sort_keys=True, ensure_ascii=False)

    def fingerprint(self) -> str:
        """Twelve hex digits that change with the pack or the code of gates and scores; keys provisional state."""
        return hashlib.md5((self.canonical() + code_fingerprint()).encode()).hexdigest()[:12]

    def scoring_version(self, instruction: str, profile: str) -> str:
        """Twelve hex digits that change with what a scorer is told or with the pack; keys cached scores."""
        return hashlib.md5("\0".join((instruction, profile, self.canonical())).encode()).hexdigest()[:12]


@cache
def code_fingerprint() -> str:
    """A hash of the source of all modules that decide a verdict, so that changed code makes rejections provisional again."""
    from winnow.functions import spans, text
    from winnow.operators import gates, score

    return hashlib.md5("\0".join(map(inspect.getsource, (gates, score, patterns, spans, terms, text))).encode()).hexdigest()


def first_readable(paths: list[str], key: str) -> list[str]:
    """A list under `key` of the first JSON file that can be read and parsed, else empty."""
    for path in paths:
        try:
            with open(path, encoding="utf-8") as f:
                return list(json.load(f).get(key, []))
        except (OSError, json.JSONDecodeError):
            continue
    return []


def drop_sections(markdown: str, titles: set[str]) -> str:
    """A Markdown text without the second-level sections of these titles."""
    out, keep = [], True
    for line in markdown.split("\n"):
        if line.startswith("## "):
            keep = line[3:].strip() not in titles
        elif line.startswith("# "):
            keep = True
        if keep:
            out.append(line)
    return "\n".join(out)


def demo_pack() -> RulePack:
    """Two roles over words of the test tables."""
    return RulePack(
        roles=[
            Role("alpha", 42, 1.0, ["the", "de"], ["that", "la", "der"], ["from the", "re*"], ["with", "les"], ["this", "for", "was", "ch*", "of and"], ["than", "enge*"], ["the"], ["is", "in"]),
            Role("beta", 30, 1.6, ["of", "un*", "los"], [], ["wh*"], ["be the", "que"], ["by", "ion*", "not", "and the"], ["are", "it"], ["of"], ["on"]),
        ],
        hard_exclude=["lorem ipsum", "stand*", "api_key"], english_penalty=["from", "this is"], english_boost=["cis", "dans"], entry=["un"], remote=["at", "anywhere"],
        onsite=["be", "on site"], relocation=["una", "bei*"], avoid=["pathetic"],
    )
