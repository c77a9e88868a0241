"""Literal cases of predicates and text functions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from winnow.functions import terms
from winnow.functions import text as tx
from winnow.operators import funnel_ops, gates, state


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("term", "text", "found"), [
    ("операц*", "опыт по операциям", True), ("операц*", "кооперация в компании", False), ("ops", "crypto ops specialist", True), ("ops", "opsgenie monitoring", False),
    ("crypto operations", "senior crypto operations manager", True),
])
def test_terms(spark, term, text, found):
    assert value(spark, terms.matches(F.lit(text), term)) is found


@pytest.mark.parametrize(("text", "asked"), [
    ("7+ years of experience in operations", True), ("requires at least 9 years experience", True), ("has spent the last 15 years building things", False), ("celebrating 20 years of innovation", False), ("", False),
])
def test_years(spark, text, asked):
    assert value(spark, gates.years_asked(F.lit(text))) is asked


@pytest.mark.parametrize(("text", "asked"), [("you must have the right to work in the eu", True), ("eligible to work in russia", False)])
def test_citizenship(spark, text, asked):
    assert value(spark, gates.citizenship_asked(F.lit(text))) is asked


@pytest.mark.parametrize(("text", "mode"), [
    ("excellent command of spoken and written english is required.", "spoken"), ("must-haves: strong written english - clear, concise, and empathetic.", "written"),
    ("fluent english is a must for this role.", "generic"), ("english is a plus.", None), ("английский: c2", "level_c"), ("английский b2", "level_b"),
])
def test_english(spark, text, mode):
    assert value(spark, gates.english_mode(F.lit(text), [])) == mode


@pytest.mark.parametrize(("text", "mode"), [
    ("night shift support engineer", "core"), ("1 night shift per month", "occasional"), ("график 2/2", "shift"), ("график работы 5/2", None), ("график 2/2 и 2-4 night shifts per month", "occasional"),
])
def test_shifts(spark, text, mode):
    assert value(spark, gates.shift_mode(F.lit(text))) == mode


@pytest.mark.parametrize(("text", "asked"), [
    ('token = "55cf1b56d3d000479a9bdb231e139ff0" ja.\nнемецкая компания', False), ("native speaker wanted.\nнемецкая компания\nlevel 3", False), ("м. белорусская", False),
    ("знание немецкого языка", True), ("языки:\nнемецкий", True), ("языки: \nнемецкий", True), ("немецкий, уровень b2", True), ("german language required", True), ("german is a plus", False),
])
def test_foreign_language(spark, text, asked):
    """A Russian name counts by the words of its own line, or of the header above it."""
    assert value(spark, gates.foreign_language_asked(F.lit(text))) is asked


def test_normal(spark):
    assert value(spark, tx.normal(F.lit("Английский С1 и выше"))) == "английский c1 и выше"
    assert value(spark, tx.normal(F.lit("артикул с12345"))) == "артикул с12345"
    assert value(spark, tx.normal(F.lit(None).cast("string"))) == ""


def test_same_key(spark):
    key = lambda c, t: value(spark, tx.same_key(F.lit(c), F.lit(t)))
    assert key("Ripple", "Professional Services Consultant") == key("ripple", "Professional  Services Consultant")
    assert key("a", "Manager IV (EMEA)") == key("a", "Manager IV (Remote)")


def test_enrich_health(spark):
    rows = spark.createDataFrame([(10, 0), (10, 3), (10, 8), (2, 0), (0, 0)], "a int, e int")
    _, healthy = funnel_ops.enrich_health(F.col("a"), F.col("e"))
    assert [r.h for r in rows.select(healthy.alias("h")).collect()] == [False, False, True, True, True]


def test_seen_state(spark):
    empty = spark.createDataFrame([], "id string, source string, title string, url string, seen_at timestamp, prefilter_version string")
    row = spark.createDataFrame([("j", "s", "t", "u")], "id string, source string, title string, url string")
    at = F.timestamp_seconds(F.lit(1))
    left = lambda table, v: state.unseen(row, table, v).count()
    rejected, final = state.mark_rejected(empty, row, "v1", at), state.mark_verdict(empty, row, at)
    assert (left(rejected, "v1"), left(rejected, "v2")) == (0, 1)
    assert (left(final, "v1"), left(final, "v2")) == (0, 0)
    assert left(state.mark_verdict(rejected, row, at), "v2") == 0
    assert left(state.mark_rejected(final, row, "v1", at), "v2") == 0


TOLD = ["ops", "full-stack", "re*", "on-*", "café", "команд*", "x_y", "c++", "of the", "la", "é*", "10", "-x", "a*"]
SAID = ["opsgenie ops", "a full-stack team", "stack full", "rest", "more", "on-site", "cafés", "un café", "команда", "x_y z", "x y", "c++", "of  the", "of the", "blah la", "été", "10th", "v 10", "", "-x", "naïve ab", "ops\nla"]


def test_words_tell_what_the_patterns_tell(spark):
    rows = spark.createDataFrame([(s,) for s in SAID], "s string").withColumn("k", terms.spaced(terms.words(F.col("s"))))
    for one in rows.select("s", terms.hits(F.col("s"), TOLD).alias("a"), terms.hits(F.col("s"), TOLD, F.col("k")).alias("b"), *[F.array(terms.any_of(F.col("s"), [t]), terms.any_of(F.col("s"), [t], F.col("k"))).alias(f"t{i}") for i, t in enumerate(TOLD)]).collect():
        assert one.a == one.b and all(x == y for x, y in one[3:]), one


def test_flags_with_and_without_words(spark):
    from winnow.rule_queries import LINES

    said = [f"prose before.\n{x.lower()}" for x in LINES] + ["we go and code in c++", "go code", "write go", "build in rust", "trust the code", "ci/cd required", "robot framework", "ukrainian", "ukrainians", "  " + "漢" * 60 + "a" * 150, "漢" * 30 + "a" * 180, "desirable:\ngerman", "desirable:\nx\nrequirements:\ngerman"]
    rows = spark.createDataFrame([(s,) for s in said], "s string").withColumn("k", terms.words(F.col("s")))
    s, k = F.col("s"), F.col("k")
    plain, told = rows.select(gates.code_asked(s), gates.foreign_language_asked(s)).collect(), rows.select(gates.code_asked(s, k), gates.foreign_language_asked(s, k)).collect()
    assert list(map(tuple, plain)) == list(map(tuple, told)) and 3 < sum(r[0] for r in plain) and 3 < sum(r[1] for r in plain)
    far = rows.select("s", gates.unreadable(s).alias("u")).where("u").collect()
    assert [r.s[:4] for r in far] == ["  漢漢"]


def test_words_of_a_pack_are_not_looked_for_by_patterns(spark, sf):
    """Each list's words were a scan of the text each, and what is shown was made for reports that don't show it."""
    from winnow import queries as q

    best = q._best(spark, sf)
    assert "reasons" not in best.columns and "bthat" not in best._jdf.queryExecution().optimizedPlan().toString()


def test_what_is_known_of_words_tells_the_same(spark):
    listed = [t for t in TOLD if terms.mode(t) == "word" and terms.one_run(t)]
    rows = spark.createDataFrame([(s,) for s in SAID], "s string").withColumn("w", terms.words(F.col("s"))).withColumns({"k": terms.spaced(F.col("w")), "f": terms.listed(F.col("w"), listed)})
    s, known = F.col("s"), terms.Known(F.col("k"), F.col("f"), frozenset(listed))
    holds = ("op", "afé", "x_y", "f th", "c++")
    for one in rows.select("s", terms.hits(s, TOLD), terms.hits(s, TOLD, known), terms.count(s, TOLD, known), terms.holds(s, holds), terms.holds(s, holds, known)).collect():
        assert one[1] == one[2] and len(one[1]) == one[3] and one[4] == one[5] == any(h in one.s for h in holds), one


def test_each_term_is_looked_for_once(spark, sf):
    """A role's words were looked for by each part of its score, in a generator, whose expressions are interpreted."""
    import re

    from winnow import queries as q

    for rows in (q._best(spark, sf), q._verdicts(spark, sf), q._rejections(spark, sf)):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        for term in ("of and", " re", "from the", "be the"):
            assert len(re.findall(rf"Contains\(\w+#\d+, {term}\)", plan)) <= 1, term
        assert not any("Contains(" in line for line in plan.split("\n") if "Generate " in line or "Filter " in line)


def test_rejections_are_those_of_the_verdicts(spark):
    from winnow.operators import score
    from winnow.rule_queries import RULES, planted

    rows = planted(spark, "/root/testdata/sf0.001")
    whole = score.verdicts(rows, RULES).select("id", "role", "ord", "passed_gate", F.when(F.col("passed_gate"), F.array().cast("array<string>")).otherwise(F.col("reasons")).alias("reasons"))
    gates_alone = score.rejections(rows, RULES).select(*whole.columns)
    assert sorted(map(str, whole.collect())) == sorted(map(str, gates_alone.collect()))


def test_english_is_looked_for_once_where_it_can_begin(spark):
    """Each text was scanned twice, at every place for each of the forms."""
    import re

    from winnow import rule_queries as q

    plan = q.english_modality(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"regexp_replace\(_blob#\d+, \(\?Ud\)\(\?=\[", plan)
    assert re.search(r"Contains\(_blob#\d+, russian\)", plan)  # the test before a pattern of words


def test_led_patterns_find_the_same(spark):
    from winnow.functions import patterns as P
    from winnow.functions import spans
    from winnow.rule_queries import LINES

    said = [x.lower() for x in LINES] + [
        "affluent english b1 english c2+ english", "b2+ english level ab1 english", "english at level b2x english b2", "fluency in fluent and good english", "excellent strong written english fluency",
        "communication skills (fluent english, b2", "effective communication in english.", "at ease in english", "уровень носителя, свободный английский - уровня c1", "отличное владение английским от b2+",
        "strong\0fluent english\0 english c1", "\0", "", "native-level  english native english", "professional proficiency of fluent english",
    ]
    rows = spark.createDataFrame([(" ".join(said[i:] + said[:i]),) for i in range(len(said))] + [(x,) for x in [*said, None]], "s string")
    s, plain = F.col("s"), P.union(P.ENGLISH)
    of = lambda p: F.regexp_extract_all(s, F.lit(p), F.lit(0))
    told = P.FLAGS + r"\b(?:" + "|".join(P.LANGUAGES + P.LANGUAGE_STEMS) + r")\b"
    for r in rows.select("s", of(plain), of(P.led(P.ENGLISH)), of(told), of(P.language()), spans.finditer(s, plain), spans.finditer(s, P.led(P.ENGLISH))).collect():
        assert r[1] == r[2] and r[3] == r[4] and r[5] == r[6], r.s
        assert r[5] is None or [m.m for m in r[5]] == r[1] and all(r.s[m.start : m.end] == m.m for m in r[5]), r.s


def test_words_and_scripts_cost_little(spark):
    """What tells unreadable texts was found for all texts, and each letter was looked up in Unicode's tables."""
    said = [*SAID, "éa b_é 10é", "x\u200dy", "\U00010400a \U0001d54f1", "a" * 5000 + "é", "_", "é_1", "  ", None, "\u3000" * 9 + "漢" * 60 + "a" * 150, "漢" * 199, "漢" * 50 + "a" * 150, "漢" * 49 + "a" * 151]
    rows = spark.createDataFrame([(x,) for x in said], "s string")
    s = F.col("s")
    text = F.regexp_replace(s, r"(?U)^\s+|\s+$", "")
    plain = (F.length(text) >= 200) & (F.regexp_count(text, F.lit(r"(?U)[^\x00-\x7F\x{400}-\x{4FF}\s]")) / F.length(text) >= 0.25)
    found = rows.select("s", terms.words(s), F.array_distinct(F.regexp_extract_all(s, F.lit(r"(?U)\w+"), F.lit(0))), gates.unreadable(s), plain)
    got = found.collect()
    assert all(r[1] == r[2] and r[3] == r[4] for r in got), got
    assert sum(bool(r[3]) for r in got) == 2
    plan = rows.select(terms.words(s), gates.unreadable(s))._jdf.queryExecution().optimizedPlan().toString()
    assert "(?=\\w)[a-z" in plan and plan.index("THEN false") < plan.index("regexp_replace")
