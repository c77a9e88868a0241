"""Queries that make rules fire on real rows: phrases are planted in all rows of a table, chosen by id.

The SQL plants the same phrases and states the rules anew, for lines as they are planted: a phrase stands on a line of its
own, so what surrounds a mention is its line, and sections are told by the headers planted above it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.functions import text as tx
from winnow.operators import funnel_ops, gates, score
from winnow.plans.rules import Role, RulePack
from winnow.queries import _lit, _sql_contains, query, sql_any, sql_matches, table
from winnow.schema import conform

# --- planted postings ---

#: A line per rule, and lines that come near one without meeting it.
LINES = (
    "", "Excellent command of spoken and written English is required.", "Strong written English - clear, concise.", "Fluent English is a must for this role.",
    "Fluent English is a plus.", "Английский: С1", "Английский В2", "Nice to have:\nFluent English", "Nice to have:\nSQL\nRequirements:\nFluent English",
    "Night shift support engineer", "1 night shift per month", "график 2/2", "график работы 5/2", "rotating shifts", "работа в ночную смену",
    "At least 8 years with payments", "10 years of experience in support", "We have built this product for 12 years", "EU passport needed", "Right to work in Germany",
    "Right to work in Georgia", "Pytest and Selenium daily", "Write clean services in Python", "German language required", "German is a plus", "Знание немецкого языка",
    "немецкая компания", "Russian-speaking team, fluent English", "A fully remote team", "Casino operator", "we like gambling", "junior support, anywhere",
    "Fluent spoken Kazakh and English C2", "2-4 night shifts per month, 2/2 schedule", "Russian is a plus. Fluent English", "漢字",
)
TITLES = ("Support manager", "Operator", "Support lead", "Backend support", "Developer", "Support developer", "Portfolio support", "Crypto portfolio support", "Clerk")
PLACES = ("", "Berlin", "Moscow", "Remote", "Limassol, Cyprus")


def rule_pack() -> RulePack:
    """Two roles for which every gate and every part of a score can apply."""
    return RulePack(
        roles=[
            Role("support", 30, 1.0, ["support", "operator*"], ["the", "de", "der", "la"], ["support manager"], ["operator"], ["payments", "team", "english*", "shift*", "язык*", "sql", "python"], ["gambl*", "selenium"], ["lead"], ["manager"]),
            Role("ai_automation", 20, 1.5, ["support", "operator", "clerk", "developer"], [], ["clerk"], ["developer"], ["python", "daily"], ["must", "needed"], ["crypto"], ["support"]),
        ],
        hard_exclude=["casino*"], english_gates=["spoken", "generic"], english_penalty=["fluent english", "english"], english_boost=["russian*", "cis"], entry=["junior"],
        remote=["remote", "anywhere"], onsite=["berlin", "office"], relocation=["cyprus", "georgia"], avoid=["gambling"],
    )


RULES = rule_pack()


def _chosen(values: tuple[str, ...], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def _sql_chosen(values: tuple[str, ...], n: str) -> str:
    cells = ", ".join("'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for v in values)
    return f"([{cells}])[CAST(({n}) % {len(values)} + 1 AS INT)]"


def planted(spark, sf_dir) -> DataFrame:
    """All documents as postings with a planted title, line and place. The script's line grows with its document."""
    d, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    line = _chosen(LINES, n)
    line = F.when(line == "漢字", F.repeat(line, F.length("text") + 200)).otherwise(line)
    return conform(d.select(
        n.cast("string").alias("id"), _chosen(TITLES, F.floor(n / len(LINES))).alias("title"), F.col("source").alias("company"), F.concat_ws(".\n", F.coalesce("text", F.lit("")), line).alias("description"),
        F.lit("").alias("url"), F.col("lang").alias("source"), _chosen(PLACES, F.floor(n / 5)).alias("location"),
    ))


_LINE = _sql_chosen(LINES, "doc_id")
_ENGLISH = r"(fluent english|(excellent|strong) (\w+ ){0,5}english|английский:? [bc][12]|english [bc][12])"
FLAGS_SQL = f"""p AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS id, {_sql_chosen(TITLES, f"doc_id // {len(LINES)}")} AS title, source AS company, lang AS source, {_sql_chosen(PLACES, "doc_id // 5")} AS location,
    coalesce(text, '') || '.' || chr(10) || CASE WHEN {_LINE} = '漢字' THEN repeat('漢字', CAST(length(text) + 200 AS INT)) ELSE {_LINE} END AS description FROM documents
), low AS (
  SELECT *, lower(title) AS t, regexp_extract_all(lower(title), '[a-z]+') AS tokens, lower(title) || ' ' || lower(replace(replace(description, 'С1', 'c1'), 'В2', 'b2')) || CASE WHEN location <> '' THEN chr(10) || 'location: ' || lower(location) ELSE '' END AS blob FROM p
), line AS (
  SELECT *, regexp_extract(blob, '[^.\\n]*{_ENGLISH}[^.\\n]*') AS english_line, regexp_extract(blob, '[^\\n]*night shift[^\\n]*') AS night_line FROM low
), b AS (
  SELECT *, CASE
      WHEN english_line = '' OR english_line LIKE '%is a plus%' OR (blob LIKE '%nice to have:%' AND blob NOT LIKE '%requirements:%') OR regexp_matches(blob, 'russian-speaking') THEN NULL
      WHEN regexp_matches(english_line, 'english[\\s:]*b[12]|английский[\\s:]*b[12]') THEN 'level_b' WHEN regexp_matches(english_line, 'spoken') THEN 'spoken'
      WHEN regexp_matches(english_line, 'english[\\s:]*c[12]|английский[\\s:]*c[12]') THEN 'level_c' WHEN regexp_matches(english_line, 'written') THEN 'written' ELSE 'generic' END AS english,
    CASE WHEN regexp_matches(night_line, '[0-9] night shifts? per month') THEN 'occasional' WHEN night_line <> '' OR blob LIKE '%в ночную смену%' THEN 'core'
      WHEN regexp_matches(blob, 'график 2/2|rotating shifts|2/2 schedule') THEN 'shift' END AS shift,
    regexp_matches(blob, 'at least 8 years|10 years of experience') AS years, regexp_matches(blob, 'eu passport|right to work in germany') AS citizen,
    regexp_matches(blob, 'pytest|write [a-z ]*python') AS code, regexp_matches(blob, '(german|kazakh)(s? language| and)|знание немецкого') AS other_language,
    contains(blob, '漢字') AS unreadable,
    contains(blob, 'location: ') AND NOT contains(blob, 'fully remote') AND NOT regexp_matches(blob, 'location: (moscow|remote|[^\\n]*cyprus)') AS away
  FROM line
)"""


def _verdict_sql(role: Role, pack: RulePack, order: int) -> str:
    """A role's first failing gate and, in order, the points and words of what applies."""
    w = pack.weights
    has = lambda *words: "list_has_any(tokens, [" + ", ".join(map(_lit, words)) + "])"
    gates_sql = [*[(sql_matches("blob", t), _lit(f"hard-exclude: '{t}'")) for t in pack.hard_exclude], *[(f"contains(blob, {_lit(a)})", "'avoided industry'") for a in pack.avoid]]
    gates_sql += [
        (has("backend"), "'executive, developer or finance title'"), (f"{has('developer')} AND NOT {has('support')}", "'developer title without operations context'"),
        (f"{has('portfolio')} AND NOT {has('crypto')}", "'finance title without crypto context'"), ("code" if role.name not in pack.code_exempt else "false", "'code required'"),
        ("years", "'seven or more years required'"), ("other_language", "'another language required'"), ("unreadable", "'unreadable script'"), ("citizen", "'citizenship or right to work required'"),
        ("english IN ('spoken', 'generic')", "'English required: ' || english"), ("shift = 'core'", "'night shifts'"), (f"NOT {sql_any('blob', role.must_role)}", "'no word of the role'"),
        *([(f"NOT {sql_any('blob', role.must_domain)}", "'no word of the domain'")] if role.must_domain else []),
    ]
    reason = "CASE " + " ".join(f"WHEN {c} THEN {r}" for c, r in gates_sql) + " END"
    hits = lambda col, ts: "list_filter([" + ", ".join(f"CASE WHEN {sql_matches(col, t)} THEN {_lit(t)} END" for t in ts) + "], lambda x: x IS NOT NULL)"
    count, shown = lambda col, ts: f"len({hits(col, ts)})", lambda col, ts, n: f"array_to_string(({hits(col, ts)})[1:{n}], ', ')"
    strong, weak = sql_any("blob", role.titles_strong), sql_any("blob", role.titles_weak)
    remote, reloc, russian = f"({sql_any('blob', pack.remote)} AND NOT away)", sql_any("blob", pack.relocation), sql_any("blob", pack.english_boost)
    outside = f"(({sql_any('blob', pack.onsite)} OR away) AND NOT {remote} AND NOT {reloc})"
    ew = role.english_weight
    capped = lambda n: f"greatest({n} * {w['penalize_each']}, {w['penalize_cap']})"
    boost, bad, led, pen = (hits(c, ts) for c, ts in (("blob", role.keywords_boost), ("blob", role.keywords_penalize), ("t", role.keywords_penalize_title), ("blob", pack.english_penalty)))
    parts = [
        (f"{strong} OR {weak}", f"CASE WHEN {strong} THEN {w['title_strong']} ELSE {w['title_weak']} END", f"CASE WHEN {strong} THEN 'strong title' ELSE 'related title' END"),
        (f"len({boost}) > 0", f"least(len({boost}) * {w['boost_each']}, {w['boost_cap']})", f"'skills: ' || {shown('blob', role.keywords_boost, 6)}"),
        (f"len({bad}) > 0", capped(f"len({bad})"), f"'mismatches: ' || {shown('blob', role.keywords_penalize, 6)}"), (f"len({led}) > 0", capped(f"len({led})"), f"'leading title: ' || {shown('t', role.keywords_penalize_title, 4)}"),
        (f"NOT {strong} AND {sql_any('t', role.senior_terms)}", w["senior"], "'senior'"), (remote, w["remote"], "'remote'"), (reloc, w["relocation"], "'relocation country'"),
        (outside, f"CASE WHEN {russian} THEN {w['onsite_ru_desk']} ELSE {w['onsite']} END", f"CASE WHEN {russian} THEN 'office abroad, Russian-speaking' ELSE 'office only' END"),
        (f"len({pen}) > 0", f"CAST(trunc(len({pen}) * {w['english_penalty_each'] * ew}) AS INT)", f"'strong English: ' || {shown('blob', pack.english_penalty, 4)}"),
        (russian, int(w["english_boost"] * ew), "'Russian-speaking team'"),
        ("english IN ('written', 'level_b', 'level_c')", f"CASE english WHEN 'written' THEN {int(w['english_written_only'] * ew)} WHEN 'level_b' THEN {int(w['english_level_b'] * ew)} ELSE {int(w['english_level_c'] * ew)} END", "'English: ' || english"),
        (sql_any("blob", pack.entry), w["entry"], "'entry level'"),
        ("shift IN ('occasional', 'shift')", f"CASE shift WHEN 'occasional' THEN {w['night_shift_occasional']} ELSE {w['shift_schedule']} END", "'shifts: ' || shift"),
    ]
    cells = ", ".join(f"CASE WHEN {c} THEN {{'p': CAST({p} AS INT), 't': {t}}} END" for c, p, t in parts)
    return f"SELECT id, {_lit(role.name)} AS role, {order} AS ord, {role.threshold} AS threshold, {reason} AS reason, list_filter([{cells}], lambda x: x IS NOT NULL) AS parts FROM b"


VERDICTS_SQL = f"""WITH {FLAGS_SQL}, raw AS MATERIALIZED (
  {chr(10).join((" UNION ALL " if i else "") + _verdict_sql(r, RULES, i) for i, r in enumerate(RULES.roles))}
), v AS (
  SELECT id, role, ord, reason IS NULL AS passed_gate, CASE WHEN reason IS NULL THEN CAST(greatest(0, least(100, {RULES.weights['gate_base']} + coalesce(list_sum(list_transform(parts, lambda x: x.p)), 0))) AS INT) ELSE 0 END AS score, threshold,
    coalesce(reason, array_to_string(list_transform(parts, lambda x: printf('%+d', x.p) || ' ' || x.t), ' | ')) AS reasons FROM raw
)
"""


@query(VERDICTS_SQL + "SELECT id, role, passed_gate, score, passed_gate AND score >= threshold AS recommend, reasons FROM v")
def planted_verdicts(spark, sf_dir):
    """Every gate, every part of a score and every reason, of both roles, on all documents."""
    rows = score.verdicts(planted(spark, sf_dir), RULES)
    return rows.select("id", "role", "passed_gate", "score", "recommend", F.array_join("reasons", " | ").alias("reasons"))


@query(VERDICTS_SQL + "SELECT reasons AS reason, CAST(count(*) AS BIGINT) AS n FROM v WHERE NOT passed_gate GROUP BY 1 ORDER BY n DESC, reason LIMIT 12")
def planted_reasons_top12(spark, sf_dir):
    """The twelve commonest first reasons of more than twelve."""
    from winnow.operators import reports

    rows = score.rejections(planted(spark, sf_dir), RULES).where(~F.col("passed_gate")).groupBy(F.get("reasons", F.lit(0)).alias("reason")).agg(F.count("*").alias("n"))
    return reports.most_common(rows, "reason")


@query(f"WITH {FLAGS_SQL} SELECT id, shift AS mode FROM b")
def shift_mode(spark, sf_dir):
    rows = planted(spark, sf_dir).select("id", tx.blob(F.col("title"), F.col("description")).alias("_blob"))
    return rows.select("id", gates.shift_mode(F.col("_blob")).alias("mode"))


@query(f"WITH {FLAGS_SQL} SELECT id, english AS mode FROM b")
def english_modality(spark, sf_dir):
    rows = score.spread(planted(spark, sf_dir)).select("id", tx.blob(F.col("title"), F.col("description")).alias("_blob"))
    return rows.select("id", gates.english_mode(F.col("_blob"), RULES.english_boost).alias("mode"))


@query(f"WITH {FLAGS_SQL} SELECT id, years, citizen, code, other_language, unreadable FROM b")
def planted_flags(spark, sf_dir):
    rows = planted(spark, sf_dir).select("id", tx.blob(F.col("title"), F.col("description")).alias("_blob"))
    found = {"years": gates.years_asked, "citizen": gates.citizenship_asked, "code": gates.code_asked, "other_language": gates.foreign_language_asked, "unreadable": gates.unreadable}
    return rows.select("id", *[f(F.col("_blob")).alias(k) for k, f in found.items()])


# --- other rules ---

KINDS, WHERE, SAID = ("", "Hybrid", "Remote"), ("", "Remote - EMEA", "Malta", "Anywhere"), ("", "remote troubleshooting", "a fully remote team", "удалённая работа")


@query(f"""WITH p AS (SELECT doc_id, {_sql_chosen(KINDS, "doc_id")} AS kind, {_sql_chosen(WHERE, "doc_id // 3")} AS place, {_sql_chosen(SAID, "doc_id // 12")} AS said, doc_id // 48 % 2 = 1 AS flag FROM documents)
SELECT doc_id, CASE WHEN kind <> '' THEN kind = 'Remote' WHEN place IN ('Remote - EMEA', 'Anywhere') THEN true WHEN said IN ('a fully remote team', 'удалённая работа') THEN true ELSE flag END AS remote FROM p""")
def remote_priority(spark, sf_dir):
    """All documents with a planted workplace, place, phrase and flag: the first that speaks decides."""
    n = F.col("doc_id")
    said = F.concat_ws("\n", F.coalesce("text", F.lit("")), _chosen(SAID, F.floor(n / 12)))
    return table(spark, sf_dir, "documents").select("doc_id", tx.is_remote(_chosen(WHERE, F.floor(n / 3)), said, _chosen(KINDS, n), F.floor(n / 48) % 2 == 1).alias("remote"))


@query("""WITH o AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS INT) AS a, CAST(floor(o_totalprice) AS INT) + o_orderkey % 5000 AS b, o_orderkey % 4 AS k FROM orders)
SELECT o_orderkey, CASE WHEN k < 3 AND a > 100 THEN a WHEN k = 0 AND b > 100 THEN b END AS low, CASE WHEN k = 0 AND a > 100 AND b > 100 THEN b END AS high,
  CASE k WHEN 0 THEN 'USD' WHEN 2 THEN 'EUR' ELSE 'RUB' END AS currency FROM o""")
def salary_parse(spark, sf_dir):
    """All orders' prices written as ranges, upper bounds, single numbers or none, with spaces between thousands."""
    o = table(spark, sf_dir, "orders")
    spaced = lambda x: F.replace(F.format_number(x, 0), F.lit(","), F.lit(" "))
    a = F.floor("o_totalprice").cast("int")
    b, k = (a + F.col("o_orderkey") % 5000).cast("int"), F.col("o_orderkey") % 4
    said = F.when(k == 0, F.concat(F.lit("от "), spaced(a), F.lit(" до "), spaced(b), F.lit(" $"))).when(k == 1, F.concat(F.lit("до "), spaced(a), F.lit(" руб"))).when(k == 2, F.concat(spaced(a), F.lit(" EUR"))).otherwise("не указано")
    return o.select("o_orderkey", tx.range_salary(said).alias("s")).select("o_orderkey", "s.*")


@query("""WITH a AS (SELECT doc_id, quality, toxic, doc_id // 5 AS batch FROM labels), m AS (SELECT batch FROM a GROUP BY batch HAVING batch % 7 <> 0)
SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 2 = 0 THEN 70 ELSE 40 END + quality AS score, CASE WHEN toxic = 1 THEN 'x,y' ELSE '' END AS why_fits FROM a JOIN m USING (batch) WHERE doc_id % 11 <> 0""")
def response_decode(spark, sf_dir):
    """All labels as answers of five: text around the array, scores as text, items without a score or id, answers cut off."""
    d = F.col("doc_id")
    points = (F.when(d % 2 == 0, 70).otherwise(40) + F.col("quality")).cast("string")
    item = F.to_json(F.struct(d.cast("string").alias("id"), F.when(d % 11 != 0, points).alias("score"), F.when(F.col("toxic") == 1, F.array(F.lit("x"), F.lit("y"))).otherwise(F.array()).alias("why_fits")))
    rows = table(spark, sf_dir, "labels").groupBy(F.expr("doc_id div 5").alias("batch")).agg(F.array_join(F.collect_list(item), ",").alias("items"))
    answer = F.when(F.col("batch") % 7 == 0, F.concat(F.lit("no array: "), F.col("items"))).otherwise(F.concat(F.lit('Sure: [{"score":5},'), F.col("items"), F.lit("] done")))
    found = rows.select(F.explode(funnel_ops.decode_response(answer)).alias("x"))
    return found.select("x.id", F.col("x.score").cast("int").alias("score"), F.array_join("x.why_fits", ",").alias("why_fits"))


FAULTS = ("HTTP 401 unauthorized", "Error code: 402 - quota", "403", "insufficient_quota", "status 429", "503 service", "504", "timeout", "rate_limit_exceeded", "1402 rows")


@query(f"SELECT event_id, CASE event_id % {len(FAULTS)} WHEN 0 THEN 'dead' WHEN 1 THEN 'dead' WHEN 2 THEN 'dead' WHEN 3 THEN 'dead' WHEN 4 THEN 'retry' WHEN 5 THEN 'retry' WHEN 6 THEN 'retry' WHEN 8 THEN 'retry' ELSE 'other' END AS kind FROM events")
def failover_matrix(spark, sf_dir):
    """All events as a provider's errors, with the event's type and user around the fault."""
    said = F.concat_ws(" ", F.lit("call"), "event_type", _chosen(FAULTS, F.col("event_id")), F.lit("by user u"), "event_type")
    return table(spark, sf_dir, "events").select("event_id", funnel_ops.error_class(said).alias("kind"))


_COUNTED = """SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS unseen, count(*) FILTER (WHERE event_type = 'click') AS prefiltered,
  count(*) FILTER (WHERE event_type IN ('click', 'purchase')) AS batches, count(*) FILTER (WHERE event_type = 'purchase') AS failed_batches FROM events GROUP BY user_id, event_id % 40"""


@query(f"""SELECT CAST(user_id AS BIGINT) AS user_id, CASE WHEN unseen = 0 THEN 'nothing new' WHEN prefiltered = 0 THEN 'all rejected by the filter' WHEN batches > 0 AND failed_batches >= batches THEN 'provider down'
  WHEN failed_batches > 0 THEN 'mixed' ELSE 'below threshold' END AS cause, CAST(count(*) AS BIGINT) AS n FROM ({_COUNTED}) q GROUP BY 1, 2""")
def zero_cause(spark, sf_dir):
    """All events as counters of runs, a run per user and part of the events: causes by user."""
    kind = F.col("event_type")
    runs = table(spark, sf_dir, "events").groupBy("user_id", (F.col("event_id") % 40).alias("run")).agg(
        F.count_if(kind == "view").alias("unseen"), F.count_if(kind == "click").alias("prefiltered"), F.count_if(kind.isin("click", "purchase")).alias("batches"), F.count_if(kind == "purchase").alias("failed_batches"),
    )
    return runs.groupBy(F.col("user_id").cast("long").alias("user_id"), funnel_ops.zero_cause().alias("cause")).agg(F.count("*").alias("n"))


POSTS = ("", "we are hiring a manager", "Всем привет! ", "резюме: analyst", "ищу работу, но ищем и мы", "remote job #реклама", "salary 2000", "дорогие подписчики, вакансия")


@query(f"""WITH c AS (SELECT conv_id, turn, lower({_sql_chosen(POSTS, "conv_id + turn")} || ' ' || coalesce(text, '') || CASE WHEN conv_id % 3 = 0 THEN ' blockchain' ELSE '' END) AS low FROM conversations)
SELECT conv_id, turn FROM c WHERE {_sql_contains('low', tx.POST_WORDS)}
AND NOT ({_sql_contains('substr(low, 1, 80)', tx.RESUME_MARKS)} AND NOT {_sql_contains('substr(low, 1, 80)', tx.VACANCY_MARKS)})
AND NOT ({_sql_contains('low', tx.PROMO_MARKS)} OR ({_sql_contains('substr(low, 1, 120)', tx.CHATTER)} AND NOT {_sql_contains('low', tx.VACANCY_MARKS)}))""")
def post_filter(spark, sf_dir):
    """All turns as a channel's posts with a planted beginning and, in a third of them, a word of work at the end."""
    said = F.concat(_chosen(POSTS, F.col("conv_id") + F.col("turn")), F.lit(" "), F.coalesce("text", F.lit("")), F.when(F.col("conv_id") % 3 == 0, " blockchain").otherwise(""))
    return table(spark, sf_dir, "conversations").where(tx.post_kept(said)).select("conv_id", "turn")
