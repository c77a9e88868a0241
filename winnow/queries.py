"""Registered queries over the test tables and their DuckDB SQL.

Postings are documents: the first line is the title, the text the description, the source the company. The SQL
of rule queries is generated from the same pack, term by term, with explicit character classes for word
boundaries, since its pattern engine knows only ASCII ones.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.functions import patterns, spans, terms
from winnow.functions import html as hx
from winnow.functions import text as tx
from winnow.operators import cards, catalog, funnel_ops, reports, score, state
from winnow.plans.rules import RulePack, demo_pack
from winnow.schema import conform
from winnow.sources import boards, pages
from winnow.tables import numbered, shared_root

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return conform(d.select(
        F.col("doc_id").cast("string").alias("id"), F.substring_index("text", "\n", 1).alias("title"), F.col("source").alias("company"), F.col("text").alias("description"), F.lit("").alias("url"), F.col("lang").alias("source"),
    ))


# --- SQL of rule packs ---

PACK = demo_pack()
LETTER = r"[\p{L}\p{N}_]"


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_matches(col: str, term: str) -> str:
    kind = terms.mode(term)
    if kind == "phrase":
        return f"contains({col}, {_lit(term)})"
    word = term.rstrip("*").replace("-", r"\-")
    return f"regexp_matches({col}, {_lit('(^|[^' + LETTER[1:-1] + '])' + word + ('' if kind == 'stem' else '([^' + LETTER[1:-1] + ']|$)'))})"


def sql_any(col: str, ts: list[str]) -> str:
    return "(" + " OR ".join(sql_matches(col, t) for t in ts) + ")" if ts else "false"


def sql_count(col: str, ts: list[str]) -> str:
    return "(" + " + ".join(f"CAST({sql_matches(col, t)} AS INT)" for t in ts) + ")" if ts else "0"


BLOBS_SQL = """, b AS (
  SELECT *, lower(title) AS t, lower(title) || ' ' || lower(description) AS blob,
    regexp_extract_all(lower(title), '[\\p{L}\\p{N}\\p{M}_\\-]+') AS tokens FROM p
)"""
POSTINGS_SQL = "p AS (SELECT CAST(doc_id AS VARCHAR) AS id, string_split(text, chr(10))[1] AS title, source AS company, text AS description, lang AS source FROM documents)" + BLOBS_SQL
TURNS_SQL = "p AS (SELECT conv_id || '_' || turn AS id, string_split(text, chr(10))[1] AS title, role AS company, text AS description, role AS source FROM conversations)" + BLOBS_SQL


def _role_sql(role, pack: RulePack, order: int) -> str:
    w = pack.weights
    reason = "CASE " + " ".join(f"WHEN {sql_matches('blob', t)} THEN {_lit(chr(39).join(['hard-exclude: ', t, '']))}" for t in pack.hard_exclude)
    reason += " " + " ".join(f"WHEN contains(blob, {_lit(a)}) THEN 'avoided industry'" for a in pack.avoid)
    has = lambda ws: "list_has_any(tokens, [" + ", ".join(map(_lit, ws)) + "])"
    reason += f" WHEN {has(patterns.TITLE_EXCLUDED)} THEN 'executive, developer or finance title'"
    reason += f" WHEN {has(patterns.TITLE_DEV)} AND NOT {has(patterns.TITLE_OPS)} THEN 'developer title without operations context'"
    reason += f" WHEN {has(pack.finance_titles)} AND NOT {has(patterns.TITLE_CRYPTO)} THEN 'finance title without crypto context'"
    share = r"length(regexp_replace(regexp_replace(blob, '^\s+|\s+$', '', 'g'), '[\x00-\x7F\x{400}-\x{4FF}\s\x{85}\x{A0}\x{2000}-\x{200A}\x{3000}]', '', 'g'))"
    reason += f" WHEN length(trim(blob)) >= 200 AND {share} >= 0.25 * length(trim(blob)) THEN 'unreadable script'"
    reason += f" WHEN NOT {sql_any('blob', role.must_role)} THEN 'no word of the role'"
    if role.must_domain:
        reason += f" WHEN NOT {sql_any('blob', role.must_domain)} THEN 'no word of the domain'"
    reason += " END"
    cap = lambda n: f"greatest({n} * {w['penalize_each']}, {w['penalize_cap']})"
    strong, remote, onsite, reloc, ru = sql_any("blob", role.titles_strong), sql_any("blob", pack.remote), sql_any("blob", pack.onsite), sql_any("blob", pack.relocation), sql_any("blob", pack.english_boost)
    points = [
        str(w["gate_base"]), f"CASE WHEN {strong} THEN {w['title_strong']} WHEN {sql_any('blob', role.titles_weak)} THEN {w['title_weak']} ELSE 0 END",
        f"least({sql_count('blob', role.keywords_boost)} * {w['boost_each']}, {w['boost_cap']})", cap(sql_count("blob", role.keywords_penalize)), cap(sql_count("t", role.keywords_penalize_title)),
        f"CASE WHEN NOT {strong} AND {sql_any('t', role.senior_terms)} THEN {w['senior']} ELSE 0 END", f"CASE WHEN {remote} THEN {w['remote']} ELSE 0 END", f"CASE WHEN {reloc} THEN {w['relocation']} ELSE 0 END",
        f"CASE WHEN {onsite} AND NOT {remote} AND NOT {reloc} THEN CASE WHEN {ru} THEN {w['onsite_ru_desk']} ELSE {w['onsite']} END ELSE 0 END",
        f"CAST(trunc({sql_count('blob', pack.english_penalty)} * {w['english_penalty_each'] * role.english_weight}) AS INT)", f"CASE WHEN {ru} THEN {int(w['english_boost'] * role.english_weight)} ELSE 0 END",
        f"CASE WHEN {sql_any('blob', pack.entry)} THEN {w['entry']} ELSE 0 END",
    ]
    return f"SELECT id, company, source, {_lit(role.name)} AS role, {order} AS ord, {role.threshold} AS threshold, {reason} AS reason, {' + '.join(points)} AS points FROM b"


def pack_sql(pack: RulePack, postings_sql: str = POSTINGS_SQL) -> str:
    """CTEs up to v (a verdict per posting and role) and best."""
    roles = "\n  UNION ALL ".join(_role_sql(r, pack, i) for i, r in enumerate(pack.roles))
    return f"""WITH {postings_sql}, raw AS MATERIALIZED (
  {roles}
), v AS (
  SELECT *, reason IS NULL AS passed_gate, CASE WHEN reason IS NULL THEN CAST(greatest(0, least(100, points)) AS INT) ELSE 0 END AS score FROM raw
), vr AS (
  SELECT *, passed_gate AND score >= threshold AS recommend FROM v
), best AS (
  SELECT * FROM vr QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, ord) = 1
)
"""


RULES = pack_sql(PACK)


def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.best(score.spread(postings(spark, sf_dir)), PACK, reasons=False)


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.verdicts(score.spread(postings(spark, sf_dir)), PACK, reasons=False)


def _rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.rejections(score.spread(postings(spark, sf_dir)), PACK)


# --- scoring ---


@query(RULES + "SELECT id, role, score, passed_gate, recommend FROM best")
def best_role(spark, sf_dir):
    return _best(spark, sf_dir).select("id", "role", "score", "passed_gate", "recommend")


@query(RULES + "SELECT id, role, score, passed_gate, recommend FROM vr")
def role_scores(spark, sf_dir):
    return _verdicts(spark, sf_dir).select("id", "role", "score", "passed_gate", "recommend")


@query(RULES + "SELECT id, role, score FROM vr WHERE passed_gate QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, ord) = 1")
def best_gated_role(spark, sf_dir):
    return score.best_of(_verdicts(spark, sf_dir), ["id"], gated_only=True).select("id", "role", "score")


@query(RULES + "SELECT id, role, coalesce(reason, '') AS reason FROM vr")
def gate_first_reason(spark, sf_dir):
    return _rejections(spark, sf_dir).select("id", "role", F.when(F.col("passed_gate"), "").otherwise(F.get("reasons", F.lit(0))).alias("reason"))


@query(RULES + """, s AS (SELECT id, bool_or(passed_gate) AS ok, string_agg(DISTINCT reason, ' | ' ORDER BY reason) AS reason FROM vr GROUP BY id)
SELECT reason, CAST(count(*) AS BIGINT) AS n FROM s WHERE NOT ok GROUP BY reason""")
def gate_reason_hist(spark, sf_dir):
    return reports.reason_sets(_rejections(spark, sf_dir))


@query(RULES + """, s AS (SELECT id, bool_or(passed_gate) AS ok, string_agg(DISTINCT reason, ' | ' ORDER BY reason) AS reason FROM vr GROUP BY id)
SELECT reason, CAST(count(*) AS BIGINT) AS n FROM s WHERE NOT ok GROUP BY reason ORDER BY n DESC, reason LIMIT 12""")
def gate_reason_top12(spark, sf_dir):
    return reports.most_common(gate_reason_hist(spark, sf_dir), "reason")


@query(RULES + "SELECT id, score FROM best WHERE passed_gate AND NOT recommend AND score >= 20 ORDER BY score DESC, id LIMIT 3")
def near_miss_top3(spark, sf_dir):
    return funnel_ops.near_misses(_best(spark, sf_dir), 20).select("id", "score")


@query(RULES + "SELECT id, role, score, row_number() OVER (ORDER BY score DESC, id) AS place FROM best WHERE passed_gate")
def gate_passers(spark, sf_dir):
    return numbered(_best(spark, sf_dir).where("passed_gate").select("id", "role", "score"), [F.desc("score"), "id"], "place")


@query(RULES + "SELECT id, role, score FROM best WHERE recommend")
def recommend_threshold(spark, sf_dir):
    return _best(spark, sf_dir).where("recommend").select("id", "role", "score")


@query(RULES + "SELECT printf('%02d-%02d', score // 10 * 10, score // 10 * 10 + 9) AS band, CAST(count(*) AS BIGINT) AS n FROM best GROUP BY 1")
def score_hist_decile(spark, sf_dir):
    return reports.deciles(_best(spark, sf_dir))


@query(RULES + "SELECT min(score) AS least, median(score) AS median, max(score) AS most FROM best WHERE passed_gate")
def score_min_median_max(spark, sf_dir):
    return reports.spread(_best(spark, sf_dir).where("passed_gate"))


@query(RULES + "SELECT " + ", ".join(f"CAST(count(*) FILTER (WHERE score >= {x}) AS BIGINT) AS at_least_{x}" for x in (55, 50, 45, 40)) + " FROM best")
def score_cutoffs(spark, sf_dir):
    return reports.cutoffs(_best(spark, sf_dir))


@query(RULES + "SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE passed_gate) AS BIGINT) AS passed, CAST(count(*) FILTER (WHERE recommend) AS BIGINT) AS recommended FROM best")
def funnel_totals(spark, sf_dir):
    return reports.totals(_best(spark, sf_dir))


@query(RULES + "SELECT count(*) AS total, count(*) FILTER (WHERE passed_gate) AS passed, count(*) FILTER (WHERE recommend) AS recommended, min(score) FILTER (WHERE passed_gate) AS least, median(score) FILTER (WHERE passed_gate) AS median, max(score) FILTER (WHERE passed_gate) AS most, "
       + ", ".join(f"count(*) FILTER (WHERE score >= {x}) AS at_least_{x}" for x in (55, 50, 45, 40)) + ", concat_ws(',', " + ", ".join(f"count(*) FILTER (WHERE score // 10 = {x})" for x in range(11)) + ") AS by_ten FROM best")
def one_scan_report(spark, sf_dir):
    """All reports of scores from one scan."""
    told = reports.told(reports.summary(_best(spark, sf_dir)))
    return told.withColumn("by_ten", F.array_join(F.transform("by_ten", lambda x: x.cast("string")), ","))


@query(f"WITH {POSTINGS_SQL} SELECT source, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE trim(coalesce(description, '')) = '') AS BIGINT) AS empty FROM p GROUP BY source")
def per_source_counts(spark, sf_dir):
    return reports.per_source(postings(spark, sf_dir))


# --- terms and text ---


@query(f"WITH {POSTINGS_SQL} SELECT id, list_has_any(tokens, ['the', 'la', 'der']) AND NOT list_has_any(tokens, ['and', 'que']) AS rejected FROM b")
def title_token_gate(spark, sf_dir):
    tokens = terms.tokens(F.col("title"))
    has = lambda *w: F.arrays_overlap(tokens, F.array(*map(F.lit, w)))
    return postings(spark, sf_dir).select("id", (has("the", "la", "der") & ~has("and", "que")).alias("rejected"))


def _term_query(name: str, term: str) -> None:
    def run(spark, sf_dir):
        return postings(spark, sf_dir).where(terms.matches(tx.blob(F.col("title"), F.col("description")), term)).select("id")

    run.__name__ = name
    query(f"WITH {POSTINGS_SQL} SELECT id FROM b WHERE {sql_matches('blob', term)}")(run)


_term_query("stem_prefix_match", "é*")
_term_query("exact_token_match", "la")
_term_query("phrase_match", "of the")

LISTED = ["the", "de*", "of the", "und", "que", "é*"]


@query(f"WITH {POSTINGS_SQL} SELECT id, CAST({sql_count('blob', LISTED)} AS INT) AS n, concat_ws(',', " + ", ".join(f"CASE WHEN {sql_matches('blob', t)} THEN {_lit(t)} END" for t in LISTED) + ") AS hits FROM b")
def hits_list(spark, sf_dir):
    found = postings(spark, sf_dir).select("id", terms.hits(tx.blob(F.col("title"), F.col("description")), LISTED).alias("h"))
    return found.select("id", F.size("h").alias("n"), F.array_join("h", ",").alias("hits"))


_TERMS_SQL = """w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word, generate_subscripts(regexp_extract_all(lower(text), '[a-z]+'), 1) AS i FROM benchmark),
g AS (SELECT word, lead(word) OVER o AS next, lead(word, 2) OVER o AS third FROM w WINDOW o AS (PARTITION BY item_id ORDER BY i)),
terms AS (SELECT DISTINCT unnest([word, left(word, 4) || '*', word || ' ' || next, word || ' ' || next || ' ' || third, word || '.']) AS term FROM g),
t AS MATERIALIZED (SELECT doc_id AS id, lower(text) AS text, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{M}_]+')) AS words FROM documents),
k AS (SELECT id, unnest(words) AS word FROM t),
found AS (
  SELECT id, term FROM k JOIN terms ON term = word
  UNION SELECT id, term FROM k JOIN terms ON term = left(word, 4) || '*'
  UNION SELECT id, term FROM k JOIN terms ON length(word) < 4 AND term = word || '*'
  UNION SELECT id, term FROM k JOIN terms ON length(term) = 4 AND term = left(word, 3) || '*'
  UNION SELECT id, term FROM k JOIN terms ON length(term) = 3 AND term = left(word, 2) || '*'
  UNION SELECT id, term FROM k JOIN terms ON length(term) = 2 AND term = left(word, 1) || '*'
  UNION SELECT id, term FROM t JOIN terms ON regexp_matches(term, '[ .]') AND contains(text, term)
)"""


@query(f"""WITH {_TERMS_SQL} SELECT t.id, CAST(count(term) AS BIGINT) AS n, md5(coalesce(string_agg(term, ',' ORDER BY term), '')) AS hits_md5
FROM t LEFT JOIN found ON found.id = t.id GROUP BY t.id""")
def term_catalogue(spark, sf_dir):
    """All words, stems, pairs and triples of words and ends of sentences of the benchmark, some thousands, in all documents."""
    words = F.transform(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)), lambda w: w)
    rows = table(spark, sf_dir, "benchmark").select(words.alias("w")).select("w", F.posexplode("w").alias("i", "word"))
    nxt, third = F.get("w", F.col("i") + 1), F.get("w", F.col("i") + 2)
    forms = F.array(F.col("word"), F.concat(F.left("word", F.lit(4)), F.lit("*")), F.concat_ws(" ", "word", nxt), F.concat_ws(" ", "word", nxt, third), F.concat("word", F.lit(".")))
    forms = F.array_compact(F.array(F.get(forms, 0), F.get(forms, 1), F.when(nxt.isNotNull(), F.get(forms, 2)), F.when(third.isNotNull(), F.get(forms, 3)), F.get(forms, 4)))
    listed = rows.select(F.explode(forms).alias("term")).distinct().withColumn("ord", F.lit(0))
    found = catalog.hits(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lower("text").alias("text")), listed)
    return found.select("id", F.size("hits").cast("long").alias("n"), F.md5(F.array_join(F.sort_array("hits"), ",")).alias("hits_md5"))


@query(r"""WITH s AS (SELECT doc_id, text, regexp_extract_all(text, '\([0-9]+\)') AS m, regexp_split_to_array(text, '\([0-9]+\)') AS g FROM documents),
x AS (SELECT doc_id, text, unnest(m) AS m1, unnest(list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(g[1:i], lambda q: length(q))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda q: length(q))), 0))) AS "at" FROM s WHERE len(m) > 0)
SELECT doc_id, CAST("at" AS INT) AS "at", m1 AS number, substr(text, CAST(greatest("at" - 20, 0) AS BIGINT) + 1, CAST("at" + length(m1) + 20 - greatest("at" - 20, 0) AS BIGINT)) AS around FROM x""")
def number_window(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where(F.col("text").rlike(r"\([0-9]+\)"))
    rows = rows.select("doc_id", "text", F.explode(spans.finditer(F.col("text"), r"\([0-9]+\)")).alias("m"))
    return rows.select("doc_id", F.col("m.start").alias("at"), F.col("m.m").alias("number"), spans.window(F.col("text"), F.col("m"), 20, 20).alias("around"))


@query(r"SELECT doc_id, CAST(length(regexp_replace(text, '[\x00-\x7F\x{400}-\x{4FF}\s]', '', 'g')) AS INT) AS other FROM documents")
def non_ascii_share(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_count("text", F.lit(patterns.UNREADABLE.replace(r"\s", r"\x09-\x0D\x20"))).alias("other"))


KEY_SQL = r"""trim(regexp_replace(regexp_replace(regexp_replace(lower(company) || '|' || lower(title), '\([^)]*\)', ' ', 'g'), '[^\p{L}\p{M}\p{N}\p{Pc}|]+', ' ', 'g'), '\s+', ' ', 'g'))"""


@query(f"WITH {POSTINGS_SQL} SELECT id, {KEY_SQL} AS key FROM p")
def dedupe_key(spark, sf_dir):
    return postings(spark, sf_dir).select("id", tx.same_key(F.col("company"), F.col("title")).alias("key"))


@query(f"WITH {POSTINGS_SQL} SELECT CAST(min(CAST(id AS BIGINT)) AS VARCHAR) AS id FROM p GROUP BY {KEY_SQL}")
def near_dup_collapse(spark, sf_dir):
    return funnel_ops.collapse(postings(spark, sf_dir), [F.col("id").cast("long")]).select("id")


@query(f"SELECT doc_id, CASE WHEN length(text) <= 1500 THEN text ELSE substr(text, 1, 700) || {_lit(tx.MIDDLE)} || substr(text, -800) END AS sample FROM documents")
def head_tail_sample(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.head_and_tail(F.col("text")).alias("sample"))


@query("SELECT doc_id, CAST(length(substr(text, 1, 12000)) AS INT) AS n, md5(substr(text, 1, 12000)) AS digest FROM documents")
def description_cap(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.length(tx.description(F.col("text"))).alias("n"), F.md5(tx.description(F.col("text"))).alias("digest"))


REDACT_SQL = reduce(lambda col, x: f"regexp_replace({col}, {_lit(x[0].replace(r'[^&' + chr(92) + 's', r'[^&' + chr(92) + 's'))}, {_lit(x[1].replace('$1', chr(92) + '1'))}, 'g')", tx.SECRETS, "text")


@query(f"SELECT doc_id, md5({REDACT_SQL}) AS digest, {REDACT_SQL} <> text AS changed FROM documents")
def redact_secrets(spark, sf_dir):
    clean = tx.redact(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(clean).alias("digest"), (clean != F.col("text")).alias("changed"))


# --- sources ---


@query(r"""WITH l AS (SELECT conv_id, turn, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM conversations),
c AS (SELECT *, list_transform(ls, lambda x: trim(regexp_replace(x, '^[^\p{L}\p{M}\p{N}]+', ''))) AS cs FROM l)
SELECT conv_id, turn, substr(coalesce(list_filter(cs, lambda x: length(regexp_replace(x, '[^\p{L}]', '', 'g')) >= 8)[1], list_filter(cs, lambda x: length(regexp_replace(x, '[^\p{L}]', '', 'g')) > 0)[1], 'Job opening'), 1, 120) AS title FROM c""")
def title_pick(spark, sf_dir):
    lines = F.filter(F.transform(F.split("text", "\n"), F.trim), lambda x: x != "")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.pick_title(lines).alias("title"))


def _sql_contains(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, {_lit(w)})" for w in words) + ")"


@query(r"SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, CAST(length(regexp_replace(html, '<[^>]+>', '', 'g')) AS INT) AS plain_chars FROM pages")
def page_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"), F.length(F.regexp_replace("html", r"<[^>]+>", "")).alias("plain_chars"))


@query(r"""SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*href="([^"]*)"[^>]*>', 1)) AS href FROM pages""")
def page_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'(?is)<a\b[^>]*href="([^"]*)"[^>]*>'), F.lit(1))).alias("href"))


UNESCAPE_SQL = reduce(lambda col, e: f"replace({col}, {_lit(e[0])}, {_lit(e[1])})", tx.ENTITIES, r"trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[\s\x{85}\x{A0}]+', ' ', 'g'))")


@query(f"SELECT page_id, md5({UNESCAPE_SQL}) AS digest FROM pages")
def strip_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(tx.plain(F.col("html"))).alias("digest"))


@query(r"""SELECT url, CAST(length(html) AS INT) AS chars, CASE WHEN contains(lower(html), '<rss') OR contains(lower(html), '<feed') THEN 'RSS/XML' WHEN contains(lower(html), '__next_data__') THEN 'NEXT_DATA(JSON)'
WHEN contains(lower(html), 'algolia') THEN 'Algolia SPA' WHEN contains(lower(html), 'graphql') THEN 'GraphQL SPA' ELSE 'HTML' END AS feed,
CAST(len(list_distinct(regexp_extract_all(html, 'href="(/[a-z0-9-]+/[a-z0-9-]{6,})"', 1))) AS INT) AS links, CAST(len(regexp_extract_all(html, 'vacancy-card|job-card|JobCard|posting-')) AS INT) AS cards FROM pages""")
def url_probe(spark, sf_dir):
    return pages.probe(table(spark, sf_dir, "pages")).drop("sound")


@query("SELECT page_id, substr(md5('page_' || url), 1, 12) AS uid FROM pages")
def md5_ids(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.short_md5(F.lit("page"), F.col("url")).alias("uid"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props_decode(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint").k.alias("k"))


@query("""SELECT source, n FROM (SELECT 'documents' AS source, CAST(count(*) AS BIGINT) AS n FROM documents UNION ALL SELECT 'conversations', CAST(count(*) AS BIGINT) FROM conversations
UNION ALL SELECT 'pages', CAST(count(*) AS BIGINT) FROM pages) WHERE n > 0""")
def source_union_active(spark, sf_dir):
    parts = [table(spark, sf_dir, t).select(F.lit(t).alias("source")) for t in ("documents", "conversations", "pages")]
    return reduce(DataFrame.unionAll, parts).groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT CAST(user_id AS BIGINT) AS user_id, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY user_id HAVING count(*) >= 20")
def saturated_queries(spark, sf_dir):
    return reports.saturated(table(spark, sf_dir, "events"), "user_id").select(F.col("user_id").cast("long").alias("user_id"), "n")


@query("""SELECT doc_id, md5(substr(coalesce(text, ''), 1, 12000)) AS digest, 'gh_' || doc_id AS id FROM documents""")
def json_board(spark, sf_dir):
    """Documents packed as a board's answer and read back through its reader."""
    body = F.to_json(F.struct(F.array(F.struct(F.col("doc_id").cast("string").alias("id"), F.lit("t").alias("title"), F.col("text").alias("content"))).alias("jobs")))
    rows = boards.greenhouse(table(spark, sf_dir, "documents").select(body.alias("body"), F.lit("x").alias("company")))
    return rows.select(F.substring("id", 4, 20).cast("long").alias("doc_id"), F.md5("description").alias("digest"), "id")


@query("""WITH f AS (SELECT event_id, event_id // 64 AS page, event_id % 64 < 20 AS newest FROM events), n AS (SELECT page FROM f WHERE newest GROUP BY page HAVING count(*) >= 20)
SELECT 'hh_' || event_id AS id, 'job ' || event_id AS title FROM f WHERE newest OR page IN (SELECT page FROM n)""")
def rss_two_passes(spark, sf_dir):
    """All events in feeds of at most 64: the 20 newest of each and, where these are full, all of it; every id once."""
    rows = table(spark, sf_dir, "events").select("event_id", F.expr("event_id div 64").alias("page"))
    item = lambda e: F.concat(F.lit("<item><title>job "), e.cast("string"), F.lit("</title><link>http://x/"), e.cast("string"), F.lit("</link><description>a</description><pubDate></pubDate></item>"))
    feed = lambda of, by_date: of.groupBy("page").agg(F.concat(F.lit("<rss><channel>"), F.array_join(F.transform(F.array_sort(F.collect_list("event_id")), item), ""), F.lit("</channel></rss>")).alias("body")).select("body", F.col("page").alias("query"), F.lit(by_date).alias("by_date"))
    return pages.hh_feed(feed(rows.where("event_id % 64 < 20"), True).unionByName(feed(rows, False))).select("id", "title")


def _as_vacancies(html):
    """Pages whose article is a vacancy's element and whose paragraphs, some never closed, are elements of the same name."""
    for old, new in (("<article>", '<div data-qa="vacancy-description">'), ("</article>", "</div>"), ("<p>", '<div class="p">'), ("</p>", "</div>")):
        html = F.replace(html, F.lit(old), F.lit(new))
    return html


@query()
def page_elements(spark, sf_dir):
    """Of all pages: the vacancy's whole element and its text, and whole elements of three names; tested against a parser."""
    html = _as_vacancies(F.col("html"))
    rows = table(spark, sf_dir, "pages").withColumn("own", hx.first_with(html, hx.attribute_is("data-qa", "vacancy-description")))
    told = [F.md5(F.array_join(hx.elements(html, name), "|")).alias(f"{name}_md5") for name in ("nav", "li", "div")]
    return rows.select("page_id", F.md5("own").alias("own_md5"), F.length("own").cast("long").alias("own_chars"), F.md5(pages.full_text(html)).alias("text_md5"), *told)


# --- state and joins ---

STATE_SQL = "SELECT doc_id AS id, CASE WHEN toxic = 1 THEN NULL WHEN quality = 1 THEN 'v1' ELSE 'v2' END AS version FROM labels"


def _seen(spark, sf_dir) -> DataFrame:
    version = F.when(F.col("toxic") == 1, F.lit(None).cast("string")).when(F.col("quality") == 1, "v1").otherwise("v2")
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), version.alias("prefilter_version"))


@query(f"SELECT doc_id AS id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM ({STATE_SQL}) s WHERE s.id = d.doc_id AND (s.version IS NULL OR s.version = 'v1'))")
def seen_versioned_anti(spark, sf_dir):
    return state.unseen(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), _seen(spark, sf_dir), "v1")


@query("SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def seen_legacy_anti(spark, sf_dir):
    return state.unseen(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), _seen(spark, sf_dir))


def _upserts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    old = _seen(spark, sf_dir).select("id", F.lit("s").alias("source"), F.lit("").alias("title"), F.lit("").alias("url"), F.timestamp_seconds(F.lit(0)).alias("seen_at"), "prefilter_version")
    new = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("n").alias("source"), F.lit("").alias("title"), F.lit("").alias("url"))
    return old, new


_UPSERT = """WITH o AS (SELECT id, version FROM ({state}) q), n AS (SELECT doc_id AS id FROM documents)
SELECT coalesce(o.id, n.id) AS id, coalesce(CASE WHEN o.id IS NOT NULL THEN 's' END, 'n') AS source, coalesce({version}, 'final') AS version, CAST(CASE WHEN {fresh} THEN 100 ELSE 0 END AS BIGINT) AS at FROM o FULL JOIN n ON o.id = n.id"""


def _told(rows: DataFrame) -> DataFrame:
    return rows.select("id", "source", F.coalesce("prefilter_version", F.lit("final")).alias("version"), F.unix_seconds("seen_at").alias("at"))


@query(_UPSERT.format(state=STATE_SQL, version="CASE WHEN n.id IS NULL THEN o.version END", fresh="n.id IS NOT NULL"))
def upsert_verdict(spark, sf_dir):
    old, new = _upserts(spark, sf_dir)
    return _told(state.mark_verdict(old, new, F.timestamp_seconds(F.lit(100))))


@query(_UPSERT.format(state=STATE_SQL, version="CASE WHEN n.id IS NULL OR (o.id IS NOT NULL AND o.version IS NULL) THEN o.version ELSE 'v9' END", fresh="n.id IS NOT NULL AND NOT (o.id IS NOT NULL AND o.version IS NULL)"))
def upsert_reject(spark, sf_dir):
    old, new = _upserts(spark, sf_dir)
    return _told(state.mark_rejected(old, new, "v9", F.timestamp_seconds(F.lit(100))))


@query("""SELECT doc_id AS id, CASE WHEN max(quality) = 1 THEN 'final' WHEN count(quality) > 0 THEN 'v2' ELSE 'v1' END AS version
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY doc_id HAVING coalesce(max(toxic), 0) = 0""")
def seen_log(spark, sf_dir):
    """Four commits to a log of deltas, read back: all rejected, some given verdicts, some rejected anew, some dropped."""
    import uuid

    from winnow.operators.log import SeenLog

    log = SeenLog(spark, f"{shared_root(spark)}/seen-{uuid.uuid4().hex}")
    rows = lambda name, *more: table(spark, sf_dir, name).select(F.col("doc_id").cast("string").alias("id"), F.lit("s").alias("source"), F.lit("").alias("title"), F.lit("").alias("url"), *more)
    labels, now = rows("labels", "quality", "toxic"), F.timestamp_seconds(F.lit(1))
    log.mark(None, rows("documents"), "v1", now)
    log.mark(labels.where("quality = 1"), None, "v1", now)
    log.mark(None, labels, "v2", now)
    log.forget(labels.where("toxic = 1"))
    return log.read().select(F.col("id").cast("long").alias("id"), F.coalesce("prefilter_version", F.lit("final")).alias("version"))


@query("SELECT d.doc_id AS id, l.doc_id IS NOT NULL AS hit, coalesce(l.quality, -1) AS score FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND l.toxic = 0")
def cache_split(spark, sf_dir):
    cache = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("job_id"), F.col("quality").alias("score"), F.col("toxic").cast("string").alias("scoring_version"))
    hits, misses = state.split_cached(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), cache, "0")
    return hits.select("id", F.lit(True).alias("hit"), "score").unionByName(misses.select("id", F.lit(False).alias("hit"), F.lit(-1).cast("int").alias("score")))


@query("SELECT d.doc_id AS id, l.quality AS score, d.lang FROM documents d JOIN labels l USING (doc_id)")
def result_join(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.select("doc_id", "lang").join(labels, "doc_id").select(F.col("doc_id").alias("id"), F.col("quality").alias("score"), "lang")


@query("SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def reject_anti(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").where("quality = 1"), "doc_id", "left_anti").select(F.col("doc_id").alias("id"))


@query("SELECT doc_id, (row_number() OVER (ORDER BY quality DESC, doc_id) - 1) // 5 AS batch FROM labels")
def micro_batches(spark, sf_dir):
    return funnel_ops.ranked_batches(table(spark, sf_dir, "labels"), 5, [F.desc("quality"), "doc_id"]).select("doc_id", "batch")


@query("WITH b AS (SELECT (row_number() OVER (ORDER BY quality DESC, doc_id) - 1) // 5 AS batch FROM labels) SELECT batch, CAST(count(*) AS BIGINT) AS n FROM b GROUP BY batch")
def batch_checkpoints(spark, sf_dir):
    return reports.checkpoints(micro_batches(spark, sf_dir))


@query("SELECT doc_id AS id, quality AS score, toxic AS origin, row_number() OVER (ORDER BY quality DESC, toxic, doc_id) AS place FROM labels")
def final_ranking(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("score"), "toxic")
    top = funnel_ops.final_order(rows.where("toxic = 0").drop("toxic"), rows.where("toxic = 1").drop("toxic"))
    return numbered(top, [F.desc("score"), "origin", "id"], "place").select("id", "score", "origin", "place")


APPS_SQL = "(SELECT CAST(o_orderkey AS VARCHAR) AS job_id, o_orderdate AS applied_at, CASE WHEN o_orderstatus = 'O' THEN 'applied' ELSE 'closed' END AS status FROM orders)"
NOW = "2001-08-01"


def _applications(spark, sf_dir) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "applied").otherwise("closed")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("job_id"), F.col("o_orderdate").alias("applied_at"), status.alias("status"))


@query(f"SELECT job_id, status FROM {APPS_SQL} ORDER BY applied_at DESC, job_id LIMIT 20")
def recent_applications(spark, sf_dir):
    return state.applications_recent(_applications(spark, sf_dir)).select("job_id", "status")


LINES_SQL = """(SELECT CAST(o_orderkey AS VARCHAR) AS job_id, o_orderdate AS applied_at, '· ' || strftime(o_orderdate, '%Y-%m-%d') || ' — '
 || CASE WHEN o_custkey % 2 = 0 THEN '<a href="https://x/' || o_orderkey || '">' ELSE '' END
 || CASE WHEN o_custkey % 5 = 0 THEN 'untitled' ELSE o_orderpriority || ' &amp; &lt;' || o_orderstatus || '&gt;' END || CASE WHEN o_custkey % 2 = 0 THEN '</a>' ELSE '' END
 || CASE WHEN o_custkey % 3 = 0 THEN '' ELSE ' — Firm ' || o_custkey END || CASE WHEN o_custkey % 7 = 0 THEN '' ELSE ' · ' || (o_custkey % 101) || '/100' END AS line FROM orders)"""


def _told_applications(spark, sf_dir) -> DataFrame:
    key, text = F.col("o_custkey"), lambda c: F.col(c).cast("string")
    return table(spark, sf_dir, "orders").select(
        text("o_orderkey").alias("job_id"), F.col("o_orderdate").alias("applied_at"), F.when(key % 2 == 0, F.concat(F.lit("https://x/"), text("o_orderkey"))).alias("url"),
        F.when(key % 5 != 0, F.concat("o_orderpriority", F.lit(" & <"), "o_orderstatus", F.lit(">"))).alias("title"), F.when(key % 3 != 0, F.concat(F.lit("Firm "), text("o_custkey"))).alias("company"),
        F.when(key % 7 != 0, key % 101).alias("score"), F.when(F.col("o_orderstatus") == "O", "applied").otherwise("closed").alias("status"),
    )


@query(f"SELECT job_id, line FROM {LINES_SQL}")
def application_lines(spark, sf_dir):
    line = cards.application_line(*[F.col(c) for c in ("applied_at", "title", "company", "url", "score")])
    return _told_applications(spark, sf_dir).select("job_id", line.alias("line"))


@query(f"""WITH s AS (SELECT count(*) AS total, count(*) FILTER (WHERE applied_at >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY) AS last7,
 count(*) FILTER (WHERE status = 'applied' AND applied_at < TIMESTAMP '{NOW}' - INTERVAL 14 DAY) AS stale FROM {APPS_SQL}),
r AS (SELECT * FROM {LINES_SQL} ORDER BY applied_at DESC, job_id LIMIT 15)
SELECT concat_ws(chr(10), '📋 <b>Applications</b> — ' || total || ' in all, ' || last7 || ' in 7 days', CASE WHEN stale > 0 THEN '⏳ No answer for over 14 days: <b>' || stale || '</b>' END,
 repeat('─', 22), (SELECT string_agg(line, chr(10) ORDER BY applied_at DESC, job_id) FROM r)) AS message FROM s""")
def applications_message(spark, sf_dir):
    rows = _told_applications(spark, sf_dir)
    return cards.applications_message(state.applications_recent(rows, 15), state.application_stats(rows, F.lit(NOW).cast("timestamp")))


@query(f"""SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE applied_at >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY) AS BIGINT) AS last7,
CAST(count(*) FILTER (WHERE status = 'applied' AND applied_at < TIMESTAMP '{NOW}' - INTERVAL 14 DAY) AS BIGINT) AS stale, 14 AS stale_days FROM {APPS_SQL}""")
def application_stats(spark, sf_dir):
    return state.application_stats(_applications(spark, sf_dir), F.lit(NOW).cast("timestamp"))


@query("SELECT CAST(o_custkey AS VARCHAR) AS job_id, CAST(o_custkey AS VARCHAR) NOT IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal > 0) AS inserted FROM (SELECT DISTINCT o_custkey FROM orders)")
def application_insert(spark, sf_dir):
    cols = [F.col("k").cast("string").alias("job_id")]
    old = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k")).select(*cols)
    new = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).select(*cols)
    return state.insert_absent(old, new, "job_id")[1].select("job_id", "inserted")


@query("SELECT CAST((SELECT count(*) FROM labels) AS BIGINT) AS before, CAST(count(*) AS BIGINT) AS matched, CAST((SELECT count(*) FROM labels) AS BIGINT) - CAST(count(*) AS BIGINT) AS after FROM labels WHERE toxic = 1")
def backfill_requeue(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "id")
    return state.requeue(labels, labels.where("toxic = 1"), apply=True)[1]


@query("SELECT CAST(user_id AS BIGINT) AS user_id, CAST(count(*) AS BIGINT) AS attempted, CAST(count(*) FILTER (WHERE event_type = 'purchase') AS BIGINT) AS enriched, round(count(*) FILTER (WHERE event_type = 'purchase') / count(*), 9) AS rate, count(*) < 5 OR count(*) FILTER (WHERE event_type = 'purchase') / count(*) >= 0.5 AS healthy FROM events GROUP BY user_id")
def enrich_health(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("long").alias("user_id")).agg(F.count("*").alias("attempted"), F.count_if(F.col("event_type") == "purchase").alias("enriched"))
    rate, healthy = funnel_ops.enrich_health(F.col("attempted"), F.col("enriched"))
    return rows.withColumns({"rate": F.round(rate, 9), "healthy": healthy})


@query("""WITH e AS (SELECT ts, event_type, CAST(user_id AS VARCHAR) AS link, event_id FROM events WHERE ts >= TIMESTAMP '2024-01-24'),
u AS (SELECT link, max(ts) AS newest FROM e GROUP BY link) SELECT link, newest FROM u ORDER BY newest DESC, link LIMIT 8""")
def digest_topk(spark, sf_dir):
    items = table(spark, sf_dir, "events").select(F.col("ts").alias("when"), F.col("event_type").alias("feed"), F.col("event_id").cast("string").alias("title"), F.col("user_id").cast("string").alias("link"))
    return reports.digest(items, F.lit("2024-01-31").cast("timestamp")).select("link", F.col("when").alias("newest"))


@query("""WITH e AS (SELECT ts, event_type, CAST(user_id AS VARCHAR) AS link, event_id FROM events WHERE ts >= TIMESTAMP '2024-01-24'),
u AS (SELECT link, max(struct_pack(a := ts, b := event_type, c := CAST(event_id AS VARCHAR))) AS x FROM e GROUP BY link), k AS (SELECT link, x.a AS newest, x.c AS title FROM u ORDER BY newest DESC, link LIMIT 8)
SELECT '<b>Of the week</b>' || chr(10) || chr(10) || string_agg('• ' || strftime(newest, '%d.%m') || ' <a href="' || link || '">' || title || '</a>', chr(10) ORDER BY newest DESC, link) AS message FROM k""")
def digest_message(spark, sf_dir):
    items = table(spark, sf_dir, "events").select(F.col("ts").alias("when"), F.col("event_type").alias("feed"), F.col("event_id").cast("string").alias("title"), F.col("user_id").cast("string").alias("link"))
    return cards.digest_message(reports.digest(items, F.lit("2024-01-31").cast("timestamp")), "Of the week")


@query("SELECT doc_id, '<code>' || (quality * 60 + 35) || '/100</code>  ·  ' || lang AS foot, quality * 60 + 35 AS score FROM labels JOIN documents USING (doc_id)")
def card_render(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").withColumn("score", F.col("quality") * 60 + 35)
    meta = cards.meta_line(F.col("source"), F.lit(False), F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit("USD"))
    none = F.array().cast("array<string>")
    card = cards.card(F.get(F.split("text", "\n"), F.lit(0)), meta, F.col("lang"), F.col("score"), none, none, F.lit(""), F.lit(None).cast("string"))
    rows = rows.select("doc_id", F.try_element_at(F.split(card, "\n"), F.lit(-1)).alias("foot"), cards.read_card(tx.without_tags(card)).score.alias("score"))
    return rows


@query(pack_sql(PACK, TURNS_SQL) + "SELECT id, role, score, passed_gate, recommend FROM best")
def stream_funnel(spark, sf_dir):
    """Conversations as a stream of postings, triaged against state that grows; rows are the verdicts of all batches."""
    import uuid

    from winnow.operators.log import SeenLog
    from winnow.streaming import funnel_stream

    base = f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"
    source = f"{sf_dir}/conversations.parquet"
    rows = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source if _is_folder(spark, source) else f"{sf_dir}/conversations*.parquet")
    posts = conform(rows.select(
        F.concat_ws("_", "conv_id", "turn").alias("id"), F.get(F.split("text", "\n"), F.lit(0)).alias("title"), F.col("role").alias("company"), F.col("text").alias("description"), F.col("role").alias("source"),
    ))
    funnel_stream.run(posts, PACK, SeenLog(spark, f"{base}/seen"), f"{base}/out", f"{base}/offsets").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("id", "role", "score", "passed_gate", "recommend")


@query("SELECT DISTINCT CAST(user_id AS BIGINT) AS user_id, event_type, strftime(ts, '%Y-%m-%d') AS day FROM events")
def stream_first_of_day(spark, sf_dir):
    """Events as a stream: one of a user, kind and day, by keyed state that expires."""
    import uuid

    from winnow.streaming import expiring

    base, source = f"{shared_root(spark)}/stream-{uuid.uuid4().hex}", f"{sf_dir}/events.parquet"
    rows = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source if _is_folder(spark, source) else f"{sf_dir}/events*.parquet")
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    expiring.run(rows, ["user_id", "event_type"], "ts", f"{base}/out", f"{base}/offsets").awaitTermination()
    return spark.read.parquet(f"{base}/out").select(F.col("user_id").cast("long").alias("user_id"), "event_type", F.date_format("span_start", "yyyy-MM-dd").alias("day"))


DUMP_SQL = """
SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 7 <> 0 THEN length(text) END AS chars, CASE WHEN doc_id % 7 <> 0 THEN md5(text) END AS text_md5,
  CASE WHEN doc_id % 7 = 0 THEN 'not JSON' END AS error, n AS read_by
FROM documents, (SELECT unnest(['batch', 'stream']) AS n)
"""


@query(DUMP_SQL)
def payload_lines(spark, sf_dir):
    """All documents as a dump of JSON lines, every seventh torn, read back as payloads in batch and as a stream: torn ones are
    rejects, of which the id is still told."""
    import uuid

    from winnow.sources import payloads, registry

    base = f"{shared_root(spark)}/payloads-{uuid.uuid4().hex}"
    text = F.coalesce("text", F.lit(""))
    line = F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), text.alias("description")))
    torn = F.when(F.col("doc_id") % 7 == 0, F.left(line, F.length(line) - 1)).otherwise(line)
    table(spark, sf_dir, "documents").select(torn.alias("value")).write.text(f"{base}/dump")

    def told(rows: DataFrame, by: str) -> DataFrame:
        good, bad = registry.lines(rows)
        good = good.select("id", F.length("description").alias("chars"), F.md5("description").alias("text_md5"), F.lit(None).cast("string").alias("error"))
        bad = bad.select(F.regexp_extract("body", r'^\{"id":"([^"]*)"', 1).alias("id"), F.lit(None).cast("int").alias("chars"), F.lit(None).cast("string").alias("text_md5"), F.left("error", F.lit(8)).alias("error"))
        return good.unionByName(bad).withColumn("read_by", F.lit(by))

    stream = payloads.payload_stream(spark, f"{base}/dump", f"{base}/index", form="lines", pieceBytes=32 << 20)
    stream.writeStream.option("checkpointLocation", f"{base}/offsets").trigger(availableNow=True).start(f"{base}/streamed", format="parquet").awaitTermination()
    batch = payloads.payloads(spark, f"{base}/dump", form="lines", pieceBytes=32 << 20)
    return told(batch, "batch").unionByName(told(spark.read.parquet(f"{base}/streamed"), "stream"))


def _is_folder(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


from winnow import rule_queries  # noqa: E402, F401  registers its queries
