"""The registered queries opN_<name> and pipeline, each over its whole table, and their DuckDB SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.llm import ann, chat, langid, linededup, lm, media, neardup, packing, pieces, repair, sharding, simhash, trie


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """A vocabulary file of the public tokenizers; WINNOW_TOKENIZERS names another folder."""
    if folder := os.environ.get("WINNOW_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_rotated_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.expand(rows))


OP2_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), n AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    sum(length(replace(replace(replace(replace(role, '\', '\b'), '</turn>', '\t'), '### ', '\h'), ':', '\c'))
      + length(replace(replace(replace(text, '\', '\b'), '</turn>', '\t'), '### ', '\h')) + 14) OVER w AS upto
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (WHERE role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars,
  CAST(count(*) FILTER (WHERE role = 'assistant' OR i = n) AS BIGINT) AS n_examples
FROM n GROUP BY conv_id
"""


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(langid.training_rows(docs))
    rows = docs.select("doc_id", "text", langid.held_out(F.col("doc_id"), 4, 2).alias("held_out"))
    return langid.identify(rows, model).select("doc_id", "held_out", "lang_pred", "score")


def op4_minhash_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), neardup.Plan(ngram=3, percent=85))


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 2], ' ') END AS shingle
  FROM w, unnest(range(1, greatest(2, CAST(len(ws) AS BIGINT) - 1))) AS r(i) WHERE len(ws) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(na.n) + any_value(nb.n) - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), c AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, c.component_id = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_chars=10, min_docs=2)
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), d AS (
  SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), m AS (
  SELECT k.*, d.key IS NOT NULL AND k.doc_id > d.first_doc AS dropped FROM k LEFT JOIN d ON k.key = d.key
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def op6_shard_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_by_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=16)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_streaming_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_file("piece_bpe_32k.model")
    coded = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return pieces.decode(coded, path).select(
        "doc_id", F.col("n_ids"), F.crc32("ids").alias("ids_crc32"), F.length("decoded").cast("long").alias("n_chars"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op8_pack_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file("word_bpe_49k.json"), window=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_back(*media.store(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op10_suffix_tree_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", langid.held_out(F.col("doc_id"), 5, 1).alias("held_out"))
    return lm.score(docs)


def op11_segment_popcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), ngram=3)


def op12_repair_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repairs(repair.damage(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))


def sql_crc32(text: str) -> str:
    """crc32 of an ASCII string, four bits at a time."""
    steps = []
    for x in range(16):
        for _ in range(4):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        steps.append(x)
    half = lambda x: f"xor(({steps})[({x} & 15) + 1], {x} >> 4)"
    return f"xor(list_reduce(list_concat([4294967295], list_transform(string_split({text}, ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda c, b: {half(half('xor(c, b)'))}), 4294967295)"


def _op12_sql() -> str:
    """The cheapest repair from every place and state, from the last row to the first, as (cost, audit, text)."""
    role = {0: "user", 1: "user", 2: "assistant", 3: "user"}
    to = {0: 2, 1: 2, 2: 3, 3: 2}
    edit = lambda p, cost, letter, said: f"{{'c': b.s{p}.c + {cost}, 'a': '{letter}' || b.s{p}.a, 't': {said}b.s{p}.t}}"
    raw = []
    for q in range(4):
        options = [edit(q, 2, "D", ""), f"CASE WHEN r.fault < 2 THEN {edit(to[q], '1 + 5 * r.fault', 'R', f'chr(10) || {chr(39)}{role[q]}:{chr(39)} || r.text || ')} END"]
        for x, p in (("s", 1), ("u", 2)) if q == 0 else (("a", 3),) if q == 2 else (("u", 2),):
            said = "chr(10) || r.role || ':' || r.text || "
            options.append(f"CASE WHEN r.fault < 2 AND r.x = '{x}' THEN {edit(p, '5 * r.fault', 'K', said)} END")
        raw.append(f"list_min([{', '.join(options)}]) AS s{q}")
    inserted = ", ".join(f"list_min([b.s{q}, {edit(to[q], 5, 'I', f'chr(10) || {chr(39)}{role[q]}:{chr(39)} || ')}]) AS s{q}" for q in range(4))
    close = lambda rows: f"(SELECT b.conv_id, b.i, {inserted} FROM {rows} AS b)"
    start = "(SELECT conv_id, n + 1 AS i, {'c': CAST(0 AS BIGINT), 'a': '', 't': ''} AS s0, {'c': CAST(99 AS BIGINT), 'a': '', 't': ''} AS s1, {'c': CAST(99 AS BIGINT), 'a': '', 't': ''} AS s2, {'c': CAST(0 AS BIGINT), 'a': '', 't': ''} AS s3 FROM sizes)"
    step = f"(SELECT b.conv_id, b.i - 1 AS i, {', '.join(raw)} FROM b JOIN r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i - 1)"
    return f"""
WITH RECURSIVE dice AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {sql_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS d
  FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
    CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM dice JOIN (VALUES (1), (2)) AS twice(copy) ON copy = 1 OR d = 3 WHERE d <> 0
), ordered AS (
  SELECT *, left(role, 1) AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged
), seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, lag(x) OVER (PARTITION BY conv_id ORDER BY i) AS x0 FROM ordered
), r AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 3 WHEN again THEN 2 WHEN regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 0 ELSE 1 END AS fault FROM seen
), sizes AS (
  SELECT conv_id, max(i) AS n, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (WHERE fault = 3) AS blank,
    count(*) FILTER (WHERE fault = 2) AS duplicate, count(*) FILTER (WHERE fault = 1) AS truncated,
    count(*) FILTER (WHERE i > 1 AND x0 || x NOT IN ('su', 'ua', 'au')) AS illegal
  FROM r GROUP BY conv_id
), b AS (
  SELECT * FROM {close(close(close(start)))} AS z
  UNION ALL SELECT * FROM {close(close(close(step)))} AS z
), ids AS (
  SELECT DISTINCT conv_id FROM conversations
)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(b.s0.c, 0) AS cost, coalesce(b.s0.a, '') AS audit, sha256(substr(coalesce(b.s0.t, ''), 2)) AS repaired_sha256
FROM ids LEFT JOIN sizes ON sizes.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM ids.conv_id AND b.i = 1
"""


OP12_SQL = _op12_sql()


def op13_family_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


OP13_SQL = f"""
WITH t AS (
  SELECT conv_id, list({{'h': md5(md5(coalesce(role, '')) || md5(coalesce(text, ''))), 'b': CAST(strlen(coalesce(text, '')) AS BIGINT)}}
    ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), h AS (
  SELECT *, {sql_crc32("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM t
), r AS (
  SELECT h.conv_id, list_concat(coalesce(base.turns[1:h.h], []), h.turns[h.h + 1:]) AS turns
  FROM h LEFT JOIN t AS base ON base.conv_id = h.conv_id - h.conv_id % 5
), p AS (
  SELECT conv_id, len(turns) AS len, d, md5(array_to_string(list_transform(turns[1:d], lambda x: x.h), '')) AS node,
    CASE WHEN d > 0 THEN md5(array_to_string(list_transform(turns[1:d - 1], lambda x: x.h), '')) END AS parent,
    CASE WHEN d > 0 THEN turns[d].b ELSE 0 END AS bytes
  FROM r, unnest(range(0, len(turns) + 1)) AS depths(d)
), n AS (
  SELECT node, any_value(parent) AS parent, CAST(any_value(d) AS BIGINT) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE d = len), '')) AS ends_sha256
  FROM p GROUP BY node
), c AS (
  SELECT parent, count(*) AS n_children FROM n GROUP BY parent
), k AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c ON c.parent = n.node
), s AS (
  SELECT above.node, count(*) FILTER (WHERE k.n_children = 0) AS n_leaves, CAST(sum((k.n_convs - 1) * k.bytes) AS BIGINT) AS saved_tokens
  FROM k JOIN p AS above ON above.conv_id = k.conv_id AND above.d <= k.depth GROUP BY above.node
)
SELECT k.conv_id, k.depth, up.conv_id AS parent_conv_id, k.n_convs, k.n_children, s.n_leaves, s.saved_tokens, k.ends_sha256
FROM k JOIN s USING (node) LEFT JOIN k AS up ON up.node = k.parent
"""


OPERATORS = (
    op1_rotated_bits, op2_chat_format, op3_language_id, op4_minhash_hamming, op5_line_dedup, op6_shard_balance, op7_streaming_pieces, op8_pack_windows,
    op9_media_chunks, op10_suffix_tree_score, op11_segment_popcount, op12_repair_layers, op13_family_trie,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_format": OP2_SQL, "op4_minhash_hamming": OP4_SQL, "op5_line_dedup": OP5_SQL, "op12_repair_layers": OP12_SQL, "op13_family_trie": OP13_SQL}
