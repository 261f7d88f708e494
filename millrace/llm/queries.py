"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, embedding_dup, filter_audit, fingerprints, lm_scoring, mixing, near_dup, packing, pfor, pii, repair, toxicity, url_filter
from ._common import table

#: Labels of this fold (crc32 of the id's text, mod 4) are never learnt from.
FOLDS, HELD_FOLD = 4, 2


def held_out(folds: int = FOLDS, fold: int = HELD_FOLD):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False))


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfor.token_id_round_trip(table(spark, sf_dir, "documents"), end=1)


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Besides the dealt columns: limit, the threshold of the document's language, and whether the score reaches it."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model, limits = toxicity.fit(documents, labels.where(~held_out()))
    scored = toxicity.with_scores(documents.select("doc_id", "text", "lang"), model, keep=["doc_id", "lang"])
    predicted = (F.col("score") >= toxicity.CUT).cast("int").alias("predicted")
    limit = toxicity.limit_of(F.col("lang"), limits).alias("limit")
    return scored.select("doc_id", held_out().alias("held_out"), "score", predicted, limit, toxicity.toxic_flag(F.col("score"), F.col("lang"), limits).alias("toxic_by_lang"))


def op5_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dup.linked_vectors(table(spark, sf_dir, "embeddings"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_with_crc(table(spark, sf_dir, "documents"), end=2)


#: A conversation of control strings that op7 formats beside the table's own.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text")
    own = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL_TEXT).alias("text"),
    )
    return chat.chat_round_trip(given.unionByName(own))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


#: The key of the registered query alone; a user's own key is secret and comes from the user.
PII_KEY = "key of the registered query"


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_pii(table(spark, sf_dir, "documents"), PII_KEY)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(table(spark, sf_dir, "documents"))


#: (verdict, host, path)
URL_RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"),
]


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Besides the dealt columns: hits of strict and soft terms, different soft terms, and the weight of all hits."""
    return url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_conversations(repair.damaged(table(spark, sf_dir, "conversations")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_fingerprints, op2_token_ids, op3_near_duplicates, op4_toxicity, op5_embedding_links, op6_packing, op7_chat,
        op8_mixing, op9_pii, op10_lm_scoring, op11_url_filter, op12_filter_audit, op13_conversation_repair,
    )
    return {f.__name__: f for f in own}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _escaped_sql(value: str) -> str:
    for i, c in enumerate(chat.CONTROLS):
        value = f"replace({value}, {_quoted(c)}, {_quoted(f'{chat.ESCAPE}{i};')})"
    return value


OP7_SQL = f"""
WITH given AS (
    SELECT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL
    UNION ALL SELECT -1, 0, 'user', {_quoted(CONTROL_TEXT)}
    UNION ALL SELECT -1, 1, 'assistant', {_quoted(CONTROL_TEXT)}
), turns AS (
    SELECT conv_id, turn, role, coalesce(role, '') AS r, coalesce(text, '') AS t,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos
    FROM given
)
SELECT conv_id,
       count(*) AS n_turns,
       sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY pos)) AS turns_sha256,
       coalesce(sum(length(t)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(t, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum({len(chat.START) + 1 + len(chat.END)} + length(replace({_escaped_sql("r")}, chr(10), {_quoted(chat.ESCAPE + "n;")}))
           + length({_escaped_sql("t")}))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""


def _values(rows) -> str:
    cell = lambda v: "NULL" if v is None else _quoted(v) if isinstance(v, str) else str(v)
    return "VALUES " + ", ".join(f"({', '.join(map(cell, row))})" for row in rows)


OP11_SQL = rf"""
WITH term(kind, term, weight) AS ({_values([("strict", *t) for t in url_filter.STRICT] + [("soft", *t) for t in url_filter.SOFT])}),
rule(verdict, host, path) AS ({_values(URL_RULES)}),
cut AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
    SELECT page_id, row_number() OVER () AS row_no, regexp_extract(rest, '^[^/?#]*') AS raw_host, rest,
           '-' || replace(regexp_replace(translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\p{{L}}\p{{N}}]+', '-', 'g'), '-', '--') || '-' AS words
    FROM cut
), judged AS (
    SELECT page_id, row_no, words, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path
    FROM parts
), best AS (
    SELECT j.row_no, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
    FROM judged j JOIN rule r ON (j.host = r.host OR ends_with(j.host, '.' || r.host)) AND starts_with(j.path, r.path) GROUP BY 1
), found AS (
    SELECT j.row_no, t.kind, t.term, t.weight, len(regexp_extract_all(j.words, '-' || replace(t.term, '-', '--') || '-')) AS n
    FROM judged j JOIN term t ON contains(j.words, '-' || replace(t.term, '-', '--') || '-')
), hits AS (
    SELECT row_no, coalesce(sum(n) FILTER (kind = 'strict'), 0)::BIGINT AS strict_hits, coalesce(sum(n) FILTER (kind = 'soft'), 0)::BIGINT AS soft_hits,
           count(*) FILTER (kind = 'soft')::BIGINT AS soft_terms, sum(n * weight)::BIGINT AS weight
    FROM found GROUP BY 1
)
SELECT page_id, host, path, rule,
       coalesce(b.verdict, CASE WHEN coalesce(strict_hits, 0) > 0 OR coalesce(soft_terms, 0) >= {url_filter.MIN_SOFT} THEN 'block' ELSE 'allow' END) AS verdict,
       coalesce(strict_hits, 0) AS strict_hits, coalesce(soft_hits, 0) AS soft_hits, coalesce(soft_terms, 0) AS soft_terms, coalesce(weight, 0) AS weight
FROM judged j LEFT JOIN best b USING (row_no) LEFT JOIN hits h USING (row_no)
"""

OP12_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
split AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first_id FROM texts),
known AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY 1),
failing AS (
    SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
           concat(CASE WHEN len(words) < 200 THEN 'A' ELSE '' END,
                  CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END,
                  CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' ELSE '' END,
                  CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END,
                  CASE WHEN coalesce(doc_id > first_id, false) THEN 'E' ELSE '' END) AS fails
    FROM split LEFT JOIN known USING (doc_id)
), sums AS (
    SELECT part, fails, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM failing GROUP BY ALL
), letter(f) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
    SELECT concat(a.f, b.f, c.f, d.f, e.f) AS filter_order FROM letter a, letter b, letter c, letter d, letter e
    WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps AS (
    SELECT filter_order, step::INT AS step, substr(filter_order, step::INT, 1) AS f, substr(filter_order, 1, step::INT - 1) AS before
    FROM orders, range(1, 6) r(step)
), removals AS (
    SELECT part, filter_order, step, f,
           coalesce(sum(n) FILTER (NOT gone AND NOT fail), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fail AND NOT gone), 0)::BIGINT AS removed,
           coalesce(sum(n) FILTER (fail AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = f), 0)::BIGINT AS unique_fails,
           coalesce(sum(good) FILTER (fail AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (fail AND NOT gone), 0)::BIGINT AS toxic_lost
    FROM (SELECT *, contains(fails, f) AS fail, fails <> '' AND translate(fails, before, '') <> fails AS gone FROM sums, steps) GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM removals
"""

#: (state, fault symbols allowed, initial asked for or null, edits, new role or null for the own one, inserted roles, next state, cost)
_MOVES = [
    (state, edits, None if edits == "D" else "s" if to == repair.SYSTEM else repair.NEEDS[to_before], None if edits[-1] != "R" else repair.ROLES[repair.NEEDS[to_before]],
     repair.ROLES[repair.NEEDS[state]] + ":" if edits[0] == "I" else None, to, cost)
    for state in range(4)
    for edits, to_before, to, cost in [
        ("D", state, state, repair.DELETE),
        *([("K", state, repair.SYSTEM, repair.KEEP)] if state == repair.START else []),
        *[(lead + last, at, repair.AFTER[repair.NEEDS[at]], price + more)
          for lead, at, price in (("", state, 0), ("I", repair.AFTER[repair.NEEDS[state]], repair.INSERT))
          for last, more in (("K", repair.KEEP), ("R", repair.REROLE))],
    ]
]
_ENDS = [(state, "I" * n, (None, "assistant:", "user:\nassistant:")[n], repair.INSERT * n) for state, n in repair.ENDING.items()]

OP13_SQL = rf"""
WITH RECURSIVE keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT)),
               lambda c, x: list_reduce(list_prepend(xor(c, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda a, b: xor(a >> 1, 3988292384 * (a & 1)))) AS crc
    FROM conversations
), hurt AS (
    SELECT conv_id, turn, xor(crc, 4294967295) % 20 AS kind, role, text FROM keyed
), lines AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
           CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM hurt, range(2) c(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS pos,
           regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last FROM lines
), faulty AS (
    SELECT conv_id, turn, role, text, pos, substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before,
           CASE WHEN last = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
                WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
    FROM placed
), move(state, edits, initial, role, lead, next, cost) AS ({_values(_MOVES)}),
tail(state, edits, lines, cost) AS ({_values(_ENDS)}),
best AS (
    SELECT DISTINCT conv_id, 0::BIGINT AS pos, 0 AS state, {{'cost': 0::BIGINT, 'audit': '', 'lines': NULL::VARCHAR}} AS way FROM conversations
    UNION ALL
    SELECT b.conv_id, f.pos, m.next AS state,
           min({{'cost': b.way.cost + m.cost + CASE WHEN f.fault = 'truncated' AND m.edits <> 'D' THEN {repair.TRUNCATED} ELSE 0 END, 'audit': b.way.audit || m.edits,
                 'lines': CASE WHEN m.edits = 'D' THEN b.way.lines ELSE concat_ws(chr(10), b.way.lines, m.lead, coalesce(m.role, f.role) || ':' || f.text) END}}) AS way
    FROM best b JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.pos = b.pos + 1 JOIN move m ON m.state = b.state
    WHERE (m.edits = 'D' OR f.fault NOT IN ('blank', 'duplicate')) AND (m.initial IS NULL OR m.role IS NOT NULL OR m.initial = f.initial)
    GROUP BY 1, 2, 3
), done AS (
    SELECT b.conv_id, min({{'cost': b.way.cost + t.cost, 'audit': b.way.audit || t.edits, 'lines': concat_ws(chr(10), b.way.lines, t.lines)}}) AS way
    FROM best b JOIN tail t ON t.state = b.state
    WHERE b.pos = (SELECT count(*) FROM lines l WHERE l.conv_id IS NOT DISTINCT FROM b.conv_id) GROUP BY 1
), counted AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count_if(fault = 'blank') AS blank, count_if(fault = 'duplicate') AS duplicate,
           count_if(fault = 'truncated') AS truncated, count_if(before IS NOT NULL AND (before || initial) NOT IN ('su', 'ua', 'au')) AS illegal
    FROM faulty GROUP BY 1
)
SELECT d.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
       d.way.cost::BIGINT AS cost, d.way.audit AS audit, sha256(coalesce(d.way.lines, '')) AS repaired_sha256
FROM done d LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM d.conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_chat": OP7_SQL, "op11_url_filter": OP11_SQL, "op12_filter_audit": OP12_SQL, "op13_conversation_repair": OP13_SQL}
