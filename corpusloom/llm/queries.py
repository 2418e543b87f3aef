"""One query for each operator of this subpackage, over whole tables, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import chat, decontam, jaccard, langid, packing, pii, substring, tokens, topk, warc
from corpusloom.llm.common import LOWER, UPPER, Scratch, table

#: A conversation whose texts hold the template's own marks.
MARKS = r"\### Assistant: </turn> ok"


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(table(spark, sf_dir, "documents")))


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "tokens").path("dataset")
    tokens.write(table(spark, sf_dir, "documents"), path)
    return tokens.digest(tokens.read(spark, path))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "warc").path("archives")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = langid.predict(docs.select("doc_id", "text"), langid.fit(langid.learnable(docs)), ["doc_id"])
    return got.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(substring.dedup(table(spark, sf_dir, "documents")))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = spark.createDataFrame([(-7, 0, "user", MARKS), (-7, 1, "assistant", MARKS)], "conv_id long, turn long, role string, text string")
    scratch = Scratch(spark, "chat")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return chat.digest(scratch.save(chat.format_turns(rows.union(marks)), "segments"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_packing, op2_token_output, op3_warc, op4_decontamination, op5_pii, op6_topk, op7_language, op8_substring_dedup, op9_jaccard_join, op10_chat)
    return {f.__name__: f for f in ops}


def _base32(hexed: str) -> str:
    group = lambda i: f"('0x' || substr({hexed}, {5 * i + 1}, 5))::INT"
    return " || ".join(f"substr('{warc.BASE32}', (({group(i)} >> {s}) & 31) + 1, 1)" for i in range(8) for s in (15, 10, 5, 0))


OP3 = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first_id FROM p GROUP BY h)
SELECT page_id, payload_bytes, {_base32("h")} AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM p JOIN f USING (h)"""

_AZ = f"'{UPPER}', '{LOWER}'"
OP4 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS s FROM b WHERE len(w) > 0),
v AS (SELECT DISTINCT item_id, array_to_string(w[s:s + 9], ' ') AS win, len(w[s:s + 9]) AS n FROM i),
sizes AS (SELECT DISTINCT n FROM v),
o AS (SELECT doc_id, w, n, unnest(range(1, greatest(1, len(w) - n + 2))) AS s FROM d, sizes),
k AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS win FROM o),
m AS (SELECT doc_id, item_id, s, k.n FROM k JOIN v ON k.win = v.win AND k.n = v.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""


def _pii_sql() -> str:
    """Pieces between matches and matches in turn give the positions; plain patterns, without look-around."""
    local, digits = r"[A-Za-z0-9._%+-]", "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(reverse({digits}), i, 1)::INT ELSE (substr(reverse({digits}), i, 1)::INT * 2) // 10 + (substr(reverse({digits}), i, 1)::INT * 2) % 10 END)) % 10 = 0"
    turned = "(substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4))"
    mod97 = f"list_reduce(list_prepend(0::BIGINT, list_transform(string_split({turned}, ''), lambda c: CASE WHEN c <= '9' THEN c::BIGINT ELSE ascii(c) - 55 END)), lambda a, x: CASE WHEN x > 9 THEN (a * 100 + x) % 97 ELSE (a * 10 + x) % 97 END) = 1"
    confirm = {
        "email": "true",
        "ip": "list_bool_and(list_transform(string_split(m, '.'), lambda p: length(ltrim(p, '0')) < 4 AND coalesce(try_cast(ltrim(p, '0') AS INT), 0) <= 255))",
        "card": f"length({digits}) BETWEEN 14 AND 19 AND {luhn}",
        "phone": f"length({digits}) BETWEEN 10 AND 15",
        "iban": mod97,
        "national_id": rf"NOT regexp_matches(m, '^(?:000|666|9)|-00-|-0000$') AND regexp_matches(lower(right(g, 40)), '(?:^|[^a-z])(?:{pii.SCORES['national_id'][2]})(?:[^a-z]|$)')",
        "secret": rf"regexp_matches(m, '[0-9]') AND regexp_matches(m, '[a-f]') AND regexp_matches(lower(right(g, 40)), '(?:^|[^a-z])(?:{pii.SCORES['secret'][2]})(?:[^a-z]|$)')",
        "api_key": "true",
    }
    plain = {
        "email": rf"{local}+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b",
        "national_id": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
        "secret": r"\b(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})\b",
        "api_key": r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64})\b",
    }
    kinds = []
    for rank, kind in enumerate(pii.KINDS):
        gaps, found = f"string_split_regex(t, '{plain[kind]}')", f"regexp_extract_all(t, '{plain[kind]}')"
        kinds.append(f"""
k{rank} AS (SELECT doc_id, {gaps} AS gs, {found} AS ms FROM d),
m{rank} AS (SELECT doc_id, {rank} AS rank, i, gs[i] AS g, ms[i] AS m, list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS s
  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM k{rank} WHERE len(ms) > 0)),
s{rank} AS (SELECT doc_id, rank, s, '{kind}:' || s::BIGINT || ':' || (s + length(m))::BIGINT AS span FROM m{rank} WHERE {confirm[kind]})""")
    every = " UNION ALL ".join(f"SELECT * FROM s{r}" for r in range(len(pii.KINDS)))
    counts = ", ".join(f"coalesce(n{r}, 0)::BIGINT AS n_{pii.KINDS[r]}" for r in range(4))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),{",".join(kinds)},
a AS (SELECT doc_id, {", ".join(f"count(*) FILTER (rank = {r}) AS n{r}" for r in range(4))},
  string_agg(span, ',' ORDER BY s, rank) FILTER (rank < 4) AS base, string_agg(span, ',' ORDER BY s, rank) AS spans FROM ({every}) GROUP BY doc_id)
SELECT doc_id, {counts}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (doc_id)"""


OP6 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""

OP8 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT win, min(doc_id) AS first_doc FROM k GROUP BY win),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM k JOIN f USING (win) WHERE first_doc < doc_id),
l AS (SELECT doc_id, list(p) AS gone FROM g GROUP BY doc_id),
e AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d WHERE len(w) > 0),
t AS (SELECT e.doc_id, string_agg(w[e.p], ' ' ORDER BY e.p) AS kept FROM e LEFT JOIN g ON e.doc_id = g.doc_id AND e.p = g.p WHERE g.p IS NULL GROUP BY e.doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN l USING (doc_id) LEFT JOIN t USING (doc_id)"""

OP9 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY a) USING (doc_id)"""

_EXTRA = r"(length({0}) - length(replace({0}, '\', ''))) + coalesce(list_sum(list_transform(regexp_extract_all({0}, '###+'), lambda x: length(x) - 2)), 0) + len(regexp_extract_all({0}, '</turn>')) + len(regexp_extract_all({0}, '<\|'))"
OP10 = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{MARKS}' UNION ALL SELECT -7, 1, 'assistant', '{MARKS}')
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(chat.OPEN) + 2 + len(chat.CLOSE)} + length(role) + {_EXTRA.format("role")} + (length(role) - length(replace(role, ':', ''))) + length(text) + {_EXTRA.format("text")})::BIGINT AS formatted_chars
FROM c GROUP BY conv_id"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_warc": OP3, "op4_decontamination": OP4, "op5_pii": _pii_sql(), "op6_topk": OP6,
        "op8_substring_dedup": OP8, "op9_jaccard_join": OP9, "op10_chat": OP10,
    }
