"""Text scalars, quality flags, exact deduplication."""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import lexicon as X
from corpusloom.functions import text as T
from corpusloom.functions.dialect import DUCK, SPARK, Dialect, listed
from corpusloom.queries import query
from corpusloom.sources.tables import spread, table

LEAST, MOST = 80, 900


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source"))


D = "(SELECT doc_id, coalesce(text, '') AS text, lang, source FROM documents)"


def _marked(q: Dialect) -> str:
    """Texts in which every flag has its case, by doc_id: the table itself raises few of them."""
    capitals = "translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"
    cases = [
        "concat('Certainly! As an AI, ', text)", "concat(text, ' see https://a.example and www.b.example')", capitals, "concat(text, repeat(' 1234567890', 300))",
        "concat(text, repeat(' ?!;:', 400))", "concat('very very very very very ', text)", "concat(text, ' URL_12')", "concat('x1 ', repeat('zq wv ', 60))", "concat('<answer>', text)",
    ]
    return "CASE doc_id % 17 " + " ".join(f"WHEN {k} THEN {c}" for k, c in enumerate(cases)) + " ELSE text END"


M = f"(SELECT doc_id, {_marked(DUCK)} AS text, lang, source FROM {D})"


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).withColumn("text", F.expr(_marked(SPARK)))


def _words(q: Dialect) -> str:
    return q.found("text", X.WORD)


def hashed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text_hash", F.expr(T.text_hash(SPARK, "text")))


H = f"(SELECT *, {T.text_hash(DUCK, 'text')} AS text_hash FROM {D})"
EMPTY = sha256(b"").hexdigest()


def with_first(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """``rows`` and first_doc, the smallest id with their text_hash, where the hash repeats.

    Pass rows without their texts. Most hashes are those of one row and find no partner, so the side that is
    joined holds repeated texts only; a text that a third of all rows share is one row of it, and adaptive
    execution splits its partition.
    """
    first = rows.groupBy("text_hash").agg(F.min(key).alias("first_doc"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    return rows.join(first, "text_hash", "left")


def is_duplicate(key: str = "doc_id") -> Column:
    """Whether an earlier row has the text; empty texts never claim."""
    return F.coalesce((F.col("text_hash") != EMPTY) & (F.col(key) > F.col("first_doc")), F.lit(False))


@query(f"SELECT doc_id, text_hash, length(text)::BIGINT AS n_chars FROM {H}")
def text_hash_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashed(_docs(spark, sf_dir)).select("doc_id", "text_hash", F.length("text").cast("long").alias("n_chars"))


@query(f"SELECT text_hash, count(*)::BIGINT AS copies, min(doc_id) AS first_doc FROM {H} GROUP BY 1 HAVING count(*) > 1")
def exact_dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashed(_docs(spark, sf_dir)).groupBy("text_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).filter("copies > 1")


@query(f"""
SELECT doc_id, text_hash, CASE WHEN text_hash <> sha256('') AND doc_id > first_doc THEN true ELSE false END AS exact_duplicate
FROM {H} JOIN (SELECT text_hash, min(doc_id) AS first_doc FROM {H} GROUP BY 1) USING (text_hash)""")
def dedup_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document with a text claims its hash, also if it is rejected later; empty texts never claim."""
    rows = hashed(_docs(spark, sf_dir)).select("doc_id", "text_hash")
    return with_first(rows).select("doc_id", "text_hash", is_duplicate().alias("exact_duplicate"))


def _three(q: Dialect) -> dict[str, str]:
    return {
        "doc_id": "doc_id", "words_regex": f"cast({q.size(_words(q))} AS bigint)", "words_nonspace": f"cast({q.count('text', T.SOME_TEXT)} AS bigint)",
        "words_split": f"cast({q.size(q.found(T.collapse(q, 'text'), '[^ ]+'))} AS bigint)",
    }


@query(f"SELECT {listed(_three(DUCK))} FROM {D}")
def word_counts_three_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen(_docs(spark, sf_dir), _three(SPARK))


def chosen(df: DataFrame, expressions: dict[str, str]) -> DataFrame:
    return df.select(*(F.expr(v).alias(k) for k, v in expressions.items()))


def _style(q: Dialect) -> dict[str, str]:
    """Counts as integers, ratios rounded."""
    return {"doc_id": "doc_id"} | {k: f"cast({v} AS bigint)" if i < 8 else f"round({v}, 6)" for i, (k, v) in enumerate(T.style(q, "text", "w").items())}


@query(f"SELECT {listed(_style(DUCK))} FROM (SELECT *, {DUCK.found('text', X.TOK_WORD)} AS w FROM {D})")
def style_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen(_docs(spark, sf_dir).withColumn("w", F.expr(SPARK.found("text", X.TOK_WORD))), _style(SPARK))


def _flags(q: Dialect, flags) -> dict[str, str]:
    return {"doc_id": "doc_id"} | flags(q, "text", "w")


W_DUCK = f"(SELECT *, {_words(DUCK)} AS w FROM {M})"


def worded(docs: DataFrame) -> DataFrame:
    return docs.withColumn("w", F.expr(_words(SPARK)))


@query(f"SELECT {listed(_flags(DUCK, T.flags_v1))} FROM {W_DUCK}")
def quality_flags_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen(worded(marked(spark, sf_dir)), _flags(SPARK, T.flags_v1))


@query(f"SELECT {listed(_flags(DUCK, T.flags_v2))} FROM {W_DUCK}")
def quality_flags_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen(worded(marked(spark, sf_dir)), _flags(SPARK, T.flags_v2))


def _reasons(q: Dialect, flags) -> str:
    return T.reasons(q, "text", "w", flags(q, "text", "w"), LEAST, MOST)


def validated(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, text_hash, word_count, text_preview, reasons (joined by commas, duplicates of an earlier document included)."""
    rows = hashed(worded(docs)).select("doc_id", "lang", "source", "text_hash", F.size("w").cast("long").alias("word_count"), F.substring("text", 1, 300).alias("text_preview"), F.expr(_reasons(SPARK, T.flags_v2)).alias("own"))
    return with_first(rows).withColumn("reasons", F.concat_ws(",", F.when(F.col("own") != "", F.col("own")), F.when(is_duplicate(), "exact_duplicate"))).drop("own", "first_doc")


V = f"""(SELECT doc_id, text, lang, source, r.text_hash, word_count, concat_ws(',', nullif(own, ''), CASE WHEN r.text_hash <> sha256('') AND doc_id > first_doc THEN 'exact_duplicate' END) AS reasons
FROM (SELECT *, {T.text_hash(DUCK, 'text')} AS text_hash, len(w)::BIGINT AS word_count, {_reasons(DUCK, T.flags_v2)} AS own FROM {W_DUCK}) r
JOIN (SELECT text_hash, min(doc_id) AS first_doc FROM (SELECT doc_id, {T.text_hash(DUCK, 'text')} AS text_hash FROM {M}) GROUP BY 1) f ON f.text_hash = r.text_hash)"""


@query(f"SELECT doc_id, {_reasons(DUCK, T.flags_v1)} AS reasons FROM {W_DUCK}")
def reject_reasons_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worded(marked(spark, sf_dir)).select("doc_id", F.expr(_reasons(SPARK, T.flags_v1)).alias("reasons"))


@query(f"SELECT doc_id, text_hash, word_count, reasons, reasons = '' AS accepted, substr(text, 1, 300) AS text_preview FROM {V}")
def reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validated(marked(spark, sf_dir)).select("doc_id", "text_hash", "word_count", "reasons", (F.col("reasons") == "").alias("accepted"), "text_preview")


@query(f"SELECT reason, count(*)::BIGINT AS n FROM (SELECT unnest(string_split(reasons, ',')) AS reason FROM {V} WHERE reasons <> '') GROUP BY 1")
def reason_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validated(marked(spark, sf_dir)).filter("reasons <> ''").select(F.explode(F.split("reasons", ",")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"SELECT source, count(*) FILTER (reasons = '')::BIGINT AS kept, count(*) FILTER (reasons <> '')::BIGINT AS rejected FROM {V} GROUP BY 1")
def acceptance_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validated(marked(spark, sf_dir)).groupBy("source").agg(F.count_if(F.col("reasons") == "").alias("kept"), F.count_if(F.col("reasons") != "").alias("rejected"))


def _clean(q: Dialect) -> dict[str, str]:
    tags = "replace(replace(text, '<answer>', ' '), '<end_answer>', ' ')"
    return {"doc_id": "doc_id", "clean": T.collapse(q, tags), "source_token": q.sub("lower(trim(source))", "[^a-z0-9_./:+-]", "_")}


@query(f"SELECT {listed(_clean(DUCK))} FROM {M}")
def cleaned_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen(marked(spark, sf_dir), _clean(SPARK))


@query("""
SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)), '^www\\.', '') AS host,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(url, '^[^?#]*')), '([?&])(utm_[^&#]*|gclid=[^&#]*|fbclid=[^&#]*)', '\\1', 'g'), '[?&]+$', ''), '^http:', 'https:'), '/+$', '') AS canonical,
  'objects/sha256/' || substr(sha256(coalesce(html, '')), 1, 2) || '/' || substr(sha256(coalesce(html, '')), 3, 2) || '/' || sha256(coalesce(html, '')) AS object_key,
  sha256(coalesce(url, '') || chr(1) || coalesce(html, '')) AS snapshot_id
FROM pages""")
def page_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, canonical address, content-addressed object key and snapshot id of each page."""
    bare = F.lower(F.regexp_extract("url", "^[^?#]*", 0))
    canonical = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"([?&])(utm_[^&#]*|gclid=[^&#]*|fbclid=[^&#]*)", "$1"), r"[?&]+$", ""), "^http:", "https:"), "/+$", "")
    html = F.coalesce("html", F.lit(""))
    h = F.sha2(html, 256)
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.regexp_replace(F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/:?#]+)", 1)), r"^www\.", "").alias("host"),
        canonical.alias("canonical"),
        F.concat(F.lit("objects/sha256/"), F.substring(h, 1, 2), F.lit("/"), F.substring(h, 3, 2), F.lit("/"), h).alias("object_key"),
        F.sha2(F.concat(F.coalesce("url", F.lit("")), F.lit("\x01"), html), 256).alias("snapshot_id"),
    )


@query("""
WITH b AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS block FROM documents),
r AS (SELECT source, sha256(block) AS h, count(*) AS n FROM b WHERE block <> '' GROUP BY ALL)
SELECT source, count(*) FILTER (n > 1)::BIGINT AS repeated_blocks, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS repeated_rows, count(*)::BIGINT AS blocks FROM r GROUP BY 1""")
def repeated_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line blocks that repeat within a source."""
    b = table(spark, sf_dir, "documents").select("source", F.explode_outer(F.split("text", "\n")).alias("block")).filter("block <> ''")
    r = b.groupBy("source", F.sha2("block", 256).alias("h")).agg(F.count("*").alias("n"))
    many = F.col("n") > 1
    return r.groupBy("source").agg(F.count_if(many).alias("repeated_blocks"), F.coalesce(F.sum(F.when(many, F.col("n"))), F.lit(0)).alias("repeated_rows"), F.count("*").alias("blocks"))


