"""Splits, caps and samples over documents with a class (labels.quality)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpusloom.functions import text as T
from corpusloom.functions.dialect import DUCK
from corpusloom.operators import sampling as S
from corpusloom.plans.text import V, hashed, marked, validated
from corpusloom.queries import query
from corpusloom.sources.tables import spread, table

L = f"""(SELECT d.doc_id, d.lang, d.source, d.text, {T.text_hash(DUCK, 'd.text')} AS text_hash, l.quality::INT AS label
FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"""
B = T.bucket(DUCK, "text_hash")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a class; the labels' side is read with the two columns it gives."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("label"))
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))
    return hashed(docs.join(labels, "doc_id"))


@query(f"SELECT doc_id, text_hash, CASE WHEN {B} < 0.25 THEN 'test' ELSE 'train' END AS split FROM {L}")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.hash_split(labelled(spark, sf_dir), 0.25).select("doc_id", "text_hash", "split")


@query(f"SELECT doc_id, text_hash, CASE WHEN {T.bucket(DUCK, 'sha256(text_hash)')} < 0.25 THEN 'test' ELSE 'train' END AS split FROM {L}")
def hash_split_double(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.hash_split(labelled(spark, sf_dir), 0.25, "sha2(text_hash, 256)").select("doc_id", "text_hash", "split")


@query(f"""
WITH s AS (SELECT text_hash, CASE WHEN {T.bucket(DUCK, "sha256(doc_id::VARCHAR)")} < 0.25 THEN 'test' ELSE 'train' END AS split FROM {L}),
g AS (SELECT text_hash, count(*) AS n, count(DISTINCT split) AS splits FROM s GROUP BY 1)
SELECT count(*)::BIGINT AS hashes, count(*) FILTER (splits > 1)::BIGINT AS leaked, count(*) FILTER (n > 1)::BIGINT AS duplicated FROM g""")
def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes that a split by id, not by text, would put on both sides."""
    rows = S.hash_split(labelled(spark, sf_dir).withColumn("id_hash", F.sha2(F.col("doc_id").cast("string"), 256)), 0.25, "id_hash")
    g = rows.groupBy("text_hash").agg(F.count("*").alias("n"), F.count_distinct("split").alias("splits"))
    return g.agg(F.count("*").alias("hashes"), F.count_if(F.col("splits") > 1).alias("leaked"), F.count_if(F.col("n") > 1).alias("duplicated"))


@query(f"""
WITH a AS (SELECT *, source IN ('src0', 'src1', 'src2') AS side FROM {L}),
n AS (SELECT count(*) FILTER (side) AS na, count(*) FILTER (NOT side) AS ne FROM a),
c AS (SELECT CASE WHEN na > ne * 0.1 THEN greatest(1, floor(ne * 0.1)) ELSE na END AS ca, CASE WHEN ne > na / 0.1 THEN greatest(1, floor(na / 0.1)) ELSE ne END AS ce FROM n)
SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY text_hash, doc_id) AS p FROM a) r, c WHERE p <= CASE WHEN side THEN ca ELSE ce END""")
def source_ratio_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.source_ratio(labelled(spark, sf_dir).drop("text", "lang"), F.col("source").isin("src0", "src1", "src2"), 0.1).select("doc_id", "source")


@query(f"""
WITH n AS (SELECT min(c) AS least FROM (SELECT label, count(*) AS c FROM {L} GROUP BY 1))
SELECT doc_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY text_hash, doc_id) AS p FROM {L}) r, n WHERE p <= least""")
def label_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.label_balance(labelled(spark, sf_dir).select("doc_id", "label", "text_hash")).select("doc_id", "label")


@query(f"""
WITH r AS (SELECT *, CASE WHEN p <= CASE WHEN label = 1 THEN 50 ELSE 50 END THEN 0 ELSE 1 END AS rest
  FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY text_hash, doc_id) AS p FROM {L}))
SELECT doc_id, label FROM r ORDER BY rest, text_hash, doc_id LIMIT 100""")
def fixed_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.fixed_sample(labelled(spark, sf_dir).select("doc_id", "label", "text_hash"), 100).select("doc_id", "label")


@query(f"""
SELECT doc_id, lang, label, CASE WHEN p <= CASE WHEN n > 1 THEN greatest(1, round_even(n * 0.25, 0)) ELSE 0 END THEN 'test' ELSE 'train' END AS split
FROM (SELECT *, count(*) OVER (PARTITION BY lang, label) AS n, row_number() OVER (PARTITION BY lang, label ORDER BY sha256(doc_id::VARCHAR), doc_id) AS p FROM {L})""")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir).select("doc_id", "lang", "label", F.sha2(F.col("doc_id").cast("string"), 256).alias("key_hash"))
    return S.stratified_split(rows, ["lang", "label"], 0.25).select("doc_id", "lang", "label", "split")


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS p FROM documents) WHERE p <= 20")
def per_source_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In arrival order; Spark cuts to the limit before the shuffle (WindowGroupLimit)."""
    place = F.row_number().over(W.partitionBy("source").orderBy("doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id", "source").withColumn("p", place).filter("p <= 20").select("doc_id", "source")


@query(f"SELECT doc_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY doc_id) AS p FROM {L}) WHERE p <= greatest(1, 61 // 2)")
def per_label_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(W.partitionBy("label").orderBy("doc_id"))
    return labelled(spark, sf_dir).select("doc_id", "label").withColumn("p", place).filter(F.col("p") <= max(1, 61 // 2)).select("doc_id", "label")


DEF = f"""(WITH r AS (SELECT *, count(*) OVER (PARTITION BY label) AS n, row_number() OVER (PARTITION BY label ORDER BY text_hash, doc_id) AS p FROM {L}),
m AS (SELECT DISTINCT text_hash FROM r WHERE p <= least(round_even(n * 0.25, 0), 60))
SELECT doc_id, label, source, text_hash, CASE WHEN text_hash IN (SELECT text_hash FROM m) THEN 'train' ELSE 'holdout' END AS role FROM {L})"""


@query(f"SELECT doc_id, label, role FROM {DEF}")
def defensive_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.defensive_split(labelled(spark, sf_dir), 0.25, 60).select("doc_id", "label", "role")


@query(f"SELECT label, role, count(*)::BIGINT AS n, count(DISTINCT source)::BIGINT AS sources FROM {DEF} GROUP BY ALL")
def defensive_split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.defensive_split(labelled(spark, sf_dir), 0.25, 60).groupBy("label", "role").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"))


@query(f"""
WITH n AS (SELECT least(count(*) FILTER (label = 0), count(*) FILTER (label = 1)) AS k FROM {L})
SELECT doc_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sha256(doc_id::VARCHAR || ':13'), doc_id) AS p FROM {L}) r, n WHERE p <= least(k, 30)""")
def seeded_balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 30 of each label, and no more than the rarer has; a task passes on 30 of a label."""
    rows = labelled(spark, sf_dir).select("doc_id", "label", F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit(":13")), 256).alias("key_hash"))
    least = rows.agg(F.least(F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1)).alias("k"))
    place = F.row_number().over(W.partitionBy("label").orderBy("key_hash", "doc_id"))
    return rows.withColumn("p", place).filter("p <= 30").join(F.broadcast(least)).filter("p <= k").select("doc_id", "label")


@query(f"""
WITH a AS (SELECT v.*, l.quality::INT AS label FROM {V} v JOIN labels l USING (doc_id) WHERE reasons = ''),
n AS (SELECT min(c) AS least FROM (SELECT label, count(*) AS c FROM a GROUP BY 1)),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY text_hash, doc_id) AS p FROM a) r, n WHERE p <= least)
SELECT label, CASE WHEN {B} < 0.25 THEN 'test' ELSE 'train' END AS split, count(*)::BIGINT AS n, sum(word_count)::BIGINT AS words FROM s GROUP BY ALL""")
def corpus_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The build end to end: validate, deduplicate, balance, split by the same hash order."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("label"))
    accepted = validated(marked(spark, sf_dir)).filter("reasons = ''").select("doc_id", "text_hash", "word_count").join(labels, "doc_id")
    return S.hash_split(S.label_balance(accepted), 0.25).groupBy("label", "split").agg(F.count("*").alias("n"), F.sum("word_count").alias("words"))
