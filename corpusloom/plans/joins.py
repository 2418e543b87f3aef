"""Joins, lookups, set operations, near duplicates of texts, interval pairs and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpusloom.functions import text as T
from corpusloom.functions.dialect import DUCK
from corpusloom.operators.near import linked, near_links
from corpusloom.plans.text import hashed
from corpusloom.queries import query
from corpusloom.sources.tables import table


@query("""
SELECT l.doc_id, quality::INT AS quality, coalesce(trim(text), '') = '' AS missing, length(coalesce(text, ''))::BIGINT AS chars FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id""")
def text_lookup_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of the whole documents table looked up for rows; a miss and a blank text both count as missing."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    j = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("quality")).join(d, "doc_id", "left")
    text = F.coalesce("text", F.lit(""))
    return j.select("doc_id", "quality", (F.trim(text) == "").alias("missing"), F.length(text).cast("long").alias("chars"))


@query("""
WITH f AS (SELECT doc_id // 3 AS key, text, 0 AS rank, doc_id AS ord FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id // 3, text, 1, doc_id FROM documents WHERE lang <> 'en')
SELECT key, sha256(text) AS h, rank::INT AS file_rank FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY rank, ord) AS p FROM f) WHERE p = 1""")
def first_wins_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The build side of a lookup from several files: the first file, then the first row, wins. A minimum, not a sort of each group."""
    d = table(spark, sf_dir, "documents").filter("lang is not null")
    rows = d.select(F.floor(F.col("doc_id") / 3).cast("long").alias("key"), F.when(F.col("lang") == "en", 0).otherwise(1).alias("file_rank"), "doc_id", F.sha2("text", 256).alias("h"))
    best = rows.groupBy("key").agg(F.min(F.struct("file_rank", "doc_id", "h")).alias("b"))
    return best.select("key", "b.h", F.col("b.file_rank").cast("int").alias("file_rank"))


_B = f"(SELECT item_id, {T.text_hash(DUCK, 'text')} AS text_hash FROM benchmark)"
_D = f"(SELECT doc_id, source, {T.text_hash(DUCK, 'text')} AS text_hash FROM documents)"


@query(f"""
WITH a AS (SELECT text_hash, count(*) AS n, min(doc_id) AS example FROM {_D} WHERE doc_id % 4 <> 0 GROUP BY 1), b AS (SELECT text_hash, count(*) AS n, min(doc_id) AS example FROM {_D} WHERE doc_id % 4 = 0 GROUP BY 1)
SELECT text_hash, a.n::BIGINT AS train_rows, b.n::BIGINT AS eval_rows, a.example AS train_id, b.example AS eval_id FROM a JOIN b USING (text_hash) ORDER BY text_hash LIMIT 10""")
def leakage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts on both sides of a split, with examples: each side is grouped before the join."""
    h = hashed(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text_hash")
    side = lambda cond, name: h.filter(cond).groupBy("text_hash").agg(F.count("*").alias(f"{name}_rows"), F.min("doc_id").alias(f"{name}_id"))
    return side("doc_id % 4 <> 0", "train").join(side("doc_id % 4 = 0", "eval"), "text_hash").select("text_hash", "train_rows", "eval_rows", "train_id", "eval_id").orderBy("text_hash").limit(10)


@query(f"SELECT (SELECT count(DISTINCT text_hash) FROM {_D} WHERE text_hash IN (SELECT text_hash FROM {_B}))::BIGINT AS shared, (SELECT count(*) FROM (SELECT text_hash FROM {_D} EXCEPT SELECT text_hash FROM {_B}))::BIGINT AS only_documents, (SELECT count(*) FROM (SELECT text_hash FROM {_B} EXCEPT SELECT text_hash FROM {_D}))::BIGINT AS only_benchmark")
def hash_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersection and both differences of two hash sets, in one full join of distinct hashes."""
    d = hashed(table(spark, sf_dir, "documents").select("doc_id", "text")).select("text_hash").distinct().withColumn("in_d", F.lit(1))
    b = hashed(table(spark, sf_dir, "benchmark").select("item_id", "text")).select("text_hash").distinct().withColumn("in_b", F.lit(1))
    j = d.join(b, "text_hash", "full")
    return j.agg(F.count_if(F.col("in_d").isNotNull() & F.col("in_b").isNotNull()).alias("shared"), F.count_if(F.col("in_b").isNull()).alias("only_documents"), F.count_if(F.col("in_d").isNull()).alias("only_benchmark"))


@query("""
SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')""")
def anti_join_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = table(spark, sf_dir, "orders").filter("o_orderpriority like '1%'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(urgent, "c_custkey", "left_anti")


@query("""
SELECT a.event_type AS event_type, count(*)::BIGINT AS pairs, round(avg(epoch_us(b.ts) - epoch_us(a.ts)) / 1e6, 3) AS mean_gap_s FROM events a JOIN events b
ON a.user_id = b.user_id AND a.event_type = b.event_type AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR GROUP BY 1""")
def interval_blocked_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one user and kind within an hour. Hours are a second key, so a task compares neighbours in time only, however active a user is."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    hour = F.floor(F.col("t") / 3_600_000_000)
    left = e.withColumn("slot", F.explode(F.array(hour, hour + 1))).withColumnRenamed("t", "a")
    right = e.withColumn("slot", hour).withColumnRenamed("t", "b")
    pairs = left.join(right, ["user_id", "event_type", "slot"]).filter("b > a and b <= a + 3600000000")
    return pairs.groupBy("event_type").agg(F.count("*").alias("pairs"), F.round(F.avg(F.col("b") - F.col("a")) / 1e6, 3).alias("mean_gap_s"))


_LINKS = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [array_to_string(w, ' ')] END AS t FROM w WHERE len(w) > 0),
s AS (SELECT doc_id, list_sort(list_distinct(t)) AS s FROM t), c AS (SELECT s, min(doc_id) AS rep, len(s) AS n FROM s GROUP BY s), k AS (SELECT rep, n, unnest(s) AS k FROM c),
o AS (SELECT x.rep AS a, y.rep AS b, x.n + y.n AS n, count(*) AS o FROM k x JOIN k y ON x.k = y.k AND x.rep < y.rep GROUP BY x.rep, y.rep, x.n, y.n)
SELECT rep AS a, doc_id AS b, 1.0::DOUBLE AS jaccard FROM s JOIN c USING (s) WHERE doc_id <> rep UNION ALL SELECT a, b, round(o / (n - o), 6) FROM o WHERE 100 * o >= 75 * (n - o)"""


@query(_LINKS)
def near_dups_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between texts whose sets of five-word shingles have a Jaccard similarity of 0.75 or more; copies link to the first of their class."""
    return near_links(table(spark, sf_dir, "documents").select("doc_id", "text")).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query(f"""
WITH RECURSIVE e AS (SELECT a, b FROM ({_LINKS})), u AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e),
r AS (SELECT x AS id, x AS o FROM u UNION SELECT r.id, u.y FROM r JOIN u ON u.x = r.o)
SELECT id, min(o) AS component FROM r GROUP BY 1""")
def connected_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitive groups of near duplicates, over the links of ``near_dups_jaccard``: whole texts of any length."""
    return linked(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("""
WITH s AS (SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS p FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01')
SELECT o_custkey, o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM s WHERE p = 1""")
def latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest revision of each logical id before a period closes, as a grouped maximum."""
    o = table(spark, sf_dir, "orders").filter(F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp"))
    best = o.groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_totalprice")).alias("b"))
    return best.select("o_custkey", "b.o_orderkey", F.round("b.o_totalprice", 2).alias("o_totalprice"))


@query("""
SELECT o_custkey AS id, count(*)::BIGINT AS n, CASE WHEN count(DISTINCT (o_orderstatus, o_orderpriority)) > 1 THEN 'conflict' ELSE 'idempotent' END AS state FROM orders GROUP BY 1 HAVING count(*) > 1""")
def duplicate_logical_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated ids with equal content are harmless; with different content they are marked, to fail closed."""
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"), F.min(F.struct("o_orderstatus", "o_orderpriority")).alias("a"), F.max(F.struct("o_orderstatus", "o_orderpriority")).alias("b")).filter("n > 1")
    return g.select("id", "n", F.when(F.col("a") == F.col("b"), "idempotent").otherwise("conflict").alias("state"))


@query("""
SELECT c_mktsegment AS seg, c_custkey, spent FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY spent DESC, c_custkey) AS p
  FROM (SELECT c_mktsegment, c_custkey, round(sum(o_totalprice), 2) AS spent FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL)) WHERE p <= 3""")
def top_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("spent"))  # before the join
    j = o.join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    place = F.row_number().over(W.partitionBy("c_mktsegment").orderBy(F.desc("spent"), "c_custkey"))
    return j.withColumn("p", place).filter("p <= 3").select(F.col("c_mktsegment").alias("seg"), "c_custkey", "spent")
