"""Aggregate statistics S1 to S8 over stand-in tables, gates, bootstrap, benchmark metrics and the output contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpusloom.functions import lexicon as X
from corpusloom.functions import text as T
from corpusloom.functions.dialect import DUCK, SPARK
from corpusloom.operators import sequences as Q
from corpusloom.operators import statistics as ST
from corpusloom.plans.models import _PRED, predictions
from corpusloom.plans.sequences import docs, repr_
from corpusloom.queries import query
from corpusloom.session import written
from corpusloom.sources.tables import table


def _r(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def div_sql(counts: str, by: str) -> str:
    """Diversity kernels over a relation with columns ``by`` and n."""
    return f"""(SELECT {by}, count(*)::BIGINT AS k, greatest(0.0, -sum(p * log2(p))) AS entropy, CASE WHEN count(*) > 1 THEN greatest(0.0, -sum(p * log2(p))) / log2(greatest(2, count(*))) ELSE 0.0 END AS norm_entropy,
pow(2.0, greatest(0.0, -sum(p * log2(p)))) AS effective, sum(p * p) AS hhi, CASE WHEN count(*) > 1 THEN (sum(p * p) - 1.0::DOUBLE / count(*)) / greatest(1e-12, 1 - 1.0::DOUBLE / count(*)) ELSE 1.0 END AS norm_hhi,
max(p) AS top1, sum(CASE WHEN place <= 5 THEN p ELSE 0.0 END) AS top5
FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY p DESC) AS place FROM (SELECT *, n / sum(n) OVER (PARTITION BY {by}) AS p FROM {counts} WHERE n > 0)) GROUP BY {by})"""


_KER = ["entropy", "norm_entropy", "effective", "hhi", "norm_hhi", "top1", "top5"]
_ROUND = ", ".join(f"round({k}, 6) AS {k}" for k in _KER)
_LEVELS = """(SELECT 'supplier' AS level, l_suppkey::VARCHAR AS id, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL
UNION ALL SELECT 'nation', n_name, count(*)::DOUBLE FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL
UNION ALL SELECT 'region', r_name, count(*)::DOUBLE FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL)"""


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One aggregation of the facts by supplier; the owners' levels add its rows up."""
    s = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").cast("double").alias("n"))
    up = s.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    name = lambda level, c: F.struct(F.lit(level).alias("level"), F.col(c).cast("string").alias("id"), F.col("n").alias("n"))
    return up.select(F.inline(F.array(name("supplier", "l_suppkey"), name("nation", "n_name"), name("region", "r_name")))).groupBy("level", "id").agg(F.sum("n").alias("n"))


@query(f"SELECT level, k, {_ROUND}, round((norm_hhi + top1) / 2 * 100, 4) AS level_score FROM {div_sql(_LEVELS, 'level')}")
def s2_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ST.diversity(_levels(spark, sf_dir), ["level"])
    return got.select("level", "k", *_r(*_KER), F.round((F.col("norm_hhi") + F.col("top1")) / 2 * 100, 4).alias("level_score"))


@query(f"SELECT round(avg((norm_hhi + top1) / 2) * 100, 4) AS score, count(*)::BIGINT AS levels FROM {div_sql(_LEVELS, 'level')}")
def s2_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ST.diversity(_levels(spark, sf_dir), ["level"])
    return got.agg(F.round(F.avg((F.col("norm_hhi") + F.col("top1")) / 2) * 100, 4).alias("score"), F.count("*").alias("levels"))


_EVT = "(SELECT date_trunc('hour', ts)::TIMESTAMP AS period, event_type, count(*)::DOUBLE AS n FROM events GROUP BY ALL)"


def _event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").alias("period"), "event_type").agg(F.count("*").cast("double").alias("n"))


@query(f"""SELECT strftime(period, '%Y-%m-%d %H:%M') AS period, k, round(norm_entropy, 6) AS breadth, round(effective, 6) AS effective, round(least(1.0, greatest(0.0, (total - 5) / 45.0)), 6) AS depth,
round((norm_entropy + least(1.0, effective / 8) + least(1.0, greatest(0.0, (total - 5) / 45.0))) / 3 * 100, 4) AS score
FROM {div_sql(_EVT, 'period')} JOIN (SELECT period, sum(n) AS total FROM {_EVT} GROUP BY 1) USING (period)""")
def s1_exploration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breadth, effective number over a capacity of 8, winsorised depth; the mean of the three."""
    c = _event_counts(spark, sf_dir)
    got = ST.diversity(c, ["period"]).join(c.groupBy("period").agg(F.sum("n").alias("total")), "period")
    depth = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("total") - 5) / 45.0))
    return got.select(F.date_format("period", "yyyy-MM-dd HH:mm").alias("period"), "k", F.round("norm_entropy", 6).alias("breadth"), F.round("effective", 6).alias("effective"), F.round(depth, 6).alias("depth"), F.round((F.col("norm_entropy") + F.least(F.lit(1.0), F.col("effective") / 8) + depth) / 3 * 100, 4).alias("score"))


_LANGS = "(SELECT source, lang, count(*)::DOUBLE AS n FROM documents WHERE lang IS NOT NULL GROUP BY ALL)"


@query(f"SELECT source, k, round(0.5 * (norm_entropy + (effective - 1) / (4 - 1)), 6) AS family FROM {div_sql(_LANGS, 'source')}")
def s4_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "documents").filter("lang is not null").groupBy("source", "lang").agg(F.count("*").cast("double").alias("n"))
    return ST.diversity(c, ["source"]).select("source", "k", F.round(0.5 * (F.col("norm_entropy") + (F.col("effective") - 1) / (4 - 1)), 6).alias("family"))


_ORD = """(SELECT o_orderkey, c_custkey AS entity, r_name, c_mktsegment, date_trunc('month', o_orderdate)::DATE AS month, substr(o_orderpriority, 1, 1)::INT AS level
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)"""
_CELLS = f"""(SELECT r_name, c_mktsegment, avg(e) AS p, sum(docs)::BIGINT AS docs, count(*)::BIGINT AS entities FROM (
  SELECT r_name, c_mktsegment, entity, avg(level / 5.0::DOUBLE) AS e, count(*) AS docs FROM {_ORD} GROUP BY ALL) GROUP BY ALL HAVING sum(docs) >= 20 AND count(*) >= 10)"""
_PI = "(SELECT r_name, c_mktsegment, count(*) / sum(count(*)) OVER () AS pi FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL)"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = _regions(spark, sf_dir)
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", F.substring("o_orderpriority", 1, 1).cast("int").alias("level"))
    return o.join(place, F.col("o_custkey") == F.col("entity")).select("o_orderkey", "entity", "r_name", "c_mktsegment", F.to_date(F.date_trunc("month", "o_orderdate")).alias("month"), "level")


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.broadcast(table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name"))
    return table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("entity"), "r_name", "c_mktsegment")


def _weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _regions(spark, sf_dir).groupBy("r_name", "c_mktsegment").count()
    total = c.agg(F.sum("count").alias("t"))
    return c.join(F.broadcast(total)).select("r_name", "c_mktsegment", (F.col("count") / F.col("t")).alias("pi"))


_CELL = ["r_name", "c_mktsegment"]


@query(f"SELECT r_name, c_mktsegment, round(p, 6) AS p, round(pi, 6) AS pi, docs, entities FROM {_CELLS} JOIN {_PI} USING (r_name, c_mktsegment)")
def s7_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ST.standardised(_orders(spark, sf_dir), _CELL, "entity", "level", _weights(spark, sf_dir))
    return got.select(*_CELL, *_r("p", "pi"), "docs", "entities")


@query(f"SELECT CASE WHEN coalesce(sum(pi), 0) >= 0.8 THEN round(100 * sum(pi * p) / sum(pi), 4) END AS score, round(coalesce(sum(pi), 0), 6) AS matched, CASE WHEN coalesce(sum(pi), 0) >= 0.8 THEN 'released' ELSE 'suppressed' END AS state FROM {_CELLS} JOIN {_PI} USING (r_name, c_mktsegment)")
def s7_standardised(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ST.standardised(_orders(spark, sf_dir), _CELL, "entity", "level", _weights(spark, sf_dir))
    s = got.agg(F.coalesce(F.sum("pi"), F.lit(0.0)).alias("m"), F.sum(F.col("pi") * F.col("p")).alias("x"))
    enough = F.col("m") >= 0.8
    return s.select(F.when(enough, F.round(100 * F.col("x") / F.col("m"), 4)).alias("score"), F.round("m", 6).alias("matched"), F.when(enough, "released").otherwise("suppressed").alias("state"))


@query(f"SELECT g.left_out, round(100 * sum(pi * p) / sum(pi), 4) AS score FROM (SELECT r_name AS left_out FROM region) g, {_CELLS} c JOIN {_PI} USING (r_name, c_mktsegment) WHERE c.r_name <> g.left_out GROUP BY 1")
def s7_leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves out each region in turn: totals less a region's own, one pass over the cells."""
    got = ST.standardised(_orders(spark, sf_dir), _CELL, "entity", "level", _weights(spark, sf_dir)).groupBy("r_name").agg(F.sum("pi").alias("m"), F.sum(F.col("pi") * F.col("p")).alias("x"))
    total = got.agg(F.sum("m").alias("tm"), F.sum("x").alias("tx"))
    regions = F.broadcast(table(spark, sf_dir, "region").select("r_name"))
    return got.join(regions, "r_name", "right").join(F.broadcast(total)).select(F.col("r_name").alias("left_out"), F.round(100 * (F.col("tx") - F.coalesce("x", F.lit(0.0))) / (F.col("tm") - F.coalesce("m", F.lit(0.0))), 4).alias("score"))


@query(f"""
WITH o AS (SELECT *, count(*) OVER (PARTITION BY month, r_name, c_mktsegment) AS docs FROM {_ORD}),
m AS (SELECT month, count(*)::BIGINT AS n, count(DISTINCT entity)::BIGINT AS entities, count(DISTINCT c_mktsegment)::BIGINT AS grps, count(DISTINCT r_name)::BIGINT AS families, avg(level / 5.0::DOUBLE) * 100 AS score FROM o GROUP BY 1),
a AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS every FROM orders GROUP BY 1),
c AS (SELECT month, r_name, c_mktsegment FROM o GROUP BY ALL HAVING count(*) >= 20 AND count(DISTINCT entity) >= 10),
w AS (SELECT month, round(sum(pi), 9) AS matched FROM c JOIN {_PI} USING (r_name, c_mktsegment) GROUP BY 1),
g AS (SELECT a.month, every, coalesce(n, 0)::BIGINT AS n, coalesce(entities, 0)::BIGINT AS entities, coalesce(grps, 0) AS grps, coalesce(families, 0)::BIGINT AS families, coalesce(matched, 0) AS matched, score FROM a LEFT JOIN m USING (month) LEFT JOIN w USING (month)),
r AS (SELECT *, concat_ws(',', CASE WHEN n < 500 THEN 'LOW_SAMPLE_SIZE' END, CASE WHEN entities < 50 THEN 'LOW_ENTITY_COUNT' END, CASE WHEN grps < 5 THEN 'LOW_GROUP_COUNT' END, CASE WHEN families < 2 THEN 'LOW_SOURCE_COUNT' END,
  CASE WHEN n / every < 0.8 THEN 'LOW_RESOLUTION' END, CASE WHEN matched < 0.8 THEN 'LOW_MATCHED_WEIGHT' END) AS reasons FROM g)
SELECT month, n, entities, families, reasons, CASE WHEN reasons = '' THEN round(score, 4) END AS score FROM r""")
def suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A suppressed month has no score; the gates that failed are listed. Groups are segments, families regions; weight is matched in cells with documents and entities enough."""
    o = _orders(spark, sf_dir)
    m = o.groupBy("month").agg(F.count("*").alias("n"), F.count_distinct("entity").alias("entities"), F.count_distinct("c_mktsegment").alias("groups"), F.count_distinct("r_name").alias("families"), (F.avg(F.col("level") / 5) * 100).alias("s"))
    every = table(spark, sf_dir, "orders").groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("month")).agg(F.count("*").alias("every"))
    cells = o.groupBy("month", *_CELL).agg(F.count("*").alias("docs"), F.count_distinct("entity").alias("some")).filter("docs >= 20 and some >= 10")
    matched = cells.join(F.broadcast(_weights(spark, sf_dir)), _CELL).groupBy("month").agg(F.round(F.sum("pi"), 9).alias("matched"))
    g = every.join(m, "month", "left").fillna(0, ["n", "entities", "groups", "families"]).join(matched, "month", "left")
    reasons = ST.suppression(ST.gates(F.col("n"), F.col("entities"), F.col("groups"), F.col("families"), F.col("n") / F.col("every"), F.coalesce("matched", F.lit(0.0))))
    return g.withColumn("reasons", reasons).select("month", "n", "entities", "families", "reasons", F.when(F.col("reasons") == "", F.round("s", 4)).alias("score"))


_MONTHS = f"(SELECT month, avg(level / 5.0::DOUBLE) * 100 AS d FROM {_ORD} GROUP BY 1)"
_Z = f"""(WITH m AS {_MONTHS}, b AS (SELECT * FROM m WHERE month < DATE '1997-01-01'),
s AS (SELECT quantile_cont(d, 0.5) AS m, count(*) AS n, quantile_cont(d, 0.75) AS q3, quantile_cont(d, 0.25) AS q1, stddev_samp(d) AS sd FROM b), a AS (SELECT quantile_cont(abs(d - m), 0.5) AS mad FROM b, s)
SELECT month, d, CASE WHEN n >= 12 THEN greatest(-5.0, least(5.0, (m - d) / CASE WHEN mad > 0 THEN 1.4826 * mad WHEN q3 > q1 THEN (q3 - q1) / 1.349 WHEN sd > 0 THEN sd END)) END AS z FROM m, s, a)"""


def _monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _orders(spark, sf_dir).groupBy("month").agg((F.avg(F.col("level") / 5) * 100).alias("d"))
    return ST.robust_z(m, "d", F.col("month") < F.lit("1997-01-01").cast("date"))


@query(f"SELECT month, round(d, 4) AS d, round(z, 4) AS z, round(greatest(0.0, least(100.0, 50 + 10 * z)), 3) AS score FROM {_Z}")
def s3_robust_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _monthly(spark, sf_dir).select("month", F.round("d", 4).alias("d"), F.round("z", 4).alias("z"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 50 + 10 * F.col("z"))), 3).alias("score"))


_TERMS = f"(SELECT source, term, count(*)::DOUBLE AS n FROM (SELECT source, lower(unnest({DUCK.found(repr_, X.TOK_WORD)})) AS term FROM documents) GROUP BY ALL)"


@query(f"""
WITH u AS {_TERMS}, p AS (SELECT *, n / sum(n) OVER (PARTITION BY source) AS p FROM u), q AS (SELECT term, sum(n) / (SELECT sum(n) FROM u) AS q FROM u GROUP BY 1)
SELECT source, round(0.5 * sum(p * log2(p / ((p + q) / 2))) + 0.5 * sum(q * log2(q / ((p + q) / 2))) + 0.5 * (1 - sum(q)), 6) AS jsd FROM p JOIN q USING (term) GROUP BY 1""")
def s3_jsd_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's word distribution against that of all."""
    words = Q.exploded(docs(spark, sf_dir), ("source",), F.split(Q.words(), "\n"), "term").filter("term <> ''")
    u = words.groupBy("source", "term").agg(F.count("*").cast("double").alias("n"))
    return ST.jsd(u.withColumn("all", F.lit(1)), "source", "term", ["all"]).select("source", F.round("jsd", 6).alias("jsd"))


_DIM = "(SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)"


@query(f"""
WITH c AS (SELECT label, i, avg(x) AS m FROM {_DIM} GROUP BY ALL)
SELECT label, round(avg(d), 6) AS dispersion, count(*)::BIGINT AS n FROM (SELECT v.vec_id, v.label, 1 - sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))) AS d FROM {_DIM} v JOIN c ON c.label = v.label AND c.i = v.i GROUP BY ALL) GROUP BY 1""")
def s3_cosine_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean cosine distance to the class centroid."""
    x = table(spark, sf_dir, "embeddings").select("label", F.transform("embedding", lambda e: e.cast("double")).alias("x"))
    c = x.select("label", F.posexplode("x").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("m")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda r: r["m"]).alias("m"))
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    norm = lambda v: F.sqrt(add(F.transform(v, lambda e: e * e)))
    d = 1 - add(F.zip_with("x", "m", lambda a, b: a * b)) / (norm("x") * norm("m"))
    return x.join(F.broadcast(c), "label").groupBy("label").agg(F.round(F.avg(d), 6).alias("dispersion"), F.count("*").alias("n"))


@query("""
WITH c AS (SELECT date_trunc('day', ts)::DATE AS day, event_type, count(*) AS n FROM events GROUP BY ALL),
b AS (SELECT event_type, avg(n) AS base FROM c GROUP BY 1)
SELECT day, round(100 * sum(w * greatest(0.0, least(2.0, n / base)) / 2) / sum(w), 4) AS score FROM (SELECT c.*, base, 1.0::DOUBLE + length(c.event_type) % 3 AS w FROM c JOIN b USING (event_type)) GROUP BY 1""")
def s6_contribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily activity of each kind against its mean, clipped, by fixed weights."""
    c = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))
    b = c.groupBy("event_type").agg(F.avg("n").alias("base"))
    w = 1.0 + F.length("event_type") % 3
    ratio = F.greatest(F.lit(0.0), F.least(F.lit(2.0), F.col("n") / F.col("base"))) / 2
    return c.join(F.broadcast(b), "event_type").groupBy("day").agg(F.round(100 * F.sum(w * ratio) / F.sum(w), 4).alias("score"))


@query("""
SELECT source, count(DISTINCT sha256(lower(text)))::BIGINT AS clusters, sum(length(text))::BIGINT AS units, round(count(DISTINCT sha256(lower(text))) / (sum(length(text)) / 1000.0::DOUBLE), 6) AS density,
  round(least(100.0, greatest(0.0, count(DISTINCT sha256(lower(text))) / (sum(length(text)) / 1000.0::DOUBLE) / 2 * 100)), 4) AS score FROM documents WHERE text IS NOT NULL AND text <> '' GROUP BY 1""")
def s8_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct texts per thousand characters against a ceiling of 2."""
    rows = table(spark, sf_dir, "documents").filter("text is not null and text <> ''").select("source", F.sha2(F.lower("text"), 256).alias("h"), F.length("text").alias("c"))
    g = rows.groupBy("source").agg(F.count_distinct("h").alias("clusters"), F.sum("c").alias("units"))
    d = F.col("clusters") / (F.col("units") / 1000.0)
    return g.select("source", "clusters", "units", F.round(d, 6).alias("density"), F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), d / 2 * 100)), 4).alias("score"))


_HIT = r"\b(the|und|les|los)\b"
_S5 = f"(SELECT source, doc_id, {DUCK.like(f'lower({T.plain(DUCK, repr_)})', _HIT)} AS hit, length({repr_}) >= 1000 AS after FROM documents)"


@query(f"""
WITH s AS (SELECT source, avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) FILTER (after) - avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) FILTER (NOT after) AS shift FROM {_S5} GROUP BY 1),
p AS (SELECT source, avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) FILTER (a) - avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) FILTER (NOT a) AS placebo FROM (SELECT *, ('0x' || substr(sha256('p:' || doc_id), 1, 8))::BIGINT % 2 = 0 AS a FROM {_S5}) GROUP BY 1)
SELECT source, round(shift, 6) AS shift, round(placebo, 6) AS placebo, abs(shift) > 0.05 AND abs(shift) > abs(placebo) AS above_noise FROM s JOIN p USING (source)""")
def s5_prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shift in prevalence between short and long documents, against a placebo grouping by hash."""
    hit = F.expr(SPARK.like(f"lower({T.plain(SPARK, repr_)})", _HIT)).cast("int")
    placebo = F.conv(F.substring(F.sha2(F.concat(F.lit("p:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("long") % 2 == 0
    rows = table(spark, sf_dir, "documents").select("source", hit.alias("hit"), (F.length(F.coalesce("text", F.lit(""))) >= 1000).alias("after"), placebo.alias("a"))
    diff = lambda c: F.avg(F.when(F.col(c), F.col("hit"))) - F.avg(F.when(~F.col(c), F.col("hit")))
    g = rows.groupBy("source").agg(diff("after").alias("shift"), diff("a").alias("placebo"))
    return g.select("source", *_r("shift", "placebo"), ((F.abs("shift") > 0.05) & (F.abs("shift") > F.abs("placebo"))).alias("above_noise"))


_ENT = f"(SELECT r_name, entity, avg(level) AS value FROM {_ORD} GROUP BY ALL)"


_WEIGHT, _DRAW = ST.replicate_weight("seed", "rep", "xor({0}, {1})")


@query(f"""
WITH e AS (SELECT r_name, value, ('0x' || substr(md5('v1:' || r_name || ':' || entity), 1, 8))::BIGINT % 2147483648 AS seed FROM {_ENT}),
d AS (SELECT *, {_WEIGHT} AS w FROM (SELECT r_name, value, rep, {_DRAW} AS u FROM e, range(1, 2001) t(rep))),
m AS (SELECT r_name, rep, sum(value * w) / sum(w) AS stat FROM d GROUP BY ALL HAVING sum(w) > 0)
SELECT r_name, round(quantile_cont(stat, 0.05), 6) AS low, round(quantile_cont(stat, 0.5), 6) AS mid, round(quantile_cont(stat, 0.95), 6) AS high FROM m GROUP BY 1""")
def cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2,000 replicates: customers weighted within their region by hash, and the percentiles of the mean."""
    e = _orders(spark, sf_dir).groupBy("r_name", "entity").agg(F.avg("level").alias("value"))
    m = ST.bootstrap(e, 2000, ["r_name"], "v1")
    return m.groupBy("r_name").agg(*(F.round(F.percentile("stat", q), 6).alias(n) for q, n in ((0.05, "low"), (0.5, "mid"), (0.95, "high"))))


@query(f"""
WITH m AS (SELECT r_name, year(month)::INT AS y, avg(level / 5.0::DOUBLE) * 100 AS v FROM {_ORD} GROUP BY ALL),
c AS (SELECT *, v - lag(v) OVER (PARTITION BY r_name ORDER BY y) AS absolute, lag(v) OVER (PARTITION BY r_name ORDER BY y) AS before FROM m)
SELECT r_name, y, round(v, 6) AS v, round(absolute, 6) AS absolute, round(CASE WHEN before <> 0 THEN absolute / before END, 6) AS relative,
  CASE WHEN absolute IS NULL THEN 'insufficient' WHEN absolute - 0.5 > 0 THEN 'increasing' WHEN absolute + 0.5 < 0 THEN 'decreasing' ELSE 'stable' END AS trend FROM c""")
def yearly_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change against the year before: relative change is null at a zero baseline, the trend follows from an interval."""
    m = _orders(spark, sf_dir).groupBy("r_name", F.year("month").alias("y")).agg((F.avg(F.col("level") / 5) * 100).alias("v"))
    before = F.lag("v").over(W.partitionBy("r_name").orderBy("y"))
    c = m.withColumn("before", before).withColumn("absolute", F.col("v") - F.col("before"))
    return c.select("r_name", "y", F.round("v", 6).alias("v"), F.round("absolute", 6).alias("absolute"), F.round(F.try_divide("absolute", F.nullif("before", F.lit(0.0))), 6).alias("relative"), ST.trend(F.col("absolute") - 0.5, F.col("absolute") + 0.5).alias("trend"))


@query(f"""
WITH p AS (SELECT actual, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS predicted FROM {_PRED}),
c AS (SELECT k, count(*) FILTER (predicted = k AND actual = k) AS tp, count(*) FILTER (predicted = k) AS pr, count(*) FILTER (actual = k) AS re FROM p, (SELECT unnest([0, 1]) AS k) GROUP BY 1)
SELECT k::INT AS class, round(tp / greatest(1, pr), 6) AS precision, round(tp / greatest(1, re), 6) AS recall, round(2 * tp / greatest(1, pr + re), 6) AS f1, round(avg(2 * tp / greatest(1, pr + re)) OVER (), 6) AS macro_f1 FROM c""")
def macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir).select("actual", F.when(F.col("p") >= 0.5, 1).otherwise(0).alias("predicted"), F.explode(F.array(F.lit(0), F.lit(1))).alias("class"))
    k = F.col("class")
    c = p.groupBy("class").agg(F.count_if((F.col("predicted") == k) & (F.col("actual") == k)).alias("tp"), F.count_if(F.col("predicted") == k).alias("pr"), F.count_if(F.col("actual") == k).alias("re"))
    part = lambda a, b: a / F.greatest(F.lit(1), b)
    f1 = part(2 * F.col("tp"), F.col("pr") + F.col("re"))
    mean = c.agg(F.round(F.avg(f1), 6).alias("macro_f1"))
    return c.join(F.broadcast(mean)).select("class", F.round(part(F.col("tp"), F.col("pr")), 6).alias("precision"), F.round(part(F.col("tp"), F.col("re")), 6).alias("recall"), F.round(f1, 6).alias("f1"), "macro_f1")


@query(f"""
WITH p AS (SELECT actual * 4 AS a, least(4, floor(p * 5))::INT AS b FROM {_PRED}), n AS (SELECT count(*)::DOUBLE AS n FROM p),
o AS (SELECT sum((a - b) * (a - b) / 16.0::DOUBLE) / any_value(n) AS o FROM p, n),
e AS (SELECT sum((x.a - y.b) * (x.a - y.b) / 16.0::DOUBLE * x.c * y.c) / any_value(n * n) AS e FROM (SELECT a, count(*)::DOUBLE AS c FROM p GROUP BY 1) x, (SELECT b, count(*)::DOUBLE AS c FROM p GROUP BY 1) y, n)
SELECT round(1 - o / e, 6) AS kappa, round((SELECT avg(abs(a - b)) FROM p), 6) AS ordinal_mae FROM o, e""")
def kappa_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quadratic weighted kappa of five levels: both margins have at most five rows."""
    p = predictions(spark, sf_dir).select((F.col("actual") * 4).alias("a"), F.least(F.lit(4), F.floor(F.col("p") * 5)).cast("int").alias("b"))
    w = (F.col("a") - F.col("b")) * (F.col("a") - F.col("b")) / 16.0
    cells = p.groupBy("a", "b").agg(F.count("*").cast("double").alias("c"))
    o = cells.agg((F.sum(w * F.col("c")) / F.sum("c")).alias("o"), F.sum("c").alias("n"), (F.sum(F.abs(F.col("a") - F.col("b")) * F.col("c")) / F.sum("c")).alias("mae"))
    rows, columns = cells.groupBy("a").agg(F.sum("c").alias("x")), cells.groupBy("b").agg(F.sum("c").alias("y"))
    e = rows.join(F.broadcast(columns)).agg(F.sum(w * F.col("x") * F.col("y")).alias("e"))
    return o.join(F.broadcast(e)).select(F.round(1 - F.col("o") / (F.col("e") / (F.col("n") * F.col("n"))), 6).alias("kappa"), F.round("mae", 6).alias("ordinal_mae"))


@query(f"""
WITH c AS (SELECT p AS v, count(*)::DOUBLE AS c FROM {_PRED} GROUP BY 1), r AS (SELECT v, sum(c) OVER (ORDER BY v) - (c - 1) / 2 AS rx FROM c),
l AS (SELECT length(text) AS v, count(*)::DOUBLE AS c FROM documents JOIN labels USING (doc_id) GROUP BY 1), s AS (SELECT v, sum(c) OVER (ORDER BY v) - (c - 1) / 2 AS ry FROM l)
SELECT round(corr(rx, ry), 5) AS spearman, count(*)::BIGINT AS n FROM {_PRED} p JOIN r ON r.v = p.p JOIN documents d ON d.doc_id = p.doc_id JOIN s ON s.v = length(d.text)""")
def spearman_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation with average ranks. Ranks come from counts of distinct values, range-partitioned, not from one sorted partition."""
    lengths = table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("double").alias("y"))
    rows = predictions(spark, sf_dir).select("doc_id", F.col("p").alias("x")).join(lengths, "doc_id").filter("y is not null")
    ranked = rows.join(_ranks(rows, "x", "rx"), "x").join(_ranks(rows, "y", "ry"), "y")
    return ranked.agg(F.round(F.corr("rx", "ry"), 5).alias("spearman"), F.count("*").alias("n"))


def _ranks(rows: DataFrame, c: str, name: str) -> DataFrame:
    """Average ranks of the values of a column, by a two-level running sum. The ranges are written, so that a lost executor can't move their bounds."""
    counts = written(rows.groupBy(c).agg(F.count("*").cast("double").alias("n")).repartitionByRange(c).withColumn("part", F.spark_partition_id()), "ranks")
    base = counts.groupBy("part").agg(F.sum("n").alias("t"))
    base = base.withColumn("before", F.coalesce(F.sum("t").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))  # a row per partition
    inside = F.sum("n").over(W.partitionBy("part").orderBy(c))
    return counts.withColumn("upto", inside).join(F.broadcast(base), "part").select(c, (F.col("before") + F.col("upto") - (F.col("n") - 1) / 2).alias(name))


@query(f"""
SELECT month, r_name, round(avg(level / 5.0::DOUBLE) * 100, 4) AS score, sha256(strftime(month, '%Y-%m-%d') || ':' || r_name) AS etag FROM {_ORD}
GROUP BY ALL HAVING (month, r_name) > (DATE '1995-06-01', 'ASIA') ORDER BY month, r_name LIMIT 25""")
def series_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page of a series in stable order, after a keyset cursor. The cursor reaches below the aggregation."""
    after = (F.col("month") > F.lit("1995-06-01").cast("date")) | ((F.col("month") == F.lit("1995-06-01").cast("date")) & (F.col("r_name") > "ASIA"))
    g = _orders(spark, sf_dir).filter(after).groupBy("month", "r_name").agg(F.round(F.avg(F.col("level") / 5) * 100, 4).alias("score"))
    return g.withColumn("etag", F.sha2(F.concat(F.date_format("month", "yyyy-MM-dd"), F.lit(":"), "r_name"), 256)).orderBy("month", "r_name").limit(25)


@query("""
WITH c AS (SELECT c_mktsegment AS seg, o_custkey AS entity, sum(o_totalprice) AS x FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
s AS (SELECT *, x / sum(x) OVER (PARTITION BY seg) AS share FROM c)
SELECT seg, count(*) FILTER (share > 0.005)::BIGINT AS capped, round(sum(least(share, 0.005)), 6) AS kept FROM s GROUP BY 1""")
def contribution_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities' shares of their segment, cut at a cap."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("x")).join(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("seg")), F.col("o_custkey") == F.col("c_custkey"))
    s = ST.shares(o, ["seg"], "x")
    return s.groupBy("seg").agg(F.count_if(F.col("p") > 0.005).alias("capped"), F.round(F.sum(F.least("p", F.lit(0.005))), 6).alias("kept"))


@query("""
SELECT source, round(count(*) FILTER (text IS NULL OR text = '') / count(*), 6) AS missing, round(quantile_cont(length(text), 0.5), 4) AS median_chars, round(quantile_cont(length(text), 0.9), 4) AS p90_chars,
  round(count(*) FILTER (lang IS NULL OR lang NOT IN ('en', 'de')) / count(*), 6) AS oov_rate FROM documents GROUP BY 1""")
def drift_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, c = F.count("*"), F.length("text")
    d = table(spark, sf_dir, "documents").select("source", "text", "lang")
    return d.groupBy("source").agg(F.round(F.count_if(F.col("text").isNull() | (F.col("text") == "")) / n, 6).alias("missing"), F.round(F.percentile(c, 0.5), 4).alias("median_chars"), F.round(F.percentile(c, 0.9), 4).alias("p90_chars"), F.round(F.count_if(F.col("lang").isNull() | ~F.col("lang").isin("en", "de")) / n, 6).alias("oov_rate"))
