"""Reports over predictions, chunks and series: extremes, summaries, descriptors, sensitivities, checks of submissions and lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.dialect import DUCK, SPARK
from corpusloom.operators import models as MO
from corpusloom.operators import statistics as ST
from corpusloom.operators.near import near_groups
from corpusloom.plans.documents import _CALIBRATION, calibration_chunks
from corpusloom.plans.joins import _LINKS
from corpusloom.plans.models import _FEAT, _MOMENTS, _PRED, _SWEEP, _WEIGHTS, _linear, docs, features, labels, predictions
from corpusloom.plans.observatory import _CELL, _CELLS, _ORD, _PI, _orders, _weights
from corpusloom.plans.sequences import seq_sql
from corpusloom.queries import query
from corpusloom.session import written
from corpusloom.sources.tables import table


@query(f"""
SELECT * FROM (SELECT 'highest' AS side, feature, round(w, 6)::DOUBLE AS weight, row_number() OVER (ORDER BY w DESC, feature)::INT AS place FROM {_WEIGHTS}) WHERE place <= 10
UNION ALL SELECT * FROM (SELECT 'lowest', feature, round(w, 6)::DOUBLE, row_number() OVER (ORDER BY w, feature)::INT AS place FROM {_WEIGHTS}) WHERE place <= 10""")
def coefficient_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both ends of a model's coefficients: ten rows of each by top-n, never a sort of the vocabulary."""
    w = _linear(spark, sf_dir)[2].select("feature", F.round("w", 6).alias("weight"))
    ends = w.orderBy(F.desc("weight"), "feature").limit(10).withColumn("side", F.lit("highest")).unionByName(w.orderBy("weight", "feature").limit(10).withColumn("side", F.lit("lowest")))
    sign = F.when(F.col("side") == "highest", -F.col("weight")).otherwise(F.col("weight"))
    listed = ends.groupBy("side").agg(F.array_sort(F.collect_list(F.struct(sign.alias("by"), "feature", "weight"))).alias("l"))  # ten rows a side
    return listed.select("side", F.posexplode("l").alias("at", "r")).select("side", "r.feature", "r.weight", (F.col("at") + 1).cast("int").alias("place"))


@query(f"""
SELECT coalesce(source, 'all') AS source, coalesce(kind, 'all') AS kind, count(*)::BIGINT AS chunks, sum(words)::BIGINT AS words FROM ({_CALIBRATION}) c JOIN (SELECT doc_id, source FROM documents) USING (doc_id)
GROUP BY CUBE (source, kind)""")
def fixture_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibration chunks by source and kind, with all margins."""
    rows = calibration_chunks(spark, sf_dir).join(docs(spark, sf_dir).select("doc_id", "source"), "doc_id")
    return rows.cube("source", "kind").agg(F.count("*").alias("chunks"), F.sum("words").alias("words")).select(F.coalesce("source", F.lit("all")).alias("source"), F.coalesce("kind", F.lit("all")).alias("kind"), "chunks", "words")


@query(f"""
WITH s AS (SELECT *, (tp + tn) / greatest(1, tp + fp + tn + fn) AS accuracy, tp / greatest(1, tp + fn) AS recall, fp / greatest(1, fp + tn) AS fpr FROM {_SWEEP})
SELECT threshold, round(accuracy, 6) AS accuracy, recall > 0.8 AND fpr < 0.2 AS passes, 'v2-' || CASE WHEN recall > 0.8 AND fpr < 0.2 THEN 'pass' ELSE 'fail' END || '-' || round(100 * threshold)::INT AS version FROM s ORDER BY round(accuracy, 6) DESC, threshold LIMIT 3""")
def edge_descriptor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best thresholds, best first, with the verdict and the version name of a descriptor."""
    s = MO.sweep(predictions(spark, sf_dir), (0.3, 0.4, 0.5, 0.6, 0.7, 0.8))
    part = lambda a, b: F.col(a) / F.greatest(F.lit(1), F.col(a) + F.col(b))
    passes = (part("tp", "fn") > 0.8) & (part("fp", "tn") < 0.2)
    version = F.concat(F.lit("v2-"), F.when(passes, "pass").otherwise("fail"), F.lit("-"), F.round(100 * F.col("threshold")).cast("int").cast("string"))
    return s.select("threshold", "accuracy", passes.alias("passes"), version.alias("version")).orderBy(F.desc("accuracy"), "threshold").limit(3)


@query(f"""
WITH m AS (SELECT *, row_number() OVER (ORDER BY df DESC, feature) - 1 AS place FROM {_MOMENTS}), z AS (SELECT doc_id, sum(abs((value - mean) / std)) AS s, count(*)::BIGINT AS active, min(place)::BIGINT AS first_place FROM {_FEAT} JOIN m USING (feature) GROUP BY 1)
SELECT doc_id, active, first_place, round(s, 4) AS absolute FROM z""")
def standardised_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features by their place in the vocabulary and their stored standardisation, summed up per document."""
    f = written(features(spark, sf_dir), "features")
    m = MO.moments(f, MO.vocabulary(f, 300, 3), docs(spark, sf_dir).select("doc_id"))
    top = m.agg(F.array_sort(F.collect_list(F.struct((-F.col("df")).alias("df"), "feature", "mean", "std"))).alias("v"))  # 300 features
    placed = top.select(F.posexplode("v").alias("place", "r")).select("place", "r.feature", "r.mean", "r.std")
    z = f.join(placed, "feature").groupBy("doc_id").agg(F.sum(F.abs((F.col("value") - F.col("mean")) / F.col("std"))).alias("s"), F.count("*").alias("active"), F.min("place").cast("long").alias("first_place"))
    return z.select("doc_id", "active", "first_place", F.round("s", 4).alias("absolute"))


@query(f"SELECT actual, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END::INT AS predicted, count(*)::BIGINT AS n, count(DISTINCT doc_id::VARCHAR)::BIGINT AS keys FROM {_PRED} GROUP BY ALL")
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and predictions joined by a stable key: the id, or for rows without one the row itself."""
    p = predictions(spark, sf_dir)
    key = F.coalesce(F.col("doc_id").cast("string"), F.to_json(F.struct("lang", "source", "actual", "p")))
    return p.groupBy("actual", F.when(F.col("p") >= 0.5, 1).otherwise(0).alias("predicted")).agg(F.count("*").alias("n"), F.count_distinct(key).alias("keys"))


_MAP = (("00000001", "n", "Process", "="), ("00000002", "v", "Motion", "+"), ("00000002", "n", "Object", "="), ("00000004", "a", "Attribute", "@"))


@query(f"""
WITH m AS (SELECT * FROM (VALUES {", ".join(str(r) for r in _MAP)}) t(off, pos, term, relation)), r AS (SELECT doc_id, lpad((doc_id % 6)::VARCHAR, 8, '0') AS off, CASE doc_id % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'n' ELSE 'v' END AS pos FROM documents)
SELECT coalesce(term, 'no_sumo_mapping') AS term, coalesce(relation, 'no_mapping') AS relation, count(*)::BIGINT AS n FROM r LEFT JOIN m USING (off, pos) GROUP BY ALL""")
def mapping_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synsets looked up in a mapping; a miss gives a sentinel. The mapping has four rows here, and is a literal."""
    m = spark.createDataFrame(_MAP, "off string, pos string, term string, relation string")
    pos = F.when(F.col("doc_id") % 4 == 0, "a").when(F.col("doc_id") % 4 == 1, "n").otherwise("v")
    r = table(spark, sf_dir, "documents").select(F.lpad((F.col("doc_id") % 6).cast("string"), 8, "0").alias("off"), pos.alias("pos"))
    return r.join(m, ["off", "pos"], "left").groupBy(F.coalesce("term", F.lit("no_sumo_mapping")).alias("term"), F.coalesce("relation", F.lit("no_mapping")).alias("relation")).agg(F.count("*").alias("n"))


_STATE = f"(SELECT doc_id, x AS k, count(*)::DOUBLE AS v FROM (SELECT doc_id, unnest(s) AS x FROM {seq_sql('coarse')}) GROUP BY ALL)"


@query(f"""
WITH v AS {_STATE}, c AS (SELECT quality::INT AS label, k, sum(v) / any_value(n) AS m FROM v JOIN labels USING (doc_id) JOIN (SELECT quality AS q, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1) ON q = quality GROUP BY 1, 2),
p AS (SELECT d.doc_id, l.label FROM documents d, (SELECT DISTINCT label FROM c) l),
u AS (SELECT p.doc_id, p.label, k.k FROM p, (SELECT DISTINCT k FROM (SELECT k FROM v UNION SELECT k FROM c)) k)
SELECT u.doc_id, u.label, round(sum((coalesce(v.v, 0) - coalesce(c.m, 0)) * (coalesce(v.v, 0) - coalesce(c.m, 0))), 4) AS d2 FROM u LEFT JOIN v ON v.doc_id = u.doc_id AND v.k = u.k LEFT JOIN c ON c.label = u.label AND c.k = u.k GROUP BY 1, 2""")
def sparse_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared distance over the union of keys, of each document to each class centroid: |a|^2 - 2 ab + |b|^2, so only shared keys meet."""
    from corpusloom.operators import sequences as Q

    every = docs(spark, sf_dir)
    v = Q.state_counts(Q.with_states(every, ("coarse",)), "coarse").select("doc_id", F.col("state").alias("k"), F.col("n").cast("double").alias("v"))
    known = labels(spark, sf_dir).join(every.select("doc_id"), "doc_id")
    n = known.groupBy("label").agg(F.count("*").alias("n"))
    c = v.join(known, "doc_id").groupBy("label", "k").agg(F.sum("v").alias("s")).join(n, "label").select("label", "k", (F.col("s") / F.col("n")).alias("m"))
    norms = c.groupBy("label").agg(F.sum(F.col("m") * F.col("m")).alias("bb"))
    own = v.groupBy("doc_id").agg(F.sum(F.col("v") * F.col("v")).alias("aa"))
    dots = v.join(c, "k").groupBy("doc_id", "label").agg(F.sum(F.col("v") * F.col("m")).alias("ab"))
    pairs = every.select("doc_id").join(own, "doc_id", "left").join(F.broadcast(norms))  # a row for each class
    d2 = F.coalesce("aa", F.lit(0.0)) - 2 * F.coalesce("ab", F.lit(0.0)) + F.col("bb")
    return pairs.join(dots, ["doc_id", "label"], "left").select("doc_id", "label", F.round(d2, 4).alias("d2"))


_NOW = "(SELECT r_name, c_mktsegment, count(*) / sum(count(*)) OVER () AS pi FROM __ORD__ GROUP BY ALL)".replace("__ORD__", _ORD)


@query(f"""
WITH c AS {_CELLS}, a AS (SELECT c.*, b.pi AS base, n.pi AS now FROM c JOIN {_PI} b USING (r_name, c_mktsegment) JOIN {_NOW} n USING (r_name, c_mktsegment))
SELECT unnest(['baseline', 'current_composition', 'document_weighted', 'equal_family']) AS sensitivity, unnest([round(100 * sum(base * p) / sum(base), 4), round(100 * sum(now * p) / sum(now), 4), round(100 * sum(docs * p) / sum(docs), 4),
  (SELECT round(100 * avg(f), 4) FROM (SELECT avg(p) AS f FROM a GROUP BY r_name))]) AS score FROM a""")
def sensitivities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The standardised level under other weights: today's composition, documents, equal families."""
    o = _orders(spark, sf_dir)
    now = o.groupBy(*_CELL).agg(F.count("*").alias("d"))
    now = now.join(F.broadcast(now.agg(F.sum("d").alias("t")))).select(*_CELL, (F.col("d") / F.col("t")).alias("now"))
    c = ST.standardised(o, _CELL, "entity", "level", _weights(spark, sf_dir)).join(now, _CELL)
    mean = lambda w: F.round(100 * F.sum(F.col(w) * F.col("p")) / F.sum(w), 4)
    one = c.agg(mean("pi").alias("baseline"), mean("now").alias("current_composition"), mean("docs").alias("document_weighted"))
    family = c.groupBy("r_name").agg(F.avg("p").alias("f")).agg(F.round(100 * F.avg("f"), 4).alias("equal_family"))
    both = one.join(F.broadcast(family))
    return both.select(F.inline(F.array(*(F.struct(F.lit(n).alias("sensitivity"), F.col(n).alias("score")) for n in both.columns))))


@query("""
WITH c AS (SELECT date_trunc('day', ts)::DATE AS day, event_type, count(*) AS n FROM events GROUP BY ALL), b AS (SELECT event_type, avg(n) AS base FROM c GROUP BY 1),
k AS (SELECT c.event_type, greatest(0.0, least(2.0, n / base)) / 2 AS r FROM c JOIN b USING (event_type)), e AS (SELECT event_type, sum(r) AS s, count(*) AS days FROM k GROUP BY 1), t AS (SELECT sum(s) AS s, sum(days) AS days FROM e)
SELECT event_type AS left_out, round(100 * (t.s - e.s) / (t.days - e.days), 4) AS score FROM e, t""")
def contribution_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean activity with each platform left out: totals less its own."""
    c = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))
    r = F.greatest(F.lit(0.0), F.least(F.lit(2.0), F.col("n") / F.col("base"))) / 2
    e = c.join(c.groupBy("event_type").agg(F.avg("n").alias("base")), "event_type").groupBy("event_type").agg(F.sum(r).alias("s"), F.count("*").alias("days"))
    t = e.agg(F.sum("s").alias("ts"), F.sum("days").alias("td"))
    return e.join(F.broadcast(t)).select(F.col("event_type").alias("left_out"), F.round(100 * (F.col("ts") - F.col("s")) / (F.col("td") - F.col("days")), 4).alias("score"))


_SPLIT = "CASE WHEN h < 0.7 THEN 'train' WHEN h < 0.85 THEN 'validation' ELSE 'test' END"


@query(f"""
WITH RECURSIVE e AS (SELECT a, b FROM ({_LINKS})), u AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e),
r AS (SELECT x AS id, x AS o FROM u UNION SELECT r.id, u.y FROM r JOIN u ON u.x = r.o), g AS (SELECT id, min(o) AS component FROM r GROUP BY 1),
s AS (SELECT doc_id, coalesce(component, doc_id) AS grp FROM documents LEFT JOIN g ON id = doc_id), h AS (SELECT *, {T.bucket(DUCK, 'sha256(grp::VARCHAR)')} AS h FROM s)
SELECT doc_id, grp AS grp, {_SPLIT} AS split FROM h""")
def grouped_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near duplicates go to one of three splits, by a hash of the group: no group is in two."""
    g = near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    s = g.select("doc_id", F.col("component_id").alias("grp")).withColumn("k", F.sha2(F.col("grp").cast("string"), 256))
    return s.withColumn("h", F.expr(T.bucket(SPARK, "k"))).select("doc_id", "grp", F.expr(_SPLIT).alias("split"))


_SUBMITTED = "(SELECT doc_id AS item, CASE WHEN doc_id % 11 = 0 THEN 'nan'::DOUBLE ELSE doc_id % 7 END AS score, CASE WHEN doc_id % 13 = 0 THEN 2 ELSE 1 END AS copies FROM documents WHERE doc_id % 17 <> 0 UNION ALL SELECT -1, 0.5, 1)"


@query(f"""
WITH s AS {_SUBMITTED}, i AS (SELECT doc_id AS item FROM documents)
SELECT (SELECT count(*) FROM i WHERE item NOT IN (SELECT item FROM s))::BIGINT AS missing, (SELECT count(*) FROM s WHERE item NOT IN (SELECT item FROM i))::BIGINT AS unknown,
  (SELECT count(*) FROM s WHERE copies > 1)::BIGINT AS duplicated, (SELECT count(*) FROM s WHERE NOT isfinite(score))::BIGINT AS not_finite""")
def submission_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A submission against its items: missing, unknown and repeated ones, and scores that are no numbers, in one full join."""
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"))
    score = F.when(F.col("item") % 11 == 0, float("nan")).otherwise(F.col("item") % 7)
    given = items.filter("item % 17 <> 0").select("item", score.cast("double").alias("score"), F.explode(F.sequence(F.lit(1), F.when(F.col("item") % 13 == 0, 2).otherwise(1))).alias("copy")).drop("copy")
    given = given.unionByName(spark.createDataFrame([(-1, 0.5)], "item long, score double"))
    per = given.groupBy("item").agg(F.count("*").alias("n"), F.max(F.isnan("score") | (F.abs("score") == float("inf"))).alias("bad"))
    both = items.withColumn("known", F.lit(True)).join(per, "item", "full")
    return both.agg(F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("known").isNull()).alias("unknown"), F.count_if(F.col("n") > 1).alias("duplicated"), F.count_if("bad").alias("not_finite"))


_SERIES = (("a", "S3", "descriptive", "month", "1.2.0"), ("b", "S3", "descriptive", "month", "1.4.1"), ("c", "S3", "descriptive", "month", "2.0.0"), ("d", "S7", "descriptive", "month", "1.2.0"), ("e", "S3", "exposure_association", "month", "1.2.0"), ("f", "S3", "descriptive", "quarter", "1.2.0"))


@query(f"""
WITH s AS (SELECT * FROM (VALUES {", ".join(str(r) for r in _SERIES)}) t(id, score_id, evidence, granularity, version))
SELECT x.id AS a, y.id AS b, concat_ws(',', CASE WHEN x.score_id <> y.score_id THEN 'score' END, CASE WHEN x.evidence <> y.evidence THEN 'evidence_class' END, CASE WHEN x.granularity <> y.granularity THEN 'granularity' END,
  CASE WHEN split_part(x.version, '.', 1) <> split_part(y.version, '.', 1) THEN 'major_version' END) AS differs FROM s x JOIN s y ON x.id < y.id""")
def series_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which series may stand in one chart, and what keeps the others apart. A request names three series at most, so pairs are few."""
    s = spark.createDataFrame(_SERIES, "id string, score_id string, evidence string, granularity string, version string")
    x, y = s.alias("x"), s.alias("y")
    major = lambda a: F.split_part(f"{a}.version", F.lit("."), F.lit(1))
    differs = F.concat_ws(",", *(F.when(F.col(f"x.{c}") != F.col(f"y.{c}"), n) for c, n in (("score_id", "score"), ("evidence", "evidence_class"), ("granularity", "granularity"))), F.when(major("x") != major("y"), "major_version"))
    return x.join(y, F.col("x.id") < F.col("y.id")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), differs.alias("differs"))


@query("""
WITH RECURSIVE e AS (SELECT doc_id AS parent, doc_id * 2 AS child FROM documents WHERE doc_id > 0 UNION ALL SELECT doc_id, doc_id * 2 + 1 FROM documents WHERE doc_id > 0),
k AS (SELECT parent, child FROM e WHERE child IN (SELECT doc_id FROM documents)), r AS (SELECT 3::BIGINT AS id UNION SELECT child FROM k JOIN r ON k.parent = r.id)
SELECT id, ('0x' || substr(sha256('rehash:' || id), 1, 8))::BIGINT % 100 < 10 AS sampled FROM r""")
def lineage_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that descends from an object that must go, level by level, and which of it the integrity sample re-hashes."""
    ids = table(spark, sf_dir, "documents").select("doc_id")
    edges = ids.filter("doc_id > 0").select(F.col("doc_id").alias("parent"), F.explode(F.array(F.col("doc_id") * 2, F.col("doc_id") * 2 + 1)).alias("child"))
    edges = edges.join(ids.withColumnRenamed("doc_id", "child"), "child", "left_semi")
    from corpusloom.operators.graphs import descendants

    found = descendants(edges, spark.createDataFrame([(3,)], "id long"))
    key = F.conv(F.substring(F.sha2(F.concat(F.lit("rehash:"), F.col("id").cast("string")), 256), 1, 8), 16, 10).cast("long") % 100
    return found.select("id", (key < 10).alias("sampled"))
