"""Markov models, vocabularies, linear, centroid, lift and tree models, and their evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpusloom.functions import lexicon as X
from corpusloom.functions import states as ST
from corpusloom.functions.dialect import DUCK, SPARK
from corpusloom.operators import markov as M
from corpusloom.operators import models as MO
from corpusloom.operators import sequences as Q
from corpusloom.plans.sequences import docs, repr_, seq_sql, zipped
from corpusloom.queries import query
from corpusloom.session import written
from corpusloom.sources.tables import table

CORE = ("shape", "posish", "true_pos")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("label"))


def fit_sql(view: str, o: int) -> str:
    """Table expressions t (transitions), f (counts), k (vocabulary size) for one view and order."""
    ctx, last = " || '|' || ".join(f"z[{k}]" for k in range(1, o + 1)), f"z[{o + 1}]"
    return f"""
s AS (SELECT x.doc_id, s, quality AS label FROM {seq_sql(view)} x LEFT JOIN labels l ON l.doc_id = x.doc_id),
t AS (SELECT doc_id, label, {ctx} AS context, {last} AS next FROM (SELECT doc_id, label, unnest({zipped('s', o + 1)}) AS z FROM s)),
n AS (SELECT context, next, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM t WHERE label IS NOT NULL GROUP BY ALL),
f AS (SELECT *, sum(n0) OVER (PARTITION BY context) AS c0, sum(n1) OVER (PARTITION BY context) AS c1 FROM n),
k AS (SELECT greatest(1, count(DISTINCT x))::BIGINT AS k FROM (SELECT unnest(s) AS x FROM s WHERE label IS NOT NULL AND len(s) > {o}))"""


def _fit(spark: SparkSession, sf_dir: str, views: tuple[str, ...], orders: tuple[int, ...]) -> DataFrame:
    rows = Q.with_states(docs(spark, sf_dir).join(labels(spark, sf_dir), "doc_id"), views)
    return M.fit(rows, views, orders)


@query(f"WITH {fit_sql('shape', 1)} SELECT context, next, n0::BIGINT AS n0, n1::BIGINT AS n1, c0::BIGINT AS c0, c1::BIGINT AS c1, k FROM f, k")
def markov_fit_o1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit(spark, sf_dir, ("shape",), (1,)).select("context", "next", "n0", "n1", "c0", "c1", "k")


@query(f"WITH {fit_sql('posish', 2)} SELECT context, next, n0::BIGINT AS n0, n1::BIGINT AS n1, c0::BIGINT AS c0, c1::BIGINT AS c1, k FROM f, k")
def markov_fit_o2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit(spark, sf_dir, ("posish",), (2,)).select("context", "next", "n0", "n1", "c0", "c1", "k")


def llr_sql(view: str, o: int) -> str:
    p = lambda n, c: f"ln((coalesce({n}, 0) + 0.1) / (coalesce({c}, 0) + 0.1 * k))"
    return f"""(WITH {fit_sql(view, o)},
d AS (SELECT t.doc_id, count(*) AS n, sum({p("n1", "x.c1")}) AS l1, sum({p("n0", "x.c0")}) AS l0
  FROM t LEFT JOIN f ON f.context = t.context AND f.next = t.next LEFT JOIN (SELECT DISTINCT context, c0, c1 FROM f) x ON x.context = t.context, k GROUP BY 1)
SELECT doc_id, '{view}' AS view, {o} AS ord, coalesce(n, 0)::BIGINT AS n, round(coalesce(l1 - l0, 0), 6) AS llr_total,
  round(coalesce((l1 - l0) / greatest(1, n), 0), 6) AS llr_per_transition, round(coalesce(-l1 / greatest(1, n), 0), 6) AS class1_ce, round(coalesce(-l0 / greatest(1, n), 0), 6) AS class0_ce
FROM (SELECT doc_id FROM documents) LEFT JOIN d USING (doc_id))"""


def _score(spark: SparkSession, sf_dir: str, views: tuple[str, ...], orders: tuple[int, ...]) -> DataFrame:
    every = Q.with_states(docs(spark, sf_dir), views)
    return M.score(every, _fit(spark, sf_dir, views, orders), views, orders)


@query(f"SELECT doc_id, n, llr_total, llr_per_transition, class1_ce, class0_ce FROM {llr_sql('shape', 1)}")
def markov_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _score(spark, sf_dir, ("shape",), (1,)).drop("view", "ord")


@query(" UNION ALL ".join(f"SELECT * FROM {llr_sql(v, o)}" for v in CORE for o in (1, 2)))
def markov_llr_core_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three views, two orders: 30 numbers for each document, from one pass over the texts."""
    return _score(spark, sf_dir, CORE, (1, 2))


@query(f"""
WITH {fit_sql('coarse', 1)} SELECT context, next, n0::BIGINT AS n0, n1::BIGINT AS n1, round(ln((n1 + 0.1) / (c1 + 0.1 * k)) - ln((n0 + 0.1) / (c0 + 0.1 * k)), 6) AS log_odds
FROM f, k ORDER BY abs(round(ln((n1 + 0.1) / (c1 + 0.1 * k)) - ln((n0 + 0.1) / (c0 + 0.1 * k)), 6)) DESC, context, next LIMIT 20""")
def markov_top_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    l1, l0 = M.log_ratio()
    got = _fit(spark, sf_dir, ("coarse",), (1,)).select("context", "next", "n0", "n1", F.round(l1 - l0, 6).alias("log_odds"))
    return got.orderBy(F.desc(F.abs("log_odds")), "context", "next").limit(20)


@query(" UNION ALL ".join(f"SELECT * FROM (WITH {fit_sql(v, 1)} SELECT '{v}' AS view, k, count(*)::BIGINT AS transitions, count(DISTINCT context)::BIGINT AS contexts, sum(n0)::BIGINT AS n0, sum(n1)::BIGINT AS n1 FROM f, k GROUP BY k)" for v in CORE))
def markov_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _fit(spark, sf_dir, CORE, (1,))
    return got.groupBy("view", "k").agg(F.count("*").alias("transitions"), F.count_distinct("context").alias("contexts"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


# Sparse features in the long form (doc_id, feature, value): lower-cased words and coarse states.
_FEAT = f"""(SELECT doc_id, feature, count(*)::DOUBLE AS value FROM (
  SELECT doc_id, 'lex::' || lower(unnest({DUCK.found(repr_, X.TOK_WORD)})) AS feature FROM documents UNION ALL SELECT doc_id, 'coarse::' || unnest(s) FROM {seq_sql('coarse')}) GROUP BY ALL)"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Q.with_states(docs(spark, sf_dir), ("coarse",)).withColumn("w", Q.words())
    every = F.concat(F.split("w", ST.WAITS), Q.grams("coarse", 1))
    found = Q.exploded(rows, ("doc_id",), every, "f").filter("f <> ''").groupBy("doc_id", "f").agg(F.count("*").cast("double").alias("value"))
    state = F.ascii("f") > 127  # words are ASCII, letters of states are not
    return found.select("doc_id", F.when(state, F.concat(F.lit("coarse::"), ST.spelled(F.col("f")))).otherwise(F.concat(F.lit("lex::"), "f")).alias("feature"), "value")


_VOCAB = f"(SELECT feature, df FROM (SELECT feature, count(*)::BIGINT AS df FROM {_FEAT} GROUP BY 1) WHERE df >= 3 ORDER BY df DESC, feature LIMIT 300)"


@query(f"SELECT * FROM {_VOCAB}")
def vocab_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MO.vocabulary(features(spark, sf_dir), 300, 3)


_MOMENTS = f"""(SELECT feature, df, sum(value) / n AS mean, CASE WHEN sqrt(greatest(0, sum(value * value) / n - (sum(value) / n) * (sum(value) / n))) = 0 THEN 1 ELSE sqrt(greatest(0, sum(value * value) / n - (sum(value) / n) * (sum(value) / n))) END AS std
FROM {_FEAT} JOIN {_VOCAB} USING (feature), (SELECT count(*) AS n FROM documents) GROUP BY feature, df, n)"""


@query(f"SELECT feature, df, round(mean, 6) AS mean, round(std, 6) AS std FROM {_MOMENTS}")
def feature_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = written(features(spark, sf_dir), "features")  # read twice
    got = MO.moments(f, MO.vocabulary(f, 300, 3), docs(spark, sf_dir).select("doc_id"))
    return got.select("feature", "df", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


# A fixed linear model: the weight of a feature follows from the length of its name, so that both engines agree.
_WEIGHTS = f"(SELECT *, ((length(feature) % 7) - 3) * 0.05 AS w FROM {_MOMENTS})"
_LINEAR = f"""(WITH m AS {_WEIGHTS}, b AS (SELECT 0.1 - sum(mean / std * w) AS base FROM m)
SELECT d.doc_id, base + coalesce(delta, 0) AS raw, 1 / (1 + exp(-greatest(-40, least(40, base + coalesce(delta, 0))))) AS probability, coalesce(active, 0)::BIGINT AS active
FROM documents d LEFT JOIN (SELECT doc_id, sum(value / std * w) AS delta, count(*) AS active FROM {_FEAT} JOIN m USING (feature) GROUP BY 1) USING (doc_id), b)"""


def _linear(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    f = written(features(spark, sf_dir), "features")  # read for the vocabulary, the moments and the scores
    m = MO.moments(f, MO.vocabulary(f, 300, 3), docs(spark, sf_dir).select("doc_id"))
    weights = m.withColumn("w", (F.length("feature") % 7 - 3) * F.lit(0.05))
    return MO.linear_scores(docs(spark, sf_dir).select("doc_id"), f, weights, 0.1), f, weights


@query(f"SELECT doc_id, round(raw, 6) AS logit, round(probability, 6) AS probability, active FROM {_LINEAR}")
def linear_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _linear(spark, sf_dir)[0].select("doc_id", F.round("raw", 6).alias("logit"), F.round("probability", 6).alias("probability"), "active")


@query(f"""
WITH c AS (SELECT doc_id, feature, round((value - mean) / std * w, 6) AS contribution FROM {_FEAT} JOIN {_WEIGHTS} USING (feature))
SELECT doc_id, feature, contribution, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY abs(contribution) DESC, feature) AS place FROM c) WHERE place <= 5""")
def linear_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, f, weights = _linear(spark, sf_dir)
    c = f.join(F.broadcast(weights), "feature").select("doc_id", "feature", F.round((F.col("value") - F.col("mean")) / F.col("std") * F.col("w"), 6).alias("contribution"))
    place = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc(F.abs("contribution")), "feature"))
    return c.withColumn("place", place).filter("place <= 5")


_PRED = f"(SELECT doc_id, lang, source, quality::INT AS actual, round(probability, 6) AS p FROM {_LINEAR} JOIN documents USING (doc_id) JOIN labels USING (doc_id))"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, actual, p: probabilities are rounded before any threshold is applied."""
    scored = _linear(spark, sf_dir)[0].select("doc_id", F.round("probability", 6).alias("p"))
    return scored.join(docs(spark, sf_dir).select("doc_id", "lang", "source"), "doc_id").join(labels(spark, sf_dir).withColumnRenamed("label", "actual"), "doc_id")


_SWEEP = f"""(SELECT threshold, count(*) FILTER (actual = 1 AND p >= threshold)::BIGINT AS tp, count(*) FILTER (actual = 0 AND p >= threshold)::BIGINT AS fp,
count(*) FILTER (actual = 0 AND p < threshold)::BIGINT AS tn, count(*) FILTER (actual = 1 AND p < threshold)::BIGINT AS fn
FROM {_PRED}, (SELECT unnest([0.3, 0.4, 0.5, 0.6, 0.7, 0.8])::DOUBLE AS threshold) GROUP BY 1)"""


@query(f"""SELECT *, round((tp + tn) / greatest(1, tp + fp + tn + fn), 6) AS accuracy, round(tp / greatest(1, tp + fn), 6) AS recall, round(fp / greatest(1, fp + tn), 6) AS fpr,
round(4 * (fp / greatest(1, fp + tn)) + fn / greatest(1, tp + fn), 6) AS cost FROM {_SWEEP}""")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MO.sweep(predictions(spark, sf_dir), (0.3, 0.4, 0.5, 0.6, 0.7, 0.8))


@query(f"""
SELECT field, value, count(*)::BIGINT AS n, count(*) FILTER (ok)::BIGINT AS correct, round(count(*) FILTER (ok) / count(*), 6) AS accuracy, count(*) FILTER (actual = 1)::BIGINT AS positives, count(*) FILTER (p >= 0.5)::BIGINT AS predicted
FROM (SELECT *, (p >= 0.5) = (actual = 1) AS ok, unnest(['lang', 'source']) AS field, unnest([lang, source]) AS value FROM {_PRED}) GROUP BY ALL""")
def confusion_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MO.grouped_metrics(predictions(spark, sf_dir), ["lang", "source"], 0.5)


@query(f"""
WITH s AS (SELECT lang AS split, count(*) FILTER (actual = 1 AND p >= 0.5) / greatest(1, count(*) FILTER (actual = 1)) AS recall, count(*) FILTER (actual = 0 AND p >= 0.5) / greatest(1, count(*) FILTER (actual = 0)) AS fpr FROM {_PRED} GROUP BY 1),
r AS (SELECT unnest(['en', 'de', 'fr', 'missing']) AS split)
SELECT r.split, round(recall, 6) AS recall, round(fpr, 6) AS fpr, coalesce(recall > 0.8 AND fpr < 0.2, false) AS passes FROM r LEFT JOIN s USING (split)""")
def operating_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall above .80 and false positives below .20 in every required split; a missing split fails."""
    p = predictions(spark, sf_dir)
    hit, one = F.col("p") >= 0.5, F.col("actual") == 1
    share = lambda a, b: F.count_if(a) / F.greatest(F.lit(1), F.count_if(b))
    s = p.groupBy(F.col("lang").alias("split")).agg(share(one & hit, one).alias("recall"), share(~one & hit, ~one).alias("fpr"))
    need = spark.createDataFrame([(x,) for x in ("en", "de", "fr", "missing")], "split string")
    return need.join(s, "split", "left").select("split", F.round("recall", 6).alias("recall"), F.round("fpr", 6).alias("fpr"), F.coalesce((F.col("recall") > 0.8) & (F.col("fpr") < 0.2), F.lit(False)).alias("passes"))


@query("""
SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(source) = 0 THEN 'source' ELSE 'all' END AS field, coalesce(lang, source, 'all') AS value, quality::INT AS label, count(*)::BIGINT AS n
FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((lang, quality), (source, quality), (quality))""")
def source_summary_gs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).select("doc_id", "lang", "source").join(labels(spark, sf_dir), "doc_id")
    got = rows.groupingSets([[F.col("lang"), F.col("label")], [F.col("source"), F.col("label")], [F.col("label")]], "lang", "source", "label").agg(F.count("*").alias("n"), F.grouping("lang").alias("gl"), F.grouping("source").alias("gs"))
    return got.select(F.when(F.col("gl") == 0, "lang").when(F.col("gs") == 0, "source").otherwise("all").alias("field"), F.coalesce("lang", "source", F.lit("all")).alias("value"), "label", "n")


_CENT = "(SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)"


@query(f"""
WITH c AS (SELECT label, i, sum(x) AS s, count(*) AS n FROM {_CENT} GROUP BY ALL),
d AS (SELECT v.vec_id, v.label, c.label AS centroid, round(sum((x - s / n) * (x - s / n)), 9) AS d2 FROM {_CENT} v JOIN c USING (i) GROUP BY 1, 2, 3)
SELECT vec_id, label, arg_min(centroid, d2 * 1000000 + centroid * 1e-9) AS nearest, round(min(d2), 5) AS d2 FROM d GROUP BY ALL""")
def centroid_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest class centroid by squared distance; ties go to the lower label. Centroids are a few rows of means."""
    return MO.nearest_centroid(table(spark, sf_dir, "embeddings"), leave_one_out=False)


@query(f"""
WITH c AS (SELECT label, i, sum(x) AS s, count(*) AS n FROM {_CENT} GROUP BY ALL),
d AS (SELECT v.vec_id, v.label, c.label AS centroid, round(sum(CASE WHEN c.label = v.label THEN (x - (s - x) / greatest(1, n - 1)) ELSE (x - s / n) END * CASE WHEN c.label = v.label THEN (x - (s - x) / greatest(1, n - 1)) ELSE (x - s / n) END), 9) AS d2
  FROM {_CENT} v JOIN c USING (i) WHERE NOT (c.label = v.label AND n = 1) GROUP BY 1, 2, 3)
SELECT vec_id, label, arg_min(centroid, d2 * 1000000 + centroid * 1e-9) AS nearest, round(min(d2), 5) AS d2 FROM d GROUP BY ALL""")
def loo_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leave-one-out: a class's own total without the row, one pass."""
    return MO.nearest_centroid(table(spark, sf_dir, "embeddings"), leave_one_out=True)


_FORM = f"(SELECT DISTINCT doc_id, 'state:' || s AS feature FROM (SELECT doc_id, unnest(s) AS s FROM {seq_sql('motif')}))"
_LIFT = f"""(WITH n AS (SELECT count(*) FILTER (quality = 1) AS n1, count(*) FILTER (quality = 0) AS n0 FROM documents JOIN labels USING (doc_id) WHERE text <> ''),
c AS (SELECT feature, count(*) FILTER (quality = 1) AS ai, count(*) FILTER (quality = 0) AS human FROM {_FORM} JOIN labels USING (doc_id) GROUP BY 1)
SELECT feature, ai::BIGINT AS ai, human::BIGINT AS human, ((ai + 1) / (n1 + 2)) / CASE WHEN n0 > 0 THEN (human + 1) / (n0 + 2) ELSE 1 / (n1 + 2) END AS lift FROM c, n)"""


def _lift(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = Q.with_states(docs(spark, sf_dir), ("motif",))
    f = Q.exploded(rows, ("doc_id",), F.array_distinct(Q.grams("motif", 1)), "s").select("doc_id", F.concat(F.lit("state:"), ST.spelled(F.col("s"))).alias("feature"))
    counted = docs(spark, sf_dir).filter("text <> ''").select("doc_id").join(labels(spark, sf_dir), "doc_id")
    return MO.lift(f, counted), f


@query(f"SELECT feature, ai, human, round(lift, 6) AS lift FROM {_LIFT}")
def lift_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lift(spark, sf_dir)[0].withColumn("lift", F.round("lift", 6))


@query(f"SELECT feature, ai, round(lift, 6) AS lift FROM {_LIFT} WHERE lift >= 1 ORDER BY round(lift, 6) DESC, ai DESC, feature LIMIT 10")
def lift_mined(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _lift(spark, sf_dir)[0].filter("lift >= 1").select("feature", "ai", F.round("lift", 6).alias("lift"))
    return got.orderBy(F.desc("lift"), F.desc("ai"), "feature").limit(10)


@query(f"""
WITH c AS (SELECT doc_id, CASE WHEN lift > 1 THEN least(28, round_even((lift - 1) * 16, 0)) WHEN lift < 1 THEN -least(18, round_even((1 - lift) * 16, 0)) ELSE 0 END AS v FROM {_FORM} JOIN {_LIFT} USING (feature)),
s AS (SELECT d.doc_id, greatest(0, least(100, 50 + coalesce(sum(v), 0)))::INT AS score FROM documents d LEFT JOIN c USING (doc_id) GROUP BY 1)
SELECT doc_id, score, CASE WHEN score >= 80 THEN 'high' WHEN score >= 55 THEN 'medium' ELSE 'low' END AS band FROM s""")
def lift_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, f = _lift(spark, sf_dir)
    return MO.lift_scores(docs(spark, sf_dir).select("doc_id"), f, model)


@query("""
WITH f AS (SELECT doc_id, length(coalesce(text, ''))::DOUBLE AS chars, len(regexp_extract_all(coalesce(text, ''), '[0-9]'))::DOUBLE AS digits, len(regexp_extract_all(coalesce(text, ''), '[A-Z]'))::DOUBLE AS capitals FROM documents),
t AS (SELECT doc_id, CASE WHEN chars = 0 OR chars < 1200 THEN CASE WHEN digits <> 0 AND digits < 4 THEN -0.4 ELSE 0.3 END ELSE CASE WHEN capitals = 0 OR capitals < 60 THEN 0.5 ELSE -0.6 END END
  + CASE WHEN digits <> 0 AND digits < 10 THEN -0.2 ELSE 0.25 END AS m FROM f)
SELECT doc_id, round(m::DOUBLE, 6) AS margin, round(1 / (1 + exp(-m::DOUBLE)), 6) AS probability FROM t""")
def tree_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two fixed trees in the JSON layout of a boosted ensemble, walked level by level; absent and zero take the default branch."""
    trees = {
        "learner": {"learner_model_param": {"base_score": "[5E-1]"}},
        "trees": [
            {"left_children": [1, 3, 5, -1, -1, -1, -1], "right_children": [2, 4, 6, -1, -1, -1, -1], "default_left": [1, 0, 1, 0, 0, 0, 0], "split_indices": [0, 1, 2, 0, 0, 0, 0], "split_conditions": [1200.0, 4.0, 60.0, -0.4, 0.3, 0.5, -0.6], "base_weights": [0.0, 0.0, 0.0, -0.4, 0.3, 0.5, -0.6]},
            {"left_children": [1, -1, -1], "right_children": [2, -1, -1], "default_left": [0, 0, 0], "split_indices": [1, 0, 0], "split_conditions": [10.0, -0.2, 0.25], "base_weights": [0.0, -0.2, 0.25]},
        ],
    }
    text = F.coalesce("text", F.lit(""))
    rows = docs(spark, sf_dir).select("doc_id", F.array(F.length(text).cast("double"), F.regexp_count(text, F.lit("[0-9]")).cast("double"), F.regexp_count(text, F.lit("[A-Z]")).cast("double")).alias("x"))
    return MO.tree_scores(rows, trees).select("doc_id", F.round("margin", 6).alias("margin"), F.round("probability", 6).alias("probability"))


_E = "(SELECT doc_id, length(text) / 1000.0::DOUBLE AS a, len(regexp_extract_all(text, '[.!?]')) / 10.0::DOUBLE AS b, quality::DOUBLE AS y FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL)"


def _epochs(k: int) -> str:
    """Gradient descent on two standardised features, unrolled: one subquery per epoch."""
    z = f"(SELECT doc_id, y, (a - avg(a) OVER ()) / stddev_pop(a) OVER () AS a, (b - avg(b) OVER ()) / stddev_pop(b) OVER () AS b, count(*) OVER () AS n FROM {_E})"
    w = "(SELECT 0.0::DOUBLE AS w0, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2)"
    for _ in range(k):
        w = f"(SELECT any_value(w0) - 0.5 * avg(e) AS w0, any_value(w1) - 0.5 * (avg(e * a) + 0.01 * any_value(w1)) AS w1, any_value(w2) - 0.5 * (avg(e * b) + 0.01 * any_value(w2)) AS w2 FROM (SELECT *, 1 / (1 + exp(-(w0 + w1 * a + w2 * b))) - y AS e FROM {z}, {w}))"
    return f"SELECT 'bias' AS feature, round(w0, 6) AS weight FROM {w} UNION ALL SELECT 'length', round(w1, 6) FROM {w} UNION ALL SELECT 'sentences', round(w2, 6) FROM {w}"


@query(_epochs(3))
def logreg_exact_k_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logistic regression by full-batch gradient descent, L2 on the weights, from zero, three epochs."""
    text = F.col("text")
    rows = docs(spark, sf_dir).filter("text is not null").join(labels(spark, sf_dir), "doc_id").select("doc_id", F.col("label").cast("double").alias("y"), (F.length(text) / 1000.0).alias("length"), (F.regexp_count(text, F.lit("[.!?]")) / 10.0).alias("sentences"))
    long = rows.select("doc_id", F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in ("length", "sentences")))).alias("f")).select("doc_id", "f.*")
    w, bias = MO.gradient_descent(rows.select("doc_id", "y"), long, epochs=3, rate=0.5, l2=0.01)
    return spark.createDataFrame([("bias", round(bias, 6)), *((k, round(v, 6)) for k, v in w.items())], "feature string, weight double")
