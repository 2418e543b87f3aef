"""Vocabularies, standardisation and the models that score sparse features in the long form.

Vocabularies and weights are joined without a hint: adaptive execution broadcasts a side whose size it has
measured, and shuffles beyond its threshold. Only single rows of totals are broadcast by hint.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def vocabulary(features: DataFrame, limit: int, least: int = 1) -> DataFrame:
    """The features with the highest document frequency; ties by name. Rows are one per document and feature, so a count is the frequency."""
    return features.groupBy("feature").agg(F.count("*").alias("df")).filter(F.col("df") >= least).orderBy(F.desc("df"), "feature").limit(limit)


def moments(features: DataFrame, vocab: DataFrame, docs: DataFrame) -> DataFrame:
    """Mean and population deviation over all documents, absent values being zero; a deviation of 0 counts as 1."""
    n = docs.agg(F.count("*").alias("n"))
    sums = features.join(vocab, "feature").groupBy("feature", "df").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    mean = F.col("s") / F.col("n")
    std = F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - mean * mean))
    return sums.join(F.broadcast(n)).select("feature", "df", mean.alias("mean"), F.when(std == 0, 1.0).otherwise(std).alias("std"))


def linear_scores(docs: DataFrame, features: DataFrame, weights: DataFrame, bias: float) -> DataFrame:
    """Every feature of the model counts: absent ones give a constant, active ones add their difference to it."""
    base = weights.agg((F.lit(bias) - F.sum(F.col("mean") / F.col("std") * F.col("w"))).alias("base"))
    delta = features.join(weights, "feature").groupBy("doc_id").agg(F.sum(F.col("value") / F.col("std") * F.col("w")).alias("delta"), F.count("*").alias("active"))
    raw = F.col("base") + F.coalesce("delta", F.lit(0.0))
    clamped = F.greatest(F.lit(-40.0), F.least(F.lit(40.0), raw))
    return docs.join(delta, "doc_id", "left").join(F.broadcast(base)).select("doc_id", raw.alias("raw"), (1 / (1 + F.exp(-clamped))).alias("probability"), F.coalesce("active", F.lit(0)).alias("active"))


def sweep(predictions: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """One pass: each prediction meets the few thresholds as an array, and counts are combined before the shuffle."""
    hit, one = F.col("p") >= F.col("threshold"), F.col("actual") == 1
    rows = predictions.select("p", "actual", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    c = rows.groupBy("threshold").agg(F.count_if(one & hit).alias("tp"), F.count_if(~one & hit).alias("fp"), F.count_if(~one & ~hit).alias("tn"), F.count_if(one & ~hit).alias("fn"))
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    part = lambda a, b: a / F.greatest(F.lit(1), b)
    return c.select("*", F.round(part(tp + tn, tp + fp + tn + fn), 6).alias("accuracy"), F.round(part(tp, tp + fn), 6).alias("recall"), F.round(part(fp, fp + tn), 6).alias("fpr"), F.round(4 * part(fp, fp + tn) + part(fn, tp + fn), 6).alias("cost"))


def grouped_metrics(predictions: DataFrame, fields: list[str], threshold: float) -> DataFrame:
    hit, one = F.col("p") >= threshold, F.col("actual") == 1
    sets = [[F.col(f)] for f in fields]
    got = predictions.groupingSets(sets, *fields).agg(
        F.count("*").alias("n"), F.count_if(hit == one).alias("correct"), F.round(F.count_if(hit == one) / F.count("*"), 6).alias("accuracy"),
        F.count_if(one).alias("positives"), F.count_if(hit).alias("predicted"), *(F.grouping(f).alias(f"_{f}") for f in fields),
    )
    name = F.coalesce(*(F.when(F.col(f"_{f}") == 0, f) for f in fields))
    return got.select(name.alias("field"), F.coalesce(*(F.when(F.col(f"_{f}") == 0, F.col(f)) for f in fields)).alias("value"), "n", "correct", "accuracy", "positives", "predicted")


def nearest_centroid(vectors: DataFrame, leave_one_out: bool) -> DataFrame:
    """Distances by position within the row; only the centroids, a row for each class, are broadcast."""
    x = vectors.select("vec_id", "label", F.transform("embedding", lambda e: e.cast("double")).alias("x"))
    at = x.select("label", F.posexplode("x").alias("i", "v")).groupBy("label", "i").agg(F.sum("v").alias("s"))
    n = x.groupBy("label").agg(F.count("*").alias("n"))
    c = at.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda r: r["s"]).alias("s")).join(n, "label").withColumnRenamed("label", "centroid")
    own = F.col("centroid") == F.col("label")
    pairs = x.join(F.broadcast(c))
    if leave_one_out:
        pairs = pairs.filter(~(own & (F.col("n") == 1)))
        mean = lambda s, v: F.when(own, (s - v) / F.greatest(F.lit(1), F.col("n") - 1)).otherwise(s / F.col("n"))
    else:
        mean = lambda s, v: s / F.col("n")
    diff = F.zip_with("x", "s", lambda v, s: (v - mean(s, v)) * (v - mean(s, v)))
    d2 = F.round(F.aggregate(diff, F.lit(0.0), lambda a, v: a + v), 9)
    best = pairs.select("vec_id", "label", "centroid", d2.alias("d2")).groupBy("vec_id", "label").agg(F.min(F.struct("d2", "centroid")).alias("b"))
    return best.select("vec_id", "label", F.col("b.centroid").alias("nearest"), F.round("b.d2", 5).alias("d2"))


def lift(features: DataFrame, labelled: DataFrame) -> DataFrame:
    """((ai + 1) / (n1 + 2)) / ((human + 1) / (n0 + 2)) of document counts; without documents of class 0 the divisor is 1 / (n1 + 2)."""
    n = labelled.agg(F.count_if(F.col("label") == 1).alias("n1"), F.count_if(F.col("label") == 0).alias("n0"))
    c = features.join(labelled, "doc_id").groupBy("feature").agg(F.count_if(F.col("label") == 1).alias("ai"), F.count_if(F.col("label") == 0).alias("human"))
    below = F.when(F.col("n0") > 0, (F.col("human") + 1) / (F.col("n0") + 2)).otherwise(1 / (F.col("n1") + 2))
    return c.join(F.broadcast(n)).select("feature", "ai", "human", (((F.col("ai") + 1) / (F.col("n1") + 2)) / below).alias("lift"))


def lift_scores(docs: DataFrame, features: DataFrame, model: DataFrame, groundings: DataFrame | None = None) -> DataFrame:
    """50 plus bounded gains and losses of a document's distinct features, less 4 for each grounding (doc_id, groundings), within 0 to 100.

    An unseen feature adds nothing.
    """
    value = F.when(F.col("lift") > 1, F.least(F.lit(28.0), F.bround((F.col("lift") - 1) * 16))).when(F.col("lift") < 1, -F.least(F.lit(18.0), F.bround((1 - F.col("lift")) * 16))).otherwise(0.0)
    sums = features.join(model, "feature").groupBy("doc_id").agg(F.sum(value).alias("v"))
    if groundings is not None:
        sums = sums.join(groundings, "doc_id", "full").select("doc_id", (F.coalesce("v", F.lit(0.0)) - 4 * F.coalesce("groundings", F.lit(0))).alias("v"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 50 + F.coalesce("v", F.lit(0.0)))).cast("int")
    return docs.join(sums, "doc_id", "left").select("doc_id", score.alias("score")).withColumn("band", F.when(F.col("score") >= 80, "high").when(F.col("score") >= 55, "medium").otherwise("low"))


def tree_scores(rows: DataFrame, model: dict) -> DataFrame:
    """margin and probability from column ``x`` (an array of double, or a map from place to double) by a boosted ensemble in its JSON layout.

    Each tree becomes one nested CASE, which Spark compiles; leaves are read from ``base_weights``. A value that is
    absent or zero goes the default way, a value below the condition to the left.
    """

    first = 0 if rows.schema["x"].dataType.typeName() == "map" else 1

    def node(tree: dict, k: int) -> Column:
        left, right = tree["left_children"][k], tree["right_children"][k]
        if left < 0:
            return F.lit(float(tree["base_weights"][k]))
        value = F.try_element_at(F.col("x"), F.lit(int(tree["split_indices"][k]) + first))
        missing = value.isNull() | (value == 0) | F.isnan(value)
        goes_left = F.when(missing, F.lit(bool(tree["default_left"][k]))).otherwise(value < float(tree["split_conditions"][k]))
        return F.when(goes_left, node(tree, left)).otherwise(node(tree, right))

    base = float(model["learner"]["learner_model_param"]["base_score"].strip("[]"))
    base = min(1 - 1e-9, max(1e-9, base))
    margin = F.lit(math.log(base / (1 - base)))
    for tree in model["trees"]:
        margin = margin + node(tree, 0)
    return rows.withColumn("margin", margin).withColumn("probability", 1 / (1 + F.exp(-F.col("margin"))))


def gradient_descent(rows: DataFrame, features: DataFrame, epochs: int, rate: float, l2: float) -> tuple[dict[str, float], float]:
    """Weights on standardised features, and bias, from zero. A row for each feature comes back per epoch.

    Absent values are zeros; their share of each gradient is a constant, so only stored values are read.
    """
    n = rows.count()
    m = {r["feature"]: r for r in moments(features.withColumn("df", F.lit(0)).drop("df"), features.groupBy("feature").agg(F.count("*").alias("df")), rows).collect()}
    weights, bias = dict.fromkeys(m, 0.0), 0.0
    spark = rows.sparkSession
    kept = rows.select("doc_id", "y").join(features, "doc_id", "left").cache()  # read once per epoch
    for _ in range(epochs):
        base = bias - sum(weights[k] * r["mean"] / r["std"] for k, r in m.items())
        w = spark.createDataFrame([(k, weights[k] / r["std"]) for k, r in m.items()], "feature string, w double")
        scored = kept.join(F.broadcast(w), "feature", "left")
        error = scored.groupBy("doc_id", "y").agg((F.lit(base) + F.coalesce(F.sum(F.col("value") * F.col("w")), F.lit(0.0))).alias("raw")).select("doc_id", (1 / (1 + F.exp(-F.col("raw"))) - F.col("y")).alias("e"))
        total = error.agg(F.sum("e")).first()[0]
        own = {r["feature"]: r["g"] for r in kept.join(error, "doc_id").groupBy("feature").agg(F.sum(F.col("value") * F.col("e")).alias("g")).collect()}
        for k, r in m.items():
            gradient = (own.get(k, 0.0) - r["mean"] * total) / r["std"] / n + l2 * weights[k]
            weights[k] -= rate * gradient
        bias -= rate * total / n
    kept.unpersist()
    return dict(sorted(weights.items())), bias
