"""Scoring of texts: label, probability, what contributed, chunks, and what the chunks say together.

A model is a small object on the driver: a vocabulary with weights, or trees with gains. Its vocabulary prunes
the features of a text before anything is joined; the model's side of each join has a row for each feature and
is broadcast below ``BROADCAST`` features, else joined.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpusloom.functions import lexicon as X
from corpusloom.operators import chunking as C
from corpusloom.operators import features as FE
from corpusloom.operators import models as MO
from corpusloom.session import written

BROADCAST = 200_000
CHUNK = "_chunk"


@dataclass
class Model:
    """A linear model (weights, means, stds, bias) or boosted trees (their JSON, gains), and what the descriptor says."""

    model_id: str
    method: str
    trainer: str
    vocab: list[str]
    threshold: float = 0.6
    weights: list[float] = field(default_factory=list)
    means: list[float] = field(default_factory=list)
    stds: list[float] = field(default_factory=list)
    bias: float = 0.0
    trees: dict = field(default_factory=dict)
    gains: dict[str, float] = field(default_factory=dict)
    views: tuple[str, ...] = ()

    @staticmethod
    def read(model: str, descriptor: str = "{}", metadata: str = "{}", name: str = "model") -> Model:
        """From the JSON texts of a model, its descriptor and its metadata; a descriptor's entry wins over the metadata's."""
        m, d, meta = json.loads(model), json.loads(descriptor), json.loads(metadata)
        trainer = d.get("trainer") or meta.get("trainer") or ("lr" if "weights" in m else "xgboost")
        common = {
            "model_id": d.get("modelVersion") or name, "method": d.get("primaryMethod") or meta.get("method") or "lexical_shape_plus_markov", "trainer": trainer,
            "threshold": float((d.get("decisionPolicy") or {}).get("threshold", 0.6)), "views": tuple((d.get("featureSource") or {}).get("markovViews") or ()),
        }
        if trainer == "xgboost":
            learner = m["learner"]
            trees = {"learner": {"learner_model_param": learner["learner_model_param"]}, "trees": learner["gradient_booster"]["model"]["trees"]}
            gains = {r["feature"]: float(r.get("gain") or 0) for r in meta.get("feature_importance", {}).get("by_gain", [])}
            return Model(**common, vocab=list(meta.get("vocab", [])), trees=trees, gains=gains)
        return Model(**common, vocab=list(m["vocab"]), weights=m["weights"], means=m["means"], stds=[s or 1.0 for s in m["stds"]], bias=float(m["bias"]))


def families(model: Model, markov: DataFrame | None) -> tuple[str, ...] | None:
    """Which Markov views the vocabulary asks for; () for none of them."""
    views = FE.markov_views(model.vocab, model.method, model.views)
    return () if markov is None else views


def warnings(model: Model, markov: DataFrame | None) -> list[str]:
    return ["surface_markov_features_unavailable"] if markov is None and FE.markov_views(model.vocab, model.method) != () else []


def features(docs: DataFrame, model: Model, markov: DataFrame | None = None) -> DataFrame:
    """doc_id, feature, value, place (in the vocabulary) for the features that the model knows and a text has."""
    known = docs.sparkSession.createDataFrame([(f, k) for k, f in enumerate(model.vocab)], "feature string, place int")
    known = F.broadcast(known) if len(model.vocab) <= BROADCAST else known
    begins = {f.split("::")[0] for f in model.vocab}
    parts = [make(docs, model.vocab) for name, make in (("lex", FE.lexical), ("style", FE.style)) if name in begins]
    if begins & {"toktype", "posish", "shape"}:
        parts.append(FE.shape(docs, model.vocab))
    views = families(model, markov)
    if views != ():
        parts.append(FE.surface(docs, markov, views))
    if not parts:
        return docs.select("doc_id", F.lit("").alias("feature"), F.lit(0.0).alias("value"), F.lit(0).alias("place")).limit(0)
    return FE.reduce(DataFrame.unionByName, parts).filter("value <> 0").join(known, "feature")


def family(feature: Column) -> Column:
    """The family that a feature's name begins with."""
    of = lambda *prefixes: FE.reduce(lambda a, b: a | b, (F.startswith(feature, F.lit(p)) for p in prefixes))
    return F.when(of("lex::", "style::"), "lexical_style").when(of("toktype::", "posish::", "shape::"), "shape_ngrams").when(of("markov::", "seqng::", "semantic::"), "surface_markov").otherwise("other")


def confidence(probability: Column, threshold: Column) -> Column:
    distance = F.abs(probability - threshold)
    return F.when(distance >= 0.25, "high").when(distance >= 0.12, "medium").otherwise("low")


def score_texts(docs: DataFrame, model: Model, markov: DataFrame | None = None, top: int = 12) -> DataFrame:
    """doc_id, available, model_id, method, trainer, probability, likelihood, label, threshold, confidence, top_features, feature_count, warnings."""
    spark, found = docs.sparkSession, written(features(docs, model, markov), "found")  # read three times
    if model.trainer == "xgboost":
        per = found.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("place", "value"))).alias("x"))
        none = F.create_map().cast("map<int,double>")
        raw = MO.tree_scores(docs.select("doc_id").join(per, "doc_id", "left").withColumn("x", F.coalesce("x", none)), model.trees).select("doc_id", "probability")
        gains = spark.createDataFrame([(k, model.gains.get(f, 0.0)) for k, f in enumerate(model.vocab)], "place int, gain double").filter("gain > 0")
        part = found.join(F.broadcast(gains) if len(model.vocab) <= BROADCAST else gains, "place").withColumn("size", F.col("gain"))
        item = F.struct("feature", family(F.col("feature")).alias("family"), F.round("value", 6).alias("value"), F.round("gain", 6).alias("weight"), F.lit(None).cast("double").alias("contribution"), F.lit("model_signal").alias("direction"))
    else:
        rows = list(zip(model.vocab, range(len(model.vocab)), model.weights, model.means, model.stds, strict=True))
        w = spark.createDataFrame([(f, k, float(a), float(m), float(s)) for f, k, a, m, s in rows], "feature string, place int, w double, mean double, std double")
        raw = MO.linear_scores(docs.select("doc_id"), found.drop("place"), w, model.bias).select("doc_id", "probability")
        share = (F.col("value") - F.col("mean")) / F.col("std") * F.col("w")
        part = found.join(F.broadcast(w.drop("feature")) if len(rows) <= BROADCAST else w.drop("feature"), "place").withColumn("c", share).withColumn("size", F.abs("c"))
        item = F.struct("feature", family(F.col("feature")).alias("family"), F.round("value", 6).alias("value"), F.round("w", 6).alias("weight"), F.round("c", 6).alias("contribution"), F.when(F.col("c") >= 0, "ai_generated").otherwise("human_written").alias("direction"))
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("size"), "place"))
    best = part.withColumn("rank", rank).filter(F.col("rank") <= top).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", item.alias("item")))).alias("t"))
    best = best.select("doc_id", F.transform("t", lambda t: t["item"]).alias("top_features"))
    active = found.groupBy("doc_id").agg(F.count("*").alias("feature_count"))
    p, threshold = F.col("probability"), F.lit(model.threshold)
    got = raw.join(best, "doc_id", "left").join(active, "doc_id", "left")
    return got.select(
        "doc_id", F.lit(True).alias("available"), F.lit(model.model_id).alias("model_id"), F.lit(model.method).alias("method"), F.lit(model.trainer).alias("trainer"),
        F.round(p, 6).alias("probability"), F.greatest(F.lit(0), F.least(F.lit(100), F.bround(p * 100))).cast("int").alias("likelihood"),
        F.when(p >= threshold, "ai_generated").otherwise("human_written").alias("label"), threshold.alias("threshold"), confidence(p, threshold).alias("confidence"),
        F.coalesce("top_features", F.array()).alias("top_features"), F.coalesce("feature_count", F.lit(0)).cast("long").alias("feature_count"),
        F.array(*map(F.lit, warnings(model, markov))).cast("array<string>").alias("warnings"),
    )


def score_chunks(docs: DataFrame, model: Model, markov: DataFrame | None = None) -> DataFrame:
    """The chunks of each document with probability, likelihood, label, confidence and top features of each chunk by itself, and a preview."""
    cut = written(C.chunks(docs), "chunks").withColumn(CHUNK, F.concat_ws(":", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")))
    scored = score_texts(cut.select(F.col(CHUNK).alias("doc_id"), "text"), model, markov, top=4)
    scored = scored.select(F.col("doc_id").alias(CHUNK), "probability", "likelihood", "label", "confidence", "top_features")
    preview = F.substring(F.trim(F.regexp_replace("text", f"[{X.SPACE}]+", " ")), 1, 220)
    return cut.join(scored, CHUNK).withColumn("preview", preview).drop(CHUNK, "text")


def mixed(chunks: DataFrame) -> DataFrame:
    """doc_id and what its chunks say together: counts, share of words, range of likelihoods, changes of label, classification, strongest chunks."""
    ai = F.col("label") == "ai_generated"
    before = F.lag("label").over(W.partitionBy("doc_id").orderBy("chunk_index"))
    strong = F.struct((-F.col("likelihood")).alias("by"), "chunk_index", "likelihood")
    weak = F.struct(F.col("likelihood").alias("by"), "chunk_index", "likelihood")
    first = lambda x: F.transform(F.slice(F.array_sort(x), 1, 3), lambda c: F.struct(c["chunk_index"].alias("chunk_index"), c["likelihood"].alias("likelihood")))
    s = chunks.withColumn("turn", F.col("label") != before).groupBy("doc_id").agg(
        F.count("*").alias("chunks"), F.count_if(ai).alias("ai_chunks"), F.sum("words").alias("words"), F.sum(F.when(ai, F.col("words")).otherwise(0)).alias("ai_words"),
        F.min("likelihood").alias("least"), F.max("likelihood").alias("most"), F.count_if("turn").alias("label_transitions"),
        first(F.collect_list(F.when(ai, strong))).alias("strong_ai"), first(F.collect_list(F.when(~ai, weak))).alias("strong_human"),
    )
    share, contrast = F.col("ai_words") / F.greatest(F.lit(1), F.col("words")), F.col("most") - F.col("least")
    both = (F.col("ai_chunks") > 0) & (F.col("ai_chunks") < F.col("chunks"))
    kind = F.when(both & (contrast >= 25) & share.between(0.15, 0.85), "mixed_ai_and_human").when(share >= 0.75, "mostly_ai_like").when(share <= 0.25, "mostly_human_like").otherwise("mixed_or_uncertain")
    return s.select(
        "doc_id", kind.alias("classification"), "chunks", "ai_chunks", (F.col("chunks") - F.col("ai_chunks")).alias("human_chunks"), F.round(share, 4).alias("ai_word_share"),
        "ai_words", (F.col("words") - F.col("ai_words")).alias("human_words"), "least", "most", contrast.alias("contrast"), "label_transitions", "strong_ai", "strong_human",
    )


def unavailable(docs: DataFrame, warning: str, model: Model | None = None) -> DataFrame:
    """The record of each document when there is no model, or it can't be used."""
    null = lambda kind: F.lit(None).cast(kind)
    known = (F.lit(model.model_id), F.lit(model.method), F.lit(model.trainer), F.lit(model.threshold)) if model else (null("string"), null("string"), null("string"), null("double"))
    return docs.select(
        "doc_id", F.lit(False).alias("available"), known[0].alias("model_id"), known[1].alias("method"), known[2].alias("trainer"), null("double").alias("probability"),
        null("int").alias("likelihood"), F.lit("unavailable").alias("label"), known[3].alias("threshold"), F.lit("unavailable").alias("confidence"),
        F.array().cast("array<struct<feature:string,family:string,value:double,weight:double,contribution:double,direction:string>>").alias("top_features"), F.lit(0).cast("long").alias("feature_count"),
        F.array(F.lit(warning)).alias("warnings"),
    )


def score(docs: DataFrame, model: Model | None, markov: DataFrame | None = None) -> DataFrame:
    """Everything about each document: ``score_texts``, its chunks (``authorship_chunks``) and their summary (``mixed_authorship``).

    Without a model, or with one that lacks what its trainer needs, each document has the record of ``unavailable``.
    A document too short for chunks has an empty list and the classification ``not_enough_text``.
    """
    if model is None:
        return unavailable(docs, "corporate_authorship_model_unavailable")
    sound = bool(model.trees.get("trees")) if model.trainer == "xgboost" else len({len(x) for x in (model.vocab, model.weights, model.means, model.stds)}) == 1
    if not sound:
        return unavailable(docs, "corporate_authorship_model_failed:ValueError", model)
    scored = written(score_chunks(docs, model, markov), "scored")
    columns = [c for c in scored.columns if c != "doc_id"]
    listed = scored.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", *(c for c in columns if c != "chunk_index")))).alias("authorship_chunks"))
    summary = mixed(scored)
    rest = [c for c in summary.columns if c != "doc_id"]
    summary = summary.select("doc_id", F.struct(*rest).alias("mixed_authorship"))
    got = score_texts(docs, model, markov).join(listed, "doc_id", "left").join(summary, "doc_id", "left")
    got = got.withColumn("classification", F.coalesce("mixed_authorship.classification", F.lit("not_enough_text")))
    return got.withColumn("authorship_chunks", F.coalesce("authorship_chunks", F.array()))
