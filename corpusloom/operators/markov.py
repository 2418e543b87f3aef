"""Smoothed Markov models per view and order, fitted as counts of grams and scored by look-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpusloom.functions import states as ST
from corpusloom.operators.sequences import told, transitions

ALPHA = 0.1


def fit(rows: DataFrame, views: tuple[str, ...], orders: tuple[int, ...] = (1,)) -> DataFrame:
    """gram, view, ord, context, next with counts n0, n1 of the labels, those of the context c0, c1, and the vocabulary size k.

    Counts are combined on the map side first: states are few, so the shuffle, and what follows it, is small
    whatever the corpus. Every state of a sequence longer than the order is in one of its grams, so the
    vocabulary (at least 1) is that of the grams.
    """
    t = transitions(rows, views, orders, keep=("label",))
    counts = t.groupBy("gram").agg(F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1"))
    named = told(counts.withColumn("letters", F.col("gram"))).withColumnRenamed("letters", "gram")
    context = W.partitionBy("view", "ord", "context")
    both = named.withColumns({"c0": F.sum("n0").over(context), "c1": F.sum("n1").over(context)})
    letters = named.select("view", "ord", F.explode_outer(F.split("gram", "")).alias("state")).filter("state <> ''")
    size = letters.groupBy("view", "ord").agg(F.count_distinct("state").alias("k"))
    return both.join(F.broadcast(size), ["view", "ord"])  # a row for each view and order


def log_ratio(n1: str = "n1", c1: str = "c1", n0: str = "n0", c0: str = "c0") -> tuple[Column, Column]:
    p = lambda n, c: F.log((F.coalesce(F.col(n), F.lit(0)) + ALPHA) / (F.coalesce(F.col(c), F.lit(0)) + ALPHA * F.col("k")))
    return p(n1, c1), p(n0, c0)


def score(docs: DataFrame, model: DataFrame, views: tuple[str, ...], orders: tuple[int, ...] = (1,)) -> DataFrame:
    """doc_id, view, ord, n, llr_total, llr_per_transition, ce1, ce0 for every document; zeros where it has no transition.

    The model's size is bounded by the states (a row for each gram of one letter more than the order), so it is
    broadcast; so are the values of a context whose next state is unseen, and of an unseen context. Scores add
    up within a task, and one shuffle brings the sums of a document together.
    """
    l1, l0 = log_ratio()
    known = model.select("gram", l1.alias("k1"), l0.alias("k0"))
    head = F.expr("substring(gram, 1, length(gram) - 1)").alias("head")
    no = F.lit(None).cast("long")
    partly = model.select(head, "c0", "c1", "k").distinct().withColumns({"n0": no, "n1": no}).select("head", l1.alias("p1"), l0.alias("p0"))
    sizes = model.select("view", "ord", (-F.log(F.col("k").cast("double"))).alias("fresh")).distinct()
    t = transitions(docs, views, orders, keep=("doc_id",), none=True).select("doc_id", "gram", head)
    found = t.join(F.broadcast(known), "gram", "left").join(F.broadcast(partly), "head", "left")
    real = ~F.substring("gram", 1, 1).isin([ST.none_letter(v) for v in views])
    unseen = real & F.coalesce("k1", "p1").isNull()
    sums = found.groupBy("doc_id", ST.view_of(F.col("gram")).alias("view"), (F.length("gram") - 1).alias("ord")).agg(
        F.count_if(real).alias("n"), F.sum(F.coalesce("k1", "p1", F.lit(0.0))).alias("l1"), F.sum(F.coalesce("k0", "p0", F.lit(0.0))).alias("l0"), F.count_if(unseen).alias("unseen")
    )
    got = sums.join(F.broadcast(sizes), ["view", "ord"], "left").withColumns({x: F.coalesce(F.col(x) + F.col("unseen") * F.col("fresh"), F.lit(0.0)) for x in ("l1", "l0")})
    got = got.withColumn("n", F.when(F.col("fresh").isNull(), F.lit(0)).otherwise(F.col("n")).cast("long"))
    per = lambda c: F.round(c / F.greatest(F.lit(1), F.col("n")), 6)
    return got.select(
        "doc_id", "view", F.col("ord").cast("int").alias("ord"), "n",
        F.round(F.col("l1") - F.col("l0"), 6).alias("llr_total"),
        per(F.col("l1") - F.col("l0")).alias("llr_per_transition"),
        per(-F.col("l1")).alias("class1_ce"),
        per(-F.col("l0")).alias("class0_ce"),
    )
