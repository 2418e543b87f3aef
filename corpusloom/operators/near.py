"""Near duplicates of whole texts: an exact similarity join of their sets of word shingles.

Which documents are linked at all, and into which groups, is found by the join of ``corpusloom.llm.jaccard``, which keeps
no shingles; the links themselves are then looked for among these documents only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpusloom.session import written

#: So many frequent shingles, as an eighth of the documents shows them, come last in the order of search. This bears on speed only: any order is exact.
COMMON = 1 << 11


def shingles(words: str, length: int) -> Column:
    """Distinct 64-bit hashes of the runs of ``length`` words (given as hashes); fewer words are one shingle. The zip keeps the lambda off the derived array."""
    n = F.size(words)
    shifted = [F.slice(words, k + 1, F.greatest(F.lit(0), n - (length - 1))).alias(f"w{k}") for k in range(length)]
    full = F.transform(F.arrays_zip(*shifted), lambda z: F.xxhash64(z))
    return F.sort_array(F.array_distinct(F.when(n >= length, full).when(n > 0, F.array(F.xxhash64(F.lit("short"), words))).otherwise(F.array().cast("array<bigint>"))))


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id and component_id, the smallest doc_id that links of ``near_links`` reach, for every row of ``docs`` (doc_id, text).

    The join lower-cases A-Z only, so it is given texts that are in lower case already; its words and its threshold are those of here.
    """
    from corpusloom.llm import jaccard  # optional to all the rest

    return jaccard.join(docs.select("doc_id", F.lower("text").alias("text"))).select("doc_id", "component_id")


def linked(docs: DataFrame) -> DataFrame:
    """id and component of the documents that have a link: those outside their component's smallest, and these smallest."""
    away = written(near_groups(docs).filter("component_id <> doc_id").select(F.col("doc_id").alias("id"), F.col("component_id").alias("component")).distinct(), "groups")
    return away.union(away.select(F.col("component").alias("id"), "component").distinct())


def near_links(docs: DataFrame, length: int = 5, percent: int = 75) -> DataFrame:
    """a < b and jaccard: links between documents (doc_id, text) whose sets have a Jaccard similarity of ``percent`` or more.

    Documents with equal sets are a class. Each links to its class's smallest doc_id, and the smallest of any two classes that
    are similar link to each other, so that copies cost a row each and every other pair follows from these. Prefix filtering, in order of rarity,
    finds the candidates; all of both sets decides. Texts without words link with nothing; repeated ids are one document.
    Documents without a link (``linked``) are left out before any set is made.
    """
    split = docs.join(linked(docs).select(F.col("id").alias("doc_id")), "doc_id", "left_semi").filter("doc_id is not null and text is not null").select("doc_id", F.transform(F.filter(F.split(F.lower("text"), r"[ \t\n\x0B\f\r]+"), lambda w: w != ""), lambda w: F.xxhash64(w)).alias("w"))
    every = written(split.select("doc_id", shingles("w", length).alias("s")).select("doc_id", F.size("s").alias("n"), F.xxhash64("s").alias("c"), "s"), "shingles").filter("n > 0")
    classes = every.groupBy("c").agg(F.min("doc_id").alias("rep"))
    copies = every.select("doc_id", "c").join(classes, "c").filter("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"), F.lit(1.0).alias("jaccard"))

    seen = every.filter("pmod(xxhash64(doc_id), 8) = 0").select(F.explode("s").alias("k")).groupBy("k").agg(F.count("*").alias("df")).filter("df > 1")
    top = seen.orderBy(F.desc("df"), "k").limit(COMMON).agg(F.sort_array(F.collect_list(F.struct("df", "k"))).alias("l")).select(F.col("l.k").alias("l"))
    order = F.concat(F.array_except("s", "l"), F.array_intersect("l", "s"))
    short = F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int") + 1
    prefix = every.join(F.broadcast(written(top, "common"))).select("c", "n", F.posexplode(F.slice(order, 1, short)).alias("at", "k"))
    w = W.partitionBy("k")
    shared = written(prefix.withColumns({"low": F.min("c").over(w), "high": F.max("c").over(w)}).filter("low <> high").select("c", "n", "at", "k").distinct(), "prefix")
    of = lambda side: shared.select("k", *(F.col(x).alias(side + x) for x in ("c", "n", "at")))
    # in the first shingle of the order that two sets share, what follows is all they can share
    rest = F.least(F.col("xn") - F.col("xat"), F.col("yn") - F.col("yat"))
    fit = (F.struct("xn", "xc") < F.struct("yn", "yc")) & (F.col("xn") * 100 >= F.col("yn") * percent) & (rest * (100 + percent) >= (F.col("xn") + F.col("yn")) * percent)
    met = of("x").join(of("y"), "k").filter(fit).groupBy("xc", "yc", "xn", "yn").agg(F.count("*").alias("o"), F.max("xat").alias("xat"), F.max("yat").alias("yat"))
    most = F.col("o") + F.least(F.col("xn") - F.col("xat"), F.col("yn") - F.col("yat")) - 1  # what met, and what follows the last of it
    pairs = written(met.filter(most * (100 + percent) >= (F.col("xn") + F.col("yn")) * percent).select("xc", "yc"), "pairs")
    wanted = pairs.select(F.explode(F.array("xc", "yc")).alias("c")).distinct().join(classes, "c").withColumnRenamed("rep", "doc_id")
    sets = written(every.join(wanted, ["c", "doc_id"]).dropDuplicates(["c"]).select("c", "doc_id", "s"), "sets")
    side = lambda x: sets.select(F.col("c").alias(f"{x}c"), F.col("doc_id").alias(f"{x}d"), F.col("s").alias(f"{x}s"))
    both = pairs.join(side("x"), "xc").join(side("y"), "yc").select("xd", "yd", (F.size("xs") + F.size("ys")).alias("n"), F.size(F.array_intersect("xs", "ys")).alias("o"))
    near = both.filter(F.col("o") * 100 >= (F.col("n") - F.col("o")) * percent).filter("xd <> yd").select(F.least("xd", "yd").alias("a"), F.greatest("xd", "yd").alias("b"), (F.col("o") / (F.col("n") - F.col("o"))).alias("jaccard"))
    return copies.union(near).groupBy("a", "b").agg(F.max("jaccard").alias("jaccard"))
