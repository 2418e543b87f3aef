"""Deterministic sampling: order by hash, never by a random number.

Places are never taken by sorting a label, a side or a stratum: ``lowest`` finds by counts the hash and the id
at which the limit falls, and each row compares itself with these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpusloom.functions import text as T
from corpusloom.functions.dialect import SPARK
from corpusloom.session import written

#: Into so many ranges of ids the rows of one hash are counted.
RANGES = 4096


def bucket(h: str = "text_hash") -> Column:
    return F.expr(T.bucket(SPARK, h))


def hash_split(df: DataFrame, ratio: float, h: str = "text_hash") -> DataFrame:
    return df.withColumn("split", F.when(bucket(h) < ratio, "test").otherwise("train"))


def _boundary(rows: DataFrame, part: list[str], bucket: Column, key: str) -> DataFrame:
    """Per part the bucket in which the last of ``_left`` rows lies, how many of its rows are to be taken, and its least and largest ids.

    Only the counts of buckets are ordered. A part whose rows are all taken, or none, has no such bucket.
    """
    counts = rows.groupBy(*part, bucket.alias("_at")).agg(F.count("*").alias("_n"), F.first("_left").alias("_left"), F.min(key).alias("_min"), F.max(key).alias("_max"))
    upto = F.sum("_n").over(W.partitionBy(*part).orderBy("_at"))
    found = counts.withColumn("_upto", upto).filter((F.col("_upto") >= F.col("_left")) & (F.col("_upto") - F.col("_n") < F.col("_left")))
    return found.select(*part, "_at", (F.col("_left") - F.col("_upto") + F.col("_n")).alias("_left"), "_min", "_max")


def lowest(df: DataFrame, part: list[str], limit: Column, h: str = "text_hash", key: str = "doc_id") -> DataFrame:
    """``df`` and ``_low``: whether a row's place by (hash, id) within ``part`` is at most ``limit``.

    ``limit`` may use columns that are the same on all rows of a part. The hash's first four digits are counted,
    then, where the limit falls, hashes and ranges of the ids that share one; what is sorted in the end is one
    such range. Rows that agree in hash and id share a place. The rows are written once, so pass only the
    columns that are needed.
    """
    rows = written(df.withColumn("_limit", limit), "lowest").withColumn("_left", F.col("_limit"))
    few, digits = rows.select(*part, h, key, "_left").filter("_left > 0"), F.substring(h, 1, 4)
    few = few.drop("_left").join(_boundary(few, part, digits, key), part).filter(digits == F.col("_at"))
    reach = F.floor((F.col(key) - F.col("_min")) / ((F.col("_max") - F.col("_min") + 1) / F.lit(float(RANGES))))
    few = few.withColumn("_range", F.struct(F.col(h), reach)).select(*part, h, key, "_left", "_range")
    few = few.drop("_left").join(_boundary(few, part, F.col("_range"), key), part).filter(F.col("_range") == F.col("_at"))
    place = F.row_number().over(W.partitionBy(*part).orderBy(key))
    last = few.withColumn("_place", place).filter(F.col("_place") == F.col("_left")).select(*part, F.col(h).alias("_h"), F.col(key).alias("_k"))
    low = (F.col("_limit") > 0) & (F.col("_h").isNull() | (F.struct(F.col(h), F.col(key)) <= F.struct(F.col("_h"), F.col("_k"))))
    return rows.drop("_left").join(last, part, "left").withColumn("_low", low).drop("_h", "_k", "_limit")


def head_by_hash(df: DataFrame, part: list[str], limit: Column, h: str = "text_hash", key: str = "doc_id") -> DataFrame:
    """Rows whose place by (hash, id) within ``part`` is at most ``limit``."""
    return lowest(df, part, limit, h, key).filter("_low").drop("_low")


def label_balance(df: DataFrame, label: str = "label") -> DataFrame:
    """The lowest hashes of each of two labels, as many of either as the rarer has."""
    counts = df.groupBy(label).count()
    least = counts.agg(F.min("count").alias("least"), F.count("*").alias("kinds")).select(F.when(F.col("kinds") > 1, F.col("least")).otherwise(0).alias("least"))
    return head_by_hash(df.join(F.broadcast(least)), [label], F.col("least")).drop("least")


def source_ratio(df: DataFrame, side: Column, ratio: float) -> DataFrame:
    """Caps the larger of two sides: at most max(1, int(e * ratio)) of a, at most max(1, int(a / ratio)) of e."""
    sided = df.withColumn("_a", side.cast("int"))
    counts = sided.agg(F.sum("_a").alias("_na"), F.sum(1 - F.col("_a")).alias("_ne"))
    cap_a = F.when(F.col("_na") > F.col("_ne") * ratio, F.greatest(F.lit(1), F.floor(F.col("_ne") * ratio))).otherwise(F.col("_na"))
    cap_e = F.when(F.col("_ne") > F.col("_na") / ratio, F.greatest(F.lit(1), F.floor(F.col("_na") / ratio))).otherwise(F.col("_ne"))
    return head_by_hash(sided.join(F.broadcast(counts)), ["_a"], F.when(F.col("_a") == 1, cap_a).otherwise(cap_e)).drop("_a", "_na", "_ne")


def fixed_sample(df: DataFrame, n: int, label: str = "label") -> DataFrame:
    """n // 2 of label 1 and the rest of label 0 by hash, then filled up by hash from what is left. At most n rows of a label leave a task."""
    place = F.row_number().over(W.partitionBy(label).orderBy("text_hash", "doc_id"))
    few = df.withColumn("_place", place).filter(F.col("_place") <= n)  # no more than n of a label can be among the n
    half = F.when(F.col(label) == 1, n // 2).otherwise(n - n // 2)
    return few.withColumn("_rest", (F.col("_place") > half).cast("int")).orderBy("_rest", "text_hash", "doc_id").limit(n).drop("_rest", "_place")


def stratified_split(df: DataFrame, strata: list[str], ratio: float, h: str = "key_hash", key: str = "doc_id") -> DataFrame:
    """test = max(1, round(n * ratio)) of a stratum with more than one row, else none; rounding is half to even."""
    counts = df.groupBy(*strata).agg(F.count("*").alias("_n"))
    tests = F.when(F.col("_n") > 1, F.greatest(F.lit(1), F.bround(F.col("_n") * ratio).cast("long"))).otherwise(0)
    got = lowest(df.join(counts, strata), strata, tests, h, key).drop("_n")
    return got.withColumn("split", F.when(F.col("_low"), "test").otherwise("train")).drop("_low")


def defensive_split(df: DataFrame, ratio: float, cap: int, label: str = "label") -> DataFrame:
    """Per label the lowest hashes, min(round(n * ratio), cap) of them, move to training; rows of one hash move together. A ratio of 0 or less moves nothing.

    At most ``cap`` rows of a label leave a task, so the hashes that move are few and known.
    """
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    place = F.row_number().over(W.partitionBy(label).orderBy("text_hash", "doc_id"))
    take = F.bround(F.col("_n") * ratio) if ratio > 0 else F.lit(0)
    few = df.select(label, "text_hash", "doc_id").withColumn("_place", place).filter(F.col("_place") <= cap).join(F.broadcast(counts), label)
    moved = few.filter(F.col("_place") <= take).select("text_hash").distinct().withColumn("_m", F.lit(True))
    return df.join(F.broadcast(moved), "text_hash", "left").withColumn("role", F.when(F.col("_m"), "train").otherwise("holdout")).drop("_m")
