"""Streaming queries, driven to the end of their input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.queries import query
from corpusloom.streaming import events as E


@query("""
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS period, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events
GROUP BY date_trunc('hour', ts), event_type HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def streaming_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = E.run(E.windowed_counts(E.stream(spark, sf_dir, "events")), "windows")
    return got.select(F.date_format("period", "yyyy-MM-dd HH:mm").alias("period"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT count(*)::BIGINT AS n, count(DISTINCT k)::BIGINT AS keys FROM (SELECT DISTINCT sha256(user_id || ':' || event_type || ':' || strftime(ts, '%Y-%m-%d %H')) AS k FROM events)")
def streaming_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event of a user and kind for each hour. The hour is part of the key, so state older than two hours goes."""
    key = F.sha2(F.concat_ws(":", F.col("user_id").cast("string"), "event_type", F.date_format("ts", "yyyy-MM-dd HH")), 256)
    keyed = E.stream(spark, sf_dir, "events").withColumn("k", key).select("ts", "k")
    return E.run(E.first_of_key(keyed, "k", "2 hours"), "keys").agg(F.count("*").alias("n"), F.count_distinct("k").alias("keys"))
