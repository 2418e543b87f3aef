"""Connected components by rounds of minimum over neighbours and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import written


def components(edges: DataFrame) -> DataFrame:
    """id and component (the smallest id reachable) for the ends of ``edges`` (a, b). Rounds grow with the logarithm of the longest path."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        low = written(labels.join(near, "id").select("id", "component", F.least("component", "near").alias("low")), "low")
        jump = low.select(F.col("id").alias("low"), F.col("low").alias("far"))
        new = written(low.join(jump, "low").select("id", F.least("low", "far").alias("component"), (F.col("component") != F.least("low", "far")).alias("changed")), "labels")
        if not new.filter("changed").head(1):
            return new.select("id", "component")
        labels = new.select("id", "component")


def descendants(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """id of the roots (id) and of all that descends from them by edges (parent, child); a level a step, each written, cycles included."""
    step, found = 0, written(roots.select("id").distinct(), "descendants")
    fresh = found
    while fresh.head(1):
        step += 1
        below = edges.join(fresh.withColumnRenamed("id", "parent"), "parent", "left_semi").select(F.col("child").alias("id")).distinct()
        fresh = written(below.join(found, "id", "left_anti"), f"descendants-{step}")
        found = found.union(fresh)
    return found
