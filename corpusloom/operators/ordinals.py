"""Positions of rows in an order, without gathering them in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpusloom.session import written


def numbered(df: DataFrame, by: list[str], name: str = "ordinal") -> DataFrame:
    """``df`` and the place of each row, from 0, in the order of ``by``, which must tell rows apart.

    Rows go to ranges, which are written, so that a lost executor can't move their bounds; a row's place is that
    in its range, and the number of rows before the range, of which there is one number each.
    """
    cut = written(df.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()), "ordinals")
    base = cut.groupBy("_part").agg(F.count("*").alias("_n"))
    base = base.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("_part").orderBy(*by)) - 1
    return cut.withColumn("_in", inside).join(F.broadcast(base), "_part").withColumn(name, (F.col("_before") + F.col("_in")).cast("long")).drop("_part", "_in", "_before")
