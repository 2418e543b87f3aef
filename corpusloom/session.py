"""Sessions and the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings the engine is tuned with; a cluster's own settings win where it has them."""
    b = SparkSession.builder.master(master).appName("corpusloom").config("spark.sql.session.timeZone", "UTC")
    b = b.config("spark.sql.shuffle.partitions", partitions).config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false")
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


#: Bytes of one Arrow batch between Spark and Python, where the session has Spark's own default of 64 MB.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def lean(spark: SparkSession) -> None:
    """Smaller Arrow batches for this session, unless it sets their size itself: what a worker makes of a batch is held whole, and is often many times the batch."""
    if spark.conf.get(BATCH) == f"{64 << 20}b":
        spark.conf.set(BATCH, f"{BATCH_BYTES}b")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; below a temporary folder where that is unset and the master local."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: lineage ends here, and a lost executor costs its running tasks only."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
