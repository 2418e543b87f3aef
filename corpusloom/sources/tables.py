"""Sources and sinks: strict and lenient JSON lines, JSON documents, CSV, Parquet, text lines, mapping files, mirrors."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of input a core below which a table is dealt out anew.
SPREAD = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """A table too small to keep all cores busy, dealt out to them in turn; any other as it is.

    A small file is often one row group, which one task reads and then works on alone. Beyond ``SPREAD`` bytes a
    core the scan's own splits do, and nothing is moved. Rows are not dealt by a key: a union of tables dealt by
    one claims to be so itself, and a later grouping by it would miss what lies in other parts.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * SPREAD else df


def read_jsonl(spark: SparkSession, paths: str | list[str], schema: StructType | str, lenient: bool = False, source_types: tuple[str, ...] = ()) -> DataFrame:
    """JSON lines, blank lines skipped. Lenient: lines that are no objects are dropped. A filter on source_type reaches the parser."""
    got = spark.read.schema(schema).json(paths, mode="DROPMALFORMED" if lenient else "FAILFAST")
    return got.filter(F.col("source_type").isin(*source_types)) if source_types else got


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header; a missing file is an empty table. No inference: casts are the caller's."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines, blanks collapsed, empty lines dropped; the file's stem is the split."""
    line = F.trim(F.regexp_replace("value", r"\s+", " "))
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]*)", 1)
    return spark.read.text(path).select(line.alias("text"), stem.alias("split")).filter("text <> ''")


def discover(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """Files below a folder by suffix, in order of path; an error if there is no such folder."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.format("binaryFile").options(recursiveFileLookup="true", pathGlobFilter=f"*{suffix}").load(path).select("path", "length").orderBy("path")


def read_two_layouts(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """``*.csv`` in a folder and ``data/*.parquet`` below it, as one table, with ``split``: the stem of a CSV file, of a Parquet file what stands before its first hyphen."""
    name = F.col("_metadata.file_name")
    got = spark.read.schema(schema).csv(root, header=True, multiLine=True, escape='"', pathGlobFilter="*.csv", recursiveFileLookup=False)
    got = got.select("*", F.regexp_extract(name, r"^(.*)\.csv$", 1).alias("split"))
    if exists(spark, f"{root}/data"):
        below = spark.read.option("pathGlobFilter", "*.parquet").parquet(f"{root}/data")
        got = got.unionByName(below.select("*", F.regexp_extract(name, r"^([^-]*)", 1).alias("split")), allowMissingColumns=True)
    return got


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One JSON document that may span lines, an array of objects giving a row each; a missing file is an empty table."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, multiLine=True)


def write_pretty_json(df: DataFrame, path: str, limit: int = 1000) -> None:
    """A small result as one indented JSON array, its keys in the order of the columns; more rows than ``limit`` are an error."""
    rows = [r[0] for r in df.limit(limit + 1).select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).collect()]
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows for one JSON document")
    text = json.dumps([json.loads(r) for r in rows], indent=2, ensure_ascii=False)
    df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """Mapping lines ``offset8 ... pos ... &%Term<relation>``: (offset, pos) to (term, relation); a later line of a file wins.

    A file is read whole, as such files have a few megabytes, so the order of its lines is that of the file.
    """
    pattern = r"^(\d{8}) \d\d ([nvars]) .*&%(\w+)([=+@\[\]:]+)"
    got = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("at", "value"))
    cut = got.select(*(F.regexp_extract("value", pattern, i).alias(c) for i, c in enumerate(("offset", "pos", "term", "relation"), 1)), "at").filter("offset <> ''")
    return cut.groupBy("offset", "pos").agg(F.max_by(F.struct("term", "relation"), "at").alias("m")).select("offset", "pos", "m.term", "m.relation")


def write_jsonl(df: DataFrame, path: str, order_by: list[str] | None = None) -> None:
    """JSON lines. In a given order the rows go to range-partitioned files whose names sort as their rows do."""
    out = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by) if order_by else df
    out.write.json(path)


def write_csv_export(df: DataFrame, path: str, limit: int = 5000) -> None:
    """A bounded export: at most ``limit`` rows, one file; cells that begin like a formula get a quote mark, null stays empty."""
    safe = [F.when(F.col(c).rlike(r"^[=+@-]"), F.concat(F.lit("'"), F.col(c))).otherwise(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]
    df.select(*safe).limit(limit).coalesce(1).write.csv(path, header=True, nullValue="", emptyValue='""', escape='"')


def markdown_table(df: DataFrame, limit: int = 200) -> str:
    """A small result as a Markdown table, formatted on the driver."""
    rows = df.limit(limit).collect()
    line = lambda xs: "| " + " | ".join("" if x is None else str(x) for x in xs) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *(line(r) for r in rows)])


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """Relative path and SHA-256 of each file below a folder."""
    files = spark.read.format("binaryFile").options(recursiveFileLookup="true", pathGlobFilter="[!._]*").load(path)
    top = path.rstrip("/").split("://")[-1].removeprefix("file:").lstrip("/")
    return files.select(F.substring_index("path", f"{top}/", -1).alias("path"), F.sha2("content", 256).alias("sha256"))


def mirror_drift(listed: DataFrame, found: DataFrame) -> DataFrame:
    """Violations between a manifest and what is there: missing, unlisted, drift."""
    both = listed.select("path", F.col("sha256").alias("want")).join(found.select("path", F.col("sha256").alias("have")), "path", "full")
    code = F.when(F.col("have").isNull(), F.concat(F.lit("missing:"), "path")).when(F.col("want").isNull(), F.concat(F.lit("invalid:"), "path")).when(F.col("want") != F.col("have"), F.concat(F.lit("drift:"), "path"))
    return both.select("path", code.alias("violation")).filter("violation is not null")
