"""Sources and sinks, exercised by round trips through the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpusloom.plans.models import _fit, fit_sql
from corpusloom.queries import query
from corpusloom.session import shared_folder
from corpusloom.sources import tables as IO

_DOC = "doc_id BIGINT, text STRING, lang STRING, source STRING"


@query("SELECT doc_id, sha256(coalesce(text, '')) AS h, lang, source FROM documents")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "jsonl")
    IO.write_jsonl(IO.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), path, ["source", "doc_id"])
    return IO.read_jsonl(spark, path, _DOC).select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"), "lang", "source")


@query("SELECT doc_id, lang, length(text)::BIGINT AS chars FROM documents WHERE lang IS NOT NULL")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with quotes, commas and line ends survive: every cell is quoted where needed, and a record may span lines."""
    path = shared_folder(spark, "csv")
    IO.table(spark, sf_dir, "documents").filter("lang is not null").select("doc_id", "lang", "text").write.csv(path, header=True, escape='"', quoteAll=True, lineSep="\n", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return IO.read_csv(spark, path, "doc_id BIGINT, lang STRING, text STRING").select("doc_id", "lang", F.length("text").cast("long").alias("chars"))


@query(r"SELECT trim(regexp_replace(line, '\s+', ' ', 'g')) AS text, count(*)::BIGINT AS n FROM (SELECT unnest(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10))) AS line FROM documents) WHERE trim(regexp_replace(line, '\s+', ' ', 'g')) <> '' GROUP BY 1")
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "lines")
    IO.table(spark, sf_dir, "documents").filter("text is not null").select("text").write.text(path)
    return IO.read_lines(spark, path).groupBy("text").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, CASE WHEN regexp_matches(c_name, '^[=+@-]') THEN '''' || c_name ELSE c_name END AS c_name, CASE WHEN c_acctbal < 0 THEN '''' || c_acctbal::VARCHAR ELSE c_acctbal::VARCHAR END <> '' AS has_balance FROM customer ORDER BY c_custkey LIMIT 5000")
def csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "export")
    rows = IO.table(spark, sf_dir, "customer").orderBy("c_custkey").select("c_custkey", "c_name", F.col("c_acctbal").cast("string").alias("balance"))
    IO.write_csv_export(rows, path)
    return IO.read_csv(spark, path, "c_custkey BIGINT, c_name STRING, balance STRING").select("c_custkey", "c_name", (F.col("balance") != "").alias("has_balance"))


@query("""
SELECT r_name AS path, CASE r_regionkey % 3 WHEN 0 THEN 'missing:' || r_name WHEN 1 THEN 'drift:' || r_name END AS violation FROM region WHERE r_regionkey % 3 < 2
UNION ALL SELECT 'EXTRA', 'invalid:EXTRA'""")
def mirror_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files on disk against a manifest of their hashes: one kind of file is not written, one is changed, one isn't listed."""
    r = IO.table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("name"))
    manifest = r.select(F.col("name").alias("path"), F.sha2(F.concat("name", F.lit("\n")), 256).alias("sha256"))  # a line and its end
    there = r.filter("r_regionkey % 3 <> 0").select("name", F.concat("name", F.when(F.col("r_regionkey") % 3 == 1, "!").otherwise("")).alias("value"))
    path = shared_folder(spark, "mirror")
    there.unionByName(spark.createDataFrame([("EXTRA", "x")], "name string, value string")).repartition("name").write.partitionBy("name").text(path)
    found = IO.file_hashes(spark, path).select(F.regexp_extract("path", "^name=([^/]+)/", 1).alias("path"), "sha256")
    return IO.mirror_drift(manifest, found)


@query("SELECT CASE doc_id % 3 WHEN 0 THEN 'ai_generated' ELSE 'human_written' END AS source_type, count(*)::BIGINT AS n, sum(doc_id)::BIGINT AS ids FROM documents WHERE doc_id % 5 > 1 AND doc_id % 3 < 2 GROUP BY 1")
def lenient_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are no objects are dropped, and rows of other source types filtered, in one scan."""
    path = shared_folder(spark, "lenient")
    kind = F.when(F.col("doc_id") % 3 == 0, "ai_generated").when(F.col("doc_id") % 3 == 1, "human_written").otherwise("unknown")
    line = F.when(F.col("doc_id") % 5 == 0, "no json").when(F.col("doc_id") % 5 == 1, "").otherwise(F.to_json(F.struct("doc_id", kind.alias("source_type"))))
    IO.table(spark, sf_dir, "documents").select(line.alias("value")).write.text(path)
    got = IO.read_jsonl(spark, path, "doc_id BIGINT, source_type STRING", lenient=True, source_types=("ai_generated", "human_written"))
    return got.groupBy("source_type").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query("SELECT CASE WHEN doc_id % 2 = 0 THEN 'csv' ELSE 'part' END AS kind, count(*)::BIGINT AS n, sum(length(coalesce(lang, '')))::BIGINT AS chars FROM documents GROUP BY 1")
def two_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV files and a folder of Parquet files, as one table with a split by the name of the file."""
    path, d = shared_folder(spark, "layouts"), IO.table(spark, sf_dir, "documents").select("doc_id", "lang")
    d.filter("doc_id % 2 = 0").write.csv(path, header=True)
    d.filter("doc_id % 2 = 1").write.parquet(f"{path}/data")
    got = IO.read_two_layouts(spark, path, "doc_id BIGINT, lang STRING")
    kind = F.when(F.col("split") == "part", "part").otherwise("csv")  # Spark names CSV files by a long stem
    return got.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.sum(F.length(F.coalesce("lang", F.lit("")))).alias("chars"))


@query("SELECT lang, count(*)::BIGINT AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1")
def json_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small result as one indented document, written and read back."""
    path = shared_folder(spark, "document")
    n = IO.table(spark, sf_dir, "documents").filter("lang is not null").groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang")
    IO.write_pretty_json(n, path)
    return IO.read_json(spark, path, "lang STRING, n BIGINT")


@query("SELECT count(*)::BIGINT AS n, 0::BIGINT AS out_of_order FROM documents")
def sorted_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written in a given order: read back, no line is smaller than the one before it, in a file or from file to file."""
    path = shared_folder(spark, "sorted")
    IO.write_jsonl(IO.table(spark, sf_dir, "documents").select("source", "doc_id"), path, ["source", "doc_id"])
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split(F.rtrim("value"), "\n")).alias("at", "line")).filter("line <> ''")
    rows = lines.select("file", "at", F.from_json("line", "source STRING, doc_id BIGINT").alias("r")).select("file", "at", F.struct("r.source", "r.doc_id").alias("k"))
    before = F.lag("k").over(W.partitionBy("file").orderBy("at"))
    inside = rows.withColumn("b", before).groupBy("file").agg(F.count("*").alias("n"), F.count_if(F.col("b") > F.col("k")).alias("bad"), F.min("k").alias("low"), F.max("k").alias("high"))
    across = F.lag("high").over(W.orderBy("file"))  # a row for each file
    return inside.withColumn("h", across).agg(F.sum("n").alias("n"), (F.sum("bad") + F.count_if(F.col("h") > F.col("low"))).alias("out_of_order"))


@query(f"WITH {fit_sql('shape', 1)} SELECT context, next, n0::BIGINT AS n0, n1::BIGINT AS n1, c0::BIGINT AS c0, c1::BIGINT AS c1, k FROM f, k")
def stored_markov_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fitted model stored as a table and loaded again; what is loaded scores like what was fitted."""
    path = shared_folder(spark, "markov")
    _fit(spark, sf_dir, ("shape",), (1,)).write.parquet(path)
    return spark.read.parquet(path).select("context", "next", "n0", "n1", "c0", "c1", "k")


@query("SELECT lpad((i // 2)::VARCHAR, 8, '0') AS \"offset\", CASE WHEN i % 4 < 2 THEN 'n' ELSE 'v' END AS pos, 'Term' || max(i) AS term, '=' AS relation FROM range(0, 40) t(i) GROUP BY ALL")
def mapping_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of fixed format, keyed by offset and part of speech; the later of two lines with a key wins, other lines are none."""
    path = shared_folder(spark, "mapping")
    lines = [f"{i // 2:08d} 03 {'n' if i % 4 < 2 else 'v'} 01 word 0 &%Term{i}=" for i in range(40)]
    spark.createDataFrame([("\n".join([*lines[:20], "no mapping", *lines[20:]]),)], "value string").coalesce(1).write.text(path)
    return IO.read_mapping(spark, path)
