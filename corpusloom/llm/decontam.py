"""Operator 4, benchmark decontamination: a prefix-filtered set join in DataFrame operations alone.

A window is a run of ``width`` words of a benchmark item (the whole item, if it has fewer); a document word
inside any occurrence of a window is hit. A window must occur whole, so one word of it is a sufficient prefix
of its set: the rarest, by counts over the whole corpus. Document words join those words; the position in the
document and the offset in the window fix the only possible start, bounds on start and length come next, and
the exact words decide. The first pass counts words (those of the benchmark only), the second joins.

The windows' side is broadcast in blocks of at most ``block`` windows, which bounds it in bytes; a benchmark
of more windows takes more passes, and nothing is dropped. Document words never leave their task: only
matches and one row for each document do.

Defined results. Null or empty text, in documents or items: no words. Null doc_id: a row like any other. Rows
that repeat a doc_id: a row each, by their own text. An item without an id marks words and is not counted
among items. Repeated items or windows count once. An empty benchmark hits nothing, an empty corpus gives no
rows. Further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpusloom.llm.common import LOWER, UPPER, Scratch, free_name

#: The contract's word, ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``, in a text without A-Z. Letters and digits stand one by one, as Java looks
#: single characters up in a table, but tries the ranges of a class one after the other.
WORD = r"[abcdefghijklmnopqrstuvwxyz0123456789\x{80}-\x{10FFFF}]+"
#: No word holds a NUL, so it may stand for the end of a document.
END = "\x00"


def lower_az(text: Column) -> Column:
    """A-Z to a-z and nothing else; in a text of ASCII alone, lower() does that and is faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    return F.regexp_extract_all(lower_az(F.coalesce(text.cast("string"), F.lit(""))), F.lit(WORD), F.lit(0))


def each_word(texts: DataFrame) -> DataFrame:
    """A row for each word of ``w``. For ``explode`` Catalyst infers a filter that would cut every text a second time."""
    return texts.select(F.explode_outer("w").alias("word")).filter("word is not null")


def benchmark_windows(benchmark: DataFrame, width: int) -> DataFrame:
    """item_id and each of its windows as an array of words; ``win`` joins them by blanks, which no word holds."""
    n = F.size("w")
    starts = F.when(n > width, F.sequence(F.lit(1), n - width + 1)).otherwise(F.array(F.lit(1)))
    return (
        benchmark.select(F.col("item_id").cast("string"), words(F.col("text")).alias("w"))
        .filter(n > 0)
        .select("item_id", "w", F.explode(starts).alias("s"))
        .select("item_id", F.slice("w", F.col("s"), width).alias("window"))
        .distinct()
        .withColumn("win", F.concat_ws(" ", "window"))
    )


def match(docs: DataFrame, benchmark: DataFrame, width: int = 10, block: int = 50_000, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(occurrences, items): doc_id, row, start, length, win for each occurrence, and one row with win null whose start is the document's number of words; item_id and win."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "decontam")
    items = scratch.save(benchmark_windows(benchmark, width), "items")
    windows = items.select("win", "window").distinct()
    vocabulary = windows.select(F.explode("window").alias("word")).distinct()
    n_windows = windows.count()
    blocks = max(1, -(-n_windows // block))
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", "text").alias("row"), words(F.col("text")).alias("w"))

    tokens = each_word(texts)
    seen = []
    for b in range(blocks):  # a block of at most width x block words
        part = vocabulary if blocks == 1 else vocabulary.filter(F.pmod(F.xxhash64("word"), F.lit(blocks)) == b)
        seen.append(tokens.join(F.broadcast(part), "word").groupBy("word").count())
    # a word is in one block, whose counts are as few as its words: they go to the windows, not the windows to them
    spread = windows.select("win", "window", F.posexplode("window").alias("offset", "word"))
    counted = reduce(DataFrame.unionByName, (spread.join(F.broadcast(s), "word") for s in seen))

    rarest = (
        counted.groupBy("win")
        .agg(F.min(F.struct("count", "word", "offset")).alias("r"), F.count("*").alias("found"), F.first("window").alias("window"))
        .filter(F.col("found") == F.size("window"))  # a window with a word the corpus lacks occurs nowhere
        .select(F.col("r.word").alias("word"), F.col("r.offset").alias("offset"), "window", "win")
    )
    keys = scratch.save(rarest, "keys")
    end = spark.createDataFrame([(END, 0, None, None)], "word string, offset int, window array<string>, win string")
    ended = texts.select("doc_id", "row", "w", F.posexplode(F.concat("w", F.array(F.lit(END)))).alias("pos", "word"))
    start, length = F.col("pos") - F.col("offset"), F.size("window")
    holds = F.col("win").isNull() | ((start >= 0) & (start + length <= F.size("w")) & (F.slice("w", F.greatest(start, F.lit(0)) + 1, F.greatest(length, F.lit(0))) == F.col("window")))
    found = None
    for b in range(blocks):
        part = keys if blocks == 1 else keys.filter(F.pmod(F.xxhash64("win"), F.lit(blocks)) == b)
        part = part if b else part.unionByName(end)
        got = ended.join(F.broadcast(part), "word").filter(holds).select("doc_id", "row", start.alias("start"), F.when(F.col("win").isNotNull(), length).alias("length"), "win")
        found = got if found is None else found.unionByName(got)
    return scratch.save(found, "occurrences"), items


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, block: int = 50_000) -> DataFrame:
    """doc_id, row, n_words, n_hit, items (sorted strings) and contaminated for each document."""
    occurrences, items = match(docs, benchmark, width, block)
    key = ["row", "doc_id"]
    hits = occurrences.filter("win is not null").withColumn("end", F.col("start") + F.col("length"))
    reached = F.max("end").over(W.partitionBy(*key).orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1))
    n_hit = (
        hits.select(*key, "start", "end").distinct()
        .select(*key, F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(reached, F.lit(0)))).alias("fresh"))
        .groupBy(*key).agg(F.sum("fresh").alias("n_hit"))
    )
    names = hits.select(*key, "win").distinct().join(items.select("win", "item_id"), "win").groupBy(*key).agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    same = lambda a, b: (a["row"] == b["row"]) & a["doc_id"].eqNullSafe(b["doc_id"])
    d, h, n = occurrences.filter("win is null").alias("d"), n_hit.alias("h"), names.alias("n")
    return (
        d.join(h, same(d_ := _of("d"), _of("h")), "left")
        .join(n, same(d_, _of("n")), "left")
        .select(
            F.col("d.doc_id"),
            F.col("d.row"),
            F.col("d.start").cast("long").alias("n_words"),
            F.coalesce(F.col("h.n_hit"), F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce(F.col("n.items"), F.array().cast("array<string>")).alias("items"),
            F.col("h.n_hit").isNotNull().alias("contaminated"),
        )
    )


def _of(name: str) -> dict[str, Column]:
    return {c: F.col(f"{name}.{c}") for c in ("row", "doc_id")}


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def clean(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """The documents that hold no benchmark window, all columns as they are."""
    dirty = decontaminate(docs, benchmark, width).filter("contaminated").select("doc_id", "row").distinct()
    key = free_name("key", docs.columns)
    marked = docs.withColumn(key, F.xxhash64(F.col("doc_id"), F.col("text")))
    return marked.join(dirty, (marked[key] == dirty["row"]) & marked["doc_id"].eqNullSafe(dirty["doc_id"]), "left_anti").select(*docs.columns)
