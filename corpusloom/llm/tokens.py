"""Operator 2, token-id output: a Parquet dataset of token lists in ascending document order.

Layout of a dataset folder: ``tokens`` holds one row per document (doc_id, part, local_start, n_tokens, ids),
range-partitioned and sorted by doc_id; ``parts`` holds one row per part with its first token position. Ids
are an int list column in dictionary encoding; the ordered integer columns are delta-encoded; row groups and
pages are kept small, and the page index lets a reader fetch single documents, or the metadata alone.

The position of a document's first token is ``local_start`` plus its part's base: a two-level prefix sum, for
which only per-part totals meet in one place.

Defined results. Null or empty text: the end id alone. Null ``doc_id``: sorts first. Repeated rows: each is
written; rows that agree in doc_id are ordered by text. An empty table gives an empty dataset. Other columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import encoder

END_ID, VOCABULARY = 2, "word_bpe_49k.json"
SCHEMA = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"


def write_options(row_group_bytes: int = 8 << 20, page_bytes: int = 256 << 10, page_rows: int = 2000, dictionary: bool = True) -> dict[str, str]:
    """Options for Spark's Parquet writer. ``dictionary=False`` stores the ids delta-encoded as well."""
    return {
        "compression": "zstd",
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.block.size": str(row_group_bytes),
        "parquet.page.size": str(page_bytes),
        "parquet.page.row.count.limit": str(page_rows),
        "parquet.enable.dictionary": "false",
        "parquet.enable.dictionary#ids.list.element": str(dictionary).lower(),
        "parquet.dictionary.page.size": str(2 << 20),
    }


def write(docs: DataFrame, path: str, end_id: int = END_ID, vocabulary: str = VOCABULARY, parts: int | None = None, **options: object) -> None:
    """Write the dataset to ``path``, a folder that driver and executors share. Spark's committer makes it safe against lost executors."""
    spark = docs.sparkSession

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, position, run = TaskContext.get().partitionId(), 0, encoder(vocabulary).encode
        for batch in batches:
            for first, ids, count in run(batch.column(1)):
                ids = np.insert(ids, np.cumsum(count), np.uint32(end_id)).astype(np.int32)
                total = count + 1
                ends = np.cumsum(total)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(count)),
                        pa.array(np.full(len(count), part, dtype=np.int32)),
                        pa.array((position + ends - total).astype(np.int64)),
                        pa.array(total.astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(ids)),
                    ],
                    ["doc_id", "part", "local_start", "n_tokens", "ids"],
                )
                position += int(ends[-1])

    ordered = (
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        .repartitionByRange(parts or int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    ordered.mapInArrow(encode, SCHEMA).write.options(**write_options(**options)).parquet(f"{path}/tokens")
    totals = spark.read.schema(SCHEMA).parquet(f"{path}/tokens").groupBy("part").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count("*").alias("n_docs"), F.sum("n_tokens").alias("part_tokens"))
    base, rows = 0, []
    for r in sorted(totals.collect(), key=lambda r: r["part"]):  # a row for each part, never for documents
        rows.append((r["part"], r["first_doc"], r["last_doc"], r["n_docs"], r["part_tokens"], base))
        base += r["part_tokens"]
    spark.createDataFrame(rows, "part int, first_doc long, last_doc long, n_docs long, part_tokens long, base long").coalesce(1).write.parquet(f"{path}/parts")


def read(spark: SparkSession, path: str, metadata_only: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and, unless only metadata is asked for, ids. A filter on doc_id reaches the page index."""
    columns = ["doc_id", "part", "local_start", "n_tokens", *([] if metadata_only else ["ids"])]
    parts = spark.read.parquet(f"{path}/parts").select("part", "base")
    got = spark.read.schema(SCHEMA).parquet(f"{path}/tokens").select(*columns)
    return got.join(parts, "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), *columns[3:])


def digest(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the CRC of the ids as little-endian unsigned 32-bit integers."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            at, flat = np.asarray(ids.offsets), memoryview(np.ascontiguousarray(np.asarray(ids.values), dtype="<i4")).cast("B")
            got = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(got, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(crc, "doc_id long, start long, n_tokens long, ids_crc32 long")
