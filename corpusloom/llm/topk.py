"""Operator 6, exact top-k by integer inner product: exhaustive term-at-a-time accumulation.

Vectors become integers, floor(scale * x) with x as double. Queries go out in blocks of at most ``block``
rows and ``block_bytes`` bytes, one block after the other: a block is broadcast, meets all candidates, leaves its
tasks' best in the shared folder, and is gone before the next. So neither the driver nor an executor ever holds
more than a block, however many queries there are. A task takes its candidates in parts,
makes posting lists of them (for each component, the rows where it is not zero and their weights), and for
each component scatters its weighted postings into dense score arrays, one for each query whose component is
not zero. Partition selection then leaves k candidates per query and part, parts are merged in the task, and
the tasks' lists, k rows each, in one shuffle by query.

Scores and places are packed in one integer that orders by score, then by smaller vec_id, so ties, even of a
third of all vectors, need no sort and lose nothing.

Defined results. Vectors that are null, or hold a null or a component that is not finite, take no part, as
do rows without vec_id. Vectors of different lengths score over the components both have. Rows that repeat a
vec_id: as a query, the smallest vector counts; as candidates, each row counts; no row of the query's own id
does. Scores must fit 62 bits with the count of rows in a part; integers of +-2^20 and 4096 components do.
An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpusloom.llm.common import Scratch

PART = 2048


def integers(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and v, an array of longs, for the rows that take part."""
    x = F.transform(F.col("embedding"), lambda e: e.cast("double"))
    sound = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(math.inf)))
    return vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & sound).select(F.col("vec_id").cast("long"), F.transform(x, lambda e: F.floor(e * scale).cast("long")).alias("v"))


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    size = np.diff(np.asarray(column.offsets))
    flat = np.asarray(column.flatten(), dtype=np.int64)
    out = np.zeros((len(column), width), dtype=np.int64)
    if len(size) and (size == width).all():
        return flat.reshape(len(column), width)
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    inside = place < width
    out[row[inside], place[inside]] = flat[inside]
    return out


class Accumulator:
    """The k best candidates of each query so far."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int) -> None:
        self.ids, self.queries, self.k = ids, queries, k
        self.score = np.zeros((len(ids), 0), dtype=np.int64)
        self.vec = np.zeros((len(ids), 0), dtype=np.int64)

    def add(self, vec: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(vec, kind="stable")
        vec, values = vec[order], values[order]
        dense = np.zeros((len(self.ids), len(vec)), dtype=np.int64)
        for term in range(values.shape[1]):
            asking = np.flatnonzero(self.queries[:, term])
            posting = np.flatnonzero(values[:, term])
            if not len(asking) or not len(posting):
                continue
            weight = self.queries[asking, term][:, None] * values[posting, term]
            if len(asking) == len(self.ids) and len(posting) == len(vec):
                dense += weight
            else:
                dense[np.ix_(asking, posting)] += weight
        place = np.searchsorted(vec, self.ids)
        last = np.searchsorted(vec, self.ids, side="right")
        key = dense * len(vec) + np.arange(len(vec) - 1, -1, -1)
        lowest = np.iinfo(np.int64).min
        for q in np.flatnonzero(last > place):
            key[q, place[q] : last[q]] = lowest
        k = min(self.k, len(vec))
        best = np.argpartition(key, len(vec) - k, axis=1)[:, len(vec) - k :]
        rows = np.arange(len(self.ids))[:, None]
        kept = key[rows, best] != lowest
        self.merge(np.where(kept, dense[rows, best], lowest), np.where(kept, vec[best], np.iinfo(np.int64).max))

    def merge(self, score: np.ndarray, vec: np.ndarray) -> None:
        score, vec = np.concatenate([self.score, score], axis=1), np.concatenate([self.vec, vec], axis=1)
        order = np.lexsort((vec, -(score + 1)), axis=1)[:, : self.k]  # +1: the lowest integer has no negative
        rows = np.arange(len(self.ids))[:, None]
        self.score, self.vec = score[rows, order], vec[rows, order]

    def result(self) -> pa.RecordBatch:
        n, k = self.score.shape
        kept = self.score.ravel() != np.iinfo(np.int64).min
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, k)[kept]), pa.array(self.vec.ravel()[kept]), pa.array(self.score.ravel()[kept])], ["query_id", "vec_id", "score"])


def search(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, block: int = 8192, block_bytes: int = 32 << 20) -> DataFrame:
    """query_id, rank, vec_id, score. Queries: rows whose vec_id is divisible by ``every``; candidates: every other row."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    rows = integers(vectors, scale)
    queries = scratch.save(rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    n, width = queries.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    blocks = max(1, -(-n // max(1, min(block, block_bytes // (8 * max(width, 1))))))
    spread = F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
    found = None
    for b in range(blocks):
        part = queries.filter(spread == b).toArrow()
        ids = np.asarray(part.column("vec_id").combine_chunks(), dtype=np.int64)
        order = np.argsort(ids)
        sent = spark.sparkContext.broadcast((ids[order], _matrix(part.column("v").combine_chunks(), width)[order]))

        def score(batches: Iterator[pa.RecordBatch], sent=sent, width=width) -> Iterator[pa.RecordBatch]:
            ids, matrix = sent.value
            step = 512
            best = [Accumulator(ids[i : i + step], matrix[i : i + step], k) for i in range(0, len(ids), step)]
            for batch in batches:
                for at in range(0, batch.num_rows, PART):
                    piece = batch.slice(at, PART)
                    vec, values = np.asarray(piece.column(0), dtype=np.int64), _matrix(piece.column(1), width)
                    for a in best:
                        a.add(vec, values)
            for a in best:
                if a.score.shape[1]:
                    yield a.result()

        got = scratch.save(rows.mapInArrow(score, "query_id long, vec_id long, score long"), f"block-{b}")
        sent.destroy()
        found = got if found is None else found.unionByName(got)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
