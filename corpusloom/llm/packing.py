"""Operator 1, packing: documents into training sequences of a fixed window, best-fit decreasing.

Documents are tokenised and closed by an end id, overlong ones are first cut into full windows, and the
remainders go to groups of about ``group_docs`` documents by a hash. Within a group the pieces arrive from
Spark's sort in descending length and each goes to the tightest open sequence that takes it; a segment tree
over remaining capacities finds that sequence. A piece is placed as it arrives, so a task holds open
sequences (a few integers each) and never the ids of a group.

Defined results. Null or empty text: one piece that holds the end id alone. Null ``doc_id``: packed like any
other. Repeated rows: each row is packed, and where rows repeat an id, or have none, their texts deal them to
groups. Ties in length: by ``doc_id``, then ``start``; which of two rows that agree in both comes first makes
no difference to any column but their place. Very long texts: cut into
windows while they are tokenised. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import encoder, lean

WINDOW, END_ID, VOCABULARY = 2048, 1, "word_bpe_49k.json"


class CapacityTree:
    """Open sequences by remaining capacity, with the smallest sufficient capacity found in O(log window)."""

    def __init__(self, window: int) -> None:
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, capacity: int, by: int) -> None:
        node = self.leaves + capacity
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, sequence: int, capacity: int) -> None:
        self.open[capacity].append(sequence)
        self._add(capacity, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """(sequence, capacity) of the tightest open sequence with at least that capacity left."""
        node = self.leaves + least
        while not self.count[node]:
            while node & 1:  # a right child: its successor hangs on an ancestor
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.leaves:
            node = 2 * node if self.count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        self._add(capacity, -1)
        return self.open[capacity].pop(), capacity


class BestFit:
    """Best-fit decreasing for one group; lengths must come in descending order."""

    def __init__(self, window: int) -> None:
        self.window, self.tree, self.sequences = window, CapacityTree(window), 0

    def place(self, length: int) -> tuple[int, int]:
        found = self.tree.take(length)
        if found is None:
            found = self.sequences, self.window
            self.sequences += 1
        sequence, capacity = found
        if capacity > length:
            self.tree.put(sequence, capacity - length)
        return sequence, self.window - capacity


def pieces(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, vocabulary: str = VOCABULARY) -> DataFrame:
    """Tokenised pieces of at most ``window`` ids: doc_id, start, length, doc_tokens, ids (little-endian, 32 bits)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for batch in batches:
            keys = batch.column(0)
            for first, ids, count in encode(batch.column(1)):
                total = count + 1
                ids = np.insert(ids, np.cumsum(count), np.uint32(end_id)) if len(count) else ids
                parts = -(-total // window)
                doc = np.repeat(np.arange(len(count)), parts)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)) * window
                length = np.minimum(window, total[doc] - start)
                offsets = np.concatenate(([0], np.cumsum(length))).astype(np.int32) * 4
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.slice(first, len(count)).take(pa.array(doc)),
                        pa.array(start.astype(np.int64)),
                        pa.array(length.astype(np.int64)),
                        pa.array(total[doc].astype(np.int64)),
                        pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(offsets), pa.py_buffer(ids)]),
                    ],
                    ["doc_id", "start", "length", "doc_tokens", "ids"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, "doc_id long, start long, length long, doc_tokens long, ids binary")


def pack(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, vocabulary: str = VOCABULARY, group_docs: int = 2048) -> DataFrame:
    """``pieces`` with their sequence_id and offset. A sequence holds pieces of one group, without gaps.

    One shuffle, by group, carries the ids. The number of groups follows the number of documents (a count
    that Parquet answers from its footers), so a group stays the same size at every scale. A group is drawn
    from the id, the place in the document, the ids themselves and the input's partition, so that neither
    missing ids nor exact copies gather in one, and every attempt of a task draws the same.
    """
    lean(docs.sparkSession)
    groups = max(1, docs.count() // group_docs)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, fit = None, None
        for batch in batches:
            sequence, offset = [], []
            for g, length in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if g != group:
                    group, fit = g, BestFit(window)
                s, o = fit.place(length)
                sequence.append(g << 32 | s)
                offset.append(o)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], [*batch.schema.names[1:], "sequence_id", "offset"])

    parts = min(groups, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1))
    cut = pieces(docs, window, end_id, vocabulary)
    return (
        cut.select(F.pmod(F.xxhash64("doc_id", "start", F.crc32("ids"), F.spark_partition_id()), F.lit(groups)).alias("pack_group"), "*")
        .repartition(parts, "pack_group")
        .sortWithinPartitions("pack_group", F.desc("length"), "doc_id", "start")
        .mapInArrow(place, "doc_id long, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long")
    )


def sequences(packed: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """Padded sequences from ``pack``: sequence_id, used, ids (binary of ``window`` ids), segments (doc_id, start, length, offset)."""
    part = F.struct("offset", "doc_id", "start", "length", "ids")
    got = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("p"), F.sum("length").alias("used"))
    joined = F.aggregate("p", F.expr("cast('' as binary)"), lambda acc, x: F.concat(acc, x["ids"]))
    pad = F.unhex(F.repeat(F.lit(pad_id.to_bytes(4, "little").hex()), (F.lit(window) - F.col("used")).cast("int")))
    filled = F.concat(joined, pad)
    return got.select("sequence_id", "used", filled.alias("ids"), F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["start"].alias("start"), x["length"].alias("length"), x["offset"].alias("offset"))).alias("segments"))


def digest(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
