"""Operator 8, substring dedup: difference-cover anchors, then fingerprints of the windows around shared ones.

A word goes if a run of ``width`` words that covers it also starts in a document with a smaller doc_id. Two
equal windows anywhere agree, for a difference cover of the residues modulo ``period``, in an anchor: a run of
``width - period + 1`` words whose start lies, in both, at a cover position. So only 3 of 7 positions are
hashed. Steps, over blocks of documents:

1. each block sends the distinct anchors it holds, by hash range, 48 bits each;
2. a hash range finds anchors of two documents or more, and returns them to the blocks they came from;
3. each block extends its shared anchors to whole windows, and sends the windows' fingerprints (96 bits),
   each with the smallest doc_id that has it there;
4. a fingerprint range takes the smallest doc_id of all, and returns it to the blocks with larger ones;
5. each block marks the words that such windows cover, and leaves the others.

False anchors cost work only; the fingerprints decide. A passage, or a copy, that a third of all documents
share is one entry per block in either exchange. Blocks and ranges keep their size as the corpus grows.

Defined results. Null or empty text: no words, empty kept text. A document of fewer than ``width`` words keeps
all. Null doc_id: neither loses words nor makes others lose them. Rows that repeat a doc_id: neither is the
smaller, so they don't affect each other. Repeats within one document stay. A text longer than a block is a
block of its own. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch
from corpusloom.llm.wordhash import Block, blocks, pack48, runs, unpack, unpack48

WIDTH, PERIOD, COVER = 13, 7, (0, 1, 3)
#: Differences of 0, 1 and 3 give every residue modulo 7.
RANGE_BYTES = 24 << 20
SENT = "part int, block long, keys binary, more binary"


def _rows(part: np.ndarray, block: int, *columns: tuple[np.ndarray, object]) -> Iterator[tuple[int, int, list[bytes]]]:
    """Slices of sorted columns, one for each value of ``part``."""
    edges = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True]))) if len(part) else np.array([0])
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(part[a]), block, [pack(values[a:b]) for values, pack in columns]


def _table(rows: list[tuple[int, int, list[bytes]]]) -> pa.Table:
    return pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2][0] for r in rows], pa.binary()), pa.array([r[2][1] for r in rows], pa.binary())], ["part", "block", "keys", "more"])


def _spread(key: np.ndarray, bits: int, parts: int) -> np.ndarray:
    """Ranges of equal width of ``bits``-bit keys."""
    return ((key >> np.uint64(bits - 32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


class Words:
    """Words, and where runs may start, of one block."""

    def __init__(self, block: Block) -> None:
        self.block = block
        self.starts, self.ends, self.doc = block.spans()
        self.hash = block.hashes(self.starts, self.ends, 0)
        self.first = np.searchsorted(self.doc, np.arange(len(block.sizes) + 1))

    def place(self) -> np.ndarray:
        return np.arange(len(self.doc)) - self.first[self.doc]

    def whole(self, length: int) -> np.ndarray:
        """Whether a run of ``length`` words from here stays in its document, and the document has an id."""
        n = max(0, len(self.doc) - length + 1)
        return (self.doc[:n] == self.doc[length - 1 :]) & self.block.has_id[self.doc[:n]]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(start, 48-bit key) of the runs at cover positions. Positions count from the document's first word."""
        length = WIDTH - PERIOD + 1
        at = np.flatnonzero(self.whole(length))
        at = at[np.isin(self.place()[at] % PERIOD, COVER)]
        return at, runs(self.hash, length, 0)[at] >> np.uint64(16)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """The fingerprints of all runs of WIDTH words, 64 and 32 bits."""
        second = self.block.hashes(self.starts, self.ends, 1)
        return runs(self.hash, WIDTH, 0), (runs(second, WIDTH, 1) >> np.uint64(32)).astype(np.uint32)


def _send_anchors(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words = Words(unpack(row))
                at, key = words.anchors()
                order = np.lexsort((words.doc[at], key))
                key, doc = key[order], words.doc[at][order]
                new = np.concatenate(([True], key[1:] != key[:-1]))[: len(key)]
                begin = np.flatnonzero(new)
                last = np.concatenate((begin[1:], [len(key)]))[: len(begin)] - 1
                several = (doc[begin] != doc[last]).astype(np.uint8)  # documents are in order within a key
                key = key[begin]
                rows = list(_rows(_spread(key, 48, parts), row["block"], (key, pack48), (several, lambda x: np.packbits(x).tobytes())))
                yield from _table(rows).to_batches()

    return run


def _shared_anchors(group: pa.Table) -> pa.Table:
    keys, several, block = [], [], group.column("block").to_pylist()
    for k, m in zip(group.column("keys").to_pylist(), group.column("more").to_pylist(), strict=True):
        keys.append(unpack48(k))
        several.append(np.unpackbits(np.frombuffer(m, dtype=np.uint8), count=len(keys[-1])).astype(bool))
    size = [len(k) for k in keys]
    flat = np.concatenate(keys)
    order = np.argsort(flat, kind="stable")
    ordered = flat[order]
    equal = ordered[1:] == ordered[:-1]
    shared = np.concatenate(several)
    twice = np.concatenate(([False], equal)) | np.concatenate((equal, [False]))
    shared[order[twice]] = True
    rows, at = [], 0
    for b, n, k in zip(block, size, keys, strict=True):
        kept = k[shared[at : at + n]]
        if len(kept):
            rows.append((0, b, [pack48(kept), b""]))
        at += n
    return _table(rows)


def _send_windows(parts: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _table([])
        row = left.to_pylist()[0]
        words = Words(unpack(row))
        shared = np.sort(np.concatenate([unpack48(k) for k in right.column("keys").to_pylist()]))
        at, key = words.anchors()
        found = np.searchsorted(shared, key)
        at = at[(found < len(shared)) & (shared[np.minimum(found, len(shared) - 1)] == key)]
        whole = words.whole(WIDTH)
        # a window that holds an anchor starts at most WIDTH - anchor length = PERIOD - 1 words before it
        near = np.zeros(len(words.doc) + 1, dtype=np.int64)
        np.add.at(near, np.maximum(at - PERIOD + 1, 0), 1)
        np.add.at(near, at + 1, -1)
        start = np.flatnonzero(whole & (np.cumsum(near)[: len(whole)] > 0))
        low, high = (x[start] for x in words.windows())
        doc = words.block.doc_ids[words.doc[start]]
        order = np.lexsort((doc, high, low))
        low, high, doc = low[order], high[order], doc[order]
        begin = np.flatnonzero(np.concatenate(([True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])))[: len(low)])
        last = np.concatenate((begin[1:], [len(low)]))[: len(begin)] - 1
        several = doc[begin] != doc[last]
        low, high, doc = low[begin], high[begin], doc[begin]
        keys = np.empty(len(low), dtype=FINGER)
        keys["low"], keys["high"] = low, high
        more = np.stack([doc, several.astype(np.int64)], axis=1)
        return _table(list(_rows(_spread(low, 64, parts), row["block"], (keys, np.ndarray.tobytes), (more, lambda x: _shrink(x.T)))))

    return run


FINGER = np.dtype([("low", "<u8"), ("high", "<u4")])


def _shrink(values: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(values, dtype="<i8").tobytes(), codec="zstd", asbytes=True)


def _grow(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, decompressed_size=8 * n, codec="zstd", asbytes=True), dtype="<i8")


def _least_documents(group: pa.Table) -> pa.Table:
    keys = [np.frombuffer(k, dtype=FINGER) for k in group.column("keys").to_pylist()]
    size = [len(k) for k in keys]
    more = [_grow(m, 2 * n).reshape(2, n) for m, n in zip(group.column("more").to_pylist(), size, strict=True)]
    flat, doc, several = np.concatenate(keys), np.concatenate([m[0] for m in more]), np.concatenate([m[1] for m in more])
    order = np.lexsort((doc, flat["high"], flat["low"]))
    low, high = flat["low"][order], flat["high"][order]
    begin = np.concatenate(([True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])))
    least = np.empty(len(flat), dtype=np.int64)
    least[order] = doc[order][np.flatnonzero(begin)[np.cumsum(begin) - 1]]
    needed = (least < doc) | (several > 0)
    rows, at = [], 0
    for b, n, k in zip(group.column("block").to_pylist(), size, keys, strict=True):
        kept = needed[at : at + n]
        if kept.any():
            rows.append((0, b, [k[kept].tobytes(), _shrink(least[at : at + n][kept])]))
        at += n
    return _table(rows)


KEPT = "doc_id long, n_words long, n_removed long, kept string"


def _remove(left: pa.Table, right: pa.Table) -> pa.Table:
    if not left.num_rows:
        return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.string())], ["doc_id", "n_words", "n_removed", "kept"])
    block = unpack(left.to_pylist()[0])
    words = Words(block)
    gone = np.zeros(len(words.doc), dtype=bool)
    if right.num_rows:
        keys = [np.frombuffer(k, dtype=FINGER) for k in right.column("keys").to_pylist()]
        least = np.concatenate([_grow(m, len(k)) for m, k in zip(right.column("more").to_pylist(), keys, strict=True)])
        keys = np.concatenate(keys)
        order = np.lexsort((keys["high"], keys["low"]))
        keys, least = keys[order], least[order]
        key_low, key_high = np.ascontiguousarray(keys["low"]), np.ascontiguousarray(keys["high"])
        low, high = words.windows()
        start = np.flatnonzero(words.whole(WIDTH))
        low, high, doc = low[start], high[start], block.doc_ids[words.doc[start]]
        at, hit = np.searchsorted(key_low, low), np.zeros(len(start), dtype=bool)
        while True:  # more than one step only where 64 bits of two windows agree
            inside = at < len(key_low)
            same = inside & (key_low[np.minimum(at, len(key_low) - 1)] == low)
            if not same.any():
                break
            here = np.minimum(at, len(key_low) - 1)
            hit |= same & (key_high[here] == high) & (least[here] < doc)
            at = np.where(same, at + 1, len(key_low))
        cover = np.zeros(len(words.doc) + 1, dtype=np.int64)
        np.add.at(cover, start[hit], 1)
        np.add.at(cover, start[hit] + WIDTH, -1)
        gone = np.cumsum(cover)[:-1] > 0
    n_docs = len(block.sizes)
    kept = ~gone
    data = block.data.copy()
    data[words.ends] = 32  # what follows a word becomes the blank between it and the next
    starts, size = words.starts[kept], words.ends[kept] - words.starts[kept] + 1
    doc = words.doc[kept]
    if len(doc):
        size[np.concatenate((doc[1:] != doc[:-1], [True]))] -= 1
    take = np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(size.sum())
    length = np.bincount(doc, weights=size, minlength=n_docs).astype(np.int64)
    offsets = np.concatenate(([0], np.cumsum(length)))
    text = pa.Array.from_buffers(pa.large_string(), n_docs, [None, pa.py_buffer(offsets), pa.py_buffer(data[take])]).cast(pa.string())
    n_words = np.diff(words.first)
    removed = np.bincount(words.doc[gone], minlength=n_docs)
    return pa.table([pa.array(block.doc_ids, mask=~block.has_id), pa.array(n_words.astype(np.int64)), pa.array(removed.astype(np.int64)), text], ["doc_id", "n_words", "n_removed", "kept"])


def ranges(table: DataFrame) -> int:
    """Hash ranges for an exchange: as many as shuffle partitions, more with much text, but no more than eight times that.

    A block sends a row to each range, so their number may not grow with the text as the blocks' does.
    """
    raw, dealt = table.agg(F.sum("raw_bytes")).first()[0] or 0, int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(max(dealt, -(-raw // RANGE_BYTES)), 8 * dealt)


def dedup(docs: DataFrame, block_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the kept words, joined by one blank) for each document."""
    scratch = Scratch(docs.sparkSession, "substring")
    texts = scratch.save(blocks(docs, block_bytes), "blocks", compression="none")
    parts = ranges(texts)
    by_block = texts.groupBy("block")
    anchors = texts.mapInArrow(_send_anchors(parts), SENT)
    shared = anchors.groupBy("part").applyInArrow(_shared_anchors, SENT)
    windows = by_block.cogroup(shared.groupBy("block")).applyInArrow(_send_windows(parts), SENT)
    least = windows.groupBy("part").applyInArrow(_least_documents, SENT)
    return texts.groupBy("block").cogroup(least.groupBy("block")).applyInArrow(_remove, KEPT)


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
