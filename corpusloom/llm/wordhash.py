"""Words, their hashes and hashes of word runs for whole blocks of documents, in numpy; and the blocks themselves.

A word is hashed eight bytes at a time, each eight through a bijective, non-linear finaliser keyed by what
went before; a word of over ``LONG_WORD`` bytes by BLAKE2b. A run of words is hashed by a multilinear form over
its words' hashes, with a multiplier of its own for each place, and the finaliser. So no pattern in a word or
in a run brings two hashes together, as patterns do with polynomials modulo a power of 2. Two seeds give
independent hashes where a fingerprint of more than 64 bits is wanted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEEDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
KEYS = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
LONG_WORD = 64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The lowest 0 to 8 bytes of a 64-bit integer.
BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def multipliers(seed: int, n: int) -> np.ndarray:
    """n odd numbers without a rule between them."""
    return np.array([int.from_bytes(hashlib.blake2b(bytes([seed, k]), digest_size=8).digest(), "little") | 1 for k in range(n)], dtype=np.uint64)


@dataclass
class Block:
    """Some documents: their ids, and their texts as one run of bytes with a blank after each."""

    doc_ids: np.ndarray
    has_id: np.ndarray
    sizes: np.ndarray
    data: np.ndarray

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, document) of each word: a run of bytes other than space and 9 to 13."""
        blank = (self.data == 32) | ((self.data >= 9) & (self.data <= 13))
        edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True]))))
        starts, ends = edge[::2], edge[1::2]
        return starts, ends, np.searchsorted(np.cumsum(self.sizes), starts, side="right")

    def hashes(self, starts: np.ndarray, ends: np.ndarray, seed: int, lower: bool = False) -> np.ndarray:
        """A hash of each word."""
        data = np.concatenate((LOWER[self.data] if lower else self.data, np.zeros(8, dtype=np.uint8)))
        eight = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
        size = ends - starts
        out = size.astype(np.uint64) * SEEDS[seed]
        short, at = np.flatnonzero(size <= LONG_WORD), 0
        while len(short):
            read = eight[starts[short] + at] & BYTES[np.minimum(size[short] - at, 8)]
            out[short] = mix(out[short] * KEYS[seed] ^ read)
            at += 8
            short = short[size[short] > at]
        for i in np.flatnonzero(size > LONG_WORD).tolist():
            digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=16).digest()
            out[i] = int.from_bytes(digest[8 * seed : 8 * seed + 8], "little")
        return out


def runs(hashes: np.ndarray, length: int, seed: int) -> np.ndarray:
    """A hash of each run of ``length`` consecutive words, whether or not it stays in one document."""
    n = max(0, len(hashes) - length + 1)
    total = np.zeros(n, dtype=np.uint64)
    for k, p in enumerate(multipliers(seed, length)):
        total += hashes[k : k + n] * p
    return mix(total)


BLOCKS = "block long, raw_bytes long, doc_ids binary, has_id binary, sizes binary, data binary"


def blocks(docs: DataFrame, block_bytes: int = 4 << 20) -> DataFrame:
    """The documents' ids and texts, in compressed blocks of about ``block_bytes`` of text; a longer text is a block of its own.

    Block ids come from the task, so use them only once the blocks are written.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, ids, texts, held = TaskContext.get().partitionId(), 0, [], [], 0
        codec = pa.Codec("zstd", compression_level=6)  # blocks are shuffled more than once

        def flush() -> pa.RecordBatch:
            data = b"".join(t + b" " for t in texts)
            row = {
                "block": task << 32 | n, "raw_bytes": len(data), "doc_ids": np.array([i or 0 for i in ids], dtype=np.int64).tobytes(),
                "has_id": np.array([i is not None for i in ids], dtype=np.uint8).tobytes(), "sizes": np.array([len(t) + 1 for t in texts], dtype=np.int64).tobytes(),
                "data": codec.compress(data, asbytes=True),
            }
            kinds = {"block": pa.int64(), "raw_bytes": pa.int64()}
            return pa.RecordBatch.from_arrays([pa.array([v], kinds.get(k, pa.binary())) for k, v in row.items()], list(row))

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_buffer().to_pybytes() if text.is_valid else b""
                if ids and held + len(text) > block_bytes:
                    yield flush()
                    n, ids, texts, held = n + 1, [], [], 0
                ids.append(doc_id)
                texts.append(text)
                held += len(text)
        if ids:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(pack, BLOCKS)


def unpack(row: dict) -> Block:
    data = pa.decompress(row["data"], decompressed_size=row["raw_bytes"], codec="zstd", asbytes=True)
    return Block(np.frombuffer(row["doc_ids"], dtype=np.int64), np.frombuffer(row["has_id"], dtype=bool), np.frombuffer(row["sizes"], dtype=np.int64), np.frombuffer(data, dtype=np.uint8))


def pack48(values: np.ndarray) -> bytes:
    """48-bit integers, 6 bytes each."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack48(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")
