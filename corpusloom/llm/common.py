"""Plumbing that the training-data operators share: scratch tables, vocabularies, word hashing.

Nothing outside this subpackage imports it.
"""

from __future__ import annotations

import atexit
import gc
import json
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: The lower-casing that several contracts name: A-Z only, every other character stays.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(name: str, columns: list[str]) -> str:
    """``name``, with underscores put in front until no column is called so."""
    while name.lower() in {c.lower() for c in columns}:
        name = f"_{name}"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is ``spark.checkpoint.dir``. Only a local master (one process, whatever its threads) may run without
    that setting; it then gets a temporary folder.
    """
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if given:
        return given.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="corpusloom-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


#: Bytes of one Arrow batch between Spark and Python, where the session has Spark's own default of 64 MB.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def lean(spark: SparkSession) -> None:
    """Smaller Arrow batches for this session, unless it sets their size itself.

    A batch is held several times over on its way to a worker and back, outside the heap, so its size decides
    how much memory an executor needs beside the heap.
    """
    if spark.conf.get(BATCH) == f"{64 << 20}b":
        spark.conf.set(BATCH, f"{BATCH_BYTES}b")


class Scratch:
    """Intermediate tables of one operator run, as Parquet in the shared folder.

    A written table cuts the lineage: a lost executor costs at most the tasks that were running on it.
    ``drop`` frees a table that nothing reads any more; the rest goes when the driver's process ends.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        lean(spark)
        self.spark, self.base = spark, f"{shared_dir(spark)}/corpusloom-{name}-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def save(self, df: DataFrame, name: str, **options: object) -> DataFrame:
        df.write.options(**options).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def free(self, *names: str) -> None:
        """Drops these tables, and lets Spark's cleaner remove the shuffle files of finished queries, which it does when the driver collects its garbage."""
        for name in names:
            self.drop(name)
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, name: str = "") -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.base)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session may have ended before the process does
            return


def vocabulary_file(name: str) -> str:
    """A path as it is, or the place of one of the public vocabulary files, found on the machine that asks."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class TextEncoder:
    """Token ids of whole texts by the ``tokenizers`` library, from the ids of their distinct chunks.

    ``CHUNKED`` is the normaliser and pre-tokeniser of a lower-casing word BPE: it never looks across a blank,
    so the ids of a text are those of its blank-free chunks in order. Texts within Latin-1 and without control
    strings are also cut where the pre-tokeniser cuts (around digits and runs of marks) and lower-cased first,
    which leaves far fewer distinct chunks. Arrow cuts the texts and numbers the chunks by their exact strings;
    the library encodes each chunk that is not in the cache, whose two generations hold ``cache_bytes`` each.
    A vocabulary with any other normaliser or pre-tokeniser encodes whole texts.
    ``tests/llm/test_tokens.py`` holds both against whole-text encoding.
    """

    #: Blanks, letters and digits of Latin-1; the suffixes are those the pre-tokeniser keeps together.
    BLANK, LETTER, DIGIT = r"\t-\r \x{85}\x{a0}", r"A-Za-z\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}", r"0-9\x{b2}\x{b3}\x{b9}\x{bc}-\x{be}"
    CUT = rf"('(?:[sStTmMdD]|[rR][eE]|[vV][eE]|[lL][lL])|[^{BLANK}{LETTER}{DIGIT}]+|[{DIGIT}])"
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    CHUNKED = (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    )
    #: What a cache entry takes besides its characters and ids: two objects' heads and a slot of the table.
    ENTRY_BYTES = 220

    def __init__(self, vocabulary: str, cache_bytes: int = 32 << 20, part_bytes: int = 4 << 20) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.cache_bytes, self.part_bytes = Tokenizer.from_file(vocabulary_file(vocabulary)), cache_bytes, part_bytes
        made_of = json.loads(self.library.to_str())
        self.chunked = (made_of["normalizer"], made_of["pre_tokenizer"]) == self.CHUNKED
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def _ids(self, chunks: list[str]) -> list[bytes]:
        """Little-endian ids of each chunk; two generations of cache keep what is asked for often."""
        out: list[bytes] = []
        for k in range(0, len(chunks), 20_000):
            part, young, old, added = chunks[k : k + 20_000], self.young, self.old, 0
            missing = [c for c in part if c not in young and c not in old]
            fresh: dict[str, bytes] = {}
            if missing:
                done = self.library.encode(missing, is_pretokenized=True, add_special_tokens=False)
                ids = np.asarray(done.ids, dtype="<u4")
                ends = np.cumsum(np.bincount(np.asarray(done.word_ids, dtype=np.int64), minlength=len(missing))) * 4
                raw, at = ids.tobytes(), 0
                for c, end in zip(missing, ends.tolist(), strict=True):
                    fresh[c] = raw[at:end]
                    at = end
            for c in part:
                got = young.get(c)
                if got is None:
                    got = old.get(c)
                    if got is None:
                        got = fresh[c]
                    if len(c) <= 64:
                        young[c] = got
                        added += self.ENTRY_BYTES + len(c) + len(got)
                out.append(got)
            self.held += added
            if self.held > self.cache_bytes:
                self.old, self.young, self.held = young, {"": b""}, 0
        return out

    def _cut(self, texts: pa.Array) -> pa.Array:
        """A list of chunks for each text."""
        plain = pc.invert(pc.or_(pc.match_substring_regex(texts, r"[^\x{00}-\x{ff}]"), pc.match_substring(texts, "<|")))
        if pc.any(plain).as_py():
            finer = pc.utf8_lower(pc.replace_substring_regex(texts, self.CUT, r" \1 "))
            texts = pc.if_else(plain, finer, texts)
        for blank in "\n\t\r":
            texts = pc.replace_substring(texts, blank, " ")
        return pc.split_pattern(texts, " ")

    def _part(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not self.chunked:
            done = [x.ids for x in self.library.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            return np.fromiter((i for x in done for i in x), dtype="<u4"), np.array([len(x) for x in done], dtype=np.int64)
        cut = self._cut(texts)
        offsets = np.asarray(cut.offsets).astype(np.int64)
        numbered = cut.values.dictionary_encode()
        kinds = self._ids(numbered.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(kinds), dtype="<u4")
        size = np.fromiter(map(len, kinds), dtype=np.int64, count=len(kinds)) // 4
        starts = np.cumsum(size) - size
        codes = np.asarray(numbered.indices)
        count = size[codes]
        ends = np.concatenate(([0], np.cumsum(count)))
        at = np.repeat(starts[codes] - ends[:-1], count)
        at += np.arange(ends[-1])
        return flat[at], np.diff(ends[offsets])

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first text, ids, ids per text) for runs of consecutive texts; null counts as empty.

        A run holds about ``part_bytes`` of text. A text longer than that is cut at blanks on the way in, where
        the vocabulary allows it, and put together again, so the working memory stays a small multiple of that
        and of its ids.
        """
        texts = pc.fill_null(texts, "")
        bytes_ = np.asarray(pc.binary_length(texts)).astype(np.int64)
        at = 0
        while at < len(texts):
            total = np.cumsum(bytes_[at:])
            n = int(np.searchsorted(total, self.part_bytes, side="right"))
            if n or not self.chunked:
                n = max(n, 1)
                yield at, *self._part(texts.slice(at, n))
                at += n
                continue
            text, ids, begin = texts[at].as_py(), [], 0
            while begin < len(text):
                end = text.find(" ", begin + self.part_bytes)
                end = len(text) if end < 0 else end
                ids.append(self._part(pa.array([text[begin:end]]))[0])
                begin = end
            ids = np.concatenate(ids)
            yield at, ids, np.array([len(ids)])
            at += 1


_ENCODERS: dict[str, TextEncoder] = {}


def encoder(vocabulary: str) -> TextEncoder:
    """One encoder per Python worker; workers are reused between tasks, and so is the cache."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = TextEncoder(vocabulary)
    return _ENCODERS[vocabulary]
