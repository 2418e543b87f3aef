from __future__ import annotations

import glob
import json
import sys
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from corpusloom.llm import packing, tokens
from corpusloom.llm.common import Scratch, TextEncoder, vocabulary_file
from tests.llm.data import DOC_SCHEMA, documents, prose

NAME = "word_bpe_49k.json"
ODD = ["", "  ", "don't DON'T I'LL ''s .'s x's's", "<|endoftext|>abc <|ENDOFTEXT|>", "éa É İstan ßÀ b\x85c\x0bd\x1ce", "12.5%½²", "日本語 テスト", "ﬁ K", "Σας ΟΔΟΣ'Α", "'", "''", "'s", "ªµµ··", "x" * 100 + " " + "'" * 50, "ÀÉ'S 'LLa 'ſa '’s", "a<|b", "\ufeffx", "e\u0301 E\u0301", "a\r\nb\tc"]


def ids(text: str | None) -> list[int]:
    return Tokenizer.from_file(vocabulary_file(NAME)).encode(text or "", add_special_tokens=False).ids


def crc(values: list[int]) -> int:
    return zlib.crc32(np.asarray(values, dtype="<u4").tobytes())


def test_chunks_give_the_ids_of_whole_texts() -> None:
    texts = ODD + [r[1] for r in documents()]
    for part_bytes in (1 << 20, 64):
        got = [x for _, flat, n in TextEncoder(NAME, cache_bytes=20_000, part_bytes=part_bytes).encode(pa.array(texts)) for x in np.split(flat, np.cumsum(n)[:-1])]
        assert [x.tolist() for x in got] == [ids(t) for t in texts]


def test_other_vocabularies_encode_whole_texts(tmp_path) -> None:
    """The same file with case kept: its chunks aren't those that the shortcut cuts."""
    raw = json.load(open(vocabulary_file(NAME)))
    raw["normalizer"]["normalizers"].pop()
    other = tmp_path / "cased.json"
    other.write_text(json.dumps(raw))
    texts = [*ODD, "Aa bB", "x " * 300]
    whole = Tokenizer.from_file(str(other))
    encode = TextEncoder(str(other), part_bytes=64)
    assert not encode.chunked and TextEncoder(NAME).chunked
    got = [x.tolist() for _, flat, n in encode.encode(pa.array(texts)) for x in np.split(flat, np.cumsum(n)[:-1])]
    assert got == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_the_cache_stays_small() -> None:
    """600,000 distinct chunks, far more than one run of texts holds as a rule: both generations below 50 MB."""
    letters = "abcdefghijklmnopqrst"
    words = ["".join(letters[k // 20**i % 20] for i in range(5)) for k in range(600_000)]
    encode = TextEncoder(NAME)
    for _, flat, _ in encode.encode(pa.array([" ".join(words)])):
        assert len(flat) >= len(words)
    held = sum(sys.getsizeof(d) + sum(sys.getsizeof(c) + sys.getsizeof(i) for c, i in d.items()) for d in (encode.young, encode.old))
    assert len(encode.young) + len(encode.old) > 50_000 and held < 50e6, held


def test_layout_of_the_token_files(spark, tmp_path) -> None:
    """Ids in dictionary pages, integers delta-encoded, indexes for both, more than one row group of a few rows."""
    rows = [(k, prose(k, 300)) for k in range(400)]
    tokens.write(spark.createDataFrame(rows, "doc_id long, text string"), f"{tmp_path}/d", parts=1, row_group_bytes=64 << 10)
    (file,) = glob.glob(f"{tmp_path}/d/tokens/*.parquet")
    meta = pq.ParquetFile(file).metadata
    assert meta.num_row_groups > 1
    for g in range(meta.num_row_groups):
        columns = {meta.row_group(g).column(i).path_in_schema: meta.row_group(g).column(i) for i in range(meta.row_group(g).num_columns)}
        assert "RLE_DICTIONARY" in columns["ids.list.element"].encodings
        for name in ("doc_id", "local_start", "n_tokens"):
            assert "DELTA_BINARY_PACKED" in columns[name].encodings and not columns[name].has_dictionary_page
            assert columns[name].has_column_index and columns[name].has_offset_index


def test_token_dataset(spark) -> None:
    rows = documents()
    path = Scratch(spark, "t").path("d")
    tokens.write(spark.createDataFrame(rows, DOC_SCHEMA), path, parts=3)
    got = tokens.digest(tokens.read(spark, path)).collect()
    want, at = [], 0
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        full = ids(r[1]) + [tokens.END_ID]
        want.append((r[0], at, len(full), crc(full)))
        at += len(full)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert tokens.read(spark, path, metadata_only=True).columns == ["doc_id", "start", "n_tokens"]
    one = tokens.read(spark, path).filter("doc_id = 7")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)" in one._jdf.queryExecution().explainString(one._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert list(one.first()["ids"])[:-1] == ids(next(r[1] for r in rows if r[0] == 7))


def test_token_dataset_of_nothing(spark) -> None:
    path = Scratch(spark, "t").path("d")
    tokens.write(spark.createDataFrame([], DOC_SCHEMA), path)
    assert tokens.digest(tokens.read(spark, path)).count() == 0


def test_packing(spark) -> None:
    rows = documents()
    packed = packing.pack(spark.createDataFrame(rows, DOC_SCHEMA), group_docs=10)
    got = packing.digest(packed).collect()
    held: dict = {}
    for r in got:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in held.values():  # gapless from 0, within the window
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    want = []
    for r in rows:
        full = ids(r[1]) + [packing.END_ID]
        want += [(r[0], s, len(full[s : s + 2048]), crc(full[s : s + 2048]), len(full)) for s in range(0, len(full), 2048)]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got), key=key) == sorted(want, key=key)
    whole = packing.sequences(packed).collect()
    assert all(len(s["ids"]) == 4 * packing.WINDOW for s in whole) and sum(s["used"] for s in whole) == sum(r["length"] for r in got)
    assert packing.pack(spark.createDataFrame([], DOC_SCHEMA)).count() == 0


def test_missing_ids_and_copies_spread_over_groups(spark) -> None:
    """All rows alike, without an id: their groups differ by the input's partition."""
    rows = [(None, "the same text in every row")] * 2000
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), group_docs=50).collect()
    assert len(got) == 2000 and len({r["sequence_id"] >> 32 for r in got}) > 2


def test_best_fit_takes_the_tightest_sequence() -> None:
    tree = packing.CapacityTree(16)
    for sequence, capacity in ((0, 9), (1, 4), (2, 16), (3, 4)):
        tree.put(sequence, capacity)
    assert tree.take(3) == (3, 4) and tree.take(3) == (1, 4) and tree.take(3) == (0, 9) and tree.take(10) == (2, 16) and tree.take(1) is None
    rng = np.random.default_rng(0)
    fit, open_ = packing.BestFit(64), []
    for length in sorted(rng.integers(1, 64, 500).tolist(), reverse=True):  # against a plain scan
        sequence, offset = fit.place(length)
        able = [c for c in open_ if c >= length]
        if able:
            assert 64 - offset == min(able)
            open_.remove(min(able))
        else:
            assert offset == 0
        open_.append(64 - offset - length)
