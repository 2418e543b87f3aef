from __future__ import annotations

import hashlib

from corpusloom.llm import substring
from tests.llm.data import BETWEEN, DOC_SCHEMA, THUE_MORSE, documents, words


def brute(rows: list[tuple]) -> list[tuple]:
    first: dict = {}
    for doc, text, *_ in rows:
        w = words(text)
        for i in range(len(w) - 12 if doc is not None else 0):
            key = tuple(w[i : i + 13])
            first[key] = min(doc, first.get(key, doc))
    out = []
    for doc, text, *_ in rows:
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - 12 if doc is not None else 0):
            if first[tuple(w[i : i + 13])] < doc:
                gone[i : i + 13] = [True] * 13
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((doc, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_against_brute_force(spark) -> None:
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    df = spark.createDataFrame(documents(), DOC_SCHEMA).repartition(3)
    want = sorted(brute(documents()), key=key)
    for block_bytes in (4 << 20, 500):
        assert sorted(map(tuple, substring.digest(substring.dedup(df, block_bytes)).collect()), key=key) == want
    assert sum(r[2] for r in want) > 300


def test_every_alignment_is_found(spark) -> None:
    """A run of 13 words at every pair of positions modulo the period."""
    run = [f"w{i}" for i in range(13)]
    rows, k = [], 0
    for a in range(7):
        for b in range(7):
            mine = [f"{x}.{k}" for x in run]
            rows += [(2 * k, " ".join([f"p{k}"] * a + mine)), (2 * k + 1, " ".join([f"q{k}"] * b + mine + ["end"]))]
            k += 1
    got = substring.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["n_removed"] for r in got if r["doc_id"] % 2} == {13} and {r["n_removed"] for r in got if r["doc_id"] % 2 == 0} == {0}


def test_words_that_polynomials_confuse(spark) -> None:
    other = THUE_MORSE.translate({97: 98, 98: 97})
    rows = [(1, BETWEEN.format(THUE_MORSE)), (2, BETWEEN.format(other)), (3, BETWEEN.format(other))]
    got = substring.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["n_removed"] for r in got} == {1: 0, 2: 0, 3: 13}


def test_nothing(spark) -> None:
    assert substring.dedup(spark.createDataFrame([], DOC_SCHEMA)).count() == 0
