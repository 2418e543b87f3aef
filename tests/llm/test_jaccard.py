from __future__ import annotations

import random
import time

import numpy as np

from corpusloom.llm import jaccard
from corpusloom.llm.wordhash import Block
from tests.llm.data import BETWEEN, DOC_SCHEMA, THUE_MORSE, documents, prose, shingles


def brute(rows: list[tuple]) -> dict:
    sets = [(d, shingles(t)) for d, t, *_ in rows if d is not None]
    parent = {d: d for d, _ in sets}

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {d: find(d) for d in parent}


def check(spark, rows: list[tuple], schema: str, **options: int) -> None:
    got = jaccard.join(spark.createDataFrame(rows, schema).repartition(3), block_bytes=3000, **options).collect()
    want = brute(rows)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"]) for r in got) == sorted((d is None, d or 0, len(shingles(t))) for d, t, *_ in rows)
    assert all(r["component_id"] == want.get(r["doc_id"]) for r in got)


def test_against_brute_force(spark) -> None:
    check(spark, documents(), DOC_SCHEMA)


def test_near_copies_of_every_degree(spark) -> None:
    """A long list: one base and many copies with up to a third of their words changed, so that links form chains."""
    r, base, rows = random.Random(3), prose(50, 90).split(" "), []
    for k in range(60):
        w = list(base)
        for _ in range(k // 6):
            w[r.randrange(len(w))] = f"n{k}"
        rows.append((1000 - k, " ".join(w)))
    rows += [(2000 + k, prose(60 + k, 60) + " " + " ".join(base[:25])) for k in range(10)]
    check(spark, rows, "doc_id long, text string")


def test_lists_in_tiles(spark) -> None:
    """Every list of two documents or more in tiles, with groups that chain, and documents outside each group."""
    r, rows = random.Random(5), []
    for g in range(3):
        base = prose(70 + g, 60).split(" ")
        for k in range(25):
            w = list(base)
            for _ in range(k % 9):
                w[r.randrange(len(w))] = f"n{g}.{k}"
            rows.append((100 * g + k, " ".join(w)))
        rows += [(100 * g + 50 + k, " ".join(base[:20]) + " " + prose(80 + 9 * g + k, 22)) for k in range(9)]
    check(spark, [*rows, (7, None), (8, "")], "doc_id long, text string", tile=1)


def test_words_that_polynomials_confuse(spark) -> None:
    check(spark, [(1, BETWEEN.format(THUE_MORSE)), (2, BETWEEN.format(THUE_MORSE.translate({97: 98, 98: 97}))), (3, BETWEEN.format(THUE_MORSE))], "doc_id long, text string")


def test_many_short_documents_take_no_longer_than_their_text() -> None:
    """450,000 documents of two words in one block; none of them costs a step of its own."""
    n = 450_000
    data = " ".join(f"w{k} v{k % 977}" for k in range(n)).encode() + b" "
    sizes = np.array([len(f"w{k} v{k % 977} ") for k in range(n)])
    began = time.perf_counter()
    key, size = jaccard.shingle_sets(Block(np.arange(n), np.ones(n, dtype=bool), sizes, np.frombuffer(data, dtype=np.uint8)))
    assert time.perf_counter() - began < 30 and len(key) == n == len(np.unique(key)) and (size == 1).all()


def test_merge_skip_counts_what_is_in_enough_lists() -> None:
    rng = random.Random(4)
    for _ in range(200):
        lists = [sorted(rng.sample(range(40), rng.randrange(0, 25))) for _ in range(rng.randrange(1, 9))]
        need = rng.randrange(1, 6)
        count = {m: sum(m in x for x in lists) for m in range(40)}
        assert jaccard.merge_skip(lists, need) == {m: c for m, c in count.items() if c >= need}


def test_deduplication_keeps_one_of_each(spark) -> None:
    docs = spark.createDataFrame(documents(), DOC_SCHEMA)
    kept = jaccard.deduplicate(docs)
    want = brute(documents())
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, c in want.items() if d == c} | {None}


def test_nothing(spark) -> None:
    assert jaccard.join(spark.createDataFrame([], DOC_SCHEMA)).count() == 0
    assert jaccard.join(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).filter("component_id = doc_id and n_shingles = 0").count() == 2


def test_divide_skip_is_exact() -> None:
    rng = np.random.default_rng(1)
    for _ in range(50):
        query = np.unique(rng.integers(0, 60, 30).astype(np.uint64))
        sets = [np.unique(np.concatenate([rng.choice(query, len(query) - int(rng.integers(0, 8)), replace=False), rng.integers(0, 60, int(rng.integers(0, 8))).astype(np.uint64)])) for _ in range(9)]
        got = jaccard.divide_skip(query, sets)
        for s, g in zip(sets, got.tolist(), strict=True):
            both = len(np.intersect1d(query, s))
            assert g == (both if 100 * both >= 75 * (len(query) + len(s) - both) else 0)


def test_bitmaps_bound_the_overlap() -> None:
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 2**64, int(rng.integers(1, 300)), dtype=np.uint64)) for _ in range(2))
        b = np.unique(np.concatenate([b, a[: len(a) // 2]]))
        assert jaccard.overlap_bound(jaccard.bitmap(a), jaccard.bitmap(b), len(a), len(b)) >= len(np.intersect1d(a, b))
