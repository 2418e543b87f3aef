from __future__ import annotations

import math

import numpy as np

from corpusloom.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def rows(n: int = 400, dims: int = 6) -> list[tuple]:
    rng = np.random.default_rng(5)
    out = [(i, [float(x) for x in rng.normal(size=dims).round(1)], 0, "s") for i in range(n)]
    for i in range(100, 240):
        out[i] = (i, [0.5, -0.25, 0.0, 0.0, 1.0, 0.0], 0, None)  # a third alike
    out[7], out[50], out[9] = (7, None, 0, None), (50, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0, None), (9, [math.nan] * dims, 0, None)
    out[11], out[12], out[13] = (11, [math.inf] * dims, 0, None), (12, [1.0], 0, None), (13, [], 0, None)
    return [*out, (None, [1.0] * dims, 0, None), (151, out[151][1], 0, None), (-50, [2.0] * dims, 0, None)]


def brute(given: list[tuple]) -> list[tuple]:
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, *_ in given if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in {i: v for i, v in sorted(ok, reverse=True) if i % 50 == 0}.items():
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in ok if i != q)[:5]
        out += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    return sorted(out)


def test_against_brute_force(spark) -> None:
    want = brute(rows())
    df = spark.createDataFrame(rows(), SCHEMA)
    assert sorted(map(tuple, topk.search(df.repartition(7)).collect())) == want
    assert sorted(map(tuple, topk.search(df.coalesce(1), block=3).collect())) == want
    assert sorted(map(tuple, topk.search(df.repartition(2), block_bytes=100).collect())) == want  # two queries a block


def test_wide_vectors(spark) -> None:
    rng = np.random.default_rng(6)
    wide = [(i, [float(x) for x in rng.normal(size=3000).round(2)], 0, None) for i in range(60)]
    assert sorted(map(tuple, topk.search(spark.createDataFrame(wide, SCHEMA).repartition(3), block_bytes=30_000).collect())) == brute(wide)


def test_few_and_none(spark) -> None:
    few = [(0, [1.0, 2.0], 0, None), (3, [0.0, 1.0], 0, None)]
    assert list(map(tuple, topk.search(spark.createDataFrame(few, SCHEMA)).collect())) == [(0, 1, 3, 512 * 256)]
    assert topk.search(spark.createDataFrame([], SCHEMA)).count() == 0
    assert topk.search(spark.createDataFrame(few[1:], SCHEMA)).count() == 0
