from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm import langid
from tests.llm.data import DOC_SCHEMA, documents


def brute(spark, rows: list[tuple], per_lang: int = 200, landmarks: int = 24, ridge: float = 0.1) -> list[tuple[str, float]]:
    """(language, score) of each row (doc_id, text, lang): sets of slots, kernel values one by one, Nyström and ridge as in the books."""
    held = [frozenset(np.flatnonzero(p).tolist()) if t and (p := langid.slots(t)) is not None else None for _, t, _ in rows]
    ids = sorted({d for d, *_ in rows if d is not None})
    low = {r[0]: r[1] for r in spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))).collect()}
    sample: list[tuple[str, frozenset]] = []
    for lang in sorted({g for d, _, g in rows if d is not None and g is not None}):
        own = [(low[d], d, t, h) for (d, t, g), h in zip(rows, held, strict=True) if g == lang and d is not None and zlib.crc32(str(d).encode()) % 3 != 1]
        chosen = sorted({x[:2] for x in own})[:per_lang]
        for c in chosen:
            texts = [(x[2], x[3]) for x in own if x[:2] == c and x[2] is not None]
            if texts and min(texts, key=lambda x: x[0])[1] is not None:
                sample.append((lang, min(texts, key=lambda x: x[0])[1]))
    if not sample:
        return [(langid.NONE, 0.0)] * len(rows)
    langs = sorted({g for g, _ in sample})
    marks = [s for g in langs for s in [s for k, s in sample if k == g][:landmarks]]
    kernel = lambda a: [len(a & b) / math.sqrt(len(a) * len(b)) for b in marks]
    values, vectors = np.linalg.eigh(np.array([kernel(m) for m in marks]))
    root = vectors @ np.diag(np.maximum(values, 1e-6) ** -0.5) @ vectors.T
    x = np.array([kernel(s) for _, s in sample]) @ root
    weights = []
    for lang in langs:  # one against the rest; every language counts alike
        y = np.array([1.0 if g == lang else -1.0 for g, _ in sample])
        w = np.array([len(sample) / (len(langs) * sum(k == g for k, _ in sample)) for g, _ in sample])
        weights.append(root @ np.linalg.solve((x * w[:, None]).T @ x + ridge * np.eye(len(marks)), (x * w[:, None]).T @ y))
    out = []
    for h in held:
        got = [float(np.dot(kernel(h), w)) for w in weights] if h is not None else []
        out.append((langs[int(np.argmax(got))], min(1.0, max(0.0, (max(got) + 1) / 2))) if got else (langid.NONE, 0.0))
    return out


def test_against_brute_force(spark) -> None:
    """Real documents, repeated ids and rows, and fewer documents a language than there are."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs] + [r[:3] for r in documents()]
    rows = [*rows, rows[0], (rows[0][0], "another text of it", rows[0][2]), (None, rows[3][1], "en"), (10_001, rows[5][1], None)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "n long, doc_id long, text string, lang string").repartition(5)
    for per_lang in (200, 12):
        want = brute(spark, rows, per_lang)
        got = {r["n"]: r for r in langid.predict(df, langid.fit(langid.learnable(df), per_lang)).collect()}
        assert len(got) == len(rows)
        for k, (lang, score) in enumerate(want):
            assert abs(got[k]["score"] - score) < 2e-3 and (got[k]["lang_pred"] == lang or abs(score - 0.5) < 2e-3), (k, rows[k], got[k], want[k])


def test_ids_that_repeat_do_not_empty_a_language(spark) -> None:
    """One id in most rows: the hash threshold alone would leave next to no document of the language."""
    rows = [(1, f"eins zwei drei {k % 7}", "de") for k in range(5000)] + [(k, f"one two three {k}", "en") for k in range(2, 400)]
    rows += [(10_000 + k, f"vier acht neun {k}", "de") for k in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.fit(langid.learnable(df), per_lang=6).languages == ["de", "en"]


def test_acceptance(spark) -> None:
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(-1, "Это довольно обычный текст на русском языке, который модель никогда не видела раньше.", None), (-2, "Это", None), (-3, "12 !!", None), (-4, None, None)], docs.schema)
    model = langid.fit(langid.learnable(docs))
    kept = {r["doc_id"] for r in langid.accept(docs.union(odd), model).collect()}
    assert -1 not in kept and -2 in kept and -3 not in kept and -4 not in kept
    assert len(kept) >= 0.98 * docs.count()


def test_held_out_accuracy(spark) -> None:
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = langid.predict(docs, langid.fit(langid.learnable(docs), per_lang=60), ["doc_id", "lang"]).withColumn("held", langid.held_out())
    rows = [r for r in got.collect() if r["held"] and r["lang_pred"] != langid.NONE]
    assert len(rows) > 30 and np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_slots_count_presence_over_whole_texts() -> None:
    text = "Größe und  Maß, 12 \t straße"
    low = "".join(c if c.isalpha() else " " for c in text.lower())
    low = " " + " ".join(low.split())
    low += " " if not text[-1].isalpha() else ""
    grams = {low[i : i + n] for n in range(1, 5) for i in range(len(low) - n + 1)}
    assert 0.9 * len(grams) <= langid.slots(text).sum() <= len(grams)
    old, langid.PIECE = langid.PIECE, 7
    try:
        assert (langid.slots(text * 3) == langid.slots(text * 3)).all()
        pieces = langid.slots(text * 3)
    finally:
        langid.PIECE = old
    assert (pieces == langid.slots(text * 3)).all()
    assert langid.slots("12 !! ") is None and langid.slots("") is None


def test_awkward_rows(spark) -> None:
    docs = spark.createDataFrame(documents(), DOC_SCHEMA)
    model = langid.fit(langid.learnable(docs))
    got = langid.predict(docs, model)
    assert got.count() == docs.count() and got.columns.count("score") == 1
    by = {r["doc_id"]: r["lang_pred"] for r in got.collect()}
    assert {by[k] for k in (1, 2, 3, 16)} == {langid.NONE} and by[0] in ("en", "de") and by[22] in ("en", "de")
    empty = spark.createDataFrame([], DOC_SCHEMA)
    assert langid.fit(langid.learnable(empty)) is None
    assert {r["lang_pred"] for r in langid.predict(docs, None).collect()} == {langid.NONE}
    assert langid.predict(empty, model).count() == 0
