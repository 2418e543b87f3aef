from __future__ import annotations

import corpus_pipeline
from corpusloom.llm import langid, packing
from tests.llm.data import documents
from tests.llm.test_decontam import brute as contaminated
from tests.llm.test_decontam import items
from tests.llm.test_jaccard import brute as linked
from tests.llm.test_langid import brute as languages
from tests.llm.test_tokens import crc, ids

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def given() -> list[tuple]:
    """With a null id, repeated rows and a repeated id."""
    return [r[:5] for r in documents()]


def accepted(spark, rows: list[tuple]) -> list[tuple]:
    got = languages(spark, [r[:3] for r in rows])
    return [r for r, (lang, score) in zip(rows, got, strict=True) if lang != langid.NONE and (score >= 0.5 or sum(map(str.isalpha, r[1])) < 40)]


def test_against_brute_force(spark, tmp_path) -> None:
    spark.createDataFrame(given(), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items(), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = accepted(spark, given())
    component = linked(kept)
    first: set = set()
    unique = []
    for r in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1])):  # of rows that repeat an id, one
        if r[0] is None or (component[r[0]] == r[0] and r[0] not in first):
            unique.append(r)
            first.add(r[0])
    dirty = [r[5] for r in contaminated(unique, items())]
    texts = [(r[0], r[1]) for r, d in zip(unique, dirty, strict=True) if not d]
    assert 19 not in dict(texts) and len(texts) > 5  # 19 holds the item "12"
    want = []
    for doc, text in texts:
        text = "mail [EMAIL] or call [PHONE], host [IP], card [CARD] iban [IBAN]" if doc == 18 else text
        full = ids(text) + [packing.END_ID]
        want += [(doc, s, crc(full[s : s + 2048])) for s in range(0, len(full), 2048)]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r["doc_id"], r["start"], r["ids_crc32"]) for r in got), key=key) == sorted(want, key=key)


def test_stages_keep_the_columns(spark, tmp_path) -> None:
    docs = spark.createDataFrame(given(), SCHEMA)
    spark.createDataFrame(items(), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "pii", "packing"] and langid.NONE == "und"


def test_language_without_a_model_keeps_what_has_letters(spark, tmp_path) -> None:
    """No label at all, and labels whose ids are all held out of learning."""
    order = lambda ids: sorted(ids, key=lambda d: (d is None, d or 0))
    want = order(r[0] for r in given() if r[1] and any(c.isalpha() for c in r[1]))
    unlabelled = spark.createDataFrame([(d, t, None, s, n) for d, t, _, s, n in given()], SCHEMA)
    got = corpus_pipeline.language(spark, unlabelled, str(tmp_path))
    assert got.columns == unlabelled.columns and order(r["doc_id"] for r in got.collect()) == want
    labelled = spark.createDataFrame(given(), SCHEMA)
    held = labelled.filter(langid.held_out())
    assert langid.fit(langid.learnable(held)) is None
    assert order(r["doc_id"] for r in corpus_pipeline.language(spark, held, str(tmp_path)).collect()) == [d for d in want if d in {r["doc_id"] for r in held.collect()}] != []
