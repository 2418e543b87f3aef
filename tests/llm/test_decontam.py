from __future__ import annotations

import hashlib
import re

from corpusloom.llm import decontam
from tests.llm.data import DOC_SCHEMA, LOWER, documents, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs: list[tuple], items: list[tuple]) -> list[tuple]:
    windows = set()
    for item, text, *_ in items:
        w = WORD.findall((text or "").translate(LOWER))
        windows |= {(item, tuple(w[i : i + 10])) for i in range(max(1, len(w) - 9))} if w else set()
    out = []
    for doc, text, *_ in docs:
        w, hit, found = WORD.findall((text or "").translate(LOWER)), set(), set()
        for item, win in windows:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    found |= {str(item)} if item is not None else set()
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def items() -> list[tuple]:
    w = prose(2, 80).split(" ")
    return [(1, " ".join(w[5:30])), (2, " ".join(w[20:40]).upper()), (10, "same"), (3, None), (4, ""), (5, prose(1, 12)), (None, prose(7, 15)), (6, prose(99, 60)), (6, prose(99, 60)), (7, "absent words here"), (8, "12")]


def test_against_brute_force(spark) -> None:
    docs, b = spark.createDataFrame(documents(), DOC_SCHEMA), spark.createDataFrame(items(), "item_id long, text string")
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    want = sorted(brute(documents(), items()), key=key)
    for block in (50_000, 20):
        got = decontam.digest(decontam.decontaminate(docs, b, block=block))
        assert sorted(map(tuple, got.collect()), key=key) == want  # repeated rows are neither lost nor doubled
        assert got.filter("contaminated").count() == sum(r[5] for r in want)
    kept = decontam.clean(docs, b)
    assert kept.columns == docs.columns and kept.count() == sum(not r[5] for r in want)


def test_nothing(spark) -> None:
    docs, none = spark.createDataFrame(documents(), DOC_SCHEMA), spark.createDataFrame([], "item_id long, text string")
    assert decontam.digest(decontam.decontaminate(docs, none)).filter("contaminated").count() == 0
    assert decontam.decontaminate(spark.createDataFrame([], DOC_SCHEMA), none).count() == 0


def test_words_are_cut_once_and_as_the_contract_says(spark) -> None:
    texts = ["".join(map(chr, range(1, 0x250))), "A1-b\x7fc\x80d É ſK 日本𝒜 \U0010ffff_x", None, "", "..", "abc"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    cut = docs.select("doc_id", decontam.words(docs.text).alias("w"))
    assert [r.w for r in cut.orderBy("doc_id").collect()] == [WORD.findall((t or "").translate(LOWER)) for t in texts]
    each = decontam.each_word(cut)
    assert sorted(r.word for r in each.collect()) == sorted(w for t in texts for w in WORD.findall((t or "").translate(LOWER)))
    assert each._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 1
