"""State letters looked up token by token, against the chains of replacements."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from corpusloom.functions import lexicon as X
from corpusloom.functions import states as ST
from corpusloom.operators import sequences as Q
from tests.data import prose

WORDS = [w for ws in (X.STOP_TERMS, X.ABSTRACT_TERMS, X.PRODUCT_TERMS, X.MODALS_WIDE, X.CLAIM_VERBS, X.NEGATIONS, X.UNIVERSALS, X.PREPOSITIONS, X.PRONOUNS) for w in ws.split()] + list(X.CONCEPT_HINTS)
MARKS = "A I IT U.S. 3.5% 7+ € $9 — - ;: ... x_y a1 B2b don't Can't O'- ﬁx ı K ſ ß É naïve 日本 ½ Ⅷ ٣     \x85 _ __ 😀 co-op- Abcdefghij ing sing ed red organizational ly"
TEXTS = [None, "", " \n\t ", "the", "the of", MARKS, MARKS.upper(), " ".join(WORDS), " ".join(WORDS).title(), " ".join(WORDS).upper(), " ".join(w + "tion" for w in WORDS), prose(4, 400), "x" * 300 + "ness"]


def test_letters_are_those_of_the_chains(spark) -> None:
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for views, pattern in ((ST.VIEWS, X.TOK_MARKOV), (("posish_wide", "token_type"), X.TOK_SPIKE)):
        want = docs.select("doc_id", *(ST.sequence(Q.tokens(pattern=pattern), v).alias(v) for v in views))
        got = Q.with_states(docs, views, pattern).select("doc_id", *views)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        assert "regexp_replace" not in got._jdf.queryExecution().optimizedPlan().toString()  # a pass over the text for each rule


def test_a_filter_reads_the_text_once(spark) -> None:
    rows = Q.with_states(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"), ("shape", "coarse"))
    plan = rows.filter(F.length("shape") > 3).filter("coarse <> ''").select("doc_id", "shape")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_memory_of_letters_is_bounded(monkeypatch) -> None:
    monkeypatch.setattr(ST, "REMEMBERED", 8)
    of = ST.Letters("shape")
    assert {of[f"w{i}"] for i in range(100)} == {ST.letter("shape", "SHORT")} and len(of) <= 8 and of["y" * 100] == ST.letter("shape", "LONG") and "y" * 100 not in of
    assert ST.lettered(("motif",))(pa.array(["", "not\ndata"])).to_pylist() == [{"motif": ST.letter("motif", "NO_MOTIF")}, {"motif": ST.letter("motif", "NEG_ABSTRACT")}]
