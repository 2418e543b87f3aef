"""Unit cases that the tables don't hold: rule order, edges of thresholds, sources and sinks, trees."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import lexicon as X
from corpusloom.functions import states as ST
from corpusloom.functions.dialect import SPARK
from corpusloom.operators import chunking as C
from corpusloom.operators import contract as CT
from corpusloom.operators import detector as D
from corpusloom.operators import features as FE
from corpusloom.operators import graphs, sampling
from corpusloom.operators import models as MO
from corpusloom.operators import sequences as Q
from corpusloom.operators.ordinals import numbered
from corpusloom.plans.contract import fixtures
from corpusloom.sources import tables as IO

TOKENS = ["for", "can", "ABC", "$", "12%", "—", "Running", "nation", "never", "system", "quickly", "api"]


@pytest.mark.parametrize(
    ("rule", "want"),
    [
        (ST.shape, ["FUNC", "SHORT", "ALLCAPS", "SHORT", "NUM", "PUNCT", "CAP", "WORD", "WORD", "WORD", "WORD", "SHORT"]),
        (ST.coarse, ["FUNC", "MODAL", "ENTITY", "NUM", "NUM", "PUNCT", "ENTITY", "ABSTRACT", "NEG", "ABSTRACT", "CONTENT", "PRODUCT"]),
        (ST.posish, ["FUNC", "MODAL", "ACRONYM", "NUM", "NUM", "CLAUSE_PUNCT", "TITLE", "NOUN_ABSTRACT", "NEG", "CONTENT", "ADVISH", "CONTENT"]),
        (ST.true_pos, ["DET", "MODAL", "OTHER", "NUM", "NUM", "OTHER", "NOUN", "NOUN", "NEG", "OTHER", "ADV", "OTHER"]),
        (ST.posish_wide, ["PREP", "MODAL", "NOUNISH", "PUNCT", "NOUNISH", "PUNCT", "GERUND", "NOUNISH", "NOUNISH", "NOUNISH", "ADV", "NOUNISH"]),
    ],
)
def test_first_rule_wins(spark, rule, want) -> None:
    rows = spark.createDataFrame(list(enumerate(TOKENS)), "i int, t string").select("i", F.expr(rule(SPARK, "t")).alias("s")).orderBy("i")
    assert [r["s"] for r in rows.collect()] == want


@pytest.mark.parametrize("view", ["shape", "coarse", "posish", "true_pos", "semantic", "token_type", "posish_wide"])
def test_chains_of_replacements_follow_the_rules(spark, view) -> None:
    """The letters of whole texts against the rules token by token, for tokens in every order."""
    spike = view in ("token_type", "posish_wide")
    odd = [*TOKENS, "€", "a", "B", "NOT", "Should", "don't", "A-", "every", "Students", "REPORT", "12.5+", "Ångström", "ly", "ing", "Bring", "x9", "AB", "McDonald", "-", "''", "\x01", "\U0001f600", "enablement"]
    texts = [" ".join(odd), " ".join(reversed(odd)), "", "  ", "the", "—", None, *odd]
    pattern = X.TOK_SPIKE if spike else X.TOK_MARKOV
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = Q.with_states(rows, (view,), pattern)
    got = got.select("doc_id", F.transform(F.filter(F.split(view, ""), lambda c: c != ""), lambda c: ST.spelled(c)).alias("s"))
    want = rows.select("doc_id", F.expr(SPARK.each(SPARK.found("coalesce(text, '')", pattern), "t", getattr(ST, view)(SPARK, "t"))).alias("s"))
    none = ["NO_SEMANTIC_PATTERN"] if view == "semantic" else []
    clean = lambda df, empty: {r["doc_id"]: [x for x in r["s"] if x] or empty for r in df.collect()}
    assert clean(got, none) == clean(want, none)


def test_char_shapes(spark) -> None:
    row = spark.createDataFrame([("Ab1 ,§É",)], "t string").select(F.expr(ST.char_shapes(SPARK, "t")).alias("s")).first()
    assert row["s"] == "UlDSPOU"


def test_one_split_tree(spark) -> None:
    tree = {"left_children": [1, -1, -1], "right_children": [2, -1, -1], "default_left": [1, 0, 0], "split_indices": [0, 0, 0], "split_conditions": [0.5, -2.0, 2.0], "base_weights": [0.0, -2.0, 2.0]}
    model = {"learner": {"learner_model_param": {"base_score": "[5E-1]"}}, "trees": [tree]}
    rows = spark.createDataFrame([(0, [1.0]), (1, [0.0]), (2, [])], "i int, x array<double>")
    got = [r["probability"] for r in MO.tree_scores(rows, model).orderBy("i").collect()]
    assert round(100 * got[0]) == 88 and got[1] == got[2] < 0.12


def test_defensive_split_moves_by_hash(spark) -> None:
    rows = [(i, i % 2, f"{(i * 7919) % 97:064x}") for i in range(16)]
    df = spark.createDataFrame(rows, "doc_id int, label int, text_hash string")
    count = lambda ratio, cap: sampling.defensive_split(df, ratio, cap).filter("role = 'train'").groupBy("label").count().collect()
    assert {r["count"] for r in count(0.25, 60)} == {2} and {r["count"] for r in count(0.9, 3)} == {3} and count(0.0, 3) == []


@pytest.mark.parametrize(
    ("sizes", "want"),
    [
        ([10, 20], []), ([39], []), ([40], [(1, 1, 40, "paragraph")]), ([100, 100, 100], [(1, 2, 200, "paragraph_merge"), (3, 3, 100, "paragraph")]),
        ([10, 320, 50], [(1, 1, 10, "paragraph"), (2, 2, 320, "long_paragraph_split"), (3, 3, 50, "paragraph")]),
        ([700], [(1, 1, 320, "long_paragraph_split"), (1, 1, 320, "long_paragraph_split"), (1, 1, 60, "long_paragraph_split")]),
        ([170, 200], [(1, 1, 170, "paragraph"), (2, 2, 200, "paragraph")]),
    ],
)
def test_packing_rules(spark, sizes, want) -> None:
    text = "\n\n".join(" ".join(["w"] * n) for n in sizes)
    got = C.chunks(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("chunk_index").collect()
    assert [(r["paragraph_start"], r["paragraph_end"], r["words"], r["kind"]) for r in got] == want


def test_chunks_keep_sections_and_offsets(spark) -> None:
    """Offsets point into the normalised text; a section's end closes a chunk; a text of headings alone is one document."""
    w = lambda n, x: " ".join([x] * n)
    text = f"\r\n  {w(60, 'a')}\u00a0\r\n\r\n{w(30, 'b')}\n2. Methods Of Study\n\n{w(50, 'c')}  \n \n{w(400, 'd  e')}\nDiscussion\n"
    docs = spark.createDataFrame([(1, text), (2, "Introduction\nA. Results Here\n" * 20), (3, None), (4, w(39, "x"))], "doc_id int, text string")
    whole = text.replace("\r\n", "\n").strip()
    got = [r.asDict() for r in C.chunks(docs).orderBy("doc_id", "chunk_index").collect()]
    one = [r for r in got if r["doc_id"] == 1]
    assert [(r["heading"], r["words"], r["kind"], r["reliability"]) for r in one] == [
        ("front matter", 90, "paragraph_merge", "high"), ("2. Methods Of Study", 50, "paragraph", "medium"), ("2. Methods Of Study", 320, "long_paragraph_split", "high"),
        ("2. Methods Of Study", 320, "long_paragraph_split", "high"), ("2. Methods Of Study", 160, "long_paragraph_split", "high"),
    ]
    assert [whole[r["char_start"] : r["char_end"]] for r in one[1:]] == [r["text"] for r in one[1:]]
    assert whole[one[0]["char_start"] : one[0]["char_end"]].split() == one[0]["text"].split() and one[0]["text"] == f"{w(60, 'a')}\n\n{w(30, 'b')}"
    assert {r["heading"] for r in got if r["doc_id"] == 2} == {"document"} and not [r for r in got if r["doc_id"] > 2]


def test_detector_with_trees(spark) -> None:
    tree = {"left_children": [1, -1, -1], "right_children": [2, -1, -1], "default_left": [1, 0, 0], "split_indices": [0, 0, 0], "split_conditions": [0.5, -2.0, 2.0], "base_weights": [0.0, -2.0, 2.0]}
    model = {"learner": {"learner_model_param": {"base_score": "[5E-1]"}, "gradient_booster": {"model": {"trees": [tree]}}}}
    meta = {"vocab": ["lex::1=synergy"], "feature_importance": {"by_gain": [{"feature": "lex::1=synergy", "gain": 10.0}]}}
    found = D.Model.read(json.dumps(model), json.dumps({"modelVersion": "m1", "trainer": "xgboost", "decisionPolicy": {"threshold": 0.6}}), json.dumps(meta))
    got = {r["doc_id"]: r for r in D.score(spark.createDataFrame([(1, "synergy"), (2, "other words"), (3, None)], "doc_id int, text string"), found).collect()}
    assert (got[1]["label"], got[1]["likelihood"], got[1]["model_id"], got[1]["available"]) == ("ai_generated", 88, "m1", True)
    assert got[1]["top_features"][0]["feature"] == "lex::1=synergy" and got[1]["top_features"][0]["weight"] == 10.0 and got[1]["feature_count"] == 1
    assert got[2]["label"] == got[3]["label"] == "human_written" and got[3]["top_features"] == [] and got[1]["classification"] == "not_enough_text"


def test_detector_reports_mixed_texts(spark) -> None:
    model = {"vocab": ["lex::1=synergy", "lex::1=handwritten"], "weights": [4.0, -4.0], "bias": 0.0, "means": [0.0, 0.0], "stds": [1.0, 1.0]}
    found = D.Model.read(json.dumps(model), json.dumps({"decisionPolicy": {"threshold": 0.6}}), name="mixed")
    text = "Introduction\n\n" + " ".join(["synergy"] * 200) + "\n\n2. Human Notes\n\n" + " ".join(["handwritten"] * 200)
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    row = D.score(docs, found).first()
    assert row["classification"] == "mixed_ai_and_human" and row["mixed_authorship"]["contrast"] >= 25 and row["mixed_authorship"]["label_transitions"] == 1
    assert [(c["label"], c["heading"]) for c in row["authorship_chunks"]] == [("ai_generated", "Introduction"), ("human_written", "2. Human Notes")]
    none = D.score(docs, None).first()
    assert (none["available"], none["label"], none["warnings"]) == (False, "unavailable", ["corporate_authorship_model_unavailable"])
    broken = D.Model("b", "lexical_style", "lr", ["lex::1=a"], weights=[1.0, 2.0], means=[0.0], stds=[1.0])
    assert D.score(docs, broken).first()["warnings"][0].startswith("corporate_authorship_model_failed")


def test_methods(spark) -> None:
    rows = spark.createDataFrame([(1, "The plan works. The plan")], "doc_id int, text string")
    got = {r["feature"]: r["value"] for r in FE.build(rows, "lexical_style").collect()}
    assert got["lex::1=the"] == 2 and got["lex::2=the|plan"] == 2 and got["style::words"] == 5
    assert len(FE.METHODS) == 26 and FE.markov_views(["lex::1=a"], "x") == () and FE.markov_views(["markov::shape::order1::n"], "a_core_markov") == FE.CORE
    assert FE.markov_views(["semantic::x"], "x", ["semantic"]) == ("semantic",) and FE.markov_views(["semantic::x"], "x") is None
    for bad in (lambda: FE.build(rows, "nothing"), lambda: FE.build(rows, "markov_core"), lambda: FE.concept_sequences(rows, "nothing")):
        with pytest.raises(ValueError):
            bad()


def test_each_contract_fixture_gives_its_code(spark) -> None:
    rows = spark.createDataFrame(fixtures(), "name string, expected string, payload string")
    got = CT.violations(rows).collect()
    assert len(got) == 27 and all(r["error"] == r["expected"] for r in got)
    odd = spark.createDataFrame([("no json",), (None,), ("[1]",)], "payload string")
    assert {r["error"] for r in CT.violations(odd).collect()} == {"schema_error"}


def test_positions_without_gathering(spark) -> None:
    got = numbered(spark.range(1000, 0, -1).repartition(7), ["id"]).orderBy("id").collect()
    assert [r["ordinal"] for r in got] == list(range(1000))


def test_headings(spark) -> None:
    lines = {"Introduction": True, "1.2 Results of Trials": True, "1.2 Results of the trial": False, "A. Method": True, "plain words here": False, "2 ends with a mark.": False, "3 4 5 6": False, "": False, "12 " + "w" * 130: False}
    rows = spark.createDataFrame([(k,) for k in lines], "v string").select("v", F.expr(C.is_heading(SPARK, "v")).alias("h")).collect()
    assert {r["v"]: r["h"] for r in rows} == lines


def test_components_of_a_long_path(spark) -> None:
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    assert {(r["id"], r["component"]) for r in graphs.components(edges).collect()} == {(i, 0) for i in range(61)} | {(100, 100), (101, 100)}


def test_sources(spark, tmp_path) -> None:
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\n{"x": 2}\nnot json\n[3]\n"x"\n{"x": null}\n')
    assert sorted((r["x"] or 0) for r in IO.read_jsonl(spark, f"{tmp_path}/a.jsonl", "x int", lenient=True).collect()) == [0, 1, 2]
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        IO.read_jsonl(spark, f"{tmp_path}/a.jsonl", "x int").collect()
    assert IO.read_csv(spark, f"{tmp_path}/none.csv", "x int").count() == 0
    (tmp_path / "t.txt").write_text(" a   b \n\n c\n")
    assert [tuple(r) for r in IO.read_lines(spark, f"{tmp_path}/t.txt").collect()] == [("a b", "t"), ("c", "t")]
    (tmp_path / "map.txt").write_text("00001740 03 n 01 entity 0 &%Physical+\n00001740 03 n 01 entity 0 &%Entity=\nno line\n")
    assert [tuple(r) for r in IO.read_mapping(spark, f"{tmp_path}/map.txt").collect()] == [("00001740", "n", "Entity", "=")]
    with pytest.raises(FileNotFoundError):
        IO.discover(spark, f"{tmp_path}/no", ".txt")
    assert IO.discover(spark, str(tmp_path), ".txt").count() == 2
    out = f"{tmp_path}/export"
    IO.write_csv_export(spark.createDataFrame([("=1", 1), ("ok", None), ("-x", 3)], "a string, b int"), out)
    assert {r["a"] for r in IO.read_csv(spark, out, "a string, b int").collect()} == {"'=1", "ok", "'-x"}
    assert IO.markdown_table(spark.createDataFrame([(1, None)], "a int, b string")) == "| a | b |\n| --- | --- |\n| 1 |  |"


def test_paragraphs_and_chunks_stay_in_their_row(spark) -> None:
    """Nothing travels to cut and pack a text; heads are those of the SQL rule, with odd white space, marks, digits and letters."""
    texts = [None, "", " \n\t\n", "Introduction", "a b\r\nc\r\r2. Methods of  Study \n\u2003x\x1cy \n z\n\nDiscussion\n", "Introduction\n3 4 5\n  \u3000\nB.  Another \xa0 Heading"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = [tuple(r) for r in C.paragraphs(docs).select("doc_id", "paragraph", "section", "heading", "char_start", "char_end", "words", "total").orderBy("doc_id", "paragraph").collect()]
    assert got[0] == (3, 1, 0, "document", 0, 12, 1, 1)
    assert got[1:4] == [(4, 1, 0, "front matter", 0, 5, 3, 11), (4, 2, 1, "2. Methods of Study", 30, 37, 3, 11)] + got[3:4] and got[3][:4] == (5, 1, 1, "Introduction")
    for df in (C.paragraphs(docs), C.chunks(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan
    some = ["Introduction", "2. Methods of Study", "3 4 5", "A. b c d", "A. Results And Outlook", "1.1 Only A Heading.", "9 ab 12345", "B \u01c5\u00e9\u4e2d x", "x " * 70, "7 " + "Word " * 14, "7 " + "Word " * 13, "REFERENCES", "\u212aey Findings", "1. \u0663\u0663 abc"]
    rows = spark.createDataFrame([(x,) for x in some], "v string").select("v", F.expr(C.is_heading(SPARK, "v")).alias("h")).collect()
    assert [(r.v, C.heads(" ".join(r.v.split()))) for r in rows] == [(r.v, r.h) for r in rows]
