"""Every query against its DuckDB equivalent, at the smallest scale."""

from __future__ import annotations

import math

import duckdb
import pytest

from corpusloom import queries as registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    return v


#: Columns that tell whether a query did its work; each has two values at least.
TELLING = {
    "heading_lines": ["headings"], "page_sections": ["heading"], "sections": ["heading", "section"], "chunks_packed": ["heading", "kind", "reliability"], "motif_matches": ["motif_found"],
    "phrase_forms": ["concepts", "propositions", "logic"], "evidence_features": ["claim_evidence_gap", "claim_sentences", "evidence_markers", "named_anchors", "date_anchors", "abstract_ratio"],
    "calibration_report": ["mean_gap", "anchored"], "quality_flags_v1": ["assistant_artifact", "placeholder_url", "url_heavy", "low_letter_ratio", "high_digit_ratio", "high_punct_ratio", "mostly_upper", "repeated_tokens"],
    "quality_flags_v2": ["assistant_artifact", "url_heavy", "placeholder_url", "high_digit_ratio", "high_punct_ratio", "repeated_tokens", "basic_junk"],
    "s5_prevalence": ["shift", "above_noise"], "mixed_summary": ["classification", "label_transitions"], "score_chunks": ["label", "confidence"], "suppression": ["reasons"],
}


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name: str) -> None:
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    for c in TELLING.get(name, []):
        assert len({r[columns.index(c)] for r in got}) > 1, c
