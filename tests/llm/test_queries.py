"""The registered queries of the training-data operators, against DuckDB where SQL can express them."""

from __future__ import annotations

import duckdb
import pytest

from corpusloom.llm import queries as registry
from tests.test_queries import SF, TABLES, plain


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name: str) -> None:
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    source = {"op1": "documents", "op2": "documents", "op7": "documents"}.get(name.split("_")[0])
    if source:  # held against brute-force versions in the operators' own tests; here every document must come back
        assert {r[columns.index("doc_id")] for r in got} == {r[0] for r in duck.sql(f"SELECT doc_id FROM {source}").fetchall()}
        return
    want = duck.sql(registry.oracle_sql()[name])
    at = [want.columns.index(c) for c in columns]
    assert sorted(want.columns) == columns and got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
