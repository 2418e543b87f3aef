"""Near duplicates: what is kept of the texts on the way to groups and links."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom import queries as registry
from corpusloom.operators import near
from tests.data import prose

TEXTS = [(i, prose(i, 60)) for i in range(20)] + [(30, prose(3, 60).upper()), (31, prose(3, 60) + " end"), (31, prose(7, 60)), (None, prose(3, 60)), (32, None), (33, "Ä b"), (34, "ä  B")]


def counted(monkeypatch) -> dict[str, int]:
    """Rows of each table that ``near`` writes, by name."""
    rows, write = {}, near.written

    def kept(df, name):
        out = write(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(near, "written", kept)
    return rows


def test_groups_keep_no_shingles(spark, tmp_path, monkeypatch) -> None:
    """Upper case beyond ASCII counts as lower case; a repeated id joins the groups of both its texts; null ids are in none."""
    spark.createDataFrame(TEXTS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = counted(monkeypatch)
    got = {r["id"]: r["component"] for r in registry.queries()["connected_groups"](spark, str(tmp_path)).collect()}
    assert got == {3: 3, 7: 3, 30: 3, 31: 3, 33: 33, 34: 33} and list(rows) == ["groups"]
    split = registry.queries()["grouped_split"](spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] or -1, r["grp"]) for r in split if r["doc_id"]) == sorted((d, got.get(d, d)) for d, _ in TEXTS if d) and len(split) == len(TEXTS) and "shingles" not in rows


def test_links_are_looked_for_within_groups(spark, monkeypatch) -> None:
    rows = counted(monkeypatch)
    got = near.near_links(spark.createDataFrame(TEXTS, "doc_id long, text string")).select("a", "b", F.col("jaccard") == 1).collect()
    assert {tuple(r) for r in got} == {(3, 30, True), (3, 31, False), (7, 31, True), (33, 34, True)} and rows["shingles"] == 7  # rows with a linked id, of 26
