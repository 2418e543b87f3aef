from __future__ import annotations

import base64
import gzip
import hashlib

from corpusloom.llm import warc
from corpusloom.llm.common import Scratch

ROWS = [(5, "http://a", "<p>x</p>", "c"), (3, "http://b/ä\r\nX: y", "<p>x</p>", "c"), (9, None, None, "c"), (8, "u", "", "c"), (4, "v", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n", "c"), (None, "w", "<p>x</p>", "c"), (None, "w", "only", None), (3, "z", "<p>x</p>", None), (7, "long", "é\r\n\r\n" * 50_000, None)]
SCHEMA = "page_id long, url string, html string, payload string"


def test_round_trip(spark) -> None:
    path = Scratch(spark, "t").path("w")
    warc.write(spark.createDataFrame(ROWS, SCHEMA), path, volume_bytes=2000)
    got = warc.read(spark, path).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[4] or "")
    want = []
    for page, _, html, _ in ROWS:
        data = (html or "").encode()
        same = [p for p, _, h, _ in ROWS if (h or "") == (html or "") and p is not None]
        first = min(same) if same else None
        revisit = len([1 for _, _, h, _ in ROWS if (h or "") == (html or "")]) > 1 and first is not None and page != first
        want.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    cut = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got]
    assert sorted(cut, key=lambda r: (r[0] is None, r[0] or 0, r[2])) == sorted(want, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    assert {r["page_id"]: bytes(r["payload"]) for r in got if r["record_type"] == "response"}[7] == ("é\r\n\r\n" * 50_000).encode()
    assert key(got[0]) is not None


def test_threshold_and_nothing(spark) -> None:
    base = Scratch(spark, "t")
    warc.write(spark.createDataFrame([(1, "u", "ab", None), (2, "u", "ab", None)], SCHEMA), base.path("a"), least_bytes=3)
    assert {r["record_type"] for r in warc.read(spark, base.path("a")).collect()} == {"response"}
    warc.write(spark.createDataFrame([], SCHEMA), base.path("b"))
    assert warc.read(spark, base.path("b")).count() == 0


def test_archives_are_bounded_in_bytes(spark) -> None:
    """Many pages in one task, one of them longer than a volume."""
    path = Scratch(spark, "t").path("w")
    rows = [(i, f"http://{i}", f"{i} " + "x" * (60_000 if i == 17 else 900), None) for i in range(120)]
    warc.write(spark.createDataFrame(rows, SCHEMA).coalesce(1), path, volume_bytes=20_000)
    sizes = [len(gzip.decompress(bytes(r["content"]))) for r in spark.read.format("binaryFile").options(pathGlobFilter="part-*", recursiveFileLookup="true").load(path).collect()]
    assert len(sizes) > 5 and sorted(sizes)[-2] < 25_000 and warc.read(spark, path, payload=False).count() == 120


def test_records_are_plain_warc(spark) -> None:
    path = Scratch(spark, "t").path("w")
    warc.write(spark.createDataFrame(ROWS[:2], SCHEMA).coalesce(1), path)
    for row in spark.read.format("binaryFile").options(pathGlobFilter="part-*", recursiveFileLookup="true").load(path).collect():
        data = gzip.decompress(bytes(row["content"]))
        assert not data or data.startswith(b"WARC/1.1\r\nWARC-Type: ") and data.endswith(b"\r\n\r\n")
