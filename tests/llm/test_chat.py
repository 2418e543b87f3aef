from __future__ import annotations

import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from corpusloom.llm import chat
from corpusloom.llm.queries import MARKS

SCHEMA = "conv_id long, turn long, role string, text string, parts string, segment int"
ROWS = [(1, 1, "assistant", "hi", None, 0), (1, 0, "user", None, None, 0), (2, None, None, "x", None, 0), (2, 0, "assistant", "b", None, 0), (2, 0, "assistant", "a", None, 0), (2, 0, "assistant", "a", None, 0), (None, 3, "user", "n", None, 0), (-7, 0, "user", MARKS, None, 0), (-7, 1, "assistant", MARKS, None, 0), (5, 0, "a:b\\: ", "### ####\n</turn>\n<|image:0|> \\", None, 0)]


@given(st.text(alphabet="\\#<|/turn>a:é \n"), st.text(alphabet="\\#<|/turn>a:é \n"))
def test_escapes_can_be_undone(role: str, text: str) -> None:
    done, start, end, _ = chat.turn(role, [{"type": "text", "text": text}])
    assert chat.parse(done) == (role, text) and chat.unescape(done[start:end]) == text
    inside = chat.escape(text)
    assert "###" not in inside and "</turn>" not in inside and "<|" not in inside


def test_digest(spark) -> None:
    got = {r["conv_id"]: r for r in chat.digest(chat.format_turns(spark.createDataFrame(ROWS, SCHEMA).repartition(4))).collect()}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in {r[0] for r in ROWS}:
        turns = sorted((r for r in ROWS if r[0] == conv), key=order)
        trained = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        r = got[conv]
        assert r["n_turns"] == len(turns) and r["loss_chars"] == len(trained)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(trained.encode()).hexdigest()
    assert chat.digest(chat.format_turns(spark.createDataFrame([], SCHEMA))).count() == 0
    assert {r["conv_id"]: r["formatted"] for r in chat.conversations(chat.format_turns(spark.createDataFrame(ROWS, SCHEMA))).collect()}[1] == "### user: </turn>\n### assistant: hi</turn>\n"


def test_typed_parts(spark) -> None:
    parts = [("text", "see <|", None, None), ("image", None, "s3://a", 300), ("audio", None, "b", None), ("document", None, None, None), (None, "end", None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts)], "conv_id long, turn long, role string, parts array<struct<type:string,text:string,uri:string,tokens:long>>")
    row = chat.format_turns(df).first()
    assert row["formatted"] == "### user: see <\\|<|image:0|><|audio:1|><|document:2|>end</turn>\n"
    assert [tuple(a) for a in row["attachments"]] == [("image", "s3://a", 300), ("audio", "b", 128), ("document", "", 512)]
    assert chat.conversations(chat.format_turns(df)).first()["expanded_tokens"] == 940
    with pytest.raises(ValueError):
        chat.turn("user", [{"type": "video"}])
