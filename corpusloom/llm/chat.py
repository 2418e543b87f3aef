"""Operator 10, chat formatting: typed parts, one template, escapes that can be undone, and a loss mask.

A turn's content is a list of typed parts: text, image, audio or document. A visitor flattens them in order:
text is escaped, any other part becomes a numbered placeholder, its reference is recorded, and the tokens it
stands for are counted. A formatted turn is ``### Role: content</turn>\\n``. Inside roles and texts a
backslash follows every backslash and the first character of every ``###``, ``</turn>`` and ``<|``, so that no
mark of the template appears in them, and taking one backslash off each pair gives the text back.

Rows are formatted where a sort by conversation and turn has put them, and leave as one row per turn (a
segment) with the span that is under the loss mask, so a conversation of any number of turns takes one turn's
memory. ``conversations`` joins segments to one text per conversation for those who want that.

Defined results. Null text: empty. Null role: the empty role. Null conv_id: a conversation like any other.
Null turn: first. Ties in turn: by role, then text; repeated rows are turns each. An empty table: no rows.
Other columns are ignored, but for ``parts`` (array of struct type, text, uri, tokens), which stands for text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "### ", "</turn>\n"
PARTS = "array<struct<type:string,text:string,uri:string,tokens:long>>"
SEGMENT = "conv_id long, segment long, formatted string, loss_start int, loss_end int, attachments array<struct<kind:string,uri:string,tokens:long>>"
_MARKS = re.compile(r"\\|#(?=##)|<(?=/turn>)|<(?=\|)")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return _MARKS.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class Flattener:
    """Visits typed parts; the result is text with placeholders, and the list of what they stand for."""

    #: Tokens a part expands to, if it doesn't say.
    TOKENS = {"image": 256, "audio": 128, "document": 512}

    def __init__(self) -> None:
        self.out: list[str] = []
        self.attachments: list[dict] = []

    def visit(self, part: dict) -> None:
        kind = part.get("type") or "text"
        getattr(self, f"visit_{kind}", self.visit_other)(kind, part)

    def visit_text(self, kind: str, part: dict) -> None:
        self.out.append(escape(part.get("text") or ""))

    def visit_other(self, kind: str, part: dict) -> None:
        if kind not in self.TOKENS:
            raise ValueError(f"unknown kind of content part: {kind}")
        self.out.append(f"<|{kind}:{len(self.attachments)}|>")
        tokens = part.get("tokens")
        self.attachments.append({"kind": kind, "uri": part.get("uri") or "", "tokens": self.TOKENS[kind] if tokens is None else tokens})


def turn(role: str, parts: list[dict]) -> tuple[str, int, int, list[dict]]:
    """(formatted turn, start and end of its content, attachments)."""
    flat = Flattener()
    for p in parts:
        flat.visit(p)
    head, content = f"{OPEN}{escape(role).replace(':', '\\:')}: ", "".join(flat.out)
    return f"{head}{content}{CLOSE}", len(head), len(head) + len(content), flat.attachments


def parse(segment: str) -> tuple[str, str]:
    """(role, text) of a formatted turn, unescaped; placeholders stay in the text."""
    m = re.fullmatch(r"### ((?:[^:\\]|\\.)*): (.*)</turn>\n", segment, re.DOTALL)
    if not m:
        raise ValueError("not a formatted turn")
    return unescape(m[1]), unescape(m[2])


def format_turns(rows: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """Segments: one row per turn, numbered within its conversation from 0."""
    typed = "parts" in rows.columns and rows.schema["parts"].dataType.simpleString().startswith("array<struct<")
    content = F.col("parts").cast(PARTS) if typed else F.array(F.struct(F.lit("text").alias("type"), F.col("text").cast("string").alias("text"), F.lit("").alias("uri"), F.lit(0).cast("long").alias("tokens"))).cast(PARTS)
    given = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), content.alias("parts"))
    ordered = given.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = (), 0
        for batch in batches:
            out = []
            for conv, role, parts in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                n = n + 1 if last == (conv,) else 0
                last = (conv,)
                text, start, end, attached = turn(role, parts or [])
                trained = role == trained_role
                out.append((conv, n, text, start if trained else None, end if trained else None, attached))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.struct([("kind", pa.string()), ("uri", pa.string()), ("tokens", pa.int64())]))]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["conv_id", "segment", "formatted", "loss_start", "loss_end", "attachments"])

    return ordered.mapInArrow(run, SEGMENT)


def conversations(segments: DataFrame) -> DataFrame:
    """conv_id, formatted (one text), expanded_tokens of its attachments. For conversations that fit a row."""
    got = segments.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("segment", "formatted", "attachments"))).alias("s"))
    tokens = F.aggregate(F.flatten(F.transform("s", lambda x: x["attachments"])), F.lit(0).cast("long"), lambda acc, a: acc + a["tokens"])
    return got.select("conv_id", F.array_join(F.transform("s", lambda x: x["formatted"]), "").alias("formatted"), tokens.alias("expanded_tokens"))


def digest(segments: DataFrame) -> DataFrame:
    """What is read back from segments: turns and trained text, by the template's own grammar, as running digests."""
    ordered = segments.repartition(int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions")), "conv_id").sortWithinPartitions("conv_id", "segment")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done = None, None, []
        flush = lambda: done.append((key[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
        names, kinds = [x.split()[0] for x in DIGEST.split(", ")], [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)
        for batch in batches:
            for conv, text, start, end in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if key != (conv,):
                    if key:
                        flush()
                    key, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, said = parse(text)
                state[0] += 1
                state[1].update(f"{role}\n{said}\n".encode())
                if start is not None:
                    trained = unescape(text[start:end])
                    state[2] += len(trained)
                    state[3].update(trained.encode())
                state[4] += len(text)
            if len(done) >= 4096:
                yield pack()
                done.clear()
        if key:
            flush()
        if done:
            yield pack()

    return ordered.mapInArrow(run, DIGEST)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
