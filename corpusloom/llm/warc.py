"""Operator 3, WARC: archives with revisit records, written and read by Spark.

Payload digests are computed row by row; only headers (digest, page_id) are shuffled by digest and grouped, with
partial sums, so a payload that a third of all pages share costs one row per task. Pages then join the digests
that occur more than once, a side that has a row for each and is broadcast where it is small; where it isn't,
Spark's skew handling splits the hot digest. They are written as archives: a revisit record has headers only,
and names the original response.

An archive is what Spark's text writer makes of one record per row with CR LF CR LF between records, which is
the end of a record in the WARC format. Its committer gives whole files even if executors are lost. A task's
records go to volumes of about ``volume_bytes``, a folder each, so an archive holds at most that and one record
more, and reading one takes that much memory; its records are read one after the other by Content-Length.

Defined results. Null or empty html: a payload of no bytes. Null url: ``urn:none``. Null page_id: sorts last,
so it is a response only if no page with an id has the payload. Rows that repeat a page_id and a payload are
all responses. Payloads smaller than ``least_bytes`` are always responses. A very long payload is whole in one
record, beyond a volume's size in a volume of its own. An empty table gives no records.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import lean

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 digest: 8 groups of 5 hex digits, 4 letters each."""
    hexed = F.sha1(payload)
    groups = [F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 10).cast("int") for i in range(8)]
    return F.concat(*(F.substring(F.lit(BASE32), (F.shiftright(g, s).bitwiseAND(31)) + 1, F.lit(1)) for g in groups for s in (15, 10, 5, 0)))


def resolve(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to and refers_to_url."""
    given = pages.select(
        F.col("page_id").cast("long"),
        F.coalesce(F.col("url").cast("string"), F.lit("urn:none")).alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"),
    ).withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": base32_sha1(F.encode("payload", "UTF-8"))})
    headers = given.filter(F.col("payload_bytes") >= least_bytes).select("payload_digest", "page_id", "url")
    firsts = (
        headers.groupBy("payload_digest")
        .agg(F.min(F.struct(F.col("page_id").isNull().alias("n"), "page_id", "url")).alias("first"), F.count("*").alias("copies"))
        .filter("copies > 1")
        .select("payload_digest", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"))
    )
    revisit = (F.col("payload_bytes") >= least_bytes) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return given.join(firsts, "payload_digest", "left").select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first_id")).alias("refers_to"),
        F.when(revisit, F.col("first_url")).alias("refers_to_url"),
    )


def record_id(page_id: Column, digest: Column) -> Column:
    """A UUID from page and payload, the same on every attempt."""
    h = F.md5(F.concat_ws(":", page_id.cast("string"), digest))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def records(resolved: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One WARC record per row, as text without the two line ends that close it."""
    revisit = F.col("record_type") == "revisit"
    safe = lambda c: F.regexp_replace(c, r"[\x00-\x20\x7f]", "%20")  # noqa: E731  a header is one line
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(2 * CRLF))
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("payload")))
    head = F.concat_ws(
        CRLF,
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), "record_type"),
        F.concat(F.lit("WARC-Record-ID: "), record_id(F.col("page_id"), F.col("payload_digest"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), safe(F.col("url"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "payload_digest"),
        F.when(F.col("page_id").isNotNull(), F.concat(F.lit("X-Page-ID: "), F.col("page_id").cast("string"))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), record_id(F.col("refers_to"), F.col("payload_digest")))),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To-Target-URI: "), safe(F.col("refers_to_url")))),
        F.when(revisit, F.lit(f"WARC-Refers-To-Date: {date}")),
        F.when(revisit, F.concat(F.lit("X-Refers-To-Page-ID: "), F.col("refers_to").cast("string"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    return resolved.select(F.concat(head, F.lit(2 * CRLF), block).alias("value"))


def write(pages: DataFrame, path: str, least_bytes: int = 0, volume_bytes: int = 32 << 20, compression: str = "gzip") -> None:
    lean(pages.sparkSession)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = 0
        for batch in batches:
            ends = held + np.cumsum(np.asarray(pc.binary_length(batch.column(0))), dtype=np.int64)
            begins = np.concatenate(([held], ends))[: len(ends)]
            held = int(ends[-1]) if len(ends) else held
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((begins // volume_bytes).astype(np.int32))], ["value", "volume"])

    dealt = records(resolve(pages, least_bytes)).mapInArrow(deal, "value string, volume int")
    dealt.write.options(lineSep=2 * CRLF, compression=compression).partitionBy("volume").text(path)


def parse(content: bytes) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """(WARC headers, HTTP headers, payload) of each record; header names in lower case."""
    fields = lambda lines: {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    at = 0
    while at < len(content):
        stop = content.index(b"\r\n\r\n", at)
        version, *lines = content[at:stop].decode("utf-8").split(CRLF)
        if not version.startswith("WARC/1."):
            raise ValueError(f"no WARC record at byte {at}")
        head, begin = fields(lines), stop + 4
        end = begin + int(head["content-length"])
        body = content.index(b"\r\n\r\n", begin)
        yield head, fields(content[begin:body].decode("utf-8").split(CRLF)[1:]), content[body + 4 : end]
        if content[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} has no end")
        at = end + 4


READ = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of the archives below ``path``. ``payload_bytes`` is that of the full payload, for a revisit from its HTTP headers."""
    number = lambda x: None if x is None else int(x)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in READ.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for file in batch.column(0):
                content, out, held = file.as_py(), [], 0
                content = zlib.decompress(content, 47) if content[:2] == b"\x1f\x8b" else content
                for head, http, body in parse(content):
                    full = int(http["content-length"])
                    digest = head["warc-payload-digest"].removeprefix("sha1:")
                    if head["warc-type"] == "response" and (len(body) != full or base64.b32encode(hashlib.sha1(body).digest()).decode() != digest):
                        raise ValueError(f"{head['warc-record-id']}: the payload is not that of the headers")
                    out.append((number(head.get("x-page-id")), head["warc-target-uri"], head["warc-type"], full, digest, number(head.get("x-refers-to-page-id")), body if payload else None))
                    held += len(body)
                    if held > 16 << 20 or len(out) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    lean(spark)
    files = spark.read.format("binaryFile").options(pathGlobFilter="part-*", recursiveFileLookup="true").load(path).select("content")
    return files.mapInArrow(rows, READ)
