"""Operator 5, personal data, in DataFrame expressions alone.

Regular expressions propose spans, checks confirm them (part values, Luhn, mod 97, numbers of digits), and
words just before a span adjust its score. The base kinds (email, ip, card, phone) are kept once confirmed,
whatever their score; iban, national_id, secret (hex digests that are called a token, key or password) and
api_key (known prefixes and lengths) are added if their score reaches ``threshold``.

Each kind's matches are leftmost and do not overlap. The patterns run in Java's engine in forms that find the
same spans as the plain ones in time linear in the text: a run that cannot start a match is entered once.
Positions come from the pieces between matches: a text is its pieces and matches in turn, so running sums of
their lengths, in code points, give every start. Each text is handled in its own row; nothing is shuffled.

Defined results. Null or empty text: no spans. Null doc_id and repeated rows: a row each. Spans of different
kinds may overlap; ties in start go by the order of kinds. Very long texts are scanned whole. Further columns
pass through ``find`` and ``redact`` unchanged, but for one called as ``find``'s result, which gives way to it. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import free_name

KINDS = ("email", "ip", "card", "phone", "iban", "national_id", "secret", "api_key")
BASE = KINDS[:4]
LOCAL = r"A-Za-z0-9._%+-"

#: Patterns. A look-behind, or the end of the previous match (\G), keeps a scan from entering a run twice.
PATTERNS = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])(?=(?:[0-9][\x20-]?){13}[0-9])[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9_])(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})(?![A-Za-z0-9_])",
    "api_key": r"(?<![A-Za-z0-9_])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64})(?![A-Za-z0-9_])",
}
#: A cheap test that every text with a match passes.
MAY = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"(?:[0-9][\x20-]?){13}[0-9]"),
    "phone": lambda t: t.rlike(r"\+[0-9]"),
    "iban": lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]"),
    "national_id": lambda t: t.rlike(r"[0-9]-[0-9]{2}-[0-9]"),
    "secret": lambda t: t.rlike(r"[0-9a-f]{32}"),
    "api_key": lambda t: t.contains("AKIA") | t.rlike("gh[pousr]_") | t.contains("sk-"),
}
#: (score of a confirmed span, what a context word adds, context words).
SCORES = {
    "email": (0.9, 0.1, "e-?mail|mail|contact|write"),
    "ip": (0.6, 0.3, r"ip|address|host|server|adresse"),
    "card": (0.7, 0.3, "card|visa|credit|karte|tarjeta|carte"),
    "phone": (0.6, 0.3, r"phone|tel|call|mobile|fax|telefon|t[eé]l[eé]fono"),
    "iban": (0.8, 0.2, "iban|account|konto|cuenta|compte"),
    "national_id": (0.3, 0.5, r"ssn|social security|national id|tax id"),
    "secret": (0.3, 0.5, "token|secret|password|passwd|key|auth|bearer"),
    "api_key": (0.8, 0.1, "token|secret|key|auth"),
}


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    value = lambda i: F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
    doubled = lambda v: F.when(v > 4, v * 2 - 9).otherwise(v * 2)
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + F.when(i % 2 == 0, doubled(value(i))).otherwise(value(i)))
    return (F.length(digits) > 0) & (total % 10 == 0)


def mod97(iban: Column) -> Column:
    """Whether the check digits of an IBAN hold."""
    plain = F.replace(iban, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    step = lambda acc, c: F.when(c <= "9", (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(step(acc, c))) == 1


CONFIRM = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$"),
    "card": lambda m: F.length(_digits(m)).between(14, 19) & luhn(_digits(m)),
    "phone": lambda m: F.length(_digits(m)).between(10, 15),
    "iban": mod97,
    "national_id": lambda m: ~m.rlike("^(?:000|666|9)|-00-|-0000$"),
    "secret": lambda m: m.rlike("[0-9]") & m.rlike("[a-f]"),
    "api_key": lambda m: F.lit(True),
}

SPAN = "array<struct<start:int,rank:int,kind:string,end:int,score:double>>"


def _spans(text: Column, kind: str) -> Column:
    """Confirmed spans of one kind: start, rank of the kind, kind, end, score."""
    pattern, (score, more, context) = PATTERNS[kind], SCORES[kind]
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(F.coalesce(x["m"], F.lit("")))
        near = F.lower(F.substring(x["gap"], -40, 40)).rlike(rf"(?:^|[^a-z])(?:{context})(?:[^a-z]|$)")
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"), F.when(near, score + more).otherwise(score).cast("double").alias("score"))
        keep = x["m"].isNotNull() & CONFIRM[kind](x["m"])
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))
    return F.when(MAY[kind](text), F.aggregate(parts, start, step, lambda acc: acc["out"])).otherwise(F.array().cast(SPAN))


def find(docs: DataFrame, threshold: float = 0.5, kinds: tuple[str, ...] = KINDS, into: str = "found") -> DataFrame:
    """All columns of ``docs`` and ``found`` (or another name): the spans by start, then kind."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    every = F.concat(*(_spans(text, k) for k in kinds))
    kept = F.filter(every, lambda s: (s["rank"] < len(BASE)) | (s["score"] >= threshold))
    return docs.withColumn(into, F.array_sort(kept))


def redact(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents with every span replaced by its kind in brackets, overlapping spans by that of the first; ``n_chars`` follows."""
    columns, text = docs.columns, F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = free_name("found", columns)

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        out = F.when(fresh, F.concat(acc["out"], F.array(gap, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    rest = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text)))
    new = F.when(F.size(found) == 0, F.col("text")).otherwise(F.aggregate(found, start, step, rest))
    out = find(docs, threshold, into=found).withColumn("text", new)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.size(found) == 0, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*columns)


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("found", lambda s: s["rank"] < len(BASE))
    return found.select("doc_id", *(count(k) for k in BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))
