"""Text scalars as SQL text for either engine, and as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import lexicon as X
from corpusloom.functions.dialect import SPARK, Dialect


#: Runs of white space, and of anything else, as Unicode has it.
SOME_SPACE, SOME_TEXT = f"[{X.SPACE}]+", f"[^{X.SPACE}]+"


def collapse(q: Dialect, x: str) -> str:
    """Runs of white space, that of Unicode, to one blank, ends trimmed."""
    return f"trim({q.sub(f'coalesce({x}, {q.lit(str())})', SOME_SPACE, ' ')})"


def plain(q: Dialect, x: str) -> str:
    """Letters beyond ASCII as underscores, so that word boundaries mean the same to every engine: such letters are word characters."""
    return q.sub(x, r"[\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{1fff}\x{2c00}-\x{2dff}\x{3040}-\x{d7ff}\x{f900}-\x{fdff}]", "_")


def text_hash(q: Dialect, x: str) -> str:
    body = f"lower({collapse(q, x)})"
    return f"sha2({body}, 256)" if q is SPARK else f"sha256({body})"


def bucket(q: Dialect, h: str) -> str:
    """The first 8 hex digits as a share of their range."""
    if q is SPARK:
        return f"cast(conv(substring({h}, 1, 8), 16, 10) AS bigint) / 4294967295D"
    return f"('0x' || substr({h}, 1, 8))::BIGINT / 4294967295.0::DOUBLE"


def letters(q: Dialect, x: str) -> str:
    return q.count(x, r"\p{L}")


def marks(q: Dialect, x: str) -> str:
    return q.count(x, r"[^\p{L}\p{N}\s]")


def ratio(q: Dialect, a: str, b: str) -> str:
    """a / max(1, b) as double."""
    return f"({q.double(a)} / greatest(1, {b}))"


#: The statistics of ``style``, in order.
STYLE = (
    "words", "unique_words", "chars", "letters", "sentences", "punct", "upper_tokens", "lower_tokens",
    "avg_word_len", "lexical_diversity", "words_per_sentence", "punct_ratio", "alpha_ratio", "upper_ratio",
)


def style(q: Dialect, x: str, w: str) -> dict[str, str]:
    """Fourteen statistics of a text x and its words w, by name."""
    n, chars = q.size(w), f"length({x})"
    unique, punct, alpha = q.size(q.unique(q.each(w, "t", "lower(t)"))), marks(q, x), letters(q, x)
    upper, lower = q.size(q.where(w, "t", q.like("t", "^[A-Z]"))), q.size(q.where(w, "t", "t = lower(t)"))
    total = f"coalesce({f"length(array_join({w}, ''))" if q is SPARK else f'list_sum(list_transform({w}, lambda t: length(t)))'}, 0)"
    sentences = f"greatest(1, {q.count(x, '[.!?]')})"
    values = (
        n, unique, chars, alpha, sentences, punct, upper, lower, ratio(q, total, n), ratio(q, unique, n), f"({q.double(n)} / {sentences})",
        ratio(q, punct, chars), ratio(q, alpha, chars), ratio(q, upper, n),
    )
    return dict(zip(STYLE, values, strict=True))


def flags_v1(q: Dialect, x: str, words: str) -> dict[str, str]:
    chars, n = f"length({x})", q.size(words)
    low = f"{q.size(q.where(q.upto(f'{n} - 1'), 'i', f'lower({q.at(words, 'i')}) = lower({q.at(words, 'i + 1')})'))}"
    return {
        "assistant_artifact": q.like(plain(q, x), X.ASSISTANT_V1),
        "placeholder_url": q.like(x, X.URL),
        "url_heavy": f"{q.count(x, X.URL)} >= 2",
        "low_letter_ratio": f"({chars} > 50 AND {ratio(q, letters(q, x), chars)} < 0.45)",
        "high_digit_ratio": f"({chars} > 80 AND {ratio(q, q.count(x, r'\p{Nd}'), chars)} > 0.25)",
        "high_punct_ratio": f"({chars} > 80 AND {ratio(q, marks(q, x), chars)} > 0.18)",
        "mostly_upper": f"({n} > 20 AND {ratio(q, q.count(x, r'\p{Lu}'), letters(q, x))} > 0.55)",
        "repeated_tokens": f"{low} >= 3",
    }


def flags_v2(q: Dialect, x: str, words: str) -> dict[str, str]:
    chars, n = f"length({x})", q.size(words)
    a, b, c = (f"lower({q.at(words, i)})" for i in ("i", "i + 1", "i + 2"))
    triples = q.size(q.where(q.upto(f"{n} - 2"), "i", f"{a} = {b} AND {b} = {c}"))
    return {
        "assistant_artifact": q.like(plain(q, x), X.ASSISTANT_V2),
        "url_heavy": f"{q.count(x, X.URL)} >= 2",
        "placeholder_url": q.like(x, X.URL),
        "low_letter_ratio": f"({chars} > 40 AND {ratio(q, letters(q, x), chars)} < 0.45)",
        "high_digit_ratio": f"({chars} > 80 AND {ratio(q, q.count(x, r'\p{Nd}'), chars)} > 0.2)",
        "high_punct_ratio": f"({chars} > 80 AND {ratio(q, marks(q, x), chars)} > 0.18)",
        "mostly_upper": "false",  # counts capitals among words already lower-cased, so it never holds
        "repeated_tokens": f"{triples} >= 3",
        "basic_junk": f"({n} > 0 AND {q.count(plain(q, x), X.FUNCTION_LIKE)} < greatest(2, {n} {'DIV' if q is SPARK else '//'} 20))",
    }


def reasons(q: Dialect, x: str, words: str, flags: dict[str, str], least: int, most: int) -> str:
    """The names of the reasons to reject a text, joined by commas, in their order; empty for none."""
    rules = {"empty_text": f"{collapse(q, x)} = ''", "too_short": f"{q.size(words)} < {least}", "too_long": f"{q.size(words)} > {most}"} | flags
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {cond} THEN '{name}' END" for name, cond in rules.items()) + ")"


def col(text: str) -> Column:
    return F.expr(text)
