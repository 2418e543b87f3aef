"""Coercion of raw rows: labels, source types, candidate texts, as SQL text for either engine."""

from __future__ import annotations

from corpusloom.functions import lexicon as X
from corpusloom.functions.dialect import Dialect


def _low(x: str) -> str:
    return f"lower(trim(coalesce({x}, '')))"


def numeric_label(q: Dialect, x: str) -> str:
    return f"CASE WHEN {_low(x)} = '1' THEN 'ai_generated' ELSE 'human_written' END"


def text_label(q: Dialect, x: str) -> str:
    return f"CASE WHEN {_low(x)} IN {q.words(X.AI_TEXT_LABELS)} THEN 'ai_generated' ELSE 'human_written' END"


def harsh_label(q: Dialect, x: str) -> str:
    return q.case([("'unknown'", f"{_low(x)} = ''"), ("'human_written'", f"{_low(x)} = 'human'")], "'ai_generated'")


def _integer(q: Dialect, x: str, value: str) -> str:
    return q.like(f"trim({x})", rf"^[+-]?0*{value}$" if value != "0" else "^[+-]?0+$")


def source_type(q: Dialect, x: str) -> str:
    """ai_generated, human_written or null: null stays null, then integers, then words."""
    return q.case(
        [
            ("NULL", f"{x} IS NULL"), ("'ai_generated'", f"{q.like(f'trim({x})', r'^[+]?0*1$')} OR lower(trim({x})) IN {q.words(X.AI_LABELS)}"),
            ("'human_written'", f"{_integer(q, x, '0')} OR lower(trim({x})) IN {q.words(X.HUMAN_LABELS)}"),
        ],
        "NULL",
    )


def label(q: Dialect, value: str, source: str) -> str:
    """1, 0 or null: by the label's words, else by the source type."""
    return q.case(
        [
            ("1", f"{_low(value)} IN {q.words(X.LABEL_ONE)}"), ("0", f"{_low(value)} IN {q.words(X.LABEL_ZERO)}"),
            ("1", f"{_low(source)} = 'ai_generated'"), ("0", f"{_low(source)} = 'human_written'"),
        ],
        "NULL",
    )


def candidate_text(fields: tuple[str, ...], title: str, strip: bool) -> str:
    """The first of the fields that is not blank, else the title, else nothing; as it is or stripped."""
    give = (lambda x: f"trim({x})") if strip else (lambda x: x)
    return f"coalesce({', '.join(f"CASE WHEN trim({f}) <> '' THEN {give(f)} END" for f in (*fields, title))}, '')"


def lemma(q: Dialect, t: str) -> str:
    """A token without its suffix; numbers as they are."""
    low = f"lower({t})"
    cut = lambda n: f"substr({low}, 1, length({t}) - {n})"
    return q.case(
        [
            (low, q.full(t, X.NUMERIC)), (cut(3), f"length({t}) > 5 AND {q.like(low, 'ing$')}"), (cut(2), f"length({t}) > 4 AND {q.like(low, 'ed$')}"),
            (f"concat({cut(3)}, 'y')", f"length({t}) > 4 AND {q.like(low, 'ies$')}"), (cut(1), f"length({t}) > 3 AND {q.like(low, 's$')}"),
        ],
        low,
    )


def numeric(q: Dialect, t: str) -> str:
    return q.full(t, X.NUMERIC)


def numeric_specific(q: Dialect, t: str) -> str:
    """A number that says something exact: a share, a fraction, or four digits and more."""
    return f"({q.like(t, '[%.]')} OR {q.like(t, '^[0-9]{4,}$')})"
