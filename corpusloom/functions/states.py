"""Token to state: ordered rules, the first that holds decides.

Each function of the first part gives SQL text for one token, in a dialect. The second part states the same
rules as patterns of whole tokens. ``lettered`` applies them to each token once and remembers its letter, so that a text
costs a look-up a token; ``sequence`` makes of them a chain of replacements over all tokens of a text, a pass for each rule.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import lexicon as X
from corpusloom.functions.dialect import Dialect

SHAPES = ("PUNCT", "NUM", "ALLCAPS", "CAP", "FUNC", "SHORT", "LONG", "WORD")
VIEWS = ("shape", "coarse", "posish", "true_pos", "motif", "semantic")


def _upper(t: str) -> str:
    return f"({t} = upper({t}) AND {t} <> lower({t}))"


def shape(q: Dialect, t: str) -> str:
    return q.case(
        [
            ("'PUNCT'", q.full(t, "[.!?;:—-]")),
            ("'NUM'", q.full(t, X.NUMBER_STATE)),
            ("'ALLCAPS'", f"{_upper(t)} AND length({t}) > 1"),
            ("'CAP'", q.like(t, "^[A-Z]")),
            ("'FUNC'", f"lower({t}) IN {q.words(X.STOP_TERMS)}"),
            ("'SHORT'", f"length({t}) <= 3"),
            ("'LONG'", f"length({t}) >= 10"),
        ],
        "'WORD'",
    )


def _number(q: Dialect, t: str) -> str:
    return f"({q.full(t, X.NUMBER_STATE)} OR {t} IN ('$', '€', '£'))"


def coarse(q: Dialect, t: str) -> str:
    low = f"lower({t})"
    return q.case(
        [
            ("'PUNCT'", q.full(t, "[.!?;:—-]")),
            ("'NUM'", _number(q, t)),
            ("'NEG'", f"{low} IN {q.words(X.NEGATIONS)}"),
            ("'UNIV'", f"{low} IN {q.words(X.UNIVERSALS)}"),
            ("'MODAL'", f"{low} IN {q.words(X.MODALS)}"),
            ("'CLAIM_VERB'", f"{low} IN {q.words(X.CLAIM_VERBS)}"),
            ("'ENTITY'", f"{q.like(t, '^[A-Z]')} AND {low} NOT IN {q.words(X.STOP_TERMS)}"),
            ("'PRODUCT'", f"{low} IN {q.words(X.PRODUCT_TERMS)}"),
            ("'ABSTRACT'", f"({low} IN {q.words(X.ABSTRACT_TERMS)} OR {q.like(low, f'(?:{X.NOUN_ENDS})$')})"),
            ("'FUNC'", f"{low} IN {q.words(X.STOP_TERMS)}"),
        ],
        "'CONTENT'",
    )


def posish(q: Dialect, t: str) -> str:
    low = f"lower({t})"
    return q.case(
        [
            ("'SENT_END'", q.full(t, "[.!?]")),
            ("'CLAUSE_PUNCT'", q.full(t, "[;:—-]")),
            ("'NUM'", _number(q, t)),
            ("'NEG'", f"{low} IN {q.words(X.NEGATIONS)}"),
            ("'MODAL'", f"{low} IN {q.words(X.MODALS)}"),
            ("'CLAIM_VERB'", f"{low} IN {q.words(X.CLAIM_VERBS)}"),
            ("'FUNC'", f"{low} IN {q.words(X.STOP_TERMS)}"),
            ("'ACRONYM'", f"{_upper(t)} AND length({t}) > 1"),
            ("'TITLE'", q.like(t, "^[A-Z]")),
            ("'ADVISH'", q.like(low, "ly$")),
            ("'VERBISH'", q.like(low, f"(?:{X.VERB_ENDS})$")),
            ("'NOUN_ABSTRACT'", q.like(low, f"(?:{X.NOUN_ENDS})$")),
            ("'ADJISH'", q.like(low, f"(?:{X.ADJECTIVE_ENDS})$")),
        ],
        "'CONTENT'",
    )


def true_pos(q: Dialect, t: str) -> str:
    """Without a tagger: a map of the states of ``posish``; sentence and clause marks are OTHER."""
    names = {"NUM": "NUM", "NEG": "NEG", "MODAL": "MODAL", "CLAIM_VERB": "CLAIM_VERB", "TITLE": "NOUN", "ADVISH": "ADV", "VERBISH": "VERB", "NOUN_ABSTRACT": "NOUN", "ADJISH": "ADJ", "FUNC": "DET"}
    text = posish(q, t)
    for state in ("SENT_END", "CLAUSE_PUNCT", "ACRONYM", "CONTENT", *names):
        text = text.replace(f"THEN '{state}'", f"THEN '={names.get(state, 'OTHER')}'").replace(f"ELSE '{state}'", f"ELSE '={names.get(state, 'OTHER')}'")
    return text.replace("'=", "'")


def motif(q: Dialect, prev: str, next_: str) -> str:
    """The motif of two adjacent coarse states, or null."""
    return q.case(
        [
            (f"concat('NEG_', {next_})", f"{prev} = 'NEG' AND {next_} IN ('ABSTRACT', 'CONTENT', 'CLAIM_VERB')"),
            (f"concat('UNIV_', {next_})", f"{prev} = 'UNIV' AND {next_} IN ('ABSTRACT', 'CONTENT', 'ENTITY', 'PRODUCT')"),
            (f"concat('MODAL_', {next_})", f"{prev} = 'MODAL' AND {next_} IN ('CLAIM_VERB', 'CONTENT', 'ABSTRACT')"),
            (f"concat('NUM_', {next_})", f"{prev} = 'NUM' AND {next_} IN ('ABSTRACT', 'CONTENT')"),
            (f"concat('SPECIFIC_', {prev}, '_', {next_})", f"{prev} IN ('ENTITY', 'PRODUCT') AND {next_} IN ('ENTITY', 'PRODUCT', 'CONTENT')"),
            (f"concat('ABSTRACT_', {next_})", f"{prev} = 'ABSTRACT' AND {next_} IN ('ABSTRACT', 'CLAIM_VERB')"),
        ],
        "NULL",
    )


def semantic(q: Dialect, t: str) -> str:
    """The semantic pattern of a token, or null for tokens that have none."""
    low = f"lower({t})"
    hints: dict[str, list[str]] = {}
    for word, concept in X.CONCEPT_HINTS.items():
        hints.setdefault(concept, []).append(word)
    return q.case(
        [
            ("'NUMERIC'", _number(q, t)),
            ("NULL", f"{low} IN {q.words(X.STOP_TERMS)} OR length({t}) <= 1"),
            *((f"'SUMO::{c}'", f"{low} IN {q.words(tuple(w))}") for c, w in hints.items()),
            ("'WORDNET_LEX::noun.attribute'", q.like(low, f"(?:{X.NOUN_ENDS})$")),
            ("'WORDNET_POS::verb'", q.like(low, f"(?:{X.VERB_ENDS})$")),
            ("'WORDNET_POS::adj'", q.like(low, f"(?:{X.ADJECTIVE_ENDS})$")),
            ("'WORDNET_ENTITY_CANDIDATE'", q.like(t, "^[A-Z]")),
        ],
        "'WORDNET_CONTENT'",
    )


def token_type(q: Dialect, t: str) -> str:
    """Of spike tokens, whose words begin with an ASCII letter and whose other tokens are single marks."""
    return q.case(
        [
            ("'EMPTY'", f"{t} = ''"),
            ("'NUM'", q.full(t, r"\p{Nd}+")),
            ("'CAPS'", f"{q.full(t, '[A-Z]{2,}')}"),
            ("'TITLE'", q.full(t, "[A-Z][a-z]*")),
            ("'LOWER'", q.full(t, "[a-z]+")),
            ("'ALPHA_MIXED'", q.full(t, "[A-Za-z]+")),
            ("'PUNCT'", q.full(t, r"[^\p{L}\p{N}]+")),
            ("'ALNUM'", f"{q.like(t, '[0-9]')} AND {q.like(t, '[A-Za-z]')}"),
        ],
        "'OTHER'",
    )


def posish_wide(q: Dialect, t: str) -> str:
    low = f"lower({t})"
    return q.case(
        [
            ("'EMPTY'", f"{t} = ''"),
            ("'PUNCT'", q.full(t, r"[^\p{L}\p{N}]+")),
            ("'NUM'", q.full(t, r"\p{Nd}+")),
            ("'DET'", f"{low} IN {q.words(X.DETERMINERS)}"),
            ("'PRON'", f"{low} IN {q.words(X.PRONOUNS)}"),
            ("'MODAL'", f"{low} IN {q.words(X.MODALS_WIDE)}"),
            ("'AUX'", f"{low} IN {q.words(X.AUXILIARIES)}"),
            ("'PREP'", f"{low} IN {q.words(X.PREPOSITIONS)}"),
            ("'CONJ'", f"{low} IN {q.words(X.CONJUNCTIONS)}"),
            ("'ADV'", f"{low} IN {q.words(X.ADVERBS)} OR {q.like(low, 'ly$')}"),
            ("'GERUND'", f"{q.like(low, 'ing$')} AND length({t}) >= 4"),
            ("'PAST'", f"{q.like(low, 'ed$')} AND length({t}) >= 3"),
        ],
        "'NOUNISH'",  # an all-capitals rule would test the lower-cased token, so it never holds
    )


def char_shapes(q: Dialect, x: str) -> str:
    """A text as a string of shape letters: U, l, D, S, P or O for each character.

    Characters first become private-use ones, so that the letters written last aren't read again.
    """
    marks = "".join("\\" + c for c in X.SHAPE_PUNCT)
    private = [chr(0xE001 + k) for k in range(6)]
    classes = (r"\p{Lu}", r"[\p{Ll}ªº]", r"\p{Nd}", r"[\s\x{1c}-\x{1f}\x{85}\x{a0}]", f"[{marks}]", r"[^\x{e001}-\x{e005}]")
    for pattern, mark in zip(classes, private, strict=True):
        x = q.sub(x, pattern, mark)
    return f"translate({x}, {q.lit(''.join(private))}, 'UlDSPO')"


class Shapes(dict):
    """``char_shapes`` by character, a table for ``str.translate``."""

    def __missing__(self, code: int) -> str:
        c, kind = chr(code), unicodedata.category(chr(code))
        if 0xE001 <= code <= 0xE006:  # the private characters of the rules stand for their classes
            got = "UlDSPO"[code - 0xE001]
        elif kind == "Lu" or kind == "Nd":
            got = "U" if kind == "Lu" else "D"
        elif kind == "Ll" or c in "ªº":
            got = "l"
        else:
            got = "S" if c in " \t\n\v\f\r\x1c\x1d\x1e\x1f\x85\xa0" else "P" if c in X.SHAPE_PUNCT else "O"
        self[code] = got
        return got


#: Before a token that waits for its state, and before a state's letter; white space, so no token holds them.
WAITS, DONE = "\n", "\t"
_ANY, _SOME, _END = r"[^\n\t]*", r"[^\n\t]+", r"(?![^\n\t])"
_UPPER_WORD, _CAPITAL = r"[A-Z][A-Z'-]+", rf"[A-Z]{_ANY}"


def _one_of(words: str) -> str:
    return "(?i:" + "|".join(dict.fromkeys(words.split())) + ")"


def _ends(endings: str) -> str:
    return rf"{_ANY}(?i:{endings})"


_NUMBER_OR_SIGN = rf"(?:{X.NUMBER_STATE}|[$€£])"
_MOTIFS = [("NEG", n) for n in ("ABSTRACT", "CONTENT", "CLAIM_VERB")]
_MOTIFS += [("UNIV", n) for n in ("ABSTRACT", "CONTENT", "ENTITY", "PRODUCT")]
_MOTIFS += [("MODAL", n) for n in ("CLAIM_VERB", "CONTENT", "ABSTRACT")]
_MOTIFS += [("NUM", n) for n in ("ABSTRACT", "CONTENT")]
_MOTIFS += [(p, n) for p in ("ENTITY", "PRODUCT") for n in ("ENTITY", "PRODUCT", "CONTENT")]
_MOTIFS += [("ABSTRACT", n) for n in ("ABSTRACT", "CLAIM_VERB")]
#: view: ordered (state, pattern of a whole token); a state of None drops the token. The last pattern takes all.
RULES: dict[str, list[tuple[str | None, str]]] = {
    "shape": [
        ("PUNCT", "[.!?;:—-]"), ("NUM", X.NUMBER_STATE), ("ALLCAPS", _UPPER_WORD), ("CAP", _CAPITAL), ("FUNC", _one_of(X.STOP_TERMS)),
        ("SHORT", r"[^\n\t]{1,3}"), ("LONG", r"[^\n\t]{10,}"), ("WORD", _SOME),
    ],
    "coarse": [
        ("PUNCT", "[.!?;:—-]"), ("NUM", _NUMBER_OR_SIGN), ("NEG", _one_of(X.NEGATIONS)), ("UNIV", _one_of(X.UNIVERSALS)), ("MODAL", _one_of(X.MODALS)),
        ("CLAIM_VERB", _one_of(X.CLAIM_VERBS)), ("ENTITY", rf"(?!{_one_of(X.STOP_TERMS)}{_END}){_CAPITAL}"), ("PRODUCT", _one_of(X.PRODUCT_TERMS)),
        ("ABSTRACT", f"(?:{_one_of(X.ABSTRACT_TERMS)}|{_ends(X.NOUN_ENDS)})"), ("FUNC", _one_of(X.STOP_TERMS)), ("CONTENT", _SOME),
    ],
    "posish": [
        ("SENT_END", "[.!?]"), ("CLAUSE_PUNCT", "[;:—-]"), ("NUM", _NUMBER_OR_SIGN), ("NEG", _one_of(X.NEGATIONS)), ("MODAL", _one_of(X.MODALS)),
        ("CLAIM_VERB", _one_of(X.CLAIM_VERBS)), ("FUNC", _one_of(X.STOP_TERMS)), ("ACRONYM", _UPPER_WORD), ("TITLE", _CAPITAL), ("ADVISH", _ends("ly")),
        ("VERBISH", _ends(X.VERB_ENDS)), ("NOUN_ABSTRACT", _ends(X.NOUN_ENDS)), ("ADJISH", _ends(X.ADJECTIVE_ENDS)), ("CONTENT", _SOME),
    ],
    "semantic": [
        ("NUMERIC", _NUMBER_OR_SIGN), (None, rf"(?:{_one_of(X.STOP_TERMS)}|[^\n\t])"),
        *((f"SUMO::{c}", _one_of(" ".join(w for w, k in X.CONCEPT_HINTS.items() if k == c))) for c in dict.fromkeys(X.CONCEPT_HINTS.values())),
        ("WORDNET_LEX::noun.attribute", _ends(X.NOUN_ENDS)), ("WORDNET_POS::verb", _ends(X.VERB_ENDS)), ("WORDNET_POS::adj", _ends(X.ADJECTIVE_ENDS)),
        ("WORDNET_ENTITY_CANDIDATE", _CAPITAL), ("WORDNET_CONTENT", _SOME),
    ],
    "token_type": [
        ("CAPS", "[A-Z]{2,}"), ("TITLE", "[A-Z][a-z]*"), ("LOWER", "[a-z]+"), ("ALPHA_MIXED", "[A-Za-z]+"), ("PUNCT", r"[^\p{L}\p{N}\n\t]+"),
        ("ALNUM", rf"[A-Za-z](?={_ANY}[0-9]){_ANY}"), ("OTHER", _SOME),
    ],
    "posish_wide": [
        ("PUNCT", r"[^\p{L}\p{N}\n\t]+"), ("DET", _one_of(X.DETERMINERS)), ("PRON", _one_of(X.PRONOUNS)), ("MODAL", _one_of(X.MODALS_WIDE)),
        ("AUX", _one_of(X.AUXILIARIES)), ("PREP", _one_of(X.PREPOSITIONS)), ("CONJ", _one_of(X.CONJUNCTIONS)), ("ADV", f"(?:{_one_of(X.ADVERBS)}|{_ends('ly')})"),
        ("GERUND", r"[^\n\t]+(?i:ing)"), ("PAST", r"[^\n\t]+(?i:ed)"), ("NOUNISH", _SOME),
    ],
}
#: What the states of ``posish`` are to ``true_pos``.
_TRUE_POS = {"NUM": "NUM", "NEG": "NEG", "MODAL": "MODAL", "CLAIM_VERB": "CLAIM_VERB", "TITLE": "NOUN", "ADVISH": "ADV", "VERBISH": "VERB", "NOUN_ABSTRACT": "NOUN", "ADJISH": "ADJ", "FUNC": "DET"}
#: The states of each view; a state's letter is the view's first letter plus its place here.
STATES: dict[str, tuple[str, ...]] = {v: tuple(s for s, _ in rules if s) for v, rules in RULES.items()}
STATES["true_pos"] = tuple(dict.fromkeys(_TRUE_POS.get(s, "OTHER") for s in STATES["posish"]))
STATES["motif"] = tuple(f"SPECIFIC_{p}_{n}" if p in ("ENTITY", "PRODUCT") else f"{p}_{n}" for p, n in _MOTIFS) + ("NO_MOTIF",)
STATES["semantic"] += ("NO_SEMANTIC_PATTERN",)
_BLOCK = 32
_FIRST = {v: 0x100 + _BLOCK * k for k, v in enumerate(STATES)}


def letter(view: str, state: str) -> str:
    return chr(_FIRST[view] + STATES[view].index(state))


def none_letter(view: str) -> str:
    """A letter of the view's block that is no state."""
    return chr(_FIRST[view] + _BLOCK - 1)


def spelled(letters: Column) -> Column:
    """The state of a letter (the first of a string), whatever its view."""
    return F.element_at(F.array(*map(F.lit, names())), F.ascii(letters) - 0xFF)


def names() -> list[str]:
    """The states of all letters, from the first letter on; empty where a letter is no state."""
    return [n for states in STATES.values() for n in [*states, *[""] * (_BLOCK - len(states))]]


def listed(sequences: pa.Array) -> pa.Array:
    """The names of each sequence's letters."""
    texts = sequences.to_pylist()
    sizes = np.array([len(x) for x in texts], dtype=np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4").astype(np.int64) - 0x100
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(names(), pa.string()).take(pa.array(codes)))


def view_of(letters: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, STATES)), F.expr("1") + F.floor((F.ascii(letters) - 0x100) / _BLOCK).cast("int"))


def _chain(marked: Column, view: str, rules: list[tuple[str | None, str]]) -> Column:
    for state, pattern in rules:
        marked = F.regexp_replace(marked, F.lit(rf"\n{pattern}{_END}"), F.lit(DONE + letter(view, state) if state else ""))
    return F.translate(marked, WAITS + DONE, "")


def sequence(tokens: Column, view: str) -> Column:
    """The states of an array of tokens as a string, a letter for each."""
    if view == "true_pos":
        posish = STATES["posish"]
        return F.translate(sequence(tokens, "posish"), "".join(letter("posish", s) for s in posish), "".join(letter(view, _TRUE_POS.get(s, "OTHER")) for s in posish))
    if view == "motif":
        pairs = [letter("coarse", p) + letter("coarse", n) for p, n in _MOTIFS]
        found = F.regexp_extract_all(sequence(tokens, "coarse"), F.lit(f"(?=({'|'.join(pairs)}))."), F.lit(1))
        got = _chain(F.concat(F.lit(WAITS), F.array_join(found, WAITS)), view, list(zip(STATES[view], pairs, strict=False)))
        return F.regexp_replace(got, F.lit("^$"), F.lit(letter(view, "NO_MOTIF")))
    got = _chain(F.concat(F.lit(WAITS), F.array_join(tokens, WAITS)), view, RULES[view])
    return F.regexp_replace(got, F.lit("^$"), F.lit(letter(view, "NO_SEMANTIC_PATTERN"))) if view == "semantic" else got


#: Tokens that are remembered for a view, and the longest of them.
REMEMBERED, LONGEST = 1 << 18, 64


def _whole(pattern: str) -> re.Pattern:
    """A rule's pattern as Python has it: digits and cases are those of ASCII, as in Java."""
    pattern = pattern.replace(r"[^\p{L}\p{N}\n\t]", r"(?:[^\w\n\t]|_)").replace(r"\d", "[0-9]").replace("(?i:", "(?ai:")
    return re.compile(f"(?:{pattern})")


#: A rule that is a list of plain words.
_LISTED = re.compile(r"\(\?i:([A-Za-z'|-]+)\)")


class Letters(dict):
    """The letter of a token in a view of ``RULES``, empty for a token that is dropped."""

    def __init__(self, view: str) -> None:
        super().__init__()
        self.letters = [letter(view, state) if state else "" for state, _ in RULES[view]]
        self.words: dict[str, int] = {}  # of rules that are lists of words: the first that has a word
        self.rules = []
        for k, (_, pattern) in enumerate(RULES[view]):
            if listed := _LISTED.fullmatch(pattern):
                for word in listed[1].split("|"):
                    self.words.setdefault(word.lower(), k)
            else:
                self.rules.append((k, _whole(pattern).fullmatch))

    def __missing__(self, token: str) -> str:
        at = self.words.get(token.lower(), len(self.letters)) if token.isascii() else len(self.letters)
        got = self.letters[min(at, next(k for k, fits in self.rules if k > at or fits(token)))]
        if len(token) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[token] = got
        return got


_BASE = {"true_pos": "posish", "motif": "coarse"}
#: Bytes of tokens that are looked up at a time; a longer text is looked up by itself.
PART = 1 << 20


def lettered(views: tuple[str, ...]):
    """A function from an array of texts' tokens, line ends between them, to structs of ``sequence`` for each of the views.

    Arrow cuts and numbers the tokens of a part; each distinct one is looked up once for a view, and the rest are tables by number.
    """
    known: dict[str, Letters] = {}
    codes_of = lambda view, of: np.array([ord(letter(view, s)) if s else 0 for s in of], dtype=np.uint32)
    to_true = codes_of("true_pos", [_TRUE_POS.get(s, "OTHER") for s in STATES["posish"]])
    pairs = np.zeros((_BLOCK, _BLOCK), dtype=np.uint32)
    for (p, n), m in zip(_MOTIFS, STATES["motif"], strict=False):
        pairs[STATES["coarse"].index(p), STATES["coarse"].index(n)] = ord(letter("motif", m))
    none = {"motif": letter("motif", "NO_MOTIF"), "semantic": letter("semantic", "NO_SEMANTIC_PATTERN")}

    def derived(view: str, base: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if view == "true_pos":
            return to_true[base - _FIRST["posish"]], owner
        if view == "motif":
            at = base - _FIRST["coarse"]
            found = np.where(owner[:-1] == owner[1:], pairs[at[:-1], at[1:]], 0).astype(np.uint32)
            return found[found > 0], owner[:-1][found > 0]
        return base, owner

    def part(joined: pa.Array, out: dict[str, list[str]]) -> None:
        cut = pc.split_pattern(joined, WAITS)
        numbered = cut.flatten().dictionary_encode()
        tokens, codes = numbered.dictionary.to_pylist(), numbered.indices.to_numpy()
        owner = np.repeat(np.arange(len(joined)), pc.list_value_length(cut).to_numpy())
        made = {}
        for b, of in known.items():
            table = np.array([ord(of[t] or "\0") if t else 0 for t in tokens], dtype=np.uint32)
            letters = table[codes]
            made[b] = (letters, owner) if table.all() else (letters[letters > 0], owner[letters > 0])
        for v in views:
            letters, own = derived(v, *made[_BASE.get(v, v)])
            whole, ends = letters.astype("<u4").tobytes().decode("utf-32-le"), np.cumsum(np.bincount(own, minlength=len(joined))).tolist()
            out[v] += [whole[a:b] or none.get(v, "") for a, b in zip([0, *ends], ends, strict=False)]

    def run(joined: pa.Array) -> pa.Array:
        for b in {_BASE.get(v, v) for v in views} - set(known):
            known[b] = Letters(b)
        out: dict[str, list[str]] = {v: [] for v in views}
        joined = pc.fill_null(joined, "")
        upto = np.cumsum(pc.binary_length(joined).to_numpy().astype(np.int64))
        at = 0
        while at < len(joined):
            done = int(upto[at - 1]) if at else 0
            n = max(1, int(np.searchsorted(upto[at:], done + PART, side="right")))
            part(joined.slice(at, n), out)
            at += n
        return pa.StructArray.from_arrays([pa.array(out[v], pa.string()) for v in views], list(views))

    return run
