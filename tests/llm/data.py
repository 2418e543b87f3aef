"""Small tables with the awkward cases, and plain versions of what the contracts ask for."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
#: A word of 2,048 letters that, with its letters exchanged, agrees in any polynomial modulo 2^64; and words around it.
THUE_MORSE = "".join("ab"[bin(k).count("1") % 2] for k in range(2048))
BETWEEN = "w0 w1 w2 w3 w4 w5 {} w6 w7 w8 w9 w10 w11"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    parts = ["an", "er", "tion", "ou", "the", "st", "in", "ré", "ß", "ch", "lo"]
    return " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 4))) + r.choice(["", "", "", ",", "."]) for _ in range(n))


def documents() -> list[tuple]:
    """doc_id, text, lang, source, n_chars and columns whose names operators use themselves."""
    base, passage = prose(1, 120), prose(99, 60)
    edited = base.split(" ")
    edited[60] = "changed"
    texts = {
        0: base, 1: None, 2: "", 3: "  \n\t ", 4: base, 5: " ".join(edited), 6: prose(2, 80) + " " + passage + " " + prose(3, 40),
        7: passage, 8: prose(4, 30) + "\n" + passage + "\n" + passage, 9: "one two", 10: "ONE two", 11: "a b c d e", 12: "same same same same same same same same same same same same same same",
        13: "x" * 5000, 14: prose(5, 20000), 15: base.upper(), 16: "12 34 !!", 17: " ".join(edited) + " tail",
        18: "mail bob.smith@mail.example.com or call +1 (988) 555-2485, host 10.0.0.255, card 4539 1488 0343 6467 iban GB82 WEST 1234 5698 7654 32",
        19: "a@b.c.d-e_f@g.h 1.2.3.4.5.6.7.8 256.1.1.1 4539148803436468 +12 3 GB82WEST12345698765433 ssn 123-45-6789 and 123-45-6789", 20: prose(7, 15),
        -3: base + " before", 21: "\x00 nul \x1c mark", 22: "日本語 テスト 文 " * 5,
    }
    rows = [(k, v, "en" if k % 2 else "de", "src0", len(v or ""), "r", 1, "f") for k, v in texts.items()]
    return [*rows, (None, base, None, None, None, None, None, None), rows[6], (9, "three four five six", "en", None, 3, None, None, None)]


DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, score int, found string"


def words(text: str | None, lower: bool = False) -> list[str]:
    return WORD.findall((text or "").translate(LOWER) if lower else (text or ""))


def shingles(text: str | None) -> set[tuple]:
    w = words(text, True)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
