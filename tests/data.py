"""Texts for tests."""

from __future__ import annotations

import random


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    parts = ["an", "er", "tion", "ou", "the", "st", "in", "re", "sh", "ch", "lo"]
    return " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 4))) + r.choice(["", "", "", ",", "."]) for _ in range(n))
