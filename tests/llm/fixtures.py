"""Small documents with the awkward cases, and plain-Python versions of what the operators compute."""

from __future__ import annotations

import random
import re
from collections import Counter

WORD = re.compile("[^\x20\x09-\x0d]+")


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(("th", "er", "on", "an", "ing", "re", "ed")) for _ in range(1 + (r.randrange(vocabulary) % 4))) + str(r.randrange(vocabulary)) * (r.random() < 0.5) for _ in range(n))


def documents(spark, rows=None):
    """doc_id, text, lang, source, n_chars and columns whose names clash with those the operators use inside."""
    rows = rows if rows is not None else awkward()
    wide = [(d, t, lang, s, len(t or ""), "clash", 7) for d, t, lang, s in rows]
    return spark.createDataFrame(wide, "doc_id long, text string, lang string, source string, n_chars long, node string, size int")


def awkward():
    long = prose(1, 6000)
    rows = [(1, prose(2, 80), "en", "a"), (2, prose(3, 60), "en", "a"), (3, None, "en", "b"), (4, "", None, "b"), (5, " \n\t", "de", None), (6, long, "de", "a"), (7, "Ä é 漢字  x", None, None)]
    return [*rows, (1, prose(2, 80), "en", "a"), (None, prose(4, 50), "de", "c"), (8, prose(2, 80), "en", "c")]


def shingles(text: str | None) -> Counter:
    w = WORD.findall((text or "").lower())
    n = min(5, len(w))
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else Counter()


def similarity(a: str | None, b: str | None) -> float:
    x, y = shingles(a), shingles(b)
    return sum((x & y).values()) / max(1, sum((x | y).values()))
