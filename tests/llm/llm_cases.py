"""Fixtures shared by the tests of this folder."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns with names that the operators use themselves.
CLASHING = DOCS + ", id long, row string, key string, score double, digest string, text_hash long, lane int, uid long, position double, size int"


def table(spark, rows, clashing=False):
    """documents of (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src", len(r[1]) if r[1] is not None else None) for r in rows]
    if clashing:
        full = [(*r, 1, "r", "k", 0.5, "d", 2, 3, 4, 0.1, 5) for r in full]
    return spark.createDataFrame(full, CLASHING if clashing else DOCS)


def prose(seed, words, vocabulary=400):
    maker = random.Random(seed)
    return " ".join(f"w{maker.randrange(vocabulary)}" for _ in range(words))


LONG = prose(7, 20_000, 50_000)
EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (6, "one two three"), (7, LONG), (8, LONG), (9, LONG + " tail"),
         (10, "Ünïcode 😀 wörds 日本"), (11, prose(3, 60)), (11, prose(3, 60)), (None, "no id"), (None, None)]
