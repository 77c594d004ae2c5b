"""Awkward rows that every operator must take."""

from __future__ import annotations

import random


def words(r: random.Random, n: int) -> str:
    return " ".join(r.choice(("ala", "bora", "cine", "dote", "efe", "fury", "gala", "hut", "iris", "jot")) + str(r.randrange(40)) for _ in range(n))


def documents(seed: int = 3) -> list[tuple]:
    """(doc_id, text, lang, source, n_chars, __wm_text): nulls, empties, copies, near copies, long and odd texts."""
    r = random.Random(seed)
    base = words(r, 300)
    near = base.split()
    near[150] = "changed"
    shared = words(r, 60)
    texts = [
        None, "", " \t\n", "one", "one two three", base, base, " ".join(near), shared, words(r, 80) + " " + shared + " " + words(r, 80), words(r, 50) + "\n" + shared, "As " * 300, "x" * 5000, "é😀漢 " * 90,
        words(r, 30), "\x1c\x85\xa0 odd spaces", "A B c d E", "a b C D e", "same line\nsame line\nsame line", words(r, 4000), "### *** $$$ %%% " * 40,
    ]
    rows = [(i, t, "en", ("a", "b", None)[i % 3], len(t or ""), "clash") for i, t in enumerate(texts)]
    return [*rows, (5, base, "en", "a", 1, "clash"), (None, base, "en", None, 1, None)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __wm_text string"


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
