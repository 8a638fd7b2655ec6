"""Small tables for the tests of marketloom.llm."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(r, n, letters="abcdefgh"):
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(n))


def frame(spark, rows):
    """rows: (doc_id, text[, lang, source])."""
    full = [(i, t, *(*rest, *("en", "s0")[len(rest):]), len(t) if t else 0) for i, t, *rest in rows]
    return spark.createDataFrame(full, DOCS)


def awkward(r):
    """Null and empty texts, a null id and source, repeated rows, a very long text."""
    long = prose(r, 30_000)
    return [(1, None), (2, ""), (3, "  \n\t "), (4, "one two"), (4, "one two"), (5, "Ünï 😀 wörd"),
            (None, "no id at all"), (6, long, None, None), (7, "x" * 20_000, "en", None)]
