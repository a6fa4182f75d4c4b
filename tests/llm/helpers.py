"""Small tables with odd rows, and rows in comparable form."""

from __future__ import annotations

import random

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, host string"

ODD_TEXTS = [None, "", " ", "\n\n", "a", "a b", "x" * 5000, "one two three " * 700, "漢字 é \x00 \x85   z", "| | |\n***", "Same text.", "Same text."]


def odd_docs(spark, extra=()):
    """Documents with nulls in each column, ties, repeated rows, odd texts, and columns whose names clash with inner ones."""
    rows = [(i, t, "en" if i % 2 else None, "src0" if i % 3 else None, 1, "clash", "clash") for i, t in enumerate([*ODD_TEXTS, *extra])]
    rows += [rows[10], (None, "no id", None, None, None, None, None), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int, text string")


def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def plain(frame, *columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=str)


def near_copies(n, seed=3, words=120):
    """``n`` texts that differ from one another in a word or two."""
    rng = random.Random(seed)
    base = [rng.choice("abcdefghij") * rng.randint(1, 6) + str(rng.randint(0, 999)) for _ in range(words)]
    out = []
    for i in range(n):
        w = list(base)
        w[rng.randrange(words)] = f"new{i}"
        out.append(" ".join(w))
    return out
