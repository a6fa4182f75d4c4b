"""Where a text may be cut: boundary offsets as a table, and offsets held against it.

The text is scanned where it lies; only offsets are shuffled and joined.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrata.functions.scans import scanned
from narrata.operators import boundaries

#: The white space before the first character of each line; offsets in it and right after it are line starts.
_INDENT = re.compile(r"^[^\S\n]*", re.MULTILINE)
#: Sources of a title that may stand at the beginning of any line.
TRUSTED = ("outline", "heading", "explicit", "layout")


def safe_starts(text: str) -> set[int]:
    """Offsets at which no sentence is split: both ends, sentence starts and headings."""
    return {0, len(text), *boundaries.sentence_starts(text), *(at for at, _ in boundaries.heading_starts(text))}


def line_starts(text: str) -> set[int]:
    """Offsets with nothing but white space before them on their line."""
    return {at for m in _INDENT.finditer(text) for at in range(m.start(), m.end() + 1)}


def _marked(text: str | None) -> list[int]:
    """Each offset times four, and 2 if it is safe, and 1 if a line begins."""
    safe, lines = safe_starts(text or ""), line_starts(text or "")
    return [at * 4 + (at in safe) * 2 + (at in lines) for at in safe | lines]


def boundary_offsets(books: DataFrame, mapping: DataFrame) -> DataFrame:
    """``(book_id, offset, safe, line)``: each offset at which a book may be cut, or where a line begins; page starts are safe."""
    mark = F.col("mark")
    own = books.select("book_id", F.explode(scanned(_marked, "array<long>", "text")).alias("mark"))
    own = own.select("book_id", F.shiftright(mark, 2).alias("offset"), (mark.bitwiseAND(2) > 0).alias("safe"), (mark.bitwiseAND(1) > 0).alias("line"))
    pages = mapping.select("book_id", F.col("cleaned_start").cast("long").alias("offset"), F.lit(True).alias("safe"), F.lit(False).alias("line"))
    return own.unionByName(pages).groupBy("book_id", "offset").agg(F.bool_or("safe").alias("safe"), F.bool_or("line").alias("line"))


def with_safety(offsets: DataFrame, marks: DataFrame, trusted: Column) -> DataFrame:
    """Offsets (book_id, offset) with ``is_safe``: a safe one, or one at the beginning of a line where ``trusted`` holds."""
    m = marks.select(F.col("book_id").alias("m_book"), F.col("offset").alias("m_offset"), "safe", "line")
    met = offsets.join(m, (F.col("book_id") == F.col("m_book")) & (F.col("offset") == F.col("m_offset")), "left")
    return met.select(*[offsets[c] for c in offsets.columns], F.coalesce(F.col("safe") | (F.col("line") & trusted), F.lit(False)).alias("is_safe"))
