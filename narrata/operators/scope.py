"""Work on a range of chapters: a book's view of its own, and the way back to the book's coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrata.operators.plan_rules import broken


def scope_violations(ranges: DataFrame, chapters: DataFrame) -> DataFrame:
    """``(book_id, code, rule, path)`` of ranges (book_id, first_chapter, last_chapter): one end alone, or chapters that the book lacks. Both null: the whole book."""
    counts = chapters.groupBy("book_id").agg(F.count(F.lit(1)).alias("n"))
    a, b = F.col("first_chapter"), F.col("last_chapter")
    met = ranges.join(counts, "book_id", "left")
    return broken(met, ["book_id"], [
        ("INVALID_CHAPTER_RANGE", "ends", F.lit("$.chapter_start"), a.isNull() == b.isNull()),
        ("INVALID_CHAPTER_RANGE", "chapters", F.lit("$.chapters"), F.col("n") > 0),
        ("INVALID_CHAPTER_RANGE", "range", F.lit("$.chapter_start"), a.isNull() | b.isNull() | ((a >= 1) & (b >= a) & (b <= F.col("n")))),
    ])


def scopes(ranges: DataFrame, chapters: DataFrame) -> DataFrame:
    """``(book_id, first_chapter, last_chapter, base, limit)``: the offsets that a range spans; ranges that break a rule have no row."""
    wrong = scope_violations(ranges, chapters).select("book_id").distinct()
    edges = chapters.select("book_id", "chapter_index", "start_offset", "end_offset")
    met = ranges.join(wrong, "book_id", "left_anti").join(edges, "book_id")
    inside = met.where(F.col("first_chapter").isNull() | F.col("chapter_index").between(F.col("first_chapter"), F.col("last_chapter")))
    return inside.groupBy("book_id").agg(F.min("chapter_index").alias("first_chapter"), F.max("chapter_index").alias("last_chapter"), F.min("start_offset").alias("base"), F.max("end_offset").alias("limit"))


def scoped_books(scoped: DataFrame, books: DataFrame) -> DataFrame:
    """``(book_id, text, cleaned_text_sha256)``: the text of each scope as a book of its own."""
    part = F.expr("substring(text, cast(base + 1 as int), cast(limit - base as int))")
    return books.join(scoped, "book_id").select("book_id", part.alias("text")).withColumn("cleaned_text_sha256", F.sha2("text", 256))


def scoped_chapters(scoped: DataFrame, chapters: DataFrame) -> DataFrame:
    """The chapters of each scope, numbered from 1 and at offsets of its own text."""
    met = chapters.join(scoped, "book_id").where(F.col("chapter_index").between(F.col("first_chapter"), F.col("last_chapter")))
    moved = {"chapter_index": F.col("chapter_index") - F.col("first_chapter") + 1, "start_offset": F.col("start_offset") - F.col("base"), "end_offset": F.col("end_offset") - F.col("base")}
    return met.withColumns(moved).select(*chapters.columns)


def scoped_spans(scoped: DataFrame, spans: DataFrame) -> DataFrame:
    """Spans in a scope's coordinates; those outside it go, and those over its edges are clipped."""
    met = spans.join(scoped, "book_id").where((F.col("source_end") > F.col("base")) & (F.col("source_start") < F.col("limit")))
    moved = {
        "chapter_index": F.greatest(F.col("chapter_index"), F.col("first_chapter")) - F.col("first_chapter") + 1,
        "source_start": F.greatest(F.col("source_start"), F.col("base")) - F.col("base"), "source_end": F.least(F.col("source_end"), F.col("limit")) - F.col("base"),
    }
    return met.withColumns(moved).select(*spans.columns)


def remapped_spans(scoped: DataFrame, spans: DataFrame) -> DataFrame:
    """Spans of a scope's analysis at their place in the whole book: the inverse of ``scoped_spans``."""
    moved = {"chapter_index": F.col("chapter_index") + F.col("first_chapter") - 1, "source_start": F.col("source_start") + F.col("base"), "source_end": F.col("source_end") + F.col("base")}
    return spans.join(scoped, "book_id").withColumns(moved).select(*spans.columns)
