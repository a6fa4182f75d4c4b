"""Interval algebra over text spans: lookup, order, coverage, gaps, review."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Kinds of spans that somebody speaks, confidence bands, and characters of an excerpt.
SPEAKING_TYPES, BANDS, EXCERPT = ("dialogue", "unknown"), ("high", "medium", "low"), 240
#: Spans of a speaker that make a character of it.
LEAST_QUOTES = 10


def page_at(offsets: DataFrame, mapping: DataFrame) -> DataFrame:
    """``(book_id, offset, page)``: the page that holds an offset; past the end the last, in a gap the nearest.

    Offsets are sorted in between the pages of their book, so that each sees the page that begins before
    it and the one after it; of equal distances the first wins. ``mapping``: book_id, source_page,
    cleaned_start, cleaned_end, in order and without overlaps.
    """
    entry = F.struct("source_page", "cleaned_start", "cleaned_end")
    marks = mapping.select("book_id", F.col("cleaned_start").cast("long").alias("at"), F.lit(0).alias("asked"), entry.alias("entry"))
    asked = offsets.select("book_id", F.col("offset").cast("long").alias("at")).distinct().withColumns({"asked": F.lit(1), "entry": F.lit(None).cast(marks.schema["entry"].dataType)})
    book = Window.partitionBy("book_id")
    seen = Window.unboundedPreceding, Window.currentRow
    rows = marks.unionByName(asked).select(
        "book_id", "at", "asked", F.last("entry", True).over(book.orderBy("at", "asked").rowsBetween(*seen)).alias("a"),
        F.last("entry", True).over(book.orderBy(F.desc("at"), F.desc("asked")).rowsBetween(*seen)).alias("b"),
    ).where("asked = 1 and (a is not null or b is not null)")
    nearer = F.coalesce(F.col("b").isNull() | (F.col("at") < F.col("a.cleaned_end")) | (F.col("at") - F.col("a.cleaned_end") <= F.col("b.cleaned_start") - F.col("at")), F.lit(False))
    return rows.select("book_id", F.col("at").alias("offset"), F.when(nearer, F.col("a.source_page")).otherwise(F.col("b.source_page")).alias("page"))


def chapter_of_spans(spans: DataFrame, chapters: DataFrame) -> DataFrame:
    """Each span with the chapter that contains it, or none: an equi-join on the book with the range as its rest."""
    c = chapters.select(F.col("book_id").alias("c_book"), F.col("chapter_index").alias("found_chapter"), "start_offset", "end_offset")
    inside = (F.col("book_id") == F.col("c_book")) & (F.col("source_start") >= F.col("start_offset")) & (F.col("source_end") <= F.col("end_offset"))
    return spans.join(c, inside, "left").select("book_id", "span_id", "source_start", "source_end", "found_chapter")


def span_violations(spans: DataFrame, chapters: DataFrame, complete: bool = False) -> DataFrame:
    """``(book_id, rule, span_id)``: spans that are repeated, overlap, are out of range, cross a chapter or (``complete``) leave a gap."""
    order = Window.partitionBy("book_id").orderBy("source_start", "source_end", "span_id")
    ends = F.max("source_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    same = F.count(F.lit(1)).over(Window.partitionBy("book_id", "span_id"))
    c = chapters.select("book_id", "chapter_index", "start_offset", "end_offset")
    met = spans.join(c, ["book_id", "chapter_index"], "left")
    rules = F.array(
        F.when(same > 1, "DUPLICATE_SPAN_ID"),
        F.when(F.col("source_start") < ends, "OVERLAPPING_SPANS"),
        F.when((F.col("source_start") < 0) | (F.col("source_end") <= F.col("source_start")), "OUT_OF_RANGE"),
        F.when(F.col("start_offset").isNull() | (F.col("source_start") < F.col("start_offset")) | (F.col("source_end") > F.col("end_offset")), "CROSS_CHAPTER"),
        *([F.when(F.col("source_start") > F.coalesce(ends, F.lit(0)), "INCOMPLETE_COVERAGE")] if complete else []),
    )
    return met.withColumn("rules", rules).select("book_id", F.explode(F.array_compact("rules")).alias("rule"), "span_id")


def fill_gaps(spans: DataFrame, chapters: DataFrame) -> DataFrame:
    """Spans of each chapter with narration in every gap, so that they cover it.

    A gap's id numbers its place in the list of the chapter: ``gap-{chapter}-{place}``.
    """
    order = Window.partitionBy("book_id", "chapter_index").orderBy("source_start", "source_end", "span_id")
    c = chapters.select("book_id", "chapter_index", "start_offset", "end_offset")
    met = c.join(spans, ["book_id", "chapter_index"], "left")
    before = F.coalesce(F.lag("source_end").over(order), F.col("start_offset"))
    after = F.lead("source_start").over(order)
    edged = met.withColumns({"before": before, "is_last": after.isNull()})
    kept = edged.where("span_id is not null").select("book_id", "chapter_index", "span_id", "source_start", "source_end", "type", "speaker_id", "band")

    def gap(rows: DataFrame, start: str, end: str) -> DataFrame:
        return rows.where(f"{start} < {end}").select(
            "book_id", "chapter_index", F.lit(None).cast("string").alias("span_id"), F.col(start).alias("source_start"), F.col(end).alias("source_end"),
            F.lit("narration").alias("type"), F.lit("narrator").alias("speaker_id"), F.lit("low").alias("band"),
        )

    tail = edged.where("is_last").withColumn("tail_start", F.coalesce("source_end", "start_offset"))
    every = kept.unionByName(gap(edged.where("span_id is not null"), "before", "source_start")).unionByName(gap(tail, "tail_start", "end_offset"))
    place = F.row_number().over(Window.partitionBy("book_id", "chapter_index").orderBy("source_start", "source_end"))
    named = F.coalesce("span_id", F.format_string("gap-%d-%d", F.col("chapter_index"), place))
    return every.withColumn("span_id", named)


def speaking_counts(spans: DataFrame) -> DataFrame:
    """``(book_id, speaker_id, n_spans)`` of spans that a named speaker speaks."""
    named = ~F.lower(F.trim(F.coalesce("speaker_id", F.lit("")))).isin("", "narrator", "unknown")
    return spans.where(named & F.col("type").isin(*SPEAKING_TYPES)).groupBy("book_id", F.trim("speaker_id").alias("speaker_id")).agg(F.count(F.lit(1)).alias("n_spans"))


def review_summary(spans: DataFrame) -> DataFrame:
    """Per book: spans, spans of each band, unresolved ones and speakers, in one pass."""
    return spans.groupBy("book_id").agg(
        F.count(F.lit(1)).alias("span_count"),
        *(F.count_if(F.col("band") == b).alias(f"n_{b}") for b in BANDS),
        F.count_if(F.col("type") == "unknown").alias("unresolved_count"),
        F.count_if(F.col("speaker_id") == "narrator").alias("narrator_count"),
    )


def review_page(spans: DataFrame, band: str | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of spans in reading order, of one band if named, each with an excerpt. At most 200 rows."""
    rows = spans if band is None else spans.where(F.col("band") == band)
    page = rows.orderBy("book_id", "source_start", "span_id").offset(offset).limit(min(limit, 200))
    return page.select("book_id", "span_id", "speaker_id", "band", F.left("text", F.lit(EXCERPT)).alias("excerpt"), (F.length("text") > EXCERPT).alias("truncated"))
