"""Registered queries over the tables of an input folder, one or more for each area of the engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrata.functions import text as T
from narrata.operators import accuracy, chapters, facts, pages, progress, spans, timeline
from narrata.sources import tables
from narrata.sources.shared import stored

#: Samples a second of the deterministic test voice.
RATE = 24_000

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def _registered(query: Query) -> Query:
    _QUERIES[query.__name__] = query
    return query


def queries() -> dict[str, Query]:
    """Every registered query by its name."""
    return dict(_QUERIES)


@_registered
def t_text_facts(spark: SparkSession, folder: str) -> DataFrame:
    return facts.text_facts(tables.books(spark, folder))


@_registered
def a02_language(spark: SparkSession, folder: str) -> DataFrame:
    return facts.language_summary(tables.books(spark, folder))


@_registered
def s02_page_split(spark: SparkSession, folder: str) -> DataFrame:
    return tables.pages(spark, folder).groupBy("book_id").agg(F.count(F.lit(1)).alias("n_pages"), F.sum(F.length("text")).alias("chars"), F.min("text").alias("least"))


@_registered
def a01_repeated_lines(spark: SparkSession, folder: str) -> DataFrame:
    return pages.repeated_lines(tables.pages(spark, folder))


@_registered
def w01_clean_pages(spark: SparkSession, folder: str) -> DataFrame:
    return pages.clean_pages(tables.pages(spark, folder)).select("book_id", "number", F.sha2("text", 256).alias("text_sha256"), "separator", "cleaned_start", "cleaned_end")


@_registered
def s09_cleaned_text(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = pages.clean_pages(tables.pages(spark, folder))
    books = pages.cleaned_books(cleaned, F.max("cleaned_end").alias("map_end"))
    return books.select("book_id", F.sha2("text", 256).alias("cleaned_sha256"), F.length("text").cast("long").alias("chars"), (F.length("text") == F.col("map_end")).alias("covered"))


@_registered
def f03_page_coverage(spark: SparkSession, folder: str) -> DataFrame:
    # Images are a rule here, since the corpus has none: pages whose number divides by seven.
    listed = tables.pages(spark, folder).withColumn("words", T.ascii_word_count(F.col("text")))
    classed = listed.withColumn("classification", T.page_class(F.col("words"), F.col("number") % 7 == 0, F.col("text").rlike(r"\p{L}")))
    return pages.coverage_violations(classed).select("book_id", "rule", F.array_join("pages", ",").alias("pages"))


def _plan(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    cleaned = stored(pages.clean_pages(tables.pages(spark, folder)))
    books = pages.cleaned_books(cleaned)
    return chapters.original_plan(chapters.heading_candidates(cleaned), books), books


@_registered
def u02_chapter_plan(spark: SparkSession, folder: str) -> DataFrame:
    plan, books = _plan(spark, folder)
    return chapters.with_words(plan, books)


@_registered
def f05_chapter_range(spark: SparkSession, folder: str) -> DataFrame:
    return chapters.chapter_range(_plan(spark, folder)[0], 2, 3)


@_registered
def r01_rename_chapters(spark: SparkSession, folder: str) -> DataFrame:
    plan, _ = _plan(spark, folder)
    titles = plan.where("index = 1").select("book_id", "index", F.concat(F.lit("Opening of "), F.col("book_id").cast("string")).alias("new_title"))
    return chapters.rename(plan, titles)


@_registered
def j02_page_at(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = stored(pages.clean_pages(tables.pages(spark, folder)))
    plan = chapters.original_plan(chapters.heading_candidates(cleaned), pages.cleaned_books(cleaned))
    mapping = cleaned.select("book_id", F.col("number").alias("source_page"), "cleaned_start", "cleaned_end")
    return spans.page_at(plan.select("book_id", (F.col("end_offset") - 1).alias("offset")).distinct(), mapping)


@_registered
def w06_fill_gaps(spark: SparkSession, folder: str) -> DataFrame:
    # Spans of low confidence are left to the narrator, so there are gaps inside and at the ends of chapters.
    kept = tables.spans(spark, folder).where("band <> 'low'")
    return spans.fill_gaps(kept, tables.chapters(spark, folder)).select("book_id", "chapter_index", "span_id", "source_start", "source_end", "type", "speaker_id")


@_registered
def j06_span_chapter(spark: SparkSession, folder: str) -> DataFrame:
    moved = tables.spans(spark, folder).withColumns({"source_start": F.col("source_start") + 3, "source_end": F.col("source_end") + 3})
    found = spans.chapter_of_spans(moved, tables.chapters(spark, folder))
    return found.withColumn("found_chapter", F.coalesce("found_chapter", F.lit(0)))


@_registered
def w04_span_violations(spark: SparkSession, folder: str) -> DataFrame:
    # Damage by rule: some spans run over their end, some have the id of another.
    odd = tables.spans(spark, folder).withColumns({
        "source_end": F.when(F.col("source_start") % 5 == 0, F.col("source_end") + 7).otherwise(F.col("source_end")),
        "span_id": F.when(F.col("source_start") % 11 == 3, "span-00000").otherwise(F.col("span_id")),
    })
    return spans.span_violations(odd, tables.chapters(spark, folder)).groupBy("book_id", "rule").agg(F.count(F.lit(1)).alias("n"))


@_registered
def w05_span_coverage(spark: SparkSession, folder: str) -> DataFrame:
    kept = tables.spans(spark, folder).where("band <> 'low'")
    return spans.span_violations(kept, tables.chapters(spark, folder), complete=True)


@_registered
def a05_speaking_counts(spark: SparkSession, folder: str) -> DataFrame:
    return spans.speaking_counts(tables.spans(spark, folder))


@_registered
def a06_characters(spark: SparkSession, folder: str) -> DataFrame:
    everywhere = spans.speaking_counts(tables.spans(spark, folder)).groupBy("speaker_id").agg(F.sum("n_spans").alias("n_spans"))
    return everywhere.where(F.col("n_spans") >= spans.LEAST_QUOTES)


@_registered
def a07_review_summary(spark: SparkSession, folder: str) -> DataFrame:
    return spans.review_summary(tables.spans(spark, folder))


@_registered
def f06_review_page(spark: SparkSession, folder: str) -> DataFrame:
    return spans.review_page(tables.spans(spark, folder), band="medium", offset=10, limit=50)


def _quotes(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Gold quotes are dialogue turns; predictions miss short ones, begin some a letter late, and err by rules of their text."""
    said = tables.spans(spark, folder).where("type = 'dialogue'")
    text, first = F.col("text"), F.substring("text", 1, 1)
    gold = said.select("book_id", "source_start", "source_end", "speaker_id", F.when(text.contains(", "), "explicit").otherwise("implicit").alias("category"))
    predicted = said.where("band <> 'low'").select(
        "book_id", (F.col("source_start") + F.when(first == "A", 1).otherwise(0)).alias("source_start"), "source_end",
        F.col("speaker_id").alias("original_speaker_id"), F.when(F.col("band") == "medium", "narrator").otherwise(F.col("speaker_id")).alias("effective_speaker_id"),
        F.when(first < "E", "exception").when(first < "J", "unresolved").when(first < "P", "manual_correction").otherwise("auto_approved").alias("decision_state"),
    )
    return gold, predicted, said.select("book_id", F.lit("narrator").alias("narrator_id")).distinct()


@_registered
def a10_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    found = accuracy.scores(accuracy.match_quotes(*_quotes(spark, folder)))
    return found.withColumn("book_id", F.coalesce("book_id", F.lit(-1)))


@_registered
def a09_category_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    return accuracy.category_scores(accuracy.match_quotes(*_quotes(spark, folder)))


def _timeline(spark: SparkSession, folder: str) -> DataFrame:
    chunks = tables.turns(spark, folder).select("book_id", "chapter_index", F.col("ordinal").alias("global_index"), F.concat("text", F.when(F.col("ordinal") % 3 == 0, "\n\n").otherwise("")).alias("text"))
    return timeline.chunk_timeline(chunks.withColumn("frames", timeline.spoken_frames(F.col("text"), RATE)), RATE)


@_registered
def w07_timeline(spark: SparkSession, folder: str) -> DataFrame:
    return _timeline(spark, folder).select("book_id", "global_index", "frames", "pause_frames", "start_frame")


@_registered
def w09_chapter_timings(spark: SparkSession, folder: str) -> DataFrame:
    return timeline.chapter_timings(_timeline(spark, folder), RATE)


@_registered
def k13_chapter_metadata(spark: SparkSession, folder: str) -> DataFrame:
    title = F.concat(F.lit("Part; #"), F.col("chapter_index").cast("string"), F.lit(" = a\\b"))
    return timeline.chapter_metadata(timeline.chapter_timings(_timeline(spark, folder), RATE), title)


@_registered
def w14_progress(spark: SparkSession, folder: str) -> DataFrame:
    return progress.regressions(tables.status_log(spark, folder))


@_registered
def w15_stage_changes(spark: SparkSession, folder: str) -> DataFrame:
    return progress.changes(tables.status_log(spark, folder))


@_registered
def o03_latest_status(spark: SparkSession, folder: str) -> DataFrame:
    return progress.latest(tables.status_log(spark, folder))


@_registered
def t23_slugs(spark: SparkSession, folder: str) -> DataFrame:
    first = F.element_at(F.split("text", "\n"), 1)
    return tables.books(spark, folder).select("book_id", T.slug(first, "character").alias("slug"), T.safe_file_name(first).alias("file_name"), T.source_type(first).alias("source_type"))
