"""The tables of an input folder as books, pages, spans, chapters and status logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Lines of a page, and pages between injected chapter headings (texts of the corpus have none).
LINES_A_PAGE, PAGES_A_CHAPTER = 5, 3
#: Turns of a chapter of a conversation.
TURNS_A_CHAPTER = 4


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def books(spark: SparkSession, folder: str) -> DataFrame:
    """``(book_id, text)`` of all documents."""
    return read(spark, folder, "documents").select(F.col("doc_id").alias("book_id"), F.coalesce("text", F.lit("")).alias("text"))


def _paged(spark: SparkSession, folder: str) -> tuple[DataFrame, Column]:
    """``(book_id, lines)`` and the list of a book's pages: five lines a page; every third page begins with ``Chapter n``.

    Split inside the row, so no shuffle: a book's lines are sliced into pages by a higher-order function.
    """
    lines = F.split(F.col("text"), "\n")
    page_count = F.ceil(F.size("lines") / F.lit(LINES_A_PAGE)).cast("int")

    def page(n: Column) -> Column:
        body = F.array_join(F.slice(F.col("lines"), (n - 1) * LINES_A_PAGE + 1, F.lit(LINES_A_PAGE)), "\n")
        head = F.when((n - 1) % PAGES_A_CHAPTER == 0, F.concat(F.lit("Chapter "), (F.floor((n - 1) / PAGES_A_CHAPTER) + 1).cast("string"), F.lit("\n"))).otherwise("")
        return F.struct(n.alias("number"), F.concat(head, body).alias("text"))

    return books(spark, folder).select("book_id", lines.alias("lines")), F.transform(F.sequence(F.lit(1), page_count), page)


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """``(book_id, number, text)`` of all pages."""
    split, listed = _paged(spark, folder)
    return split.select("book_id", F.inline(listed))


def paged_books(spark: SparkSession, folder: str) -> DataFrame:
    """``(book_id, text)`` of all documents with a blank line between pages: wrapped paragraphs, some below a heading."""
    split, listed = _paged(spark, folder)
    return split.select("book_id", F.array_join(F.transform(listed, lambda p: p["text"]), "\n\n").alias("text"))


def turns(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns as spans of a book: offsets are running sums of text lengths."""
    order = Window.partitionBy("book_id").orderBy("turn")
    rows = read(spark, folder, "conversations").select(
        F.col("conv_id").alias("book_id"), "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    end = F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("source_end", end.cast("long")).select(
        "book_id", "turn", "role", "text",
        (F.row_number().over(order) - 1).cast("long").alias("ordinal"),
        (F.col("source_end") - F.length("text")).alias("source_start"), "source_end",
    ).withColumn("chapter_index", (F.floor(F.col("ordinal") / TURNS_A_CHAPTER) + 1).cast("long"))


def spans(spark: SparkSession, folder: str) -> DataFrame:
    """Machine spans: turns of a person are dialogue; a system turn is narration."""
    return turns(spark, folder).select(
        "book_id", "chapter_index", F.format_string("span-%05d", F.col("ordinal")).alias("span_id"), "source_start", "source_end",
        F.when(F.col("role") == "system", "narration").otherwise("dialogue").alias("type"),
        F.when(F.col("role") == "system", "narrator").otherwise(F.col("role")).alias("speaker_id"),
        # Bands by rule, since the corpus has no confidences.
        F.when(F.length("text") >= 200, "high").when(F.length("text") >= 60, "medium").otherwise("low").alias("band"), "text",
    )


def chapters(spark: SparkSession, folder: str) -> DataFrame:
    """Chapters of conversations: so many turns each."""
    return turns(spark, folder).groupBy("book_id", "chapter_index").agg(
        F.min("source_start").alias("start_offset"), F.max("source_end").alias("end_offset"), F.count(F.lit(1)).alias("n_turns")
    )


def status_log(spark: SparkSession, folder: str) -> DataFrame:
    """Events as a status log: one analysis a user, the value as a share done."""
    return read(spark, folder, "events").select(
        F.col("user_id").alias("analysis_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("stage"), F.col("value")
    )
