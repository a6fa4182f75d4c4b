"""Audio timeline arithmetic: durations, pauses, chapter bounds, chapter metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from narrata.functions import text as T

#: Milliseconds of silence between chapters, paragraphs and other chunks.
CHAPTER_PAUSE, PARAGRAPH_PAUSE, ORDINARY_PAUSE = 750, 400, 150


def spoken_frames(text: Column, rate: int, speed: float = 1.0) -> Column:
    """Frames of the deterministic test voice: 0.32 s a word and 0.25 s more."""
    words = F.greatest(F.lit(1), F.regexp_count(text, F.lit(r"(?U)\S+")))
    return F.greatest(F.lit(1), F.floor((words * 0.32 + 0.25) * rate / speed)).cast("long")


def chunk_timeline(chunks: DataFrame, rate: int) -> DataFrame:
    """Each chunk's first frame and the pause after it. ``chunks``: book_id, chapter_index, global_index, text, frames."""
    order = Window.partitionBy("book_id").orderBy("global_index")
    following = F.lead("chapter_index").over(order)
    ms = (
        F.when(following.isNull(), 0)
        .when(following != F.col("chapter_index"), CHAPTER_PAUSE)
        .when(F.col("text").rlike(r"\n\s*\n+\s*$"), F.when(T.ends_sentence(T.strip(F.col("text"))), PARAGRAPH_PAUSE).otherwise(0))
        .otherwise(ORDINARY_PAUSE)
    )
    paused = chunks.withColumn("pause_frames", F.bround(ms * rate / 1000.0).cast("long"))
    start = F.sum(F.col("frames") + F.col("pause_frames")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("frames") - F.col("pause_frames")
    return paused.withColumn("start_frame", start.cast("long"))


def chapter_timings(timeline: DataFrame, rate: int) -> DataFrame:
    """Frames and milliseconds of each chapter; a chapter's last pause is no part of it, but its end in ms is the next one's start."""
    framed = timeline.groupBy("book_id", "chapter_index").agg(F.min("start_frame").alias("start_frame"), F.max(F.col("start_frame") + F.col("frames")).alias("end_frame"))
    start_ms, end_ms = (F.bround(F.col(c) * 1000 / F.lit(float(rate))).cast("long") for c in ("start_frame", "end_frame"))
    order = Window.partitionBy("book_id").orderBy("chapter_index")
    return framed.withColumn("start_ms", start_ms).withColumn("end_ms", F.coalesce(F.lead("start_ms").over(order), end_ms))


def chapter_metadata(timings: DataFrame, title: Column) -> DataFrame:
    """``(book_id, metadata)``: the chapters of a book as a metadata text."""
    entry = F.format_string("[CHAPTER]\nTIMEBASE=1/1000\nSTART=%d\nEND=%d\ntitle=%s", F.col("start_ms"), F.col("end_ms"), T.escape_metadata(title))
    entries = F.transform(F.array_sort(F.collect_list(F.struct("chapter_index", entry.alias("e")))), lambda x: x["e"])
    return timings.groupBy("book_id").agg(F.concat(F.lit(";FFMETADATA1\n"), F.array_join(entries, "\n"), F.lit("\n")).alias("metadata"))
