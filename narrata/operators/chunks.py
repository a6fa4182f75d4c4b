"""Packing of chapters into speakable chunks, and hashes that decide what can be reused.

A chapter is packed in one scan of its own text, inside its row, so chapters are never brought together.
"""

from __future__ import annotations

import json
import math
from bisect import bisect_right
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from narrata.functions import canonical
from narrata.functions.scans import scanned
from narrata.operators import boundaries as B


def _sentence_taken(text: str, cap: int) -> list[int]:
    """Chunk ends: the last paragraph end within the cap, else the last sentence end, else the next one."""
    ends = B.chunk_sentence_ends(text)
    marks = sorted(set(B.paragraph_ends(text)).intersection(ends))
    taken, cursor = [], 0
    while cursor < len(text):
        target = min(len(text), cursor + cap)
        i, m = bisect_right(ends, target), bisect_right(marks, target)
        if m and marks[m - 1] > cursor:
            cursor = marks[m - 1]
        elif i and ends[i - 1] > cursor:
            cursor = ends[i - 1]
        else:
            cursor = ends[i] if i < len(ends) else len(text)
        taken.append(cursor)
    return taken


def _taken_column(take: Callable[[str], list[int]]) -> Column:
    return scanned(take, "array<int>", "text")


def _chunk_rows(packed: DataFrame) -> DataFrame:
    """Rows of chunks from ``taken`` ends, numbered in the book and in the chapter."""
    begin = F.when(F.col("local_index") == 0, 0).otherwise(F.get("taken", F.col("local_index") - 1))
    rows = packed.select("*", F.posexplode("taken").alias("local_index", "end")).withColumn("begin", begin)
    order = Window.partitionBy("book_id").orderBy("chapter_index", "local_index")
    return rows.select(
        "book_id", "chapter_index", (F.row_number().over(order) - 1).alias("global_index"), "local_index",
        (F.col("start_offset") + F.col("begin")).alias("source_start"), (F.col("start_offset") + F.col("end")).alias("source_end"),
        F.expr("substring(text, begin + 1, end - begin)").alias("text"),
    )


def sentence_chunks(chapters: DataFrame, cap: int) -> DataFrame:
    """Chunks of at most ``cap`` characters where sentences allow it. ``chapters``: book_id, chapter_index, start_offset, text."""
    return _chunk_rows(chapters.where("text <> ''").withColumn("taken", _taken_column(lambda t: _sentence_taken(t, cap))))


def _paragraph_taken(text: str, cuts: list[int], cap: int) -> list[int]:
    """Chunk ends: a chunk takes in paragraph after paragraph while it stays within the cap.

    What comes after the last letter or digit is never a chunk of its own: the first cut after it, if
    it is within the cap, stands for the end of the text. Spoken text after the last cut is a chunk.
    """
    spoken = len(text) - next((n for n, c in enumerate(reversed(text)) if c.isalnum()), len(text) + 1)
    inner = [c for c in cuts if c < spoken]
    close = next((c for c in cuts if c >= spoken), math.inf)
    taken, begin, last = [], 0, 0
    for cut in (*inner, close):
        if cut - begin > cap and last > begin:
            taken.append(last)
            begin = last
        last = cut
    return [*taken, len(text)]


def paragraph_chunks(chapters: DataFrame, cap: int) -> DataFrame:
    """Chunks of whole paragraphs; a cut is only where a pause is heard, and unspoken rests join the last chunk."""

    return _chunk_rows(chapters.where("text <> ''").withColumn("taken", _taken_column(lambda t: _paragraph_taken(t, B.spoken_cuts(t), cap))))


def chapter_chunks(chapters: DataFrame) -> DataFrame:
    """One chunk a chapter."""
    return _chunk_rows(chapters.where("text <> ''").withColumn("taken", F.array(F.length("text"))))


def canonical_json(value: object) -> str:
    """Sorted keys, no blanks, non-ASCII as it is; numbers that aren't finite are refused."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def with_input_hash(chunks: DataFrame, metadata: dict, column: str = "input_hash", implementation: str | None = None) -> DataFrame:
    """Chunks with the digest of their text and the settings it is spoken with; ``implementation``: of an engine whose own changes count."""
    fixed = f'{{"metadata":{canonical_json(metadata)},' + (f'"synthesis_implementation":{canonical_json(implementation)},' if implementation is not None else "")
    text = F.coalesce(canonical.quoted(F.col("text")), F.lit("null"))
    return chunks.withColumn(column, F.sha2(F.concat(F.lit(fixed + '"text":'), text, F.lit("}")), 256))


def reuse(plan: DataFrame, completed: DataFrame) -> DataFrame:
    """The plan with ``reused``: whether a completed chunk has the same place and input hash."""
    c = completed.select("book_id", "global_index", F.col("chapter_index").alias("c_chapter"), F.col("local_index").alias("c_local"), F.col("input_hash").alias("c_hash"))
    same = (F.col("chapter_index") == F.col("c_chapter")) & (F.col("local_index") == F.col("c_local")) & (F.col("input_hash") == F.col("c_hash"))
    return plan.join(c, ["book_id", "global_index"], "left").select(*plan.columns, F.coalesce(same, F.lit(False)).alias("reused"))


def chapter_completion(reused: DataFrame) -> DataFrame:
    """Per book: chapters, complete ones, and the first chapter that isn't (else the last)."""
    chapters = reused.groupBy("book_id", "chapter_index").agg(F.bool_and("reused").alias("complete"))
    first_open = F.min(F.when(~F.col("complete"), F.col("chapter_index")))
    return chapters.groupBy("book_id").agg(
        F.count(F.lit(1)).alias("chapters"), F.count_if("complete").alias("complete_chapters"), F.coalesce(first_open, F.max("chapter_index")).alias("current_chapter")
    )


def interactive_chunks(spans: DataFrame, cast: DataFrame, cap: int, revision: int, settings: dict[str, str]) -> DataFrame:
    """Chunks of an approved plan: none crosses a span, each has the voice of its span's speaker, and two digests.

    ``spans``: book_id, chapter_index, span_id, source_start, type, speaker_id, text; ``cast``: book_id,
    cast_id, voice_id. Unknown spans are narration. ``input_hash`` covers the plan's revision,
    ``audio_input_hash`` doesn't: audio stays good where only the plan around it has changed. Both are
    digests of JSON objects with keys in order.
    """
    packed = spans.where("text <> ''").withColumn("taken", _taken_column(lambda t: _sentence_taken(t, cap)))
    rows = packed.select("*", F.posexplode("taken").alias("nth", "end"))
    rows = rows.withColumn("begin", F.when(F.col("nth") == 0, 0).otherwise(F.get("taken", F.col("nth") - 1)))
    book = Window.partitionBy("book_id").orderBy("chapter_index", "source_start")
    chapter = Window.partitionBy("book_id", "chapter_index").orderBy("source_start")
    told = F.when(F.col("type") == "unknown", "narration").otherwise(F.col("type"))
    pieces = rows.select(
        "book_id", "chapter_index", "span_id", told.alias("segment_type"), "speaker_id", F.expr("substring(text, begin + 1, end - begin)").alias("text"),
        (F.col("source_start") + F.col("begin")).alias("source_start"), (F.col("source_start") + F.col("end")).alias("source_end"),
    )
    voiced = pieces.join(cast.select("book_id", F.col("cast_id").alias("speaker_id"), "voice_id"), ["book_id", "speaker_id"])
    fixed = {k: F.lit(v) for k, v in settings.items()}

    def digest(**more: Column) -> Column:
        fields = fixed | {"text": F.col("text"), "voice_id": F.col("voice_id"), "segment_type": F.col("segment_type")} | more
        return F.sha2(F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields)))), 256)

    return voiced.select(
        "book_id", "chapter_index", (F.row_number().over(book) - 1).alias("global_index"), (F.row_number().over(chapter) - 1).alias("local_index"),
        "source_start", "source_end", "span_id", "speaker_id", "voice_id", "segment_type", "text",
        digest(revision=F.lit(revision), span_id=F.col("span_id")).alias("input_hash"), digest().alias("audio_input_hash"),
    )


def plan_matches(recorded: DataFrame, planned: DataFrame) -> DataFrame:
    """``(book_id, matches)``: whether a book's recorded chunks are the planned ones, one by one."""
    columns = ["chapter_index", "local_index", "input_hash"]
    r = recorded.select("book_id", "global_index", F.struct(*columns).alias("r"))
    p = planned.select("book_id", "global_index", F.struct(*columns).alias("p"))
    return r.join(p, ["book_id", "global_index"], "full").groupBy("book_id").agg(F.bool_and(F.col("r").eqNullSafe(F.col("p"))).alias("matches"))
