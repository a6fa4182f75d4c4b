"""Chapter plans: candidates, family choice, boundaries, ranges."""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from narrata.functions import text as T
from narrata.functions.scans import scanned
from narrata.operators import boundaries, spans


def heading_candidates(cleaned: DataFrame) -> DataFrame:
    """``(book_id, offset, title, source_type)``: heading lines of cleaned pages at their offsets in the book.

    A line's offset in its page is the length of the lines before it, all in the row.
    """
    lines = F.split(F.expr("left(text, cleaned_end - cleaned_start)"), "\n")
    headed = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: T.is_heading(T.strip(F.get("lines", i))))
    at = F.transform(
        headed,
        lambda i: F.struct(
            F.get(F.col("lines"), i).alias("title"),
            (F.aggregate(F.slice(F.col("lines"), F.lit(1), i), F.lit(0), lambda s, x: s + F.length(x) + 1)).alias("before"),
        ),
    )
    rows = cleaned.select("book_id", "cleaned_start", lines.alias("lines")).select("book_id", "cleaned_start", F.inline(at))
    return rows.select("book_id", (F.col("cleaned_start") + F.col("before")).alias("offset"), T.strip(F.col("title")).alias("title"), F.lit("heading").alias("source_type"))


def original_plan(candidates: DataFrame, books: DataFrame, whole_title: str = "Whole Book") -> DataFrame:
    """Chapters of the best family of candidates; a book without one is one whole chapter.

    Of candidates at one offset the least (type, title) counts; text before the first belongs to it.
    """
    ranked = candidates.withColumn("family", T.source_family(F.col("source_type")))
    best = ranked.withColumn("best", F.min("family").over(Window.partitionBy("book_id"))).where("family = best and title <> ''")
    chosen = best.groupBy("book_id", "offset").agg(F.min(F.struct("source_type", "title")).alias("c"))
    whole = books.select("book_id", F.length("text").cast("long").alias("n")).where("n > 0")
    met = whole.join(chosen.select("book_id", "offset", "c.title", "c.source_type"), "book_id", "left").where("offset is null or offset < n")
    order = Window.partitionBy("book_id").orderBy("offset")
    return met.select(
        "book_id", F.row_number().over(order).alias("index"), F.coalesce("title", F.lit(whole_title)).alias("title"),
        F.when(F.row_number().over(order) == 1, 0).otherwise(F.col("offset")).cast("long").alias("start_offset"),
        F.coalesce(F.lead("offset").over(order), F.col("n")).cast("long").alias("end_offset"), F.coalesce("source_type", F.lit("whole")).alias("source_type"),
    )


def with_words(plan: DataFrame, books: DataFrame) -> DataFrame:
    """The plan with each chapter's words."""
    text = F.expr("substring(text, start_offset + 1, end_offset - start_offset)")
    return plan.join(books, "book_id").select(*plan.columns, T.latin_word_count(text).alias("word_count"))


def plan_artifacts(plan: DataFrame, books: DataFrame, mapping: DataFrame, mode: str = "original", requested_count: int | None = None) -> DataFrame:
    """Plans as artifacts, a row a book: version, mode, digest of the text, and the chapters with their pages and words as an array.

    ``mapping``: book_id, source_page, cleaned_start, cleaned_end. Chapters are numbers and titles by then; texts meet them once.
    """
    worded = with_words(plan, books)
    edges = worded.select("book_id", "index", F.explode(F.array("start_offset", F.greatest("start_offset", F.col("end_offset") - 1))).alias("offset"))
    paged = edges.join(spans.page_at(edges, mapping), ["book_id", "offset"]).groupBy("book_id", "index").agg(F.min_by("page", "offset").alias("start_page"), F.max_by("page", "offset").alias("end_page"))
    chapter = F.struct("index", "title", "start_offset", "end_offset", "start_page", "end_page", "source_type", "word_count")
    listed = worded.join(paged, ["book_id", "index"]).groupBy("book_id").agg(F.array_sort(F.collect_list(chapter)).alias("chapters"))
    return books.select("book_id", F.sha2("text", 256).alias("cleaned_text_sha256")).join(listed, "book_id").select(
        "book_id", F.lit(1).alias("schema_version"), F.lit(mode).alias("mode"), F.lit(requested_count).cast("int").alias("requested_count"), "cleaned_text_sha256",
        F.array().cast("array<string>").alias("warnings"), "chapters",
    )


def chapter_range(plan: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Chapters ``first`` to ``last`` (from 1, both included; null: to the edge), numbered from 1 again."""
    low = 1 if first is None else first
    kept = plan.where(F.col("index") >= low) if last is None else plan.where(F.col("index").between(low, last))
    return kept.withColumn("index", F.col("index") - (low - 1))


def rename(plan: DataFrame, titles: DataFrame) -> DataFrame:
    """The plan with new titles (book_id, index, new_title) where there are some, of 200 characters at most."""
    met = plan.join(titles, ["book_id", "index"], "left")
    return met.select(*(F.left(F.coalesce("new_title", "title"), F.lit(200)).alias("title") if c == "title" else F.col(c) for c in plan.columns))


#: Bounds of a custom chapter count, and words below which chapters are short.
LEAST_COUNT, MOST_COUNT, SHORT_WORDS = 2, 50, 250


def custom_boundaries(text: str, count: int, supplied: dict[int, str] | None = None) -> list[tuple[int, str | None, str]] | None:
    """Starts of ``count`` chapters of about equal words, each at a heading, paragraph or sentence; None if there are too few.

    The k-th start aims at k of ``count`` equal parts. Of the places that leave enough for the starts
    after it, those within a window round the aim are preferred, headings among them first; then rank,
    distance and offset decide. ``supplied``: titles by offset that rank as headings.
    """
    ranked: dict[int, tuple[int, str | None, str]] = {o: (2, None, "custom") for o in boundaries.sentence_starts(text)}
    ranked |= {o: (1, None, "custom") for o in boundaries.paragraph_starts(text)}
    headings = dict(boundaries.heading_starts(text))
    ranked |= {o: (0, t, "heading") for o, t in headings.items()}
    ranked |= {o: (0, t, "candidate") for o, t in (supplied or {}).items()}
    places = sorted(o for o in ranked if 0 < o < len(text))
    if len(places) < count - 1:
        return None
    words = boundaries.word_starts(text)
    at = [bisect_left(words, o) for o in places]
    window = max(10.0, min(len(words) / count / 2, 40.0))
    starts, low = [], 0
    for k in range(1, count):
        high = len(places) - (count - 1 - k)  # the starts after this one need a place each
        away = [(ranked[places[i]][0], abs(at[i] - len(words) * k / count), places[i], i) for i in range(low, high)]
        near = [x for x in away if x[1] <= window]
        _, _, place, i = min([x for x in near if x[0] == 0] or near or away)
        starts.append(place)
        low = i + 1
    first = (0, (supplied or {}).get(0) or headings.get(0), "heading" if 0 in headings else "custom")
    return [first, *((o, ranked[o][1], ranked[o][2]) for o in starts)]


def custom_plan(books: DataFrame, count: int) -> DataFrame:
    """Plans of ``count`` chapters; a book that can't be cut so often has no rows."""
    if not LEAST_COUNT <= count <= MOST_COUNT:
        raise ValueError("INVALID_COUNT")

    def planned(text: str) -> list[dict] | None:
        found = custom_boundaries(text, count)
        return found and [{"offset": o, "title": t, "source_type": s} for o, t, s in found]

    starts = scanned(planned, "array<struct<offset:long,title:string,source_type:string>>", "text")
    order = Window.partitionBy("book_id").orderBy("start_offset")
    # Inside the generator, which leaves nulls out: a filter of it would be pushed below and scan all texts a second time.
    flat = books.where("text <> ''").select("book_id", F.length("text").cast("long").alias("n"), F.posexplode(starts).alias("pos", "s"))
    flat = flat.select("book_id", "n", (F.col("pos") + 1).alias("index"), F.col("s.offset").alias("start_offset"), "s.title", "s.source_type")
    return flat.select(
        "book_id", "index", F.coalesce("title", F.format_string("Chapter %02d", F.col("index"))).alias("title"), "start_offset",
        F.coalesce(F.lead("start_offset").over(order), F.col("n")).alias("end_offset"), "source_type",
    )


def short_chapters(planned: DataFrame) -> DataFrame:
    """``(book_id, words_a_chapter, recommended)``: plans whose chapters are short, with the count that wouldn't be (1: whole book)."""
    facts = planned.groupBy("book_id").agg(F.count(F.lit(1)).alias("chapters"), F.sum("word_count").alias("words"))
    short = facts.where(F.col("words") / F.col("chapters") < SHORT_WORDS)
    fit = F.floor(F.col("words") / SHORT_WORDS)
    return short.select("book_id", (F.col("words") / F.col("chapters")).alias("words_a_chapter"), F.when(fit >= LEAST_COUNT, fit).otherwise(1).alias("recommended"))
