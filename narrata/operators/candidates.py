"""Titles of chapters to offsets in the text: a ladder of tries, the first that holds counts.

1. ``direct``: the candidate's own offset, if its title stands there and a cut is safe;
2. ``outline``: an outline's title stands for the beginning of its page;
3. ``search``: the first place of the title in its page;
4. ``line``: the first line of its page that has the title but for white space and case.

Tries are rows; whether one may be cut at is a join with the boundaries of the book.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrata.functions import text as T
from narrata.functions.scans import scanned
from narrata.operators import safety

#: White space of any script, as ``str.isspace`` has it.
_SPACES = re.compile(r"\s+")
STEPS = ("direct", "outline", "search", "line")


def folded(text: Column | str) -> Column:
    """Full case folding, which built-in functions lack."""
    return scanned(lambda t: t if t is None else t.casefold(), "string", text)


def page_segments(mapping: DataFrame) -> DataFrame:
    """``(book_id, source_page, segment_start, segment_end)``: from the first to the last offset of each page."""
    return mapping.groupBy("book_id", "source_page").agg(F.min("cleaned_start").cast("long").alias("segment_start"), F.max("cleaned_end").cast("long").alias("segment_end"))


def _page_read(page: str | None, there: list[str | None]) -> dict:
    """Folded texts of a page's candidates, and its lines: each folded with blanks for white space, and where it begins behind its indent."""
    lines, before = [], 0
    for nth, line in enumerate([] if page is None else page.split("\n")):
        if line:
            lines.append({"nth": nth, "held": _SPACES.sub(" ", line.strip(T.WHITE_SPACE).casefold()), "at": before + len(line) - len(line.lstrip())})
        before += len(line) + 1
    return {"there": [x if x is None else x.casefold() for x in there], "lines": lines}


def _sliced(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, (start + 1).cast("int"), (end - start).cast("int"))


def resolved(candidates: DataFrame, books: DataFrame, mapping: DataFrame) -> DataFrame:
    """``(book_id, candidate_id, offset, step)`` for every candidate; null where no try holds.

    ``candidates``: book_id, candidate_id, title, source, source_page, cleaned_offset. A null or blank
    title is resolved by nothing; a candidate without a page, or of a page that the book lacks, by its
    own offset alone. Texts are joined once, to the list of their candidates by page; a page is cut and read
    once for all its candidates, and all tries of a candidate are made in its row.
    """
    named = candidates.withColumns({"title": T.strip(F.col("title")), "source_type": T.source_type(F.col("source")), "cleaned_offset": F.col("cleaned_offset").cast("long")}).where("title <> ''")
    titled = named.select("book_id", "candidate_id", "source_page", "source_type", "cleaned_offset", F.length("title").alias("n_title"), folded("title").alias("folded_title"))
    placed = titled.join(page_segments(mapping), ["book_id", "source_page"], "left")
    asked = placed.groupBy("book_id", "source_page", "segment_start", "segment_end").agg(F.collect_list(F.struct("candidate_id", "folded_title", "n_title", "source_type", "cleaned_offset")).alias("asked"))
    listed = asked.groupBy("book_id").agg(F.collect_list(F.struct("source_page", "segment_start", "segment_end", "asked")).alias("listed"))
    met = books.select("book_id", "text").join(listed, "book_id").withColumn("folded_text", folded("text"))
    text, whole, c = F.col("text"), F.col("folded_text"), F.col

    def pieces(p: Column) -> Column:
        # A page of the folded text is cut at the offsets of the text itself, as its searches are.
        there = F.transform(p["asked"], lambda x: _sliced(text, x["cleaned_offset"], x["cleaned_offset"] + x["n_title"]))
        return p.withField("there", there).withField("page", _sliced(text, p["segment_start"], p["segment_end"])).withField("folded_page", _sliced(whole, p["segment_start"], p["segment_end"]))

    paged = met.select("book_id", F.length("text").alias("n"), F.explode(F.transform("listed", pieces)).alias("p")).select("book_id", "n", "p.*")
    read = paged.withColumn("read", scanned(_page_read, "struct<there:array<string>,lines:array<struct<nth:int,held:string,at:int>>>", "page", "there"))
    rows = read.select("book_id", "n", "source_page", "segment_start", "folded_page", "read", F.posexplode("asked").alias("place", "c")).select("*", "c.*")
    found = F.position(c("folded_title"), c("folded_page"))

    def tried(step: str, holds: Column, offset: Column, nth: Column = F.lit(0)) -> Column:
        return F.when(holds, F.struct(F.lit(STEPS.index(step)).alias("step_no"), F.lit(step).alias("step"), nth.alias("nth"), offset.cast("long").alias("offset")))

    compact = F.regexp_replace("folded_title", r"(?U)[\s\x1c-\x1f]+", " ")
    inside = c("source_page") >= 1
    single = F.array(
        tried("direct", (c("cleaned_offset") >= 0) & (c("cleaned_offset") < c("n")) & (F.get("read.there", c("place")) == c("folded_title")), c("cleaned_offset")),
        tried("outline", (c("source_type") == "outline") & c("segment_start").isNotNull() & inside, c("segment_start")),
        tried("search", inside & (found > 0), c("segment_start") + found - 1),
    )
    lines = F.transform(F.when(inside, c("read.lines")), lambda x: tried("line", F.contains(x["held"], c("compact")), c("segment_start") + x["at"], x["nth"]))
    tries = F.array_compact(F.concat(single, F.coalesce(lines, F.array().cast("array<struct<step_no:int,step:string,nth:int,offset:bigint>>"))))
    every = rows.withColumn("compact", compact).select("book_id", "candidate_id", F.inline(tries))
    judged = safety.with_safety(every, safety.boundary_offsets(books, mapping), F.lit(True)).where("is_safe or step = 'outline'")
    best = judged.groupBy("book_id", "candidate_id").agg(F.min(F.struct("step_no", "nth", "offset", "step")).alias("best"))
    return candidates.select("book_id", "candidate_id").join(best, ["book_id", "candidate_id"], "left").select("book_id", "candidate_id", "best.offset", "best.step")
