"""Rules of page mappings and chapter plans: every broken one is a row with the JSON path of what breaks it.

A plan is an artifact: one row with its chapters as an array. Chapters are taken apart once; what their
text has to say is computed where text and chapters meet, so that only numbers go on from there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from narrata.functions import text as T
from narrata.operators import safety, spans
from narrata.operators.chapters import LEAST_COUNT, MOST_COUNT
from narrata.operators.rules import SHA256

#: The version of plans, and how they can be made.
PLAN_VERSION, MODES = 1, ("original", "custom", "whole")
CHAPTER = "struct<index:int,title:string,start_offset:long,end_offset:long,start_page:int,end_page:int,source_type:string,word_count:int>"

Check = tuple[str, str, Column, Column]


def broken(rows: DataFrame, keys: Sequence[str], checks: Sequence[Check]) -> DataFrame:
    """``(keys, code, rule, path)``: a row for each check ``(code, rule, path, holds)`` that a row fails; a null condition fails."""
    found = F.array(*(F.when(~F.coalesce(holds, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(rule).alias("rule"), path.alias("path"))) for code, rule, path, holds in checks))
    return rows.select(*keys, F.inline(F.array_compact(found)))


def _at(base: str, place: Column, field: str = "") -> Column:
    return F.concat(F.lit(f"$.{base}["), place.cast("string"), F.lit("]" + (f".{field}" if field else "")))


def mapping_violations(mapping: DataFrame, books: DataFrame) -> DataFrame:
    """``(book_id, code, rule, path)`` of cleaned maps: book_id, position (from 0), source_page, cleaned_start, cleaned_end.

    Ranges are positive, inside the text, in order and without overlaps, and reach from its beginning to
    its end; a book without text or without a map breaks a rule too.
    """
    order = Window.partitionBy("book_id").orderBy("position")
    sized = mapping.join(books.select("book_id", F.length("text").cast("long").alias("n")), "book_id")
    seen = sized.withColumns({
        "before_start": F.coalesce(F.lag("cleaned_start").over(order), F.lit(-1)), "before_end": F.coalesce(F.lag("cleaned_end").over(order), F.lit(0)),
        "is_first": F.row_number().over(order) == 1, "is_last": F.lead("position").over(order).isNull(),
    })
    path, c = _at("cleaned_map", F.col("position")), F.col
    ranges = broken(seen, ["book_id"], [
        ("INVALID_MAPPING", "range", path, (c("source_page") >= 1) & (c("cleaned_start") >= 0) & (c("cleaned_end") > c("cleaned_start")) & (c("cleaned_end") <= c("n"))),
        ("INVALID_MAPPING", "order", path, (c("cleaned_start") >= c("before_start")) & (c("cleaned_start") >= c("before_end"))),
        ("INVALID_MAPPING", "coverage", path, (~c("is_first") | (c("cleaned_start") == 0)) & (~c("is_last") | (c("cleaned_end") == c("n")))),
    ])
    mapped = mapping.select("book_id").distinct().withColumn("mapped", F.lit(True))
    whole = broken(books.join(mapped, "book_id", "left"), ["book_id"], [
        ("INVALID_TEXT", "text", F.lit("$.cleaned_text"), F.length("text") > 0),
        ("INVALID_MAPPING", "empty", F.lit("$.cleaned_map"), c("mapped")),
    ])
    return ranges.unionByName(whole)


def _header(plan: DataFrame) -> DataFrame:
    """Rules that a plan's own fields decide."""
    c, n = F.col, F.coalesce(F.size("chapters"), F.lit(0))
    counted = F.when(c("mode") == "custom", c("requested_count").between(LEAST_COUNT, MOST_COUNT) & (n == c("requested_count"))).otherwise(c("requested_count").isNull() & ((c("mode") != "whole") | (n == 1)))
    return broken(plan, ["book_id"], [
        ("INVALID_PLAN", "schema_version", F.lit("$.schema_version"), c("schema_version") == PLAN_VERSION),
        ("INVALID_PLAN", "mode", F.lit("$.mode"), c("mode").isin(*MODES)),
        ("INVALID_PLAN", "hash_form", F.lit("$.cleaned_text_sha256"), c("cleaned_text_sha256").rlike(SHA256)),
        ("INVALID_PLAN", "warnings", F.lit("$.warnings"), ~F.exists("warnings", lambda w: w.isNull())),
        ("INVALID_PLAN", "chapters", F.lit("$.chapters"), n > 0),
        ("INVALID_PLAN", "requested_count", F.lit("$.requested_count"), counted | (n == 0)),
    ])


def _chapters(plan: DataFrame, *more: str) -> DataFrame:
    """Chapters with their place in the list and the end of the one before."""
    before = F.when(F.col("position") == 0, F.lit(0)).otherwise(F.get(F.col("chapters"), F.col("position") - 1)["end_offset"])
    rows = plan.select("book_id", "chapters", *more, F.posexplode("chapters").alias("position", "c"))
    return rows.select("book_id", "position", "c.*", before.cast("long").alias("expected_start"), *more)


def _shape_checks(c_path: str = "chapters") -> list[Check]:
    c = F.col
    at = lambda field: _at(c_path, c("position"), field)
    return [
        ("INVALID_PLAN", "index", at("index"), c("index") == c("position") + 1),
        ("INVALID_PLAN", "title", at("title"), (T.strip(c("title")) != "") & ~c("title").rlike(r"[\x00-\x1f]")),
        ("INVALID_PLAN", "source_type", at("source_type"), c("source_type") != ""),
        ("INVALID_PLAN", "contiguous", at("start_offset"), (c("start_offset") == c("expected_start")) & (c("end_offset") > c("start_offset"))),
        ("INVALID_PLAN", "page_order", at("start_page"), (c("start_page") >= 1) & (c("end_page") >= c("start_page"))),
        ("INVALID_PLAN", "word_count", at("word_count"), c("word_count") >= 0),
    ]


def shape_violations(plans: DataFrame) -> DataFrame:
    """``(book_id, code, rule, path)``: rules that need nothing but the plan.

    ``plans``: book_id, schema_version, mode, requested_count, cleaned_text_sha256, warnings, chapters.
    """
    return _header(plans).unionByName(broken(_chapters(plans), ["book_id"], _shape_checks()))


def plan_violations(plans: DataFrame, books: DataFrame, mapping: DataFrame) -> DataFrame:
    """The same with what text and pages say: the text's digest, coverage, words and pages of chapters, and no sentence split.

    A chapter whose title comes from the document may begin at any line; others only where no sentence
    is split. Rules are judged each on its own, so one fault can break several.
    """
    c = F.col

    def told(x: Column) -> Column:
        inside = F.substring(c("text"), (x["start_offset"] + 1).cast("int"), (x["end_offset"] - x["start_offset"]).cast("int"))
        return x.withField("words", T.latin_word_count(inside))

    met = plans.join(books.select("book_id", "text"), "book_id", "left").withColumn("text", F.coalesce("text", F.lit("")))
    # Nothing after these has the text. Words are counted for the rows alone, and edges need no text.
    facts = met.select(*(plans[x] for x in plans.columns), F.length("text").cast("long").alias("n"), F.sha2("text", 256).alias("text_sha256"))
    header = broken(facts, ["book_id"], [
        ("HASH_MISMATCH", "hash", F.lit("$.cleaned_text_sha256"), c("cleaned_text_sha256") == c("text_sha256")),
        ("INVALID_PLAN", "coverage", F.lit("$.chapters"), (F.coalesce(F.size("chapters"), F.lit(0)) == 0) | (F.element_at("chapters", -1)["end_offset"] == c("n"))),
    ])
    rows = _chapters(met.select(plans["book_id"], F.length("text").cast("long").alias("n"), F.transform("chapters", told).alias("chapters")), "n")
    edges = _chapters(plans).select("book_id", "position", F.inline(F.array(
        F.struct(F.lit("a").alias("edge"), c("start_offset").alias("offset")), F.struct(F.lit("b").alias("edge"), F.greatest(c("start_offset"), c("end_offset") - 1).alias("offset")),
    )))
    paged = edges.join(spans.page_at(edges, mapping), ["book_id", "offset"]).groupBy("book_id", "position").agg(
        F.max(F.when(c("edge") == "a", c("page"))).alias("page_a"), F.max(F.when(c("edge") == "b", c("page"))).alias("page_b")
    )
    judged = safety.with_safety(rows.withColumn("offset", c("start_offset")), safety.boundary_offsets(books, mapping), c("source_type").isin(*safety.TRUSTED))
    checks = [
        ("INVALID_PLAN", "range", _at("chapters", c("position"), "end_offset"), c("end_offset") <= c("n")),
        ("INVALID_PLAN", "pages", _at("chapters", c("position"), "start_page"), (c("start_page") == c("page_a")) & (c("end_page") == c("page_b"))),
        ("INVALID_PLAN", "words", _at("chapters", c("position"), "word_count"), c("word_count") == c("words")),
        ("UNSAFE_BOUNDARY", "boundary", _at("chapters", c("position"), "start_offset"), c("is_safe")),
    ]
    inner = broken(judged.join(paged, ["book_id", "position"], "left"), ["book_id"], checks)
    return shape_violations(plans).unionByName(header).unionByName(inner)


def first_violations(violations: DataFrame) -> DataFrame:
    """How many rules of each code a book breaks, and the first path of each."""
    return violations.groupBy("book_id", "code", "rule").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path"))
