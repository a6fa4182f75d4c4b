"""Page cleaning with provenance: repeated lines, separators, offsets, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from narrata.functions import text as T

#: Fixed value: characters that end a line.
LINE_BREAK = "[\n\r\\x0B\\x0C\\x1C\\x1D\\x1E\\x85  ]"


def _lines(text: Column) -> Column:
    """The lines of a text; a carriage return with its line feed ends one."""
    return F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), LINE_BREAK)


def _full_lines(text: Column) -> Column:
    return F.filter(_lines(text), lambda x: T.strip(x) != "")


def _repeated_lists(pages: DataFrame) -> DataFrame:
    """``(book_id, repeated)``: each book's repeated lines with their counts, in one pass over the pages.

    A null line counts the pages that have text, so that lines and pages are counted together.
    """
    lined = pages.where("book_id is not null").select("book_id", _full_lines(F.col("text")).alias("lines"))
    edges = lined.select("book_id", F.get("lines", F.lit(0)).alias("first"), F.get("lines", F.size("lines") - 1).alias("last"))
    nothing = F.lit(None).cast("string")
    votes = edges.select("book_id", F.explode(F.when(F.col("first").isNotNull(), F.array_distinct(F.array("first", "last", nothing)))).alias("line"))
    counted = votes.groupBy("book_id", "line").agg(F.count(F.lit(1)).alias("n_pages"))
    often = (F.col("n_pages") >= 2) & (F.length("line") > 2)
    listed = counted.groupBy("book_id").agg(F.collect_list(F.when(often, F.struct("line", "n_pages"))).alias("listed"), F.max(F.when(F.col("line").isNull(), F.col("n_pages"))).alias("considered"))
    return listed.select("book_id", F.filter("listed", lambda x: x["n_pages"] >= F.greatest(F.lit(2), F.ceil(F.col("considered") * 0.6))).alias("repeated"))


def repeated_lines(pages: DataFrame) -> DataFrame:
    """``(book_id, line, n_pages)``: first or last lines of at least 60 % of a book's pages with text, two at least.

    A page votes once for a line that is both its first and its last.
    """
    return _repeated_lists(pages).select("book_id", F.inline("repeated"))


def clean_page_text(text: Column, repeated: Column) -> Column:
    """A page without repeated lines and page numbers, words joined over hyphens and sentences over wraps."""
    lines = F.transform(_lines(text), T.strip)
    lines = F.filter(lines, lambda x: ~F.coalesce(F.array_contains(repeated, x), F.lit(False)) & ~T.is_page_number(x))
    joined = F.regexp_replace(F.array_join(lines, "\n"), "\n\n+", "\n\n")
    # What is looked for stands before what has to precede it, so that few places look behind.
    joined = F.regexp_replace(joined, r"(?U)-(?<=[\p{L}\p{N}_]-)\n(?=[a-z])", "")
    return T.strip(F.regexp_replace(joined, r"\n(?<=[^.!?:;\n]\n)(?=\p{Ll})", " "))


def clean_pages(pages: DataFrame) -> DataFrame:
    """``(book_id, number, text, separator, cleaned_start, cleaned_end)`` of pages that keep any text.

    Offsets are running sums over a book's pages: a page starts after all texts and separators before
    it. Where a word runs over a hyphen the separator is empty and the hyphen goes: the page before
    ends one earlier, and all after it start one earlier.
    """
    repeated = _repeated_lists(pages).where(F.size("repeated") > 0).select("book_id", "repeated.line")
    text = clean_page_text(F.col("text"), F.coalesce("line", F.array().cast("array<string>")))
    # A filter would be pushed below the cleaning and clean a second time; one inside the generator isn't.
    cleaned = pages.join(repeated, "book_id", "left").select("book_id", "number", F.explode(F.filter(F.array(text), lambda x: x != "")).alias("text"))
    order = Window.partitionBy("book_id").orderBy("number")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    before = F.col("before")
    joined = cleaned.withColumn("before", F.lag("text").over(order)).withColumn("separator", F.when(before.isNull(), "").otherwise(T.page_separator(before, F.col("text"))))
    joined = joined.withColumn("hyphen", (before.isNotNull() & (F.col("separator") == "")).cast("int"))
    start = F.sum(F.length("text") + F.length("separator") - F.col("hyphen")).over(so_far) - F.length("text")
    placed = joined.withColumn("cleaned_start", start.cast("long"))
    lost = F.coalesce(F.lead("hyphen").over(order), F.lit(0))
    return placed.select(
        "book_id", "number", F.expr("text").alias("text"), "separator", "cleaned_start", (F.col("cleaned_start") + F.length("text") - lost).cast("long").alias("cleaned_end")
    )


def cleaned_books(cleaned: DataFrame, *more: Column) -> DataFrame:
    """``(book_id, text)``: a book's pages put together as their offsets say; ``more``: other aggregates of a book's pages."""
    part = F.concat("separator", F.expr("left(text, cleaned_end - cleaned_start)"))
    parts = F.array_sort(F.collect_list(F.struct("number", part.alias("part"))))
    return cleaned.groupBy("book_id").agg(F.array_join(F.transform(parts, lambda p: p["part"]), "").alias("text"), *more)


def coverage_violations(pages: DataFrame) -> DataFrame:
    """``(book_id, rule, pages)``: books whose inner pages can't be read, or that have no usable page.

    ``pages``: book_id, number, text, classification. The first and last page may be decoration.
    """
    order = Window.partitionBy("book_id").orderBy("number")
    book = Window.partitionBy("book_id")
    words = T.ascii_word_count(F.col("text"))
    seen = pages.select(
        "book_id", "number", "classification", words.alias("words"),
        ((F.row_number().over(order) > 1) & (F.lead("number").over(order).isNotNull())).alias("inner_page"),
        F.max((words >= 2).cast("int")).over(book).alias("usable"), F.max((F.col("classification") == "unsupported").cast("int")).over(book).alias("odd"),
    )
    scan = (F.col("classification") == "scanned") | ((F.col("classification") == "mixed") & (F.col("words") < T.MIXED_MIN_WORDS))
    rule = (
        F.when(F.col("usable") == 0, F.when(F.col("odd") == 1, "NO_USABLE_TEXT").otherwise("OCR_REQUIRED"))
        .when(F.col("inner_page") & (F.col("classification") == "unsupported"), "PARSER_FAILURE")
        .when(F.col("inner_page") & scan, "OCR_REQUIRED")
    )
    ranked = seen.withColumn("rule", rule).where("rule is not null")
    found = ranked.groupBy("book_id", "rule").agg(F.array_sort(F.collect_list("number")).alias("pages"))
    # A page that could not be parsed is told before one that needs reading by eye.
    first = Window.partitionBy("book_id").orderBy(F.when(F.col("rule") == "PARSER_FAILURE", 0).otherwise(1))
    return found.withColumn("n", F.row_number().over(first)).where("n = 1").select("book_id", "rule", "pages")
