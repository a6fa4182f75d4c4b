"""Pages are cleaned once, and as by the patterns that were there before."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

import __spark_entry__
from narrata.functions import text as T
from narrata.operators import pages
from narrata.sources import tables

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_white_space_is_stripped_as_by_the_pattern(spark):
    texts = [chr(c) + "a " + chr(c) + "b" + chr(c) * 2 for c in [*range(1, 0x180), *range(0x1670, 0x1690), 0x180E, *range(0x1FF0, 0x2070), 0x3000, 0xFEFF, 0x1F600]] + ["", " \n ", None]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select(T.strip(F.col("t")).alias("new"), F.regexp_replace(F.regexp_replace("t", r"(?U)^\s+", ""), r"(?U)\s+$", "").alias("old")).collect()
    assert all(r["new"] == r["old"] for r in found)


def test_wraps_and_hyphens_as_by_the_older_patterns(spark):
    draw, parts = random.Random(5), ["a", "B", "é", "_", "7", "-", "-", "\n", "\n", ".", ",", "\U0001d4d0", "\r\n", "\r", " ", " "]
    texts = ["".join(draw.choices(parts, k=draw.randrange(1, 16))) for _ in range(4000)]
    lines = F.transform(F.split("t", "\r\n|[\n\r\\x0B\\x0C\\x1C\\x1D\\x1E\\x85  ]"), T.strip)
    lines = F.filter(lines, lambda x: ~T.is_page_number(x))
    joined = F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), "\n\n+", "\n\n"), r"(?U)(?<=[\p{L}\p{N}_])-\n(?=[a-z])", "")
    old = T.strip(F.regexp_replace(joined, r"(?<=[^.!?:;\n])\n(?=\p{Ll})", " "))
    new = pages.clean_page_text(F.col("t"), F.array().cast("array<string>"))
    assert spark.createDataFrame([(t,) for t in texts], "t string").where(~old.eqNullSafe(new)).count() == 0


def test_pages_are_cleaned_once(spark):
    plan = _plan(pages.clean_pages(tables.pages(spark, SF)))
    assert plan.count(r"\p{Ll}), ") == 1 and plan.count("split(") <= 6


def test_a_cleaned_text_reads_documents_twice(spark):
    assert _plan(__spark_entry__.queries()["s09_cleaned_text"](spark, SF)).count("Relation [doc_id") == 2
