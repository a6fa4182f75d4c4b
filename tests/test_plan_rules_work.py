"""Words of chapters are counted for the rows alone where plans are held against their texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from narrata.functions import text as T
from narrata.operators import chapters, pages, plan_rules
from narrata.sources import tables

SF = "/root/testdata/sf0.001"


def test_words_are_counted_for_rows_alone(spark):
    cleaned = pages.clean_pages(tables.pages(spark, SF)).localCheckpoint()
    books = pages.cleaned_books(cleaned).localCheckpoint()
    mapping = cleaned.select("book_id", F.col("number").alias("source_page"), "cleaned_start", "cleaned_end")
    plans = chapters.plan_artifacts(chapters.original_plan(chapters.heading_candidates(cleaned), books), books, mapping).localCheckpoint()
    found = plan_rules.plan_violations(plans, books, mapping)
    assert found._jdf.queryExecution().optimizedPlan().toString().count(T.LATIN_WORD) <= 2
    assert found.count() == 0
