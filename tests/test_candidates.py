"""Candidates are resolved in one pass."""

from __future__ import annotations

from pyspark.sql import functions as F

from narrata.operators import candidates, chapters, pages
from narrata.sources import tables

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_candidates_are_folded_once(spark):
    cleaned = pages.clean_pages(tables.pages(spark, SF)).localCheckpoint()
    books = pages.cleaned_books(cleaned).localCheckpoint()
    mapping = cleaned.select("book_id", F.col("number").alias("source_page"), "cleaned_start", "cleaned_end")
    titles = chapters.heading_candidates(cleaned).select("book_id", F.col("offset").cast("string").alias("candidate_id"), "title", F.lit("heading").alias("source"), F.lit(1).alias("source_page"), F.col("offset").alias("cleaned_offset"))
    assert _plan(candidates.resolved(titles, books, mapping)).count("ArrowEvalPython") <= 4
