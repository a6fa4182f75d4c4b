"""Offsets of analyzer tokens: bytes of UTF-8 to code points and back."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def token_offsets(tokens: DataFrame) -> DataFrame:
    """Tokens (book_id, token_id, word, gap: the text before it) with first and last places in characters and in bytes."""
    order = Window.partitionBy("book_id").orderBy("token_id").rowsBetween(Window.unboundedPreceding, 0)
    end, byte_end = (F.sum(f(F.col("gap")) + f(F.col("word"))).over(order).cast("long") for f in (F.length, F.octet_length))
    placed = tokens.withColumns({"char_end": end, "byte_end": byte_end})
    return placed.select(
        "book_id", "token_id", "word", (F.col("char_end") - F.length("word")).alias("char_start"), "char_end",
        (F.col("byte_end") - F.octet_length("word")).alias("byte_start"), "byte_end",
    )


def quote_places(quotes: DataFrame, offsets: DataFrame) -> DataFrame:
    """Quotes (book_id, quote_id, start_token, end_token included) as character spans: two equi-joins on tokens."""
    first = offsets.select("book_id", F.col("token_id").alias("start_token"), F.col("char_start").alias("source_start"))
    last = offsets.select("book_id", F.col("token_id").alias("end_token"), F.col("char_end").alias("source_end"))
    return quotes.join(first, ["book_id", "start_token"]).join(last, ["book_id", "end_token"]).select("book_id", "quote_id", "source_start", "source_end")


def _fits(starts: pd.Series, ends: pd.Series) -> pd.Series:
    """For each list of ranges in order, which begin at or behind the end of the last one kept."""

    def fits(begin: np.ndarray, end: np.ndarray) -> list[bool]:
        out, reach = [], 0
        for a, b in zip(begin.tolist(), end.tolist()):
            out.append(a >= reach)
            reach = b if out[-1] else reach
        return out

    return pd.Series([fits(a, b) for a, b in zip(starts, ends)], dtype="object")


def without_overlaps(quotes: DataFrame) -> DataFrame:
    """Quotes of a book in order, without those that begin before the end of the last one kept.

    A dropped quote must not move the end, so this is a fold over the book's quotes, in one pass inside the row.
    """
    rows = quotes.select("book_id", F.col("source_start").cast("long"), F.col("source_end").cast("long"), F.col("quote_id").cast("long"))
    listed = rows.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("source_start", "source_end", "quote_id"))).alias("q"))
    judged = listed.select("book_id", "q", F.pandas_udf(_fits, "array<boolean>")("q.source_start", "q.source_end").alias("fits"))
    return judged.select("book_id", F.inline(F.arrays_zip("q", "fits"))).where("fits").select("book_id", "q.*")
