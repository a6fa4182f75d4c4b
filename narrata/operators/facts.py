"""Facts of whole texts: words, language, duration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrata.functions import text as T


def text_facts(books: DataFrame) -> DataFrame:
    """Per book: words by each of the four word rules, characters, minutes of narration and language."""
    text = F.col("text")
    words = T.ascii_word_count(text)
    return books.select(
        "book_id", F.length(text).alias("characters"), words.alias("ascii_words"), T.latin_word_count(text).alias("latin_words"),
        T.bench_word_count(text).alias("bench_words"), F.size(T.any_words(text)).alias("any_words"),
        F.bround(words / F.lit(float(T.WORDS_PER_MINUTE)), 2).alias("minutes"), T.language(text).alias("language"),
        F.sha2(F.left(text, F.lit(T.PREVIEW_CHARACTERS)), 256).alias("preview_sha256"), F.sha2(text, 256).alias("text_sha256"),
    )


def language_summary(books: DataFrame) -> DataFrame:
    """Books and words of each detected language; the text is read once."""
    facts = books.select(T.language(F.col("text")).alias("language"), T.ascii_word_count(F.col("text")).alias("words"))
    return facts.groupBy("language").agg(F.count(F.lit(1)).alias("books"), F.sum("words").alias("words"))
