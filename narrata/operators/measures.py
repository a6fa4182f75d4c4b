"""Measures of runs, and corpora held against each other before anything is scored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a short sample, and warnings that are listed.
SAMPLE_WORDS, MOST_WARNINGS = 220, 50


def rtf(generation: Column, audio: Column) -> Column:
    """Time that speech takes to make by the time it takes to hear; null where either is out of its domain."""
    return F.when((generation >= 0) & (audio > 0), generation / audio)


def utilisation(cpu: Column, wall: Column, cores: Column) -> Column:
    """Share of all cores that was used; null without a number of cores or a duration."""
    return F.when(wall > 0, cpu / (wall * cores))


def run_measures(runs: DataFrame) -> DataFrame:
    """``runs`` (run_id, generation_ms, cpu_ms, wall_ms, audio_ms, cores; whole milliseconds) with ``rtf`` and ``utilisation``."""
    c = F.col
    return runs.withColumns({"rtf": rtf(c("generation_ms"), c("audio_ms")), "utilisation": utilisation(c("cpu_ms"), c("wall_ms"), c("cores"))})


def run_averages(runs: DataFrame, by: str) -> DataFrame:
    """Per group the mean seconds of its runs, and the measures of those means, not the means of the measures.

    Sums are of whole milliseconds, so they don't depend on the order of rows.
    """
    parts = ("generation_ms", "cpu_ms", "wall_ms", "audio_ms")
    sums = runs.groupBy(by).agg(F.count(F.lit(1)).alias("runs"), F.max("cores").alias("cores"), *(F.sum(p).alias(p) for p in parts))
    means = {p.replace("_ms", "_seconds"): F.col(p) / F.col("runs") / 1000.0 for p in parts}
    measures = {"rtf": rtf(F.col("generation_ms"), F.col("audio_ms")), "utilisation": utilisation(F.col("cpu_ms"), F.col("wall_ms"), F.col("cores"))}
    return sums.withColumns(means | measures).drop(*parts)


def corpus_differences(gold: DataFrame, predictions: DataFrame, compared: list[str]) -> DataFrame:
    """``(book_id, rule)``: books that one corpus lacks, and those whose ``compared`` columns differ."""
    g = gold.select("book_id", F.struct(*compared).alias("g"))
    p = predictions.select("book_id", F.struct(*compared).alias("p"))
    rules = F.array(
        F.when(F.col("p").isNull(), "missing_predictions"), F.when(F.col("g").isNull(), "unknown_book"),
        *(F.when(F.col("g").isNotNull() & F.col("p").isNotNull() & ~F.col(f"g.{c}").eqNullSafe(F.col(f"p.{c}")), c) for c in compared),
    )
    return g.join(p, "book_id", "full").select("book_id", F.explode(F.array_compact(rules)).alias("rule"))


def ordered_voices(cast: DataFrame, order: str = "rank") -> DataFrame:
    """``(book_id, voice_ids)``: the voices of a book's cast, each once, in the order of their first member."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("rank"), "voice_id")))
    return cast.groupBy("book_id").agg(F.array_distinct(F.transform(rows, lambda r: r["voice_id"])).alias("voice_ids"))


def capped(warnings: Column, most: int = MOST_WARNINGS) -> Column:
    """The first warnings of a list, how many there are in all, and whether some aren't listed."""
    n = F.coalesce(F.size(warnings), F.lit(0))
    return F.struct(F.slice(F.coalesce(warnings, F.array().cast("array<string>")), 1, most).alias("listed"), n.alias("total"), (n > most).alias("truncated"))


def short_sample(text: Column, words: int = SAMPLE_WORDS) -> Column:
    """The first words of a text, with one blank between them."""
    return F.array_join(F.slice(F.filter(F.split(text, r"(?U)[\s\x1c-\x1f]+"), lambda w: w != ""), 1, words), " ")
