"""Scoring of attributed quotes against gold quotes, by book and pooled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrata.functions.text import ratio

#: Decisions that put a quote before a person.
EXCEPTION_STATES = ("exception", "unresolved")


def match_quotes(gold: DataFrame, predictions: DataFrame, narrators: DataFrame, exception_states: tuple[str, ...] = EXCEPTION_STATES) -> DataFrame:
    """Gold and predicted quotes of a book met by their exact range; what has no partner stays with nulls.

    ``narrators``: book_id, narrator_id. One full join on (book, start, end), then flags of each pair.
    """
    g = gold.select("book_id", "source_start", "source_end", F.col("speaker_id").alias("gold_speaker"), "category")
    p = predictions.select("book_id", "source_start", "source_end", "original_speaker_id", "effective_speaker_id", "decision_state")
    met = g.join(p, ["book_id", "source_start", "source_end"], "full").join(narrators, "book_id")
    both = F.col("gold_speaker").isNotNull() & F.col("decision_state").isNotNull()
    right = both & F.col("effective_speaker_id").eqNullSafe(F.col("gold_speaker"))
    cast = F.col("gold_speaker") != F.col("narrator_id")
    exception = F.col("decision_state").isin(*exception_states)
    return met.select(
        "book_id", "category", "decision_state", F.col("gold_speaker").isNotNull().alias("is_gold"), F.col("decision_state").isNotNull().alias("is_predicted"),
        both.alias("matched"), right.alias("correct"), F.when(cast, F.col("gold_speaker")).alias("cast_speaker"), (right & cast).alias("recovered"),
        (both & ~right).alias("wrong"), (both & ~right & exception).alias("captured"), (both & exception).alias("exception"), (both & cast).alias("cast_matched"),
        (both & cast & F.col("original_speaker_id").isNotNull() & (F.col("original_speaker_id") != F.col("narrator_id")) & F.col("effective_speaker_id").eqNullSafe(F.col("narrator_id"))).alias("demoted"),
        (F.col("decision_state").eqNullSafe("auto_approved")).alias("auto"), (F.col("decision_state").eqNullSafe("auto_approved") & ~right).alias("auto_wrong"),
    )


def scores(matched: DataFrame) -> DataFrame:
    """Metrics of each book, and of all books together in the row whose ``book_id`` is null.

    Speakers of different books are different speakers, so pooled cast recall counts pairs.
    """
    flags = ("is_gold", "is_predicted", "matched", "correct", "wrong", "captured", "exception", "cast_matched", "demoted", "auto", "auto_wrong")
    names = F.struct(F.col("book_id").alias("b"), F.col("cast_speaker").alias("s"))
    counted = (
        matched.withColumns({"in_book": F.col("book_id"), "cast_key": F.when(F.col("cast_speaker").isNotNull(), names), "found_key": F.when(F.col("recovered"), names)})
        .groupingSets([["in_book"], []], F.col("in_book"))
        .agg(*(F.count_if(f).alias(f"n_{f}") for f in flags), F.count_distinct("cast_key").alias("n_cast"), F.count_distinct("found_key").alias("n_recovered"), F.count_if(F.col("decision_state") == "manual_correction").alias("n_corrections"))
    )
    c = {f: F.col(f"n_{f}") for f in flags}
    first = counted.select("*", ratio(c["matched"], c["is_predicted"]).alias("precision"), ratio(c["matched"], c["is_gold"]).alias("recall"))
    return first.select(
        F.col("in_book").alias("book_id"), F.col("n_is_gold").alias("gold"), F.col("n_is_predicted").alias("predicted"), F.col("n_matched").alias("matched"),
        "precision", "recall", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"),
        ratio(c["correct"], c["is_gold"]).alias("speaker_accuracy"), ratio(F.col("n_recovered"), F.col("n_cast")).alias("cast_recall"),
        ratio(c["demoted"], c["cast_matched"]).alias("demotion_rate"), ratio(c["auto_wrong"], c["auto"]).alias("auto_error_rate"),
        ratio(c["captured"], c["wrong"]).alias("exception_capture"), ratio(c["exception"], c["matched"]).alias("exception_rate"),
        ratio(100 * F.col("n_corrections"), c["is_gold"]).alias("corrections_per_100"),
        (c["is_predicted"] - c["matched"]).alias("spurious"), (c["is_gold"] - c["matched"]).alias("missed"),
    )


def category_scores(matched: DataFrame) -> DataFrame:
    """Accuracy of each category over all books."""
    return matched.where("is_gold").groupBy("category").agg(F.count_if("correct").alias("correct"), F.count(F.lit(1)).alias("gold")).withColumn("accuracy", ratio(F.col("correct"), F.col("gold")))
