"""Decision records of a verifier's answers, and their summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The state that each decision of a verifier leads to.
STATES = {"correct_primary": "verified_consensus", "override_primary": "auto_corrected", "ambiguous": "ambiguous", "unresolved": "unresolved"}


def decision_records(exchanges: DataFrame) -> DataFrame:
    """``exchanges``: book_id, span_id, original_speaker_id, proposed_speaker_id, decision."""
    d = F.col("decision")
    state = F.create_map(*(F.lit(x) for pair in STATES.items() for x in pair))[d]
    auto = d.isin("correct_primary", "override_primary")
    return exchanges.select(
        "book_id", "span_id", "original_speaker_id", F.when(d == "unresolved", "unknown").otherwise(F.col("proposed_speaker_id")).alias("proposed_speaker_id"),
        F.when(d == "correct_primary", F.col("original_speaker_id")).when(d == "override_primary", F.col("proposed_speaker_id")).alias("effective_speaker_id"),
        state.alias("decision_state"), auto.alias("auto_approved"), (~auto).alias("review_required"),
    )


def summary(records: DataFrame) -> DataFrame:
    """Per book: records, records of each state, and those approved, for review or with a repeated span id."""
    counts = [F.count_if(F.col("decision_state") == s).alias(s) for s in STATES.values()]
    return records.groupBy("book_id").agg(
        F.count(F.lit(1)).alias("total"), *counts, F.count_if("auto_approved").alias("auto_approved"), F.count_if("review_required").alias("review_required"),
        (F.count(F.lit(1)) - F.count_distinct("span_id")).alias("repeated_ids"),
    )
