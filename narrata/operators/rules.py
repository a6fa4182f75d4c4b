"""Integrity rules as tables of conditions: each broken one becomes a row ``(keys, rule)``.

A rule is a name and a condition that has to hold; a condition that is null is broken. All rules of a
table are checked in one pass; rules over several rows use windows of the same key.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from narrata.operators.verification import STATES

#: Stages of each status of an analysis.
STAGES = {
    "queued": ("queued",), "running": ("preparing", "analyzing", "validating", "persisting"), "completed": ("completed",), "cancelled": ("cancelled",), "failed": ("failed",)
}
SHA256, TIMESTAMP = r"^[0-9a-f]{64}$", r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(?::\d\d(?:\.\d{1,6})?)?(?:Z|[+-]\d\d:?\d\d)$"


def violations(rows: DataFrame, keys: list[str], rules: Mapping[str, Column]) -> DataFrame:
    """One row for each rule that a row breaks."""
    broken = F.array(*(F.when(~F.coalesce(holds, F.lit(False)), name) for name, holds in rules.items()))
    return rows.withColumn("_broken", broken).select(*keys, F.explode(F.array_compact("_broken")).alias("rule"))


def status_rules() -> dict[str, Column]:
    """Of a status: status, stage, completed, total, cancel_requested, error, started_at, updated_at, finished_at (texts)."""
    c = F.col
    stage = F.lit(False)
    for status, stages in STAGES.items():
        stage = stage | ((c("status") == status) & c("stage").isin(*stages))
    active = c("status").isin("queued", "running")
    started, updated, finished = (F.try_to_timestamp(c(n)) for n in ("started_at", "updated_at", "finished_at"))
    return {
        "INVALID_STATUS_VALUE": c("status").isin(*STAGES),
        "INVALID_STAGE": stage,
        "INVALID_PROGRESS": (c("completed") >= 0) & (c("completed") <= c("total")) & ((c("status") != "completed") | (c("completed") == c("total"))),
        "INVALID_CANCEL_REQUEST": F.when(c("cancel_requested"), c("status").isin("running", "cancelled")).otherwise(c("status") != "cancelled"),
        "INVALID_ERROR": (c("status") == "failed") == c("error").isNotNull(),
        "INVALID_TIMESTAMP": c("started_at").rlike(TIMESTAMP) & c("updated_at").rlike(TIMESTAMP) & F.coalesce(c("finished_at").rlike(TIMESTAMP), F.lit(True)) & (active == c("finished_at").isNull()),
        "INVALID_TIMESTAMP_ORDER": (started <= updated) & F.coalesce(updated <= finished, F.lit(True)),
    }


def record_rules() -> dict[str, Column]:
    """Of a decision record: who was proposed, who is effective and what follows has to fit the state."""
    c = F.col
    named = lambda n: c(n).isNotNull() & (c(n) != "unknown")
    none = lambda n: c(n).isNull()
    same = lambda a, b: c(a).eqNullSafe(c(b))
    fits = (
        F.when(c("decision_state") == "verified_consensus", named("original_speaker_id") & same("proposed_speaker_id", "original_speaker_id") & same("effective_speaker_id", "original_speaker_id") & none("alternative_speaker_id"))
        .when(c("decision_state") == "auto_corrected", named("proposed_speaker_id") & ~same("original_speaker_id", "proposed_speaker_id") & same("effective_speaker_id", "proposed_speaker_id"))
        .when(c("decision_state") == "ambiguous", named("proposed_speaker_id") & c("alternative_speaker_id").isNotNull() & none("effective_speaker_id"))
        .when(c("decision_state") == "unresolved", (c("proposed_speaker_id") == "unknown") & none("alternative_speaker_id") & none("effective_speaker_id"))
    )
    auto = c("decision_state").isin("verified_consensus", "auto_corrected")
    return {
        "decision_state": c("decision_state").isin(*STATES.values()),
        "review_required": (c("auto_approved") == auto) & (c("review_required") == ~auto),
        "confidence": c("confidence").between(0, 1),
        "alternative_speaker_id": none("alternative_speaker_id") | ~same("alternative_speaker_id", "proposed_speaker_id"),
        "speakers": fits,
    }


def cast_violations(cast: DataFrame, spans: DataFrame) -> DataFrame:
    """``(book_id, rule)``: no or several narrators, repeated ids, a narrator's other name with another voice, speakers without an entry."""
    own = F.col("cast_id") == "narrator"
    facts = cast.groupBy("book_id").agg(
        F.count_if(own).alias("by_id"), F.count_if(F.col("role") == "narrator").alias("by_role"), F.count_if(own & (F.col("role") == "narrator")).alias("both"),
        (F.count(F.lit(1)) - F.count_distinct("cast_id")).alias("repeated"), F.max(F.when(own, F.col("voice_id"))).alias("narrator_voice"),
        F.collect_set(F.when((F.col("role") == "character") & (F.col("relationship") == "same_as_narrator"), F.col("voice_id"))).alias("other_voices"),
    )
    found = violations(facts, ["book_id"], {
        "MISSING_NARRATOR": (F.col("by_id") > 0) | (F.col("by_role") > 0),
        "MISIDENTIFIED_NARRATOR": ((F.col("by_id") == 0) & (F.col("by_role") == 0)) | ((F.col("both") == 1) & (F.col("by_role") == 1)),
        "DUPLICATE_CAST_ID": F.col("repeated") == 0,
        "NARRATOR_VOICE_MISMATCH": F.size(F.array_except("other_voices", F.array("narrator_voice"))) == 0,
    })
    lost = spans.join(cast.select("book_id", F.col("cast_id").alias("speaker_id")), ["book_id", "speaker_id"], "left_anti")
    return found.unionByName(lost.select("book_id", F.lit("UNKNOWN_SPEAKER_REFERENCE").alias("rule")).distinct())


def chunk_log_violations(completed: DataFrame) -> DataFrame:
    """``(book_id, global_index, rule)`` of completed chunks: book_id, ord (place in the log), chapter_index, global_index, local_index, input_hash, duration_seconds, total_chunks."""
    order = Window.partitionBy("book_id").orderBy("ord")
    seen = completed.withColumn("_before", F.max("global_index").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    return violations(seen, ["book_id", "global_index"], {
        "indexes": (F.col("chapter_index") >= 1) & (F.col("global_index") >= 0) & (F.col("local_index") >= 0),
        "exceeds_total": F.col("global_index") < F.col("total_chunks"),
        "order": F.coalesce(F.col("global_index") > F.col("_before"), F.lit(True)),
        "input_hash": F.col("input_hash").rlike(SHA256),
        "duration": (F.col("duration_seconds") > 0) & ~F.isnan("duration_seconds") & (F.col("duration_seconds") < float("inf")),
    })


def output_rules() -> dict[str, Column]:
    """Of a published output: filename, path, size_bytes, duration_seconds, chapter_count, codec, sha256."""
    c = F.col
    return {
        "path": c("path").startswith("/") & (F.element_at(F.split("path", "/"), -1) == c("filename")) & (c("filename") != ""),
        "codec": c("codec") == "aac",
        "size": (c("size_bytes") > 0) & (c("chapter_count") > 0),
        "duration": (c("duration_seconds") > 0) & (c("duration_seconds") < float("inf")),
        "sha256": c("sha256").rlike(SHA256),
    }
