"""Edits of a voice plan as new revisions. A plan is three tables, each keyed by book_id and revision:

``cast`` (cast_id, display_label, role, relationship, voice_id), ``aliases`` (alias_id, text,
character_id) and ``spans`` (span_id, type, speaker_id, override struct<kind,from,to,actor,reason>).
An edit gives new DataFrames with the next revision; the old ones are as they were.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OVERRIDE = "struct<kind:string,from:string,to:string,actor:string,reason:string>"


class PlanError(ValueError):
    """An edit that a plan doesn't allow; ``code`` is stable."""

    def __init__(self, code: str) -> None:
        super().__init__(code)
        self.code = code


@dataclass(frozen=True)
class Plan:
    """Tables of the plans of many books, all at one revision."""

    cast: DataFrame
    aliases: DataFrame
    spans: DataFrame
    revision: int
    state: str = "draft"

    def _next(self, expected: int, **tables: DataFrame) -> Plan:
        if expected != self.revision:
            raise PlanError("STALE_REVISION")
        return replace(self, revision=self.revision + 1, state="draft", **tables)

    def _require(self, cast_id: str, role: str | None = None) -> None:
        rows = self.cast.where(F.col("cast_id") == cast_id)
        if rows.isEmpty():
            raise PlanError("UNKNOWN_CAST_ID")
        if role and rows.where(F.col("role") != role).limit(1).count():
            raise PlanError("CANNOT_REMOVE_NARRATOR")

    def rename_cast(self, cast_id: str, label: str, expected: int) -> Plan:
        """The cast member gets a new label."""
        self._require(cast_id)
        return self._next(expected, cast=self.cast.withColumn("display_label", _if(F.col("cast_id") == cast_id, F.lit(label), "display_label")))

    def assign_voice(self, cast_id: str, voice_id: str, expected: int) -> Plan:
        """The cast member gets a new voice; whoever is the narrator's other name follows the narrator."""
        self._require(cast_id)
        own = (F.col("cast_id") == cast_id) | ((F.lit(cast_id) == "narrator") & (F.col("relationship") == "same_as_narrator"))
        return self._next(expected, cast=self.cast.withColumn("voice_id", _if(own, F.lit(voice_id), "voice_id")))

    def same_as_narrator(self, cast_id: str, expected: int) -> Plan:
        """The character is the narrator's other name and speaks with that voice."""
        self._require(cast_id)
        narrators = self.cast.where("cast_id = 'narrator'").select("book_id", F.col("voice_id").alias("narrator_voice"))
        own = F.col("cast_id") == cast_id
        met = self.cast.join(narrators, "book_id", "left").withColumns({
            "voice_id": _if(own, F.coalesce("narrator_voice", "voice_id"), "voice_id"), "relationship": _if(own, F.lit("same_as_narrator"), "relationship"),
        })
        return self._next(expected, cast=met.drop("narrator_voice"))

    def merge_aliases(self, target: str, alias_ids: list[str], expected: int) -> Plan:
        """The aliases belong to another character."""
        self._require(target, "character")
        return self._next(expected, aliases=self.aliases.withColumn("character_id", _if(F.col("alias_id").isin(alias_ids), F.lit(target), "character_id")))

    def split_aliases(self, alias_ids: list[str], new_id: str, label: str, expected: int) -> Plan:
        """The aliases get a character of their own, with the narrator's voice till one is assigned."""
        if not self.cast.where(F.col("cast_id") == new_id).isEmpty():
            raise PlanError("AMBIGUOUS_CAST_ID")
        books = self.aliases.where(F.col("alias_id").isin(alias_ids)).select("book_id").distinct()
        added = self.cast.where("cast_id = 'narrator'").join(books, "book_id", "left_semi").withColumns({
            "cast_id": F.lit(new_id), "display_label": F.lit(label), "role": F.lit("character"), "relationship": F.lit("separate_from_narrator"),
        })
        moved = self.aliases.withColumn("character_id", _if(F.col("alias_id").isin(alias_ids), F.lit(new_id), "character_id"))
        return self._next(expected, cast=self.cast.unionByName(added), aliases=moved)

    def remove_cast(self, cast_id: str, expected: int) -> Plan:
        """The character goes with its aliases; its spans fall to the narrator and say why."""
        self._require(cast_id, "character")
        return self._next(
            expected, cast=self.cast.where(F.col("cast_id") != cast_id), aliases=self.aliases.where(F.col("character_id") != cast_id), spans=_moved(self.spans, cast_id, "narrator", "cast_removed")
        )

    def merge_cast(self, source: str, target: str, expected: int) -> Plan:
        """One character becomes part of another, which keeps its voice."""
        if source == target:
            raise PlanError("CANNOT_MERGE_SELF")
        if "narrator" in (source, target):
            raise PlanError("CANNOT_MERGE_NARRATOR")
        self._require(source), self._require(target)
        return self._next(
            expected, cast=self.cast.where(F.col("cast_id") != source), spans=_moved(self.spans, source, target, "cast_merged"),
            aliases=self.aliases.withColumn("character_id", _if(F.col("character_id") == source, F.lit(target), "character_id")),
        )

    def override_spans(self, changes: DataFrame, expected: int) -> Plan:
        """Spans get another speaker or type. ``changes``: book_id, span_id, kind, to, actor, reason.

        A speaker other than the narrator makes an unknown span dialogue; narration and unknown spans
        are the narrator's.
        """
        met = self.spans.join(changes.select("book_id", "span_id", "kind", "to", "actor", "reason"), ["book_id", "span_id"], "left")
        speaker, kind = F.col("kind") == "speaker", F.col("kind") == "type"
        done = met.withColumns({
            "override": F.when(F.col("kind").isNotNull(), F.struct("kind", F.when(speaker, F.col("speaker_id")).otherwise(F.col("type")).alias("from"), "to", "actor", "reason")).otherwise(F.col("override")),
            "speaker_id": F.when(speaker, F.col("to")).when(kind & F.col("to").isin("narration", "unknown"), "narrator").otherwise(F.col("speaker_id")),
            "type": F.when(kind, F.col("to")).when(speaker & (F.col("to") != "narrator") & (F.col("type") == "unknown"), "dialogue").otherwise(F.col("type")),
        })
        return self._next(expected, spans=done.select(*self.spans.columns))

    def approve(self, accept_narrator_fallback: bool = False) -> Plan:
        """The draft as approved; unknown spans need the narrator to be accepted for them."""
        if self.state == "approved":
            return self
        if not accept_narrator_fallback and not self.spans.where("type = 'unknown'").isEmpty():
            raise PlanError("UNRESOLVED_SPANS")
        return replace(self, state="approved")


def _if(condition: Column, value: Column, column: str) -> Column:
    return F.when(condition, value).otherwise(F.col(column))


def _moved(spans: DataFrame, source: str, target: str, reason: str) -> DataFrame:
    own = F.col("speaker_id") == source
    record = F.struct(F.lit("speaker").alias("kind"), F.lit(source).alias("from"), F.lit(target).alias("to"), F.lit("user").alias("actor"), F.lit(reason).alias("reason"))
    return spans.withColumn("override", F.when(own, record).otherwise(F.col("override"))).withColumn("speaker_id", _if(own, F.lit(target), "speaker_id"))


def collisions(cast: DataFrame) -> DataFrame:
    """Per book: characters that aren't the narrator but have the narrator's voice."""
    narrators = cast.where("cast_id = 'narrator'").select("book_id", F.col("voice_id").alias("narrator_voice"))
    same = (F.col("role") == "character") & (F.col("relationship") != "same_as_narrator") & (F.col("voice_id") == F.col("narrator_voice"))
    return cast.join(narrators, "book_id", "left").groupBy("book_id").agg(F.count(F.lit(1)).alias("cast_count"), F.count_if(same).alias("voice_collisions"))
