"""Draft voice plans from speaker analyses: who is cast, under which names, with which voice, and who speaks each span.

All of it is joins and ordered aggregates by book. What depends on order has it as a column: characters
whose ids make the same cast id are merged in the order of the analysis, and of several cast members that
claim a name the last one gets it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from narrata.functions import text as T
from narrata.operators import cast as C
from narrata.operators import digests
from narrata.operators.artifact_rules import SPAN_TYPES, VOICE_PLAN_FIELDS
from narrata.operators.spans import LEAST_QUOTES, speaking_counts

#: Who isn't anybody in particular, and reasons of a draft's confidences.
NOBODY = ("", "narrator", "unknown")
NOT_CAST, GAP = "speaker_not_cast", "coverage_gap"


def identity_keys() -> Column:
    """The names under which a character's spans may come: its id, its label, its aliases."""
    named = F.concat(F.array(F.trim("character_id"), F.trim("label")), F.transform("aliases", lambda a: F.trim(a["text"])))
    return F.array_distinct(F.filter(named, lambda k: k.isNotNull() & (k != "")))


def named_properly() -> Column:
    """Whether aliases that have a kind say that it is a name; without such, whether the label looks like one."""
    typed = F.filter("aliases", lambda a: a["kind"].isNotNull() & (F.trim(a["text"]) != ""))
    return F.when(F.size(typed) > 0, F.exists(typed, lambda a: a["kind"] == "proper")).otherwise(C.looks_like_name(F.col("label")))


def _gender() -> Column:
    """The gender that the analysis gives, else the one that all pronouns among the aliases have."""
    said = F.array_distinct(F.array_compact(F.transform(F.filter("aliases", lambda a: a["kind"] == "pronoun"), lambda a: C._mapped(a["text"], C.PRONOUN_GENDERS))))
    return F.coalesce(C.gender_word(F.col("gender")), F.when(F.size(said) == 1, F.get(said, F.lit(0))))


def cast_members(characters: DataFrame, spans: DataFrame, least_quotes: int = LEAST_QUOTES) -> DataFrame:
    """``(book_id, rank, cast_id, source_id, label, relationship, gender, keys, aliases)``: who is cast, in order.

    ``characters``: book_id, ord, character_id, label, gender, relationship, aliases (array of alias_id,
    text, kind); ``spans``: book_id, ord, type, speaker_id. A character needs enough spoken spans under all
    its names, and a proper name. Those that make one cast id become one: the first gives label and
    relationship, names and aliases are added, and genders that differ cancel. Speakers of enough spans that
    the analysis doesn't list follow in the order of their first span.
    """
    counts = speaking_counts(spans)
    listed = characters.select(
        "book_id", "ord", F.trim("character_id").alias("source_id"), T.slug(F.col("character_id"), "character").alias("cast_id"), "label", F.coalesce("relationship", F.lit("separate_from_narrator")).alias("relationship"),
        _gender().alias("gender"), identity_keys().alias("keys"), "aliases", named_properly().alias("proper"),
        F.coalesce(F.get(F.filter("aliases", lambda a: (a["kind"] == "proper") & (F.trim(a["text"]) != "")), F.lit(0))["text"], F.col("label")).alias("name"),
    )
    claimed = listed.select("book_id", "ord", F.explode("keys").alias("speaker_id"))
    heard = claimed.join(counts, ["book_id", "speaker_id"]).groupBy("book_id", "ord").agg(F.sum("n_spans").alias("n_spans"))
    fit = listed.join(heard, ["book_id", "ord"]).where((F.col("n_spans") >= least_quotes) & F.col("proper"))
    one = F.struct("ord", "source_id", "name", "relationship", "gender", "keys", "aliases")
    grouped = fit.groupBy("book_id", "cast_id").agg(F.array_sort(F.collect_list(one)).alias("all"))
    first = F.get("all", F.lit(0))
    keys = F.array_distinct(F.flatten(F.transform("all", lambda c: F.concat(c["keys"], F.array(F.trim(c["name"]))))))
    gender = F.aggregate(F.slice("all", 2, 1 << 20), first["gender"], lambda g, c: F.when(g.isNull(), c["gender"]).when(c["gender"].isNotNull() & (c["gender"] != g), F.lit(None)).otherwise(g))

    def added(have: Column, c: Column) -> Column:
        # Aliases of later characters come in once each, by their text.
        new = F.filter(c["aliases"], lambda a, i: (F.trim(a["text"]) != "") & ~F.exists(have, lambda h: F.trim(h["text"]) == F.trim(a["text"])) & ~F.exists(F.slice(c["aliases"], F.lit(1), i), lambda b: F.trim(b["text"]) == F.trim(a["text"])))
        return F.concat(have, new)

    aliases = F.aggregate(F.slice("all", 2, 1 << 20), first["aliases"], added)
    members = grouped.select("book_id", F.struct(F.lit(0).alias("part"), first["ord"].cast("long").alias("at")).alias("order"), "cast_id", first["source_id"].alias("source_id"), first["name"].alias("label"), first["relationship"].alias("relationship"), gender.alias("gender"), keys.alias("keys"), aliases.alias("aliases"))
    known = claimed.select("book_id", "speaker_id").distinct()
    at = spans.groupBy("book_id", F.trim("speaker_id").alias("speaker_id")).agg(F.min("ord").cast("long").alias("at"))
    unlisted = counts.where((F.col("n_spans") >= least_quotes) & C.looks_like_name(F.col("speaker_id"))).join(known, ["book_id", "speaker_id"], "left_anti").join(at, ["book_id", "speaker_id"])
    own = unlisted.withColumn("cast_id", T.slug(F.col("speaker_id"), "character")).groupBy("book_id", "cast_id").agg(F.min(F.struct("at", "speaker_id")).alias("f"))
    own = own.join(members.select("book_id", "cast_id"), ["book_id", "cast_id"], "left_anti")
    none = F.array().cast(members.schema["aliases"].dataType)
    late = own.select("book_id", F.struct(F.lit(1).alias("part"), F.col("f.at").alias("at")).alias("order"), "cast_id", F.col("f.speaker_id").alias("source_id"), F.col("f.speaker_id").alias("label"), F.lit("separate_from_narrator").alias("relationship"), F.lit(None).cast("string").alias("gender"), F.array("f.speaker_id").alias("keys"), none.alias("aliases"))
    rank = F.row_number().over(Window.partitionBy("book_id").orderBy("order"))
    return members.unionByName(late).select("book_id", rank.alias("rank"), "cast_id", "source_id", F.coalesce(F.when(F.trim("label") != "", F.col("label")), F.col("cast_id")).alias("label"), "relationship", "gender", "keys", "aliases")


def with_voices(members: DataFrame, voices: Sequence[str]) -> DataFrame:
    """Members with their voice: the narrator's for those who are he; else the first of their gender, or the next in turn."""
    if not voices:
        raise ValueError("INVALID_VOICE_IDS")
    rest = F.array(*(F.lit(v) for v in voices[1:])).cast("array<string>")
    same = F.col("relationship") == "same_as_narrator"
    turn = F.sum(F.when(same, 0).otherwise(1)).over(Window.partitionBy("book_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)) - 1
    fit = F.get(F.filter(rest, lambda v: C.voice_gender(v) == F.col("gender")), F.lit(0))
    next_one = F.get(rest, F.pmod(turn, F.lit(max(1, len(voices) - 1))).cast("int"))
    return members.withColumn("voice_id", F.when(same, F.lit(voices[0])).otherwise(F.coalesce(fit, next_one, F.lit(voices[0]))))


def cast_keys(members: DataFrame) -> DataFrame:
    """``(book_id, speaker_id, cast_id)``: whom each name means; of several that claim it the last in order."""
    names = F.concat(F.col("keys"), F.array("cast_id", F.col("label"), F.col("source_id")), F.transform("aliases", lambda a: a["text"]))
    claims = members.select("book_id", "rank", "cast_id", F.explode(F.array_distinct(F.filter(names, lambda k: k.isNotNull() & (k != "")))).alias("speaker_id"))
    own = members.select("book_id").distinct().select("book_id", F.lit(0).alias("rank"), F.lit("narrator").alias("cast_id"), F.lit("narrator").alias("speaker_id"))
    return claims.unionByName(own).groupBy("book_id", "speaker_id").agg(F.max_by("cast_id", "rank").alias("cast_id"))


def plan_aliases(members: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """``(book_id, rank, position, alias_id, text, character_id)``: aliases of the cast, numbered where they have no id.

    ``more``: aliases of the analysis itself (book_id, ord, alias_id, text, character_id); those of nobody who is cast go.
    """
    numbered = F.format_string("alias-%s-%d", F.col("character_id"), F.col("position") + 1)
    own = members.select("book_id", "rank", F.col("cast_id").alias("character_id"), F.posexplode("aliases").alias("position", "a"))
    rows = own.where("a.text <> ''").select("book_id", "rank", "position", F.coalesce(F.col("a.alias_id"), numbered).alias("alias_id"), F.col("a.text").alias("text"), "character_id")
    if more is None:
        return rows
    named = more.withColumnRenamed("character_id", "speaker_id").join(cast_keys(members).withColumnRenamed("cast_id", "found"), ["book_id", "speaker_id"], "left")
    meant = named.withColumn("character_id", F.coalesce("found", T.slug(F.col("speaker_id"), "character")))
    there = members.select("book_id", F.col("cast_id").alias("character_id")).union(members.select("book_id", F.lit("narrator")).distinct())
    place = meant.join(there, ["book_id", "character_id"], "left_semi").where("text <> ''").withColumn("position", F.col("ord").cast("int"))
    late = place.select("book_id", F.lit(1 << 30).alias("rank"), "position", F.coalesce("alias_id", numbered).alias("alias_id"), "text", "character_id")
    return rows.unionByName(late)


def planned_spans(spans: DataFrame, keys: DataFrame) -> DataFrame:
    """Spans of a plan: each with the member who speaks it; one whose speaker isn't cast is the narrator's and unknown, with the reason.

    ``spans``: book_id, span_id, chapter_index, source_start, source_end, type, speaker_id, confidence
    (score, band, reasons), provenance (source, analysis_revision). A span without a speaker is unknown too.
    """
    said = F.trim(F.coalesce("speaker_id", F.lit("")))
    nobody = F.lower(said).isin("", "unknown")
    asked = spans.withColumns({"speaker_id": F.when(nobody, "narrator").otherwise(said), "type": F.when(nobody, "unknown").otherwise(F.col("type"))})
    met = asked.join(keys, ["book_id", "speaker_id"], "left")
    lost = F.col("cast_id").isNull() & ~F.lower("speaker_id").isin(*NOBODY)
    reasons = F.array_union(F.coalesce("confidence.reasons", F.array().cast("array<string>")), F.array(F.lit(NOT_CAST)))
    kind = F.when(lost | ~F.coalesce(F.col("type").isin(*SPAN_TYPES), F.lit(False)), "unknown").otherwise(F.col("type"))
    return met.select(
        "book_id", "chapter_index", "span_id", "source_start", "source_end", kind.alias("type"), F.coalesce("cast_id", F.lit("narrator")).alias("speaker_id"),
        F.when(lost, F.col("confidence").withField("reasons", reasons)).otherwise(F.col("confidence")).alias("confidence"), "provenance",
    )


def covered(spans: DataFrame, chapters: DataFrame, analyzer: str) -> DataFrame:
    """Spans with narration in every gap of their chapter (book_id, chapter_index, start_offset, end_offset), numbered by its place."""
    order = Window.partitionBy("book_id", "chapter_index").orderBy("source_start", "source_end")
    c = chapters.select("book_id", "chapter_index", "start_offset", "end_offset")
    edged = c.join(spans, ["book_id", "chapter_index"], "left").withColumn("before", F.coalesce(F.lag("source_end").over(order), F.col("start_offset"))).withColumn("is_last", F.lead("source_start").over(order).isNull())
    confidence = F.struct(F.lit(0.0).alias("score"), F.lit("low").alias("band"), F.array(F.lit(GAP)).alias("reasons")).cast(spans.schema["confidence"].dataType)
    provenance = F.struct(F.lit(analyzer).alias("source"), F.lit(1).alias("analysis_revision")).cast(spans.schema["provenance"].dataType)

    def gap(start: Column, end: Column) -> Column:
        return F.when(start < end, F.struct(F.lit(None).cast("string").alias("span_id"), start.alias("source_start"), end.alias("source_end"), F.lit("narration").alias("type"), F.lit("narrator").alias("speaker_id"), confidence.alias("confidence"), provenance.alias("provenance")))

    own = F.when(F.col("span_id").isNotNull(), F.struct("span_id", "source_start", "source_end", "type", "speaker_id", "confidence", "provenance"))
    start, end = F.coalesce("source_start", "end_offset"), F.coalesce("source_end", "end_offset")
    parts = F.array_compact(F.array(gap(F.col("before"), start), own, gap(F.when(F.col("is_last"), end), F.col("end_offset"))))
    rows = edged.select("book_id", "chapter_index", F.inline(parts))
    place = F.row_number().over(order)
    return rows.withColumn("span_id", F.coalesce("span_id", F.format_string("gap-%d-%d", F.col("chapter_index"), place)))


def draft_plans(members: DataFrame, aliases: DataFrame, spans: DataFrame, chapters: DataFrame, bindings: DataFrame, narrator_voice: str, analyzer: str) -> DataFrame:
    """Drafts of voice plans as artifacts with their digest, a row a book of ``bindings``.

    ``members`` come with voices, ``spans`` cover their chapters (book_id, chapter_index, start_offset,
    end_offset, start_page, end_page); ``bindings``: book_id and the digests of source, text and chapter plan.
    """
    settings = F.struct(F.lit(1.0).alias("speed"), F.lit(0).alias("pitch_semitones"), F.lit("neutral").alias("tone_preset"))
    entry = F.struct("cast_id", F.col("label").alias("display_label"), F.lit("character").alias("role"), "relationship", "voice_id", settings.alias("voice_settings"))
    narrator = F.struct(F.lit("narrator").alias("cast_id"), F.lit("Narrator").alias("display_label"), F.lit("narrator").alias("role"), F.lit("third_person").alias("relationship"), F.lit(narrator_voice).alias("voice_id"), settings.alias("voice_settings"))
    cast = members.groupBy("book_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", entry.alias("e")))), lambda x: x["e"]).alias("others"))
    alias = F.struct("alias_id", "text", "character_id", F.lit("accepted").alias("override_state"))
    names = aliases.groupBy("book_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "position", alias.alias("a")))), lambda x: x["a"]).alias("aliases"))
    override = F.lit(None).cast("struct<kind:string,from:string,to:string,actor:string,reason:string>").alias("override")
    span = F.struct("source_start", "source_end", "span_id", "type", "speaker_id", "confidence", "provenance", override)
    held = spans.groupBy("book_id", "chapter_index").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    part = F.struct("chapter_index", F.col("start_offset").alias("source_start"), F.col("end_offset").alias("source_end"), F.col("start_page").alias("source_page_start"), F.col("end_page").alias("source_page_end"), "spans")
    parts = chapters.join(held, ["book_id", "chapter_index"]).groupBy("book_id").agg(F.array_sort(F.collect_list(part)).alias("chapters"))
    nothing = F.lit(None).cast("string")
    made = bindings.join(parts, "book_id").join(cast, "book_id", "left").join(names, "book_id", "left").select(
        "book_id", F.lit(1).alias("schema_version"), F.lit("voice-plan").alias("artifact"), F.lit(1).alias("revision"), "source_pdf_sha256", "cleaned_text_sha256", "chapter_plan_sha256",
        F.lit(1).alias("chapter_plan_schema_version"), F.struct(F.lit(analyzer).alias("id"), F.lit("1").alias("version"), nothing.alias("model_hash")).alias("analyzer"),
        F.concat(F.array(narrator), F.coalesce("others", F.array().cast(cast.schema["others"].dataType))).alias("cast"), F.coalesce("aliases", F.array().cast(names.schema["aliases"].dataType)).alias("aliases"), "chapters",
        F.struct(F.lit("narrator").alias("mode"), F.lit(False).alias("accepted_by_user"), nothing.alias("accepted_at")).alias("unresolved_policy"),
        F.struct(F.lit("draft").alias("state"), nothing.alias("approved_at"), F.lit(None).cast("int").alias("approved_revision")).alias("approval"),
    )
    return digests.with_artifact_hash(made, VOICE_PLAN_FIELDS)
