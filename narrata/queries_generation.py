"""Registered queries of analyzer output, scopes, generations and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


from narrata.functions.text import chunk_path
from narrata.operators import generation, intake, measures, offsets, scope
from narrata.queries import _registered
from narrata.queries_cast import _tokens
from narrata.sources import tables


def _raw(spark: SparkSession, folder: str, damaged: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Turns as an analyzer writes them: tokens, a quote each turn, and its first two words as mentions of who speaks.

    Damage by book: a token's number, an empty word, a quote that ends before it begins, or a character below -1.
    """
    t, kind = _tokens(spark, folder), F.col("book_id") % 9 if damaged else F.lit(-1)
    placed = offsets.token_offsets(t).join(t.select("book_id", "token_id", "ordinal"), ["book_id", "token_id"])
    tokens = placed.select(
        "book_id", F.col("token_id").alias("position"), F.when((kind == 1) & (F.col("token_id") == 3), "5").otherwise(F.col("token_id").cast("string")).alias("token_ID_within_document"),
        F.when((kind == 2) & (F.col("token_id") == 2), "").otherwise(F.when(F.col("word") == "", "_").otherwise(F.col("word"))).alias("word"),
        F.when((kind == 3) & (F.col("token_id") == 1), "x").otherwise(F.col("char_start").cast("string")).alias("byte_onset"), F.col("char_end").cast("string").alias("byte_offset"), "ordinal",
    )
    turns = tables.turns(spark, folder).select("book_id", "ordinal", "role")
    ends = t.groupBy("book_id", "ordinal").agg(F.min("token_id").alias("a"), F.max("token_id").alias("b")).join(turns, ["book_id", "ordinal"])
    coref = F.when(F.col("role") == "user", "4").when(F.col("role") == "assistant", "7").otherwise("None")
    quotes = ends.select(
        "book_id", F.col("ordinal").alias("position"), F.col("a").cast("string").alias("quote_start"), F.when((kind == 4) & (F.col("ordinal") == 0), F.lit("-1")).otherwise(F.col("b").cast("string")).alias("quote_end"),
        F.when((kind == 5) & (F.col("ordinal") == 1), "-2").otherwise(coref).alias("char_id"),
    )
    firsts = t.join(ends.select("book_id", "ordinal", "a", "role"), ["book_id", "ordinal"]).where("token_id < a + 2")
    entities = firsts.select(
        "book_id", F.col("token_id").alias("position"), coref.alias("COREF"), F.col("token_id").cast("string").alias("start_token"), F.col("token_id").cast("string").alias("end_token"),
        F.when(F.col("token_id") == F.col("a"), F.when(F.col("ordinal") % 3 == 0, "PROP").otherwise("NOM")).otherwise("PRON").alias("prop"), F.when(F.col("ordinal") % 5 == 4, "LOC").otherwise("PER").alias("cat"), F.col("word").alias("text"),
    )
    return tokens, quotes, entities


@_registered
def s16_characters(spark: SparkSession, folder: str) -> DataFrame:
    tokens, quotes, entities = _raw(spark, folder)
    people = intake.characters(intake.mentions(entities, intake.read_tokens(tokens)), intake.read_quotes(quotes))
    return people.select("book_id", "coref_id", "canonical_label", F.size("aliases").alias("n_aliases"), "quote_count", F.sha2(F.array_join(F.transform("aliases", lambda a: F.concat_ws("|", a["alias"], a["kind"], a["token_start"].cast("string"), a["token_end"].cast("string"))), "\n"), 256).alias("aliases_sha256"))


@_registered
def s16_quote_spans(spark: SparkSession, folder: str) -> DataFrame:
    tokens, quotes, entities = _raw(spark, folder)
    read, said = intake.read_tokens(tokens), intake.read_quotes(quotes)
    people = intake.characters(intake.mentions(entities, read), said)
    places = read.select("book_id", "token_id", F.col("byte_start").alias("char_start"), F.col("byte_end").alias("char_end"))
    found = intake.quote_spans(said, places, people)
    return found.select("book_id", "quote_id", "source_start", "source_end", F.coalesce("coref_id", F.lit(-1)).alias("coref_id"), F.coalesce("label", F.lit("")).alias("label"))


@_registered
def s16_intake_violations(spark: SparkSession, folder: str) -> DataFrame:
    """What can't be read, and how many quotes of sound books are left in all."""
    tokens, quotes, _ = _raw(spark, folder, damaged=True)
    read, said = intake.read_tokens(tokens), intake.read_quotes(quotes)
    found = intake.intake_violations(read, said)
    left = intake.sound(said, found).groupBy("book_id").agg(F.count(F.lit(1)).alias("position")).select("book_id", F.lit("quotes").alias("file"), "position", F.lit("sound").alias("rule"))
    return found.unionByName(left)


@_registered
def p10_unified_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Spans as records of four shapes: nested, flat, with other names, and with odd values."""
    s = tables.spans(spark, folder)
    at = F.substring("span_id", 6, 5).cast("int")
    whole = {"ignoreNullFields": "false"}
    full = F.struct("span_id", "source_start", "source_end", "type", "speaker_id", F.struct(F.lit(0.5).alias("score"), "band", F.array("band", F.lit("x")).alias("reasons")).alias("confidence"), F.struct(F.lit("a").alias("source"), F.lit(2).alias("analysis_revision")).alias("provenance"))
    flat = F.struct(F.col("source_start").alias("start"), F.col("source_end").alias("end"), F.col("type").alias("span_type"), F.col("speaker_id").alias("speaker"), F.lit(0.25).alias("confidence"))
    other = F.struct(F.col("source_start").alias("start_offset"), F.col("source_end").alias("end_offset"), F.lit(None).cast("string").alias("speaker_id"), F.lit("user").alias("speaker"))
    odd = F.struct("span_id", F.col("source_start").cast("string").alias("source_start"), (F.col("source_end") + F.lit(0.5)).alias("source_end"), F.lit("song").alias("type"), F.lit(" Unknown ").alias("speaker_id"))
    record = F.when(at % 4 == 0, F.to_json(full, whole)).when(at % 4 == 1, F.to_json(flat, whole)).when(at % 4 == 2, F.to_json(other, whole)).otherwise(F.to_json(odd, whole))
    found = intake.unified_spans(s.select("book_id", at.cast("long").alias("position"), record.alias("record")), "rules")
    return found.select(
        "book_id", "span_id", F.coalesce("source_start", F.lit(-1)).alias("source_start"), F.coalesce("source_end", F.lit(-1)).alias("source_end"), "type", "speaker_id", F.col("confidence.score").alias("score"), F.col("confidence.band").alias("band"),
        F.array_join("confidence.reasons", "|").alias("reasons"), F.concat_ws("|", "provenance.source", F.col("provenance.analysis_revision").cast("string")).alias("provenance"), "is_valid",
    )


def _ranges(spark: SparkSession, folder: str) -> DataFrame:
    """Ranges by book: all, one chapter, from the second on, and wrong ones."""
    n = F.count(F.lit(1)).cast("int")
    kind = F.col("book_id") % 5
    books = tables.chapters(spark, folder).groupBy("book_id").agg(n.alias("n"))
    first = F.when(kind == 1, 1).when(kind == 2, F.least(F.lit(2), "n")).when(kind == 3, 2).when((kind == 4) & (F.col("book_id") % 2 == 0), 1)
    last = F.when(kind == 1, 1).when(kind == 2, F.col("n")).when(kind == 3, 1)
    return books.select("book_id", first.alias("first_chapter"), last.alias("last_chapter"))


@_registered
def p07_scoped_inputs(spark: SparkSession, folder: str) -> DataFrame:
    """Texts and chapters of scopes, on rows of their own."""
    parts = tables.chapters(spark, folder)
    scoped = scope.scopes(_ranges(spark, folder), parts)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), "")
    books = tables.turns(spark, folder).groupBy("book_id").agg(text.alias("text"))
    texts = scope.scoped_books(scoped, books).select("book_id", "cleaned_text_sha256", F.length("text").alias("characters"))
    return scope.scoped_chapters(scoped, parts).join(texts, "book_id").select("book_id", "chapter_index", "start_offset", "end_offset", "characters", "cleaned_text_sha256")


@_registered
def p07_scope_violations(spark: SparkSession, folder: str) -> DataFrame:
    return scope.scope_violations(_ranges(spark, folder), tables.chapters(spark, folder))


@_registered
def p08_remapped_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Spans that run over their end are clipped to the scope, analysed there, and put back."""
    scoped = scope.scopes(_ranges(spark, folder), tables.chapters(spark, folder))
    wide = tables.spans(spark, folder).select("book_id", "span_id", "chapter_index", "source_start", (F.col("source_end") + 4).alias("source_end"))
    own = scope.scoped_spans(scoped, wide)
    back = scope.remapped_spans(scoped, own)
    place = own.select("book_id", "span_id", F.col("chapter_index").alias("scoped_chapter"), F.col("source_start").alias("scoped_start"))
    return back.join(place, ["book_id", "span_id"])


def _log(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Turns as planned chunks, a log that ends early, and files; some records have another hash, some files are empty or changed."""
    t = tables.turns(spark, folder)
    plan = t.select("book_id", F.col("ordinal").cast("int").alias("global_index"), F.col("chapter_index").cast("int").alias("chapter_index"), (F.col("ordinal") % tables.TURNS_A_CHAPTER).cast("int").alias("local_index"), F.sha2("text", 256).alias("input_hash"), F.length("text").alias("n"))
    odd = (F.col("book_id") % 3 == 0) & (F.col("global_index") == 2)
    kept = plan.where((F.col("book_id") % 4 != 1) | (F.col("global_index") < 3))
    path = F.concat(F.lit("chunks/"), chunk_path(F.col("chapter_index"), F.col("local_index")))
    records = kept.select("book_id", F.col("global_index").alias("ord"), "global_index", "chapter_index", "local_index", F.when(odd, "other").otherwise(F.col("input_hash")).alias("input_hash"), path.alias("relative_path"), F.sha2(path, 256).alias("wav_sha256"), "n")
    audio = records.select("book_id", "relative_path", F.when((F.col("book_id") % 5 == 2) & (F.col("global_index") == 1), "changed").otherwise(F.col("wav_sha256")).alias("sha256"), (F.col("n") / 15.0).alias("duration_seconds"))
    return plan, records, audio


@_registered
def j19_generation_summary(spark: SparkSession, folder: str) -> DataFrame:
    found = generation.generation_summary(generation.recorded_chunks(*_log(spark, folder), ["input_hash"]))
    return found.withColumn("first_mismatch", F.coalesce("first_mismatch", F.lit(-1)))


@_registered
def j20_bound_summary(spark: SparkSession, folder: str) -> DataFrame:
    plan, records, _ = _log(spark, folder)
    counts = plan.groupBy("book_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    manifests = counts.select("book_id", F.lit("synthesis").alias("stage"), (F.col("n") + F.when(F.col("book_id") % 7 == 5, 1).otherwise(0)).alias("total_chunks"))
    found = generation.bound_summary(plan, records, manifests, ["input_hash"])
    return found.select("book_id", "stage", "total_chunks", "reason", *(F.coalesce(F.col(c), F.lit(-1)).alias(c) for c in ("completed_chunks", "total_chapters", "completed_chapters", "current_chapter")))


def _manifests(spark: SparkSession, folder: str, damaged: bool = False) -> DataFrame:
    """Conversations as manifests of versions 1 to 5 by their id, as JSON text; with ``damaged`` one fault a book, by its id."""
    t = tables.turns(spark, folder)
    kind = (F.col("book_id") / 5).cast("int") % 8 if damaged else F.lit(-1)
    version = F.col("book_id") % 5 + 1
    place = F.col("ordinal").cast("int")
    path = F.concat(F.lit("chunks/"), chunk_path(F.col("chapter_index").cast("int"), (place % tables.TURNS_A_CHAPTER)))
    chunk = {
        "global_index": place, "chapter_index": F.col("chapter_index").cast("int"), "local_index": (place % tables.TURNS_A_CHAPTER), "input_hash": F.sha2("text", 256), "relative_path": path,
        "duration_seconds": F.length("text") / 15.0 + 1, "wav_sha256": F.sha2(path, 256), "audio_input_hash": F.sha2("text", 256), "span_id": F.format_string("s%d", place), "speaker_id": F.col("role"), "voice_id": F.lit("v1"),
        "segment_type": F.lit("dialogue"), "source_start": F.col("source_start"), "source_end": F.col("source_end") + 1,
    }

    def listed(names: list[str]) -> Column:
        return F.array_sort(F.collect_list(F.struct(F.col("ordinal").alias("global_index_"), *(chunk[n].alias(n) for n in names))))

    rows = t.groupBy("book_id").agg(F.count(F.lit(1)).cast("int").alias("n"), *(listed(names).alias(f"chunks_{v}") for v, names in generation.CHUNK_FIELDS.items()))
    nothing, time, digest = F.lit(None).cast("string"), F.lit("2026-01-02T03:04:05Z"), F.sha2(F.col("book_id").cast("string"), 256)
    status = F.when(version >= 3, F.when(F.col("book_id") % 2 == 0, "completed").otherwise("cancelled")).otherwise("planned")
    done = status == "completed"
    total = F.col("n") + F.when(kind == 3, 1).otherwise(0)
    output = F.struct(F.lit("a.m4b").alias("filename"), F.lit("/x/a.m4b").alias("path"), F.lit(9).alias("size_bytes"), F.lit(1.5).alias("duration_seconds"), F.lit(1).alias("chapter_count"), F.lit("aac").alias("codec"), digest.alias("sha256"))
    final = F.col("book_id") % 4 == 0
    value = {
        "schema_version": F.when(kind == 1, 9).otherwise(version.cast("int")), "conversion_id": F.col("book_id").cast("string"), "original_display_filename": F.lit("a.pdf"), "source_pdf_sha256": F.when(kind == 2, "x").otherwise(digest),
        "status": status, "stage": F.when(done & final, "completed").when(done, "synthesis_complete").otherwise("chapter_review"), "created_at": time, "updated_at": time, "cleaned_text_sha256": nothing, "chapter_plan_sha256": digest,
        "warnings": F.array().cast("array<string>"), "error": F.when(kind == 4, F.lit("")), "tts": F.struct(F.lit("fake").alias("engine"), F.when(kind == 5, "v2").otherwise("v1").alias("voice"), F.lit(1.0).alias("speed"), F.lit(24000).alias("sample_rate"), F.lit(300).alias("chunk_cap")),
        "total_chunks": total, "progress": F.struct(F.col("n").alias("completed"), F.col("n").alias("current"), total.alias("total")), "worker": F.lit(None).cast("struct<pid:int,started_at:string,updated_at:string>"),
        "last_safe_error": nothing, "output": F.when(done & final & (kind != 6), output), "mode": F.lit("interactive_voices"), "voice_plan_sha256": digest, "voice_plan_revision": F.when(kind == 7, 0).otherwise(1), "speaker_analysis_sha256": digest,
        "cast_voice_ids": F.array(F.lit("v1")), "voice_registry_revision": digest,
    }
    text = nothing
    for v, names in generation.FIELDS.items():
        chunks = F.transform(f"chunks_{v}", lambda c: c.dropFields("global_index_")) if v in generation.CHUNK_FIELDS else None
        fields = [(chunks if n == "completed_chunks" else value[n]).alias(n) for n in names]
        text = F.when(version == v, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})).otherwise(text)
    return rows.select("book_id", F.when(kind == 0, F.concat(F.lit("{"), text)).otherwise(text).alias("manifest"))


@_registered
def s14_upgraded_manifests(spark: SparkSession, folder: str) -> DataFrame:
    """Manifests of five versions as three; files of chunks with an odd number are gone."""
    _, records, _ = _log(spark, folder)
    files = records.where("global_index % 2 = 0").select("book_id", "relative_path", F.col("wav_sha256").alias("sha256"))
    found = generation.upgraded(_manifests(spark, folder), files)
    chunks = F.coalesce("completed_chunks", F.array().cast(found.schema["completed_chunks"].dataType))
    return found.select(
        "book_id", "from_version", "schema_version", "status", F.coalesce("total_chunks", F.lit(-1)).alias("total_chunks"), F.size(chunks).alias("n_chunks"), F.size(F.filter(chunks, lambda c: c["wav_sha256"] == generation.NO_FILE)).alias("n_gone"),
        F.size(F.filter(chunks, lambda c: c["wav_sha256"].isNull())).alias("n_without"), F.coalesce("mode", F.lit("")).alias("mode"),
    )


@_registered
def v14_manifest_violations(spark: SparkSession, folder: str) -> DataFrame:
    return generation.manifest_violations(_manifests(spark, folder, damaged=True))


def _jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Jobs of every status by their id, with the chunks done so far and the settings wanted now."""
    statuses = F.array(*map(F.lit, [*generation.OPEN, *generation.ACTIVE, "completed", "broken"]))
    t = tables.turns(spark, folder)
    done = t.where("ordinal % 3 <> 2").groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct(F.col("ordinal").cast("int").alias("global_index"), F.sha2("text", 256).alias("input_hash")))).alias("completed_chunks"))
    counts = t.groupBy("book_id").agg(F.count(F.lit(1)).cast("int").alias("total_chunks")).join(done, "book_id")
    kind = F.col("book_id") % 3
    return counts.select(
        "book_id", F.get(statuses, (F.col("book_id") % 9).cast("int")).alias("status"), F.when(F.col("book_id") % 2 == 0, "synthesis_complete").otherwise("chapter_review").alias("stage"), (F.col("book_id") % 4 == 1).alias("published"),
        F.lit("one").alias("tts"), "total_chunks", F.lit("p1").alias("voice_plan_sha256"), F.lit(1).alias("voice_plan_revision"), "completed_chunks",
        F.when(kind == 0, "two").otherwise("one").alias("new_tts"), F.when(kind == 1, F.col("total_chunks")).otherwise(F.greatest(F.lit(1), F.col("total_chunks") - 2)).alias("new_total_chunks"),
        F.when(kind == 2, "p2").otherwise("p1").alias("new_voice_plan_sha256"), F.when(kind == 2, 2).otherwise(1).alias("new_voice_plan_revision"),
    )


@_registered
def r13_configured(spark: SparkSession, folder: str) -> DataFrame:
    return generation.configured_generations(_jobs(spark, folder)).withColumn("completed_chunks", F.array_join(F.transform("completed_chunks", lambda c: c["global_index"].cast("string")), ","))


@_registered
def r14_configured_interactive(spark: SparkSession, folder: str) -> DataFrame:
    return generation.configured_interactive(_jobs(spark, folder)).withColumn("completed_chunks", F.array_join(F.transform("completed_chunks", lambda c: c["global_index"].cast("string")), ","))


def _runs(spark: SparkSession, folder: str) -> DataFrame:
    """Events as measured runs of a user: their value decides the times; some have no sound, some no known cores."""
    e = tables.read(spark, folder, "events")
    ms = F.floor(F.abs(F.col("value")) * 1000).cast("long")
    return e.select(
        F.col("user_id").alias("group_id"), F.col("event_id").alias("run_id"), F.when(F.col("event_id") % 50 == 3, -1).otherwise(ms).alias("generation_ms"), (ms * 3 + 7).alias("cpu_ms"), (ms + F.col("event_id") % 5).alias("wall_ms"),
        F.when(F.col("event_id") % 40 == 1, 0).otherwise(F.col("event_id") % 977 + 1).alias("audio_ms"), F.when(F.col("user_id") % 10 != 4, 8).alias("cores"),
    )


@_registered
def m01_run_measures(spark: SparkSession, folder: str) -> DataFrame:
    return measures.run_measures(_runs(spark, folder)).select("run_id", F.coalesce("rtf", F.lit(-1.0)).alias("rtf"), F.coalesce("utilisation", F.lit(-1.0)).alias("utilisation"))


@_registered
def a18_run_averages(spark: SparkSession, folder: str) -> DataFrame:
    found = measures.run_averages(_runs(spark, folder).where("generation_ms >= 0"), "group_id")
    return found.select("group_id", "runs", "generation_seconds", "cpu_seconds", "audio_seconds", F.coalesce("rtf", F.lit(-1.0)).alias("rtf"), F.coalesce("utilisation", F.lit(-1.0)).alias("utilisation"))


@_registered
def u03_corpus_differences(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as two corpora: each lacks some books, some texts differ, and some speakers."""
    d = tables.read(spark, folder, "documents").select(F.col("doc_id").alias("book_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text"), F.coalesce("source", F.lit("")).alias("cast"))
    other = d.where("book_id % 17 <> 5").withColumns({"text": F.when(F.col("book_id") % 13 == 2, "changed").otherwise(F.col("text")), "cast": F.when(F.col("book_id") % 19 == 4, F.lit(None)).otherwise(F.col("cast"))})
    return measures.corpus_differences(d.where("book_id % 11 <> 3"), other, ["text", "cast"])


@_registered
def a16_ordered_voices(spark: SparkSession, folder: str) -> DataFrame:
    """Turns as members of a cast whose voices go by role and book."""
    t = tables.turns(spark, folder)
    cast = t.select("book_id", F.col("ordinal").alias("rank"), F.concat_ws("-", "role", (F.col("ordinal") % (F.col("book_id") % 3 + 1)).cast("string")).alias("voice_id"))
    return measures.ordered_voices(cast).select("book_id", F.array_join("voice_ids", ",").alias("voice_ids"))


@_registered
def a20_capped_warnings(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of documents as warnings, seven of which are listed."""
    rows = tables.books(spark, folder).select("book_id", measures.capped(F.split("text", "\n"), 7).alias("w"))
    return rows.select("book_id", F.sha2(F.array_join("w.listed", "\n"), 256).alias("listed_sha256"), "w.total", "w.truncated")


@_registered
def o06_short_samples(spark: SparkSession, folder: str) -> DataFrame:
    return tables.books(spark, folder).select("book_id", F.sha2(measures.short_sample(F.col("text")), 256).alias("sample_sha256"))
