"""Registered queries of artifacts: digests, reuse by digest, plans and analyses against their rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from narrata.functions import text as T
from narrata.operators import artifact_rules, candidates, chapters, digests, pages, plan_rules, voice_plans
from narrata.plans import edits
from narrata.queries import _registered
from narrata.sources import tables
from narrata.sources.shared import stored

#: What an analysis artifact covers, besides its key.
ANALYSIS = ("schema_version", "artifact", "revision", "title", "analyzer", "spans", "warnings")


def _analyses(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as analysis artifacts: nested spans in reading order; short ones have no speaker."""
    low = F.col("band") == "low"
    span = F.struct(
        "source_start", "source_end", "chapter_index", "span_id", "type", F.when(~low, F.col("speaker_id")).alias("speaker_id"),
        F.struct((F.length("text") / F.lit(1000.0)).alias("score"), "band", F.array("band", F.left("text", F.lit(24))).alias("reasons")).alias("confidence"),
        F.struct(F.lit("turns").alias("source"), F.when(F.col("type") == "dialogue", F.concat(F.lit("q."), "span_id")).alias("quote_id")).alias("provenance"),
    )
    grouped = tables.spans(spark, folder).groupBy("book_id").agg(F.array_sort(F.collect_list(span)).alias("spans"), F.min_by("text", "source_start").alias("title"))
    return grouped.select(
        "book_id", F.lit(1).alias("schema_version"), F.lit("speaker-analysis").alias("artifact"), F.lit(3).alias("revision"), "title",
        _analyzer().alias("analyzer"), "spans",
        F.array(F.concat(F.lit("«"), F.right("title", F.lit(9)), F.lit("» \"\\"))).alias("warnings"),
    )


@_registered
def t41_artifact_digest(spark: SparkSession, folder: str) -> DataFrame:
    return digests.with_artifact_hash(_analyses(spark, folder), ANALYSIS).select("book_id", digests.ARTIFACT_HASH)


@_registered
def t43_hash_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Damage after the digest was made: its letters made large, a leaf of the last span changed, a score that isn't finite."""
    made = digests.with_artifact_hash(_analyses(spark, folder), ANALYSIS)
    hurt = lambda s: s.withField("confidence.reasons", F.array(F.lit("changed")))
    lost = lambda s: s.withField("confidence.score", F.lit(float("nan")))
    last = F.transform("spans", lambda s, i: F.when(i == F.size("spans") - 1, F.when(F.col("book_id") % 5 == 2, hurt(s)).when(F.col("book_id") % 11 == 3, lost(s)).otherwise(s)).otherwise(s))
    digest = F.col(digests.ARTIFACT_HASH)
    odd = made.withColumns({"spans": last, digests.ARTIFACT_HASH: F.when(F.col("book_id") % 7 == 1, F.upper(digest)).when(F.col("book_id") % 13 != 6, digest)})
    return digests.hash_violations(odd, ["book_id"], ANALYSIS)


def _voices(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as voices: their balance decides the speed, segment and key the rest; some settings are old, some wrong."""
    c = tables.read(spark, folder, "customer")
    old = F.col("c_custkey") % 5 == 0
    return c.select(
        F.col("c_name").alias("voice_id"), (F.abs("c_acctbal") / F.lit(4000.0)).alias("speed"), F.when(~old, F.col("c_custkey") % 9 - 4).cast("int").alias("pitch_semitones"),
        F.when(~old & (F.col("c_custkey") % 17 != 1), F.when(F.col("c_mktsegment") == "BUILDING", "bright").when(F.col("c_mktsegment") == "MACHINERY", "loud").otherwise("warm")).alias("tone_preset"),
        F.struct(F.col("c_name").alias("id"), F.lit("fake").alias("engine"), F.col("c_nationkey").alias("voice_version"), F.lit(24000).alias("sample_rate"), F.lit(True).alias("enabled")).alias("facts"),
    )


@_registered
def t46_settings_digest(spark: SparkSession, folder: str) -> DataFrame:
    return digests.with_settings_digest(_voices(spark, folder)).select("voice_id", F.coalesce("settings_sha256", F.lit("")).alias("settings_sha256"))


@_registered
def m15_settings_violations(spark: SparkSession, folder: str) -> DataFrame:
    return digests.settings_violations(_voices(spark, folder), ["voice_id"])


@_registered
def t47_preview_keys(spark: SparkSession, folder: str) -> DataFrame:
    keyed = digests.with_preview_key(_voices(spark, folder), "facts", "shape-1")
    return keyed.select("voice_id", F.coalesce("preview_key", F.lit("")).alias("preview_key"))


@_registered
def t48_descriptor_digest(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as references of a voice; a digest that is there already isn't covered."""
    fields = ["schema_version", "name", "duration_seconds", "sample_rate", "note", "descriptor_sha256"]
    rows = tables.read(spark, folder, "supplier").select(
        F.lit(1).alias("schema_version"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("duration_seconds"), F.lit(24000).alias("sample_rate"),
        F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit('"ü" '), F.col("s_suppkey").cast("string"))).alias("note"), F.lit("old").alias("descriptor_sha256"),
    )
    return digests.with_descriptor_hash(rows, fields).select("name", "descriptor_sha256")


def _spoken(spark: SparkSession, folder: str, revision: int, changed: Column | None = None) -> DataFrame:
    """Spans as chunks of a plan: its cast has a voice for each speaker; ``changed`` spans are the narrator's."""
    s = tables.spans(spark, folder)
    speaker = F.col("speaker_id") if changed is None else F.when(changed, "narrator").otherwise(F.col("speaker_id"))
    at = F.substring("span_id", 6, 5).cast("int")
    told = s.withColumn("speaker_id", speaker).withColumn("voice_id", F.concat(F.lit("voice_"), F.col("speaker_id")))
    chunks = told.select(
        "book_id", "chapter_index", at.alias("global_index"), (at % tables.TURNS_A_CHAPTER).alias("local_index"), "source_start", "source_end", "text", "span_id",
        F.col("type").alias("segment_type"), "speaker_id", "voice_id",
    )
    cast = chunks.select("book_id", "speaker_id", "voice_id").distinct()
    voices = cast.select(
        "book_id", "speaker_id", F.struct(F.lit(1.25).alias("speed"), (F.length("speaker_id") % 3).alias("pitch_semitones"), F.lit("warm").alias("tone_preset")).alias("voice_settings"),
        F.struct(F.col("voice_id").alias("id"), F.lit("fake").alias("engine"), F.lit(24000).alias("sample_rate"), F.lit(True).alias("enabled")).alias("generation_facts"),
    )
    plans = cast.select("book_id").distinct().select("book_id", F.sha2(F.col("book_id").cast("string"), 256).alias("voice_plan_canonical_hash"), F.lit(revision).alias("voice_plan_revision"))
    return digests.with_interactive_hashes(chunks, voices, plans, 300, "shape-1", "r" * 64)


@_registered
def t45_interactive_hashes(spark: SparkSession, folder: str) -> DataFrame:
    return _spoken(spark, folder, 2).select("book_id", "span_id", "audio_input_hash", "input_hash")


@_registered
def j17_reuse_audio(spark: SparkSession, folder: str) -> DataFrame:
    """A log of the first revision against a second one in which short spans are the narrator's; some records have no sound file."""
    log = _spoken(spark, folder, 1).select(
        "book_id", "chapter_index", "global_index", "local_index", "audio_input_hash", F.col("global_index").alias("ord"),
        F.when(F.col("global_index") % 9 != 4, F.sha2("text", 256)).alias("wav_sha256"), (F.length("text") / 15.0).alias("duration_seconds"),
    )
    plan = _spoken(spark, folder, 2, F.col("band") == "low")
    found = digests.reuse_audio(plan, log)
    return found.select("book_id", "global_index", "speaker_id", F.coalesce("wav_sha256", F.lit("")).alias("wav_sha256"), F.coalesce("duration_seconds", F.lit(0.0)).alias("duration_seconds"))


@_registered
def j17_moved_audio(spark: SparkSession, folder: str) -> DataFrame:
    """Turns in the order of their texts are another plan of the same speech: all audio is found again, if its file is whole."""
    spoken = F.sha2(F.concat_ws("\n", "speaker_id", "text"), 256)
    log = _spoken(spark, folder, 1).select(
        "book_id", "global_index", spoken.alias("spoken_sha256"), F.col("global_index").alias("ord"), F.when(F.col("global_index") % 9 != 4, F.sha2("span_id", 256)).alias("wav_sha256"),
        (F.length("text") / 15.0 + 1).alias("duration_seconds"),
    )
    plan = _spoken(spark, folder, 2).select("book_id", (F.lit(0) - F.col("global_index")).alias("global_index"), spoken.alias("spoken_sha256"))
    found = digests.moved_audio(plan, log)
    return found.select("book_id", "global_index", F.coalesce("wav_sha256", F.lit("")).alias("wav_sha256"), F.coalesce("duration_seconds", F.lit(0.0)).alias("duration_seconds"))


def _documents(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cleaned pages, books and the map of pages."""
    cleaned = stored(pages.clean_pages(tables.pages(spark, folder)))
    mapping = cleaned.select("book_id", F.col("number").alias("source_page"), "cleaned_start", "cleaned_end")
    return cleaned, stored(pages.cleaned_books(cleaned)), mapping


def _plan_artifacts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    cleaned, books, mapping = _documents(spark, folder)
    plan = chapters.original_plan(chapters.heading_candidates(cleaned), books)
    return stored(chapters.plan_artifacts(plan, books, mapping)), books, mapping


@_registered
def p02_plan_artifacts(spark: SparkSession, folder: str) -> DataFrame:
    plans, _, _ = _plan_artifacts(spark, folder)
    flat = plans.select("book_id", "mode", "cleaned_text_sha256", F.size("chapters").alias("n_chapters"), F.inline("chapters"))
    return flat.select("book_id", "mode", "cleaned_text_sha256", "n_chapters", "index", "title", "start_offset", "end_offset", "start_page", "end_page", "source_type", "word_count")


def _damaged_plans(plans: DataFrame) -> DataFrame:
    """One fault a book by its id: digest, version, mode, title, a chapter that begins two letters late, words, page, index and source, a lost last chapter."""
    kind, last = F.col("book_id") % 10, F.size("chapters")

    def hurt(c: Column, i: Column) -> Column:
        ending = i == last - 1
        return (
            F.when((kind == 4) & (i == 0), c.withField("title", F.lit(" \t")))
            .when((kind == 5) & (i == 1), c.withField("start_offset", c["start_offset"] + 2))
            .when((kind == 6) & ending, c.withField("word_count", c["word_count"] + 1))
            .when((kind == 7) & ending, c.withField("end_page", c["end_page"] + 1))
            .when((kind == 8) & ending, c.withField("index", F.lit(99)).withField("source_type", F.lit("")))
            .otherwise(c)
        )

    hurt_chapters = F.transform("chapters", hurt)
    return plans.withColumns({
        "cleaned_text_sha256": F.when(kind == 1, F.repeat(F.lit("0"), F.lit(64))).otherwise(F.col("cleaned_text_sha256")), "schema_version": F.when(kind == 2, 2).otherwise(F.col("schema_version")),
        "mode": F.when(kind == 3, "custom").otherwise(F.col("mode")), "chapters": F.when(kind == 9, F.slice(hurt_chapters, F.lit(1), last - 1)).otherwise(hurt_chapters),
    })


@_registered
def v02_plan_violations(spark: SparkSession, folder: str) -> DataFrame:
    plans, books, mapping = _plan_artifacts(spark, folder)
    return plan_rules.first_violations(plan_rules.plan_violations(_damaged_plans(plans), books, mapping))


@_registered
def v01_mapping_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Maps with a fault by book: the second page begins earlier, the last page ends later, the first is numbered 0, or one is empty."""
    _, books, mapping = _documents(spark, folder)
    listed = mapping.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("source_page", "cleaned_start", "cleaned_end"))).alias("m"))
    rows = listed.select("book_id", F.size("m").alias("n"), F.posexplode("m").alias("position", "e")).select("book_id", "n", "position", "e.*")
    kind, place = F.col("book_id") % 6, F.col("position")
    odd = rows.select(
        "book_id", "position", F.when((kind == 3) & (place == 0), 0).otherwise(F.col("source_page")).alias("source_page"),
        F.when((kind == 1) & (place == 1), F.col("cleaned_start") - 3).when((kind == 4) & (place == 0), 1).otherwise(F.col("cleaned_start")).alias("cleaned_start"),
        F.when((kind == 2) & (place == F.col("n") - 1), F.col("cleaned_end") + 1).when((kind == 5) & (place == 1), F.col("cleaned_start")).otherwise(F.col("cleaned_end")).alias("cleaned_end"),
    )
    return plan_rules.mapping_violations(odd.where("book_id % 12 <> 7"), books)


def _title_candidates(cleaned: DataFrame) -> DataFrame:
    """Lines of cleaned pages as titles: in capitals with their offset, as outlines, in small letters with a wrong offset, with wide blanks, from the middle of the line, or unknown."""
    lines = F.split(F.expr("left(text, cleaned_end - cleaned_start)"), "\n")
    line = F.transform(lines, lambda x, i: F.struct(i.alias("nth"), x.alias("line"), F.aggregate(F.slice(lines, F.lit(1), i), F.lit(0), lambda s, y: s + F.length(y) + 1).alias("before")))
    rows = cleaned.select("book_id", F.col("number").alias("source_page"), "cleaned_start", F.inline(line)).where("line <> ''")
    kind, at = (F.col("source_page") * 5 + F.col("nth")) % 6, F.col("cleaned_start") + F.col("before")
    head, small, large = F.left("line", F.lit(40)), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    title = F.when(kind == 0, F.translate(head, small, large)).when(kind == 1, "an outline").when(kind == 2, F.translate(head, large, small)).when(kind == 3, F.replace(head, F.lit(" "), F.lit("  "))).when(kind == 4, F.substring("line", 9, 24)).otherwise("no such title")
    return rows.select(
        "book_id", F.format_string("%d-%d", "source_page", "nth").alias("candidate_id"), title.alias("title"), F.when(kind == 1, "PDF outline").otherwise("heading").alias("source"),
        F.when(kind > 0, F.col("source_page")).alias("source_page"), F.when(kind == 0, at).when(kind == 2, at + 1).when(kind == 5, F.lit(-1)).cast("long").alias("cleaned_offset"),
    )


@_registered
def j05_candidate_offsets(spark: SparkSession, folder: str) -> DataFrame:
    cleaned, books, mapping = _documents(spark, folder)
    found = candidates.resolved(_title_candidates(cleaned), books, mapping)
    return found.select("book_id", "candidate_id", F.coalesce("offset", F.lit(-1)).alias("offset"), F.coalesce("step", F.lit("")).alias("step"))


@_registered
def j04_page_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Pages counted in pairs, so that a page has several ranges."""
    _, _, mapping = _documents(spark, folder)
    return candidates.page_segments(mapping.withColumn("source_page", F.floor((F.col("source_page") + 1) / 2).cast("int")))


def _bindings(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """What conversations are now: digests of their source, text and chapter plan; and their chapters."""
    t = tables.turns(spark, folder)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), "")
    books = t.groupBy("book_id").agg(text.alias("text"))
    parts = tables.chapters(spark, folder).withColumns({"start_page": F.col("chapter_index").cast("int"), "end_page": F.col("chapter_index").cast("int")})
    chapter = F.struct(F.col("chapter_index").alias("index"), "start_offset", "end_offset", "start_page", "end_page")
    plans = parts.groupBy("book_id").agg(F.lit(1).alias("schema_version"), F.array_sort(F.collect_list(chapter)).alias("chapters"))
    hashed = plans.select("book_id", digests.digest(plans, ["schema_version", "chapters"], newline=True).alias("current_plan_sha256"), F.size("chapters").alias("n_chapters"))
    now = books.select("book_id", F.sha2(F.concat(F.lit("pdf "), "text"), 256).alias("source_pdf_sha256"), F.sha2("text", 256).alias("cleaned_text_sha256")).join(hashed, "book_id")
    return stored(now.withColumn("chapter_plan_sha256", F.col("current_plan_sha256"))), stored(parts)


def _analyzer() -> Column:
    return F.struct(F.lit("rules").alias("id"), F.lit("1").alias("version"), F.lit(None).cast("string").alias("model_hash"))


def _band_score() -> Column:
    return F.when(F.col("band") == "high", 0.9).when(F.col("band") == "medium", 0.6).otherwise(0.3)


@_registered
def v06_analysis_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Analyses with one fault a book, by its id; digests are made after the fault, but for the last kind."""
    bindings, parts = _bindings(spark, folder)
    kind = F.col("book_id") % 12
    s = tables.spans(spark, folder)
    person = F.col("speaker_id") != "narrator"
    lines = s.where(person).groupBy("book_id", "speaker_id").agg(F.count(F.lit(1)).cast("int").alias("n"), F.min(F.substring("span_id", 6, 5).cast("int")).alias("first"))
    alias = F.struct(
        F.col("speaker_id").alias("alias"), F.when(kind == 5, "verb").otherwise("nominal").alias("kind"), F.lit(0.5).alias("confidence"),
        F.struct(F.lit("turns").alias("source"), F.col("first").alias("token_start"), (F.col("first") + F.when(kind == 5, 0).otherwise(1)).alias("token_end")).alias("provenance"),
    )
    character = F.struct(
        F.when((kind == 3) & (F.col("speaker_id") == "user"), "narrator").otherwise(F.col("speaker_id")).alias("character_id"), F.initcap("speaker_id").alias("canonical_label"),
        F.array(alias).alias("aliases"), F.col("n").alias("line_count"), F.col("n").alias("quote_count"),
    )
    people = lines.groupBy("book_id").agg(F.array_sort(F.collect_list(character)).alias("characters"))
    span = F.struct("source_start", "source_end", "span_id", F.col("chapter_index").alias("chapter_index"), "type", "speaker_id", F.struct(_band_score().alias("score"), "band", F.array("band").alias("reasons")).alias("confidence"), F.struct(F.lit("turns").alias("source"), F.lit(None).cast("string").alias("quote_id")).alias("provenance"))
    said = s.groupBy("book_id").agg(F.array_sort(F.collect_list(span)).alias("spans"))

    def hurt(x: Column, i: Column) -> Column:
        return (
            F.when((kind == 6) & (i == F.size("spans") - 1), x.withField("confidence.score", F.lit(1.5)).withField("confidence.band", F.lit("sure")))
            .when((kind == 7) & (i == 1), x.withField("source_start", x["source_start"] - 1))
            .when((kind == 8) & (i == 2), x.withField("chapter_index", F.lit(99).cast("long")))
            .otherwise(x)
        )

    none = F.array().cast(people.schema["characters"].dataType)
    listed = F.coalesce("characters", none)
    made = said.join(people, "book_id", "left").join(bindings, "book_id").select(
        "book_id", F.lit(1).alias("schema_version"), F.lit("speaker-analysis").alias("artifact"), F.when(kind == 1, 0).otherwise(3).alias("revision"),
        F.when(kind == 2, F.repeat(F.lit("a"), F.lit(64))).otherwise(F.col("source_pdf_sha256")).alias("source_pdf_sha256"), "cleaned_text_sha256", "chapter_plan_sha256", F.lit(1).alias("chapter_plan_schema_version"),
        _analyzer().alias("analyzer"), F.when(kind == 4, F.concat(listed, listed)).otherwise(listed).alias("characters"), F.transform("spans", hurt).alias("spans"),
        F.when(kind == 10, F.array(F.lit("a\tb"))).otherwise(F.array(F.lit("ok"))).alias("warnings"), F.when(kind == 9, 1).alias("chapter_start"), F.when(kind == 9, 1).alias("chapter_end"),
    )
    hashed = digests.with_artifact_hash(made, artifact_rules.ANALYSIS_FIELDS)
    stale = stored(hashed).withColumn("warnings", F.when(kind == 11, F.array(F.lit("later"))).otherwise(F.col("warnings")))
    now = bindings.withColumn("current_plan_sha256", F.when(kind == 10, F.lit("other")).otherwise(F.col("current_plan_sha256")))
    return plan_rules.first_violations(artifact_rules.analysis_violations(stale, now, parts))


def _voice_plans(spark: SparkSession, folder: str, kind: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Voice plans with the fault of their kind (0: none), what they are bound to, and chapters; odd books are drafts."""
    bindings, parts = _bindings(spark, folder)
    draft = F.col("book_id") % 2 == 1
    s = tables.spans(spark, folder)
    members = s.select("book_id", F.col("speaker_id").alias("cast_id")).union(s.select("book_id", F.lit("narrator"))).distinct().where((F.col("cast_id") != "narrator") | (kind != 1))
    own = F.col("cast_id") == "narrator"
    settings = F.struct(F.when((kind == 2) & own, 3.0).otherwise(1.0).alias("speed"), F.lit(0).alias("pitch_semitones"), F.lit("warm").alias("tone_preset"))
    member = F.struct(
        "cast_id", F.initcap("cast_id").alias("display_label"), F.when(own, "narrator").otherwise("character").alias("role"),
        F.when(own, "third_person").when(kind == 11, "same_as_narrator").otherwise("separate_from_narrator").alias("relationship"), F.concat(F.lit("v-"), "cast_id").alias("voice_id"), settings.alias("voice_settings"),
    )
    name = F.struct(F.concat(F.lit("alias-"), "cast_id").alias("alias_id"), F.initcap("cast_id").alias("text"), F.when(kind == 3, "nobody").otherwise(F.col("cast_id")).alias("character_id"), F.when(kind == 3, "pending").otherwise("accepted").alias("override_state"))
    cast = members.groupBy("book_id").agg(F.array_sort(F.collect_list(member)).alias("cast"), F.array_sort(F.collect_list(F.when(~own, name))).alias("aliases"))
    first = F.col("span_id") == "span-00000"
    last = F.col("source_end") == F.max("source_end").over(Window.partitionBy("book_id"))
    override = F.struct(F.lit("speaker").alias("kind"), F.lit("user").alias("from"), F.lit("x").alias("to"), F.lit("user").alias("actor"), F.lit("review").alias("reason"))
    told = s.withColumns({
        "type": F.when(kind.isin(6, 14) & last, "unknown").otherwise(F.col("type")), "speaker_id": F.when((kind == 7) & first, F.lit(None)).when((kind == 14) & last, "narrator").otherwise(F.col("speaker_id")),
        "override": F.when((kind == 8) & first, override),
    })
    span = F.struct("source_start", "source_end", "span_id", "type", "speaker_id", F.struct(_band_score().alias("score"), "band", F.array("band").alias("reasons")).alias("confidence"), F.struct(F.lit("turns").alias("source"), F.lit(3).alias("analysis_revision")).alias("provenance"), "override")
    held = told.where(~first | (kind != 5)).groupBy("book_id", "chapter_index").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    empty = F.array().cast(held.schema["spans"].dataType)
    page = F.col("start_page") + F.when((kind == 12) & (F.col("chapter_index") == 1), 1).otherwise(0)
    part = F.struct("chapter_index", F.col("start_offset").alias("source_start"), F.col("end_offset").alias("source_end"), page.alias("source_page_start"), F.col("end_page").alias("source_page_end"), F.coalesce("spans", empty).alias("spans"))
    whole = parts.join(held, ["book_id", "chapter_index"], "left").groupBy("book_id").agg(F.array_sort(F.collect_list(part)).alias("chapters"))
    kept = F.when(kind == 4, F.slice("chapters", F.lit(1), F.size("chapters") - 1)).otherwise(F.col("chapters"))
    time, nothing = F.lit("2026-01-02T03:04:05Z"), F.lit(None).cast("string")
    approval = F.struct(
        F.when(draft, "draft").otherwise("approved").alias("state"), F.when(kind == 10, "soon").when(draft, nothing).otherwise(time).alias("approved_at"),
        F.when(draft, F.lit(None)).when(kind == 9, 9).otherwise(2).cast("int").alias("approved_revision"),
    )
    made = whole.join(cast, "book_id").join(bindings, "book_id").select(
        "book_id", F.lit(1).alias("schema_version"), F.lit("voice-plan").alias("artifact"), F.lit(2).alias("revision"), "source_pdf_sha256", "cleaned_text_sha256", "chapter_plan_sha256",
        F.lit(1).alias("chapter_plan_schema_version"), _analyzer().alias("analyzer"), "cast", "aliases", kept.alias("chapters"),
        F.struct(F.lit("narrator").alias("mode"), F.lit(False).alias("accepted_by_user"), nothing.alias("accepted_at")).alias("unresolved_policy"), approval.alias("approval"),
    )
    return stored(digests.with_artifact_hash(made, artifact_rules.VOICE_PLAN_FIELDS)), bindings, parts


@_registered
def v08_voice_plan_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Voice plans with one fault a book, by its id."""
    return plan_rules.first_violations(artifact_rules.voice_plan_violations(*_voice_plans(spark, folder, F.col("book_id") % 13)))


def _edits(spark: SparkSession, folder: str) -> DataFrame:
    """An edit for most books, its kind by the book's id; some at an old revision, some of what isn't there."""
    kinds = [
        {"kind": "rename_cast", "cast_id": "user", "label": "The Reader"}, {"kind": "assign_cast", "cast_id": "user", "relationship": "same_as_narrator", "speed": 1.5}, {"kind": "merge_aliases", "cast_id": "user", "alias_ids": ["alias-assistant"]},
        {"kind": "split_aliases", "alias_ids": ["alias-user"], "label": "New One"}, {"kind": "remove_cast", "cast_id": "assistant"}, {"kind": "merge_cast", "cast_id": "assistant", "target_id": "user"}, {"kind": "override_speaker", "span_id": "span-00001", "to_value": "user", "reason": "heard"},
        {"kind": "override_type", "span_id": "span-00000", "to_value": "unknown", "actor": "tool", "reason": "odd"}, {"kind": "remove_cast", "cast_id": "narrator"}, {"kind": "merge_cast", "cast_id": "user", "target_id": "user"}, {"kind": "override_type", "span_id": "none", "to_value": "song"}, {"kind": "odd"},
    ]
    table = spark.createDataFrame([(n, *(k.get(f.split(" ")[0]) for f in edits.EDIT.split(", "))) for n, k in enumerate(kinds)], f"n int, {edits.EDIT}")
    books = tables.spans(spark, folder).select("book_id").distinct().where("book_id % 13 <> 12")
    named = books.select("book_id", (F.col("book_id") % len(kinds)).cast("int").alias("n"), F.when(F.col("book_id") % 11 == 10, 1).otherwise(2).alias("expected_revision"))
    return named.join(F.broadcast(table), "n").drop("n")  # a dozen rows


@_registered
def r02_edited_plans(spark: SparkSession, folder: str) -> DataFrame:
    plans, _, _ = _voice_plans(spark, folder, F.lit(0))
    found = stored(edits.edited(plans, _edits(spark, folder)))
    cast = F.transform("cast", lambda c: F.concat_ws(":", c["cast_id"], c["display_label"], c["relationship"], c["voice_id"], c["voice_settings"]["speed"].cast("string")))
    names = F.transform("aliases", lambda a: F.concat_ws(":", a["alias_id"], a["character_id"]))
    spans = F.transform(F.flatten(F.transform("chapters", lambda c: c["spans"])), lambda s: F.concat_ws(":", s["span_id"], s["type"], s["speaker_id"], s["override"]["kind"], s["override"]["from"], s["override"]["to"], s["override"]["actor"], s["override"]["reason"]))
    right = digests.hash_violations(found, ["book_id"], artifact_rules.VOICE_PLAN_FIELDS)
    told = found.select("book_id", "outcome", "revision", F.col("approval.state").alias("state"), F.array_join(cast, "|").alias("cast"), F.array_join(names, "|").alias("aliases"), F.sha2(F.array_join(spans, "|"), 256).alias("spans_sha256"))
    return told.join(right, "book_id", "left").withColumn("rule", F.coalesce("rule", F.lit("")))


@_registered
def r09_approved_plans(spark: SparkSession, folder: str) -> DataFrame:
    """Plans whose last span is unknown: approved ones break a rule, drafts need the narrator, whom every third book accepts."""
    plans, bindings, parts = _voice_plans(spark, folder, F.when(F.col("book_id") % 4 < 2, 14).otherwise(0))
    broken = artifact_rules.voice_plan_violations(plans, bindings, parts)
    found = stored(edits.approved(plans, broken, plans.where("book_id % 3 = 0").select("book_id"), "2026-02-03T04:05:06Z"))
    after = artifact_rules.voice_plan_violations(found.drop("outcome"), bindings, parts).groupBy("book_id").agg(F.count(F.lit(1)).alias("n_broken"))
    told = found.select("book_id", "outcome", F.col("approval.state").alias("state"), F.coalesce("approval.approved_at", F.lit("")).alias("approved_at"), F.coalesce("approval.approved_revision", F.lit(0)).alias("approved_revision"), F.col("unresolved_policy.accepted_by_user").alias("accepted"))
    return told.join(after, "book_id", "left").withColumn("n_broken", F.coalesce("n_broken", F.lit(0)))


@_registered
def a07_plan_review(spark: SparkSession, folder: str) -> DataFrame:
    return edits.review(_voice_plans(spark, folder, F.col("book_id") % 13)[0])




VOICES, LEAST_SPOKEN = ["af_one", "am_two", "bf_three", "bm_four"], 2


def _speech(spark: SparkSession, folder: str) -> DataFrame:
    """Spans whose speakers go by two names each, and a guest whom no analysis lists; short ones are left out."""
    at = F.substring("span_id", 6, 5).cast("int")
    said, guest = F.col("type") == "dialogue", (F.col("book_id") % 4 == 1) & (at % 5 == 4)
    name = F.when(said & guest, "Guest One").when(said & (at % 2 == 1), F.concat("speaker_id", F.lit("!"))).when(said & (at % 7 == 6), " Unknown ").otherwise(F.col("speaker_id"))
    return tables.spans(spark, folder).where("band <> 'low'").select(
        "book_id", at.alias("ord"), "chapter_index", "span_id", "source_start", "source_end", "type", name.alias("speaker_id"),
        F.struct(_band_score().alias("score"), "band", F.array("band").alias("reasons")).alias("confidence"), F.struct(F.lit("turns").alias("source"), F.lit(1).alias("analysis_revision")).alias("provenance"),
    )


def _listed(spark: SparkSession, folder: str) -> DataFrame:
    """Two characters for each role, whose ids make one cast id; the second isn't in every book."""
    roles = tables.spans(spark, folder).where("type = 'dialogue'").select("book_id", "speaker_id").distinct()
    order = F.row_number().over(Window.partitionBy("book_id").orderBy("speaker_id"))
    nothing = F.lit(None).cast("string")

    def alias(alias_id: Column, text: Column, kind: str) -> Column:
        return F.struct(alias_id.alias("alias_id"), text.alias("text"), F.lit(kind).alias("kind"))

    the = F.concat(F.lit("The "), F.initcap("speaker_id"))
    first = roles.select("book_id", order.alias("ord"), F.col("speaker_id").alias("character_id"), F.initcap("speaker_id").alias("label"), nothing.alias("gender"), nothing.alias("relationship"), F.array(alias(nothing, the, "proper"), alias(nothing, F.lit("she"), "pronoun")).alias("aliases"))
    second = roles.where("book_id % 3 = 0").select(
        "book_id", (order + 100).alias("ord"), F.concat("speaker_id", F.lit("!")).alias("character_id"), F.lit("X").alias("label"), F.lit("m").alias("gender"), F.lit("same_as_narrator").alias("relationship"),
        F.array(alias(F.lit("al-9"), F.concat(F.lit("Dr X "), "speaker_id"), "proper"), alias(nothing, the, "proper")).alias("aliases"),
    )
    return first.unionByName(second)


def _members(spark: SparkSession, folder: str) -> DataFrame:
    return stored(voice_plans.with_voices(voice_plans.cast_members(_listed(spark, folder), stored(_speech(spark, folder)), LEAST_SPOKEN), VOICES))


@_registered
def p06_cast_members(spark: SparkSession, folder: str) -> DataFrame:
    m = _members(spark, folder)
    return m.select("book_id", "rank", "cast_id", "source_id", "label", "relationship", F.coalesce("gender", F.lit("")).alias("gender"), "voice_id", F.array_join(F.array_sort("keys"), "|").alias("keys"))


def _names(spark: SparkSession, folder: str) -> DataFrame:
    """Aliases of the analysis itself: of a speaker's second name, and of nobody."""
    books = tables.spans(spark, folder).select("book_id").distinct()
    row = lambda n, text, who: F.struct(F.lit(n).alias("ord"), F.lit(None).cast("string").alias("alias_id"), F.lit(text).alias("text"), F.lit(who).alias("character_id"))
    return books.select("book_id", F.inline(F.array(row(0, "Chief", "user!"), row(1, "Nobody", "ghost"), row(2, "Me", "narrator"))))


@_registered
def p06_plan_aliases(spark: SparkSession, folder: str) -> DataFrame:
    found = voice_plans.plan_aliases(_members(spark, folder), _names(spark, folder))
    return found.select("book_id", "alias_id", "text", "character_id", (F.col("rank") == 1 << 30).alias("late"))


def _covered(spark: SparkSession, folder: str) -> DataFrame:
    spoken = voice_plans.planned_spans(_speech(spark, folder), voice_plans.cast_keys(_members(spark, folder)))
    return voice_plans.covered(spoken, tables.chapters(spark, folder), "rules")


@_registered
def p06_planned_spans(spark: SparkSession, folder: str) -> DataFrame:
    found = _covered(spark, folder)
    return found.select("book_id", "chapter_index", "span_id", "source_start", "source_end", "type", "speaker_id", F.array_join("confidence.reasons", "|").alias("reasons"))


@_registered
def p06_draft_plans(spark: SparkSession, folder: str) -> DataFrame:
    """Whole drafts, and how many rules each breaks: only books with an empty turn or without a cast of two voices do."""
    bindings, parts = _bindings(spark, folder)
    members = _members(spark, folder)
    plans = stored(voice_plans.draft_plans(members, voice_plans.plan_aliases(members, _names(spark, folder).where("ord = 0")), _covered(spark, folder), parts, bindings, VOICES[0], "rules"))
    found = artifact_rules.voice_plan_violations(plans, bindings, parts).groupBy("book_id").agg(F.count(F.lit(1)).alias("n_broken"))
    spans = F.aggregate("chapters", F.lit(0), lambda n, c: n + F.size(c["spans"]))
    facts = plans.select("book_id", F.size("cast").alias("n_cast"), F.size("aliases").alias("n_aliases"), F.size("chapters").alias("n_chapters"), spans.alias("n_spans"))
    return facts.join(found, "book_id", "left").withColumn("n_broken", F.coalesce("n_broken", F.lit(0)))


@_registered
def f03_damaged_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Books with pages that can't be read: empty ones, some with images, pages in other scripts, and whole books without a word."""
    kind, number = F.col("book_id") % 5, F.col("number")
    odd = F.when(((kind == 1) & (number % 7 == 0)) | (kind == 3), "").when(((kind == 2) & (number == 2)) | ((F.col("book_id") % 10 == 4) & (number % 2 == 0)), "漢字").when((kind == 0) & (number % 7 == 0), "only two")
    listed = tables.pages(spark, folder).withColumn("text", F.coalesce(odd, "text"))
    worded = listed.withColumn("words", T.ascii_word_count(F.col("text")))
    classed = worded.withColumn("classification", T.page_class(F.col("words"), F.col("number") % 7 == 0, F.col("text").rlike(r"\p{L}")))
    return pages.coverage_violations(classed).select("book_id", "rule", F.array_join("pages", ",").alias("pages"))
