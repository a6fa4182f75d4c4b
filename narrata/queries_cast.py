"""Registered queries of chunks, cast, plan revisions, verification and incremental work."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from narrata.operators import boundaries, cast, chapters, chunks, offsets, rules, verification
from narrata.plans.revisions import OVERRIDE, Plan, collisions
from narrata.queries import _plan, _registered
from narrata.sources import tables
from narrata.sources.shared import shared_folder, stored
from narrata.streaming import resume

#: Characters of a chunk, and the settings that chunk hashes cover.
CAP = 300
SETTINGS = {"engine": "fake", "settings": {"speed": 1.0}}
#: A narrator's and three other voices; the second letter of an id is the voice's gender.
VOICES = ["af_one", "am_two", "bf_three", "bm_four"]
LEAST_QUOTES = 2


def _chapter_texts(spark: SparkSession, folder: str) -> DataFrame:
    plan, books = _plan(spark, folder)
    text = F.expr("substring(text, start_offset + 1, end_offset - start_offset)")
    return plan.join(books, "book_id").select("book_id", F.col("index").alias("chapter_index"), "start_offset", text.alias("text"))


def _digest(rows: DataFrame) -> DataFrame:
    return rows.withColumn("text", F.sha2("text", 256)).withColumnRenamed("text", "text_sha256")


@_registered
def p03_sentence_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return _digest(chunks.sentence_chunks(_chapter_texts(spark, folder), CAP))


@_registered
def p04_paragraph_chunks(spark: SparkSession, folder: str) -> DataFrame:
    # Lines of the corpus are its paragraphs: it has no blank lines.
    spread = _chapter_texts(spark, folder).withColumn("text", F.regexp_replace("text", "\n+", "\n\n"))
    return _digest(chunks.paragraph_chunks(spread, CAP))


@_registered
def p04_chapter_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return _digest(chunks.chapter_chunks(_chapter_texts(spark, folder)))


def _interactive(spark: SparkSession, folder: str) -> DataFrame:
    members = voice_plan(spark, folder).cast.select("book_id", "cast_id", "voice_id")
    return chunks.interactive_chunks(tables.spans(spark, folder), members, 200, 1, {"engine": "fake"})


@_registered
def p05_interactive_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return _digest(_interactive(spark, folder))


@_registered
def j18_plan_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Recorded chunks are one a turn, so that books whose turns are all short match their plan by place."""
    planned = _interactive(spark, folder).withColumn("input_hash", F.sha2("text", 256))
    turns = tables.turns(spark, folder).withColumn("local_index", (F.col("ordinal") % tables.TURNS_A_CHAPTER).cast("int"))
    recorded = turns.select("book_id", F.col("ordinal").cast("int").alias("global_index"), "chapter_index", "local_index", F.sha2("text", 256).alias("input_hash"))
    return chunks.plan_matches(recorded, planned)


@_registered
def p01_custom_plan(spark: SparkSession, folder: str) -> DataFrame:
    return chapters.custom_plan(_plan(spark, folder)[1], 3)


@_registered
def p01_short_chapters(spark: SparkSession, folder: str) -> DataFrame:
    plan, books = _plan(spark, folder)
    return chapters.short_chapters(chapters.with_words(plan, books))


def _tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Blank-separated words of turns as analyzer tokens, numbered through the book."""
    t = tables.turns(spark, folder).select("book_id", "ordinal", F.posexplode(F.split("text", " ")).alias("pos", "word"))
    order = Window.partitionBy("book_id").orderBy("ordinal", "pos")
    gap = F.when(F.col("pos") == 0, "").otherwise(" ")
    return t.select("book_id", "ordinal", (F.row_number().over(order) - 1).cast("long").alias("token_id"), "word", gap.alias("gap"))


@_registered
def w13_token_offsets(spark: SparkSession, folder: str) -> DataFrame:
    return offsets.token_offsets(_tokens(spark, folder))


@_registered
def j08_quote_places(spark: SparkSession, folder: str) -> DataFrame:
    tokens = _tokens(spark, folder)
    quotes = tokens.groupBy("book_id", F.col("ordinal").alias("quote_id")).agg(F.min("token_id").alias("start_token"), F.max("token_id").alias("end_token"))
    return offsets.quote_places(quotes, offsets.token_offsets(tokens))


@_registered
def w11_without_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    """Turns stretched by a tenth of their length run over the next one's beginning."""
    t = tables.turns(spark, folder)
    return offsets.without_overlaps(t.select("book_id", "source_start", (F.col("source_end") + F.floor(F.length("text") / 10)).alias("source_end"), F.col("ordinal").alias("quote_id")))


@_registered
def t15_sentence_starts(spark: SparkSession, folder: str) -> DataFrame:
    found = tables.books(spark, folder).select("book_id", boundaries.sentence_start_column(F.col("text")).alias("at"))
    return found.select("book_id", F.size("at").alias("n"), F.sha2(F.array_join("at", ","), 256).alias("at_sha256"))


@_registered
def t17_word_starts(spark: SparkSession, folder: str) -> DataFrame:
    found = tables.books(spark, folder).select("book_id", boundaries.word_start_column(F.col("text")).alias("at"))
    return found.select("book_id", F.size("at").alias("n"), F.coalesce(F.try_element_at("at", F.lit(1)), F.lit(-1)).alias("first"))


@_registered
def t19_flowed_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    found = tables.paged_books(spark, folder).select("book_id", boundaries.flowed_column(F.col("text")).alias("p"))
    return found.select("book_id", F.size("p").alias("n"), F.sha2(F.array_join("p", "\n"), 256).alias("p_sha256"))


@_registered
def t44_input_hash(spark: SparkSession, folder: str) -> DataFrame:
    turns = tables.turns(spark, folder).select("book_id", "ordinal", "text")
    return chunks.with_input_hash(turns, SETTINGS).select("book_id", "ordinal", "input_hash")


def _reused(spark: SparkSession, folder: str) -> DataFrame:
    """Turns are the planned chunks; system turns aren't completed yet, and some had another text."""
    turns = tables.turns(spark, folder)
    plan = turns.select("book_id", "role", "chapter_index", F.col("ordinal").alias("global_index"), (F.col("ordinal") % tables.TURNS_A_CHAPTER).alias("local_index"), F.sha2("text", 256).alias("input_hash"))
    done = plan.where("role <> 'system'").withColumn("input_hash", F.when(F.col("input_hash") < "2", F.lit("other")).otherwise(F.col("input_hash")))
    return chunks.reuse(plan.drop("role"), done)


@_registered
def j16_reuse(spark: SparkSession, folder: str) -> DataFrame:
    return _reused(spark, folder)


@_registered
def a11_chapter_completion(spark: SparkSession, folder: str) -> DataFrame:
    return chunks.chapter_completion(_reused(spark, folder))


def _characters(spark: SparkSession, folder: str) -> DataFrame:
    roles = tables.spans(spark, folder).where("type = 'dialogue'").select("book_id", "speaker_id").distinct()
    return roles.select(
        "book_id", F.when(F.col("speaker_id") == "user", 1).otherwise(2).alias("ord"), F.col("speaker_id").alias("character_id"), F.initcap("speaker_id").alias("label"),
        F.when((F.col("book_id") % 3 == 0) & (F.col("speaker_id") == "user"), "female").alias("gender"), F.array("speaker_id", F.initcap("speaker_id")).alias("keys"),
    )


def _cast(spark: SparkSession, folder: str) -> DataFrame:
    return cast.resolve_cast(tables.spans(spark, folder), _characters(spark, folder), VOICES, LEAST_QUOTES)


@_registered
def p06_cast(spark: SparkSession, folder: str) -> DataFrame:
    return _cast(spark, folder).select("book_id", "cast_id", "label", "n_spans", F.coalesce("gender", F.lit("")).alias("gender"), "voice_id")


@_registered
def j12_speakers_to_cast(spark: SparkSession, folder: str) -> DataFrame:
    keys = _cast(spark, folder).select("book_id", F.lower("label").alias("speaker_id"), "cast_id")
    return cast.speakers_to_cast(tables.spans(spark, folder), keys)


def _aliases(spark: SparkSession, folder: str) -> DataFrame:
    """First words of turns as aliases of their speakers, their kinds by rule; pronouns go by book and turn."""
    t = tables.turns(spark, folder)
    kind = F.when(F.col("ordinal") % 3 == 0, "proper").when(F.col("ordinal") % 3 == 1, "nominal").otherwise("pronoun")
    word = F.element_at(F.split("text", " "), 1)
    pronoun = F.when(F.col("book_id") % 2 == 0, "She").when(F.col("ordinal") % 2 == 0, "he").otherwise("her")
    return t.select("book_id", F.col("role").alias("character_id"), F.col("ordinal").alias("ord"), F.when(kind == "pronoun", pronoun).otherwise(word).alias("alias"), kind.alias("kind"))


@_registered
def a13_canonical_labels(spark: SparkSession, folder: str) -> DataFrame:
    return cast.canonical_labels(_aliases(spark, folder))


@_registered
def a15_character_genders(spark: SparkSession, folder: str) -> DataFrame:
    return cast.character_genders(_aliases(spark, folder)).select("book_id", "character_id", F.coalesce("gender", F.lit("")).alias("gender"))


def voice_plan(spark: SparkSession, folder: str) -> Plan:
    """The plans of all conversations: a narrator and a member for each role."""
    t = tables.spans(spark, folder).select("book_id", "span_id", "type", "speaker_id", F.lit(None).cast(OVERRIDE).alias("override"))
    members = t.select("book_id", F.col("speaker_id").alias("cast_id")).union(t.select("book_id", F.lit("narrator"))).distinct()
    own = F.col("cast_id") == "narrator"
    table = members.select(
        "book_id", "cast_id", F.initcap("cast_id").alias("display_label"), F.when(own, "narrator").otherwise("character").alias("role"),
        F.when(own, "third_person").otherwise("separate_from_narrator").alias("relationship"), F.when(own | (F.col("book_id") % 4 == 1), VOICES[0]).otherwise(VOICES[1]).alias("voice_id"),
    )
    aliases = table.where("role = 'character'").select("book_id", F.concat(F.lit("alias-"), "cast_id").alias("alias_id"), F.col("display_label").alias("text"), F.col("cast_id").alias("character_id"))
    return Plan(table, aliases, t, 1)


def _span_rows(plan: Plan) -> DataFrame:
    o = F.col("override")
    return plan.spans.select("book_id", "span_id", "type", "speaker_id", F.coalesce(F.concat_ws("|", o["kind"], o["from"], o["to"], o["reason"]), F.lit("")).alias("override"))


@_registered
def r06_remove_cast(spark: SparkSession, folder: str) -> DataFrame:
    return _span_rows(voice_plan(spark, folder).remove_cast("assistant", 1))


@_registered
def r07_merge_cast(spark: SparkSession, folder: str) -> DataFrame:
    return _span_rows(voice_plan(spark, folder).merge_cast("assistant", "user", 1))


@_registered
def r08_override_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Short spans are given to the user, and spans of middle length are made unknown."""
    plan = voice_plan(spark, folder)
    short = F.col("band") == "low"
    changes = tables.spans(spark, folder).where("band <> 'high'").select(
        "book_id", "span_id", F.when(short, "speaker").otherwise("type").alias("kind"), F.when(short, "user").otherwise("unknown").alias("to"), F.lit("user").alias("actor"), F.lit("review").alias("reason")
    )
    return _span_rows(plan.override_spans(changes, 1))


@_registered
def a07_voice_collisions(spark: SparkSession, folder: str) -> DataFrame:
    return collisions(voice_plan(spark, folder).cast)


def _records(spark: SparkSession, folder: str) -> DataFrame:
    n = F.substring("span_id", 6, 5).cast("int")
    decision = F.when(n % 4 == 0, "correct_primary").when(n % 4 == 1, "override_primary").when(n % 4 == 2, "ambiguous").otherwise("unresolved")
    said = tables.spans(spark, folder)
    return verification.decision_records(said.select("book_id", "span_id", F.col("speaker_id").alias("original_speaker_id"), F.lit("user").alias("proposed_speaker_id"), decision.alias("decision")))


@_registered
def r11_decision_records(spark: SparkSession, folder: str) -> DataFrame:
    return _records(spark, folder).withColumn("effective_speaker_id", F.coalesce("effective_speaker_id", F.lit("")))


@_registered
def a08_verification_summary(spark: SparkSession, folder: str) -> DataFrame:
    return verification.summary(_records(spark, folder))


@_registered
def i09_stage_counts(spark: SparkSession, folder: str) -> DataFrame:
    return resume.stage_counts(tables.status_log(spark, folder)).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("hour"), "stage", "reports")


@_registered
def i01_resumed_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Turns as a stream of chunks, spoken by the test voice; the stream is run again and finds nothing to do."""
    from narrata.operators.timeline import spoken_frames

    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    tables.turns(spark, folder).select("text", F.sha2("text", 256).alias("input_hash")).write.parquet(f"{base}/in")

    def speak(rows: DataFrame) -> DataFrame:
        return rows.select("input_hash", spoken_frames(F.col("text"), 24_000).alias("frames"))

    for _ in range(2):
        resume.speak_new_chunks(spark, f"{base}/in", "text string, input_hash string", f"{base}/done", f"{base}/checkpoint", speak)
    return spark.read.parquet(f"{base}/done").select("input_hash", "frames")




@_registered
def v09_cast_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as plans in which only roles that speak are cast: books without a system turn lack a narrator."""
    lines = tables.spans(spark, folder).select("book_id", "speaker_id")
    roles = lines.distinct().where("speaker_id <> 'assistant'")
    members = roles.select(
        "book_id", F.col("speaker_id").alias("cast_id"), F.when(F.col("speaker_id") == "narrator", "narrator").otherwise("character").alias("role"),
        F.lit("same_as_narrator").alias("relationship"), F.when(F.col("speaker_id") == "narrator", VOICES[0]).otherwise(VOICES[1]).alias("voice_id"),
    )
    return rules.cast_violations(members, lines)


@_registered
def v12_record_rules(spark: SparkSession, folder: str) -> DataFrame:
    records = _records(spark, folder).withColumns({"alternative_speaker_id": F.lit(None).cast("string"), "confidence": F.lit(0.5)})
    return rules.violations(records, ["book_id", "span_id"], rules.record_rules())


@_registered
def v13_chunk_log(spark: SparkSession, folder: str) -> DataFrame:
    """Turns as a log of completed chunks in the order of their hashes; the total is what has at least 60 characters."""
    t = tables.turns(spark, folder)
    total = F.count_if(F.length("text") >= 60).over(Window.partitionBy("book_id"))
    log = t.select(
        "book_id", F.sha2("text", 256).alias("input_hash"), "chapter_index", F.col("ordinal").alias("global_index"), F.lit(0).alias("local_index"),
        (F.length("text") / 15.0).alias("duration_seconds"), total.alias("total_chunks"), F.struct(F.sha2("text", 256), F.col("ordinal")).alias("ord"),
    )
    return rules.chunk_log_violations(log)
