"""Digests of artifacts by their canonical JSON: attached, compared, and composed for caches.

An artifact is a row; its fields are columns of any depth. What a digest covers is decided by names
alone: all fields but the one that holds the digest itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrata.functions.canonical import canonical_json
from narrata.operators.rules import SHA256

#: The field of an artifact's digest, that of a reference's, and settings of a voice that has none.
ARTIFACT_HASH, DESCRIPTOR_HASH = "canonical_artifact_sha256", "descriptor_sha256"
TONES = ("neutral", "warm", "bright")
#: The text that previews speak, and its version.
PREVIEW_TEXT, PREVIEW_TEXT_VERSION = "This is a short voice preview for your audiobook.", "preview-text-v1"


def canonical_row(rows: DataFrame, fields: Sequence[str], newline: bool = False) -> Column:
    """The canonical JSON of some columns of a row as one object, with a line feed after it or not."""
    kind = rows.select(*fields).schema
    text = canonical_json(F.struct(*fields), kind)
    return F.concat(text, F.lit("\n")) if newline else text


def digest(rows: DataFrame, fields: Sequence[str], newline: bool = False) -> Column:
    """SHA-256 of the canonical JSON of some columns; null if they hold a number that isn't finite."""
    return F.sha2(canonical_row(rows, fields, newline), 256)


def with_artifact_hash(artifacts: DataFrame, fields: Sequence[str], field: str = ARTIFACT_HASH) -> DataFrame:
    """Artifacts with the digest of their ``fields``; a digest among these is left out."""
    return artifacts.withColumn(field, digest(artifacts, [f for f in fields if f != field], newline=True))


def hash_violations(artifacts: DataFrame, keys: Sequence[str], fields: Sequence[str], field: str = ARTIFACT_HASH) -> DataFrame:
    """``(keys, rule)``: artifacts without a canonical form, without a digest of the right form, or whose digest is of something else."""
    computed = digest(artifacts, [f for f in fields if f != field], newline=True)
    given = F.col(field)
    rule = (
        F.when(F.col("_computed").isNull(), "INVALID_ARTIFACT")
        .when(~F.coalesce(given.rlike(SHA256), F.lit(False)), "INVALID_ARTIFACT_HASH")
        .when(given != F.col("_computed"), "ARTIFACT_HASH_MISMATCH")
    )
    return artifacts.withColumn("_computed", computed).select(*keys, rule.alias("rule")).where("rule is not null")


def _settings_rule() -> Column:
    """What is wrong with a voice's settings; a voice with a speed alone is an old one and is right."""
    old = F.col("pitch_semitones").isNull() & F.col("tone_preset").isNull()
    speed = F.col("speed").cast("double")
    return (
        F.when(~old & (F.col("pitch_semitones").isNull() | F.col("tone_preset").isNull()), "INVALID_VOICE_SETTINGS")
        .when(~F.coalesce(speed.between(0.5, 2.0), F.lit(False)), "INVALID_SPEED")
        .when(~old & ~F.col("pitch_semitones").between(-3, 3), "INVALID_PITCH")
        .when(~old & ~F.col("tone_preset").isin(*TONES), "INVALID_TONE")
    )


def settings_violations(voices: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, rule)`` of voice settings: speed, pitch_semitones, tone_preset."""
    return voices.select(*keys, _settings_rule().alias("rule")).where("rule is not null")


def canonical_settings() -> Column:
    """The settings of a voice in full, or null if they are wrong: an old one's pitch is 0 and its tone neutral."""
    full = F.struct(
        F.coalesce(F.col("pitch_semitones"), F.lit(0)).cast("int").alias("pitch_semitones"), F.col("speed").cast("double").alias("speed"), F.coalesce("tone_preset", F.lit(TONES[0])).alias("tone_preset"),
    )
    return F.when(_settings_rule().isNull(), full)


def with_settings_digest(voices: DataFrame) -> DataFrame:
    """Voices with the digest of their settings (``settings_sha256``); wrong settings have none."""
    named = voices.withColumn("_settings", canonical_settings())
    text = canonical_json(F.col("_settings"), named.schema["_settings"].dataType)
    return named.withColumn("settings_sha256", F.when(F.col("_settings").isNotNull(), F.sha2(text, 256))).drop("_settings")


def with_preview_key(voices: DataFrame, facts: str, shaping: str) -> DataFrame:
    """Voices with the key of their preview (``preview_key``): it changes with the voice, its settings, its facts (a struct column), the text and the shaping."""
    rows = voices.withColumns({
        "voice": F.col("voice_id"), "settings": canonical_settings(), "generation_facts": F.col(facts), "text": F.lit(PREVIEW_TEXT),
        "text_version": F.lit(PREVIEW_TEXT_VERSION), "shaping_fingerprint": F.lit(shaping),
    })
    key = digest(rows, ["voice", "settings", "generation_facts", "text", "text_version", "shaping_fingerprint"])
    return rows.withColumn("preview_key", F.when(F.col("settings").isNotNull(), key)).select(*voices.columns, "preview_key")


def with_descriptor_hash(descriptors: DataFrame, fields: Sequence[str], field: str = DESCRIPTOR_HASH) -> DataFrame:
    """Descriptors of references with the digest of their other fields, without a line feed."""
    return descriptors.withColumn(field, digest(descriptors, [f for f in fields if f != field]))


#: Fields of a spoken chunk that decide what it sounds like, and those of the plan round it.
AUDIO_FIELDS = (
    "mode", "chapter_index", "source_start", "source_end", "text", "span_id", "segment_type", "speaker_id", "voice_id", "voice_settings", "generation_facts", "chunk_cap",
    "boundary_policy", "shaping_fingerprint",
)
PLAN_FIELDS = ("voice_plan_canonical_hash", "voice_plan_revision", "registry_revision")


def with_interactive_hashes(chunks: DataFrame, voices: DataFrame, plans: DataFrame, cap: int, shaping: str, registry: str) -> DataFrame:
    """Chunks with ``audio_input_hash``, and ``input_hash`` that covers the plan round them too.

    ``chunks``: book_id, chapter_index, source_start, source_end, text, span_id, segment_type,
    speaker_id, voice_id; ``voices``: book_id, speaker_id, voice_settings and generation_facts (structs);
    ``plans``: book_id, voice_plan_canonical_hash, voice_plan_revision. A chunk whose speaker has no
    entry goes, since nobody can speak it.
    """
    met = chunks.join(voices.select("book_id", "speaker_id", "voice_settings", "generation_facts"), ["book_id", "speaker_id"])
    met = met.join(plans.select("book_id", *PLAN_FIELDS[:2]), "book_id").withColumns({
        "mode": F.lit("interactive_voices"), "chunk_cap": F.lit(cap), "boundary_policy": F.lit("sentence_paragraph_safe"),
        "shaping_fingerprint": F.lit(shaping), "registry_revision": F.lit(registry),
    })
    hashed = met.withColumns({"audio_input_hash": digest(met, AUDIO_FIELDS), "input_hash": digest(met, AUDIO_FIELDS + PLAN_FIELDS)})
    return hashed.select(*chunks.columns, "audio_input_hash", "input_hash")


def reuse_audio(plan: DataFrame, completed: DataFrame) -> DataFrame:
    """The chunks of a plan with the audio that is there already: ``wav_sha256`` and ``duration_seconds``, null where it has to be spoken.

    A recorded chunk serves a planned one at the same place (book, chapter, global and local index) with
    the same audio digest, whatever plan it was made for; all but the audio is the plan's. Of several
    records that serve, the last of the log (``ord``) counts; records without a digest of their file or
    with no duration serve none.
    """
    place = ["book_id", "chapter_index", "global_index", "local_index", "audio_input_hash"]
    sound = completed.where(F.col("wav_sha256").rlike(SHA256) & (F.col("duration_seconds") > 0))
    last = sound.groupBy(*place).agg(F.max_by(F.struct("wav_sha256", "duration_seconds"), "ord").alias("audio"))
    return plan.join(last, place, "left").select(*[plan[c] for c in plan.columns], "audio.wav_sha256", "audio.duration_seconds")


def moved_audio(plan: DataFrame, completed: DataFrame, text_digest: str = "spoken_sha256") -> DataFrame:
    """The same where a plan's chunks may have moved: audio is found by what is spoken and how (``text_digest``), not where.

    Many places may share one digest, and each gets the audio of the least of those recorded.
    """
    sound = completed.where(F.col("wav_sha256").rlike(SHA256) & (F.col("duration_seconds") > 0))
    audio = sound.groupBy("book_id", text_digest).agg(F.min_by(F.struct("wav_sha256", "duration_seconds"), F.struct("global_index", "ord")).alias("audio"))
    return plan.join(audio, ["book_id", text_digest], "left").select(*[plan[c] for c in plan.columns], "audio.wav_sha256", "audio.duration_seconds")
