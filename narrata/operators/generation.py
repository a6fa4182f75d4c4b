"""Generations of audio: what is recorded against what is planned, and manifests of several versions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from narrata.functions.text import chunk_path
from narrata.operators.plan_rules import Check, broken
from narrata.operators.rules import SHA256, TIMESTAMP

#: Versions of manifests (1 and 3 are read and made into 2 and 4), statuses at which settings may change, kinds of spoken spans.
OLD_JOB, JOB, OLD_GENERATION, GENERATION, INTERACTIVE = 1, 2, 3, 4, 5
OPEN, ACTIVE = ("planned", "analyzed", "pending", "cancelled", "failed"), ("synthesizing", "cancelling")
SEGMENTS = ("narration", "dialogue", "thought", "unknown")
#: The fields of manifests and of their completed chunks, by what each version adds.
_JOB = "schema_version conversion_id original_display_filename source_pdf_sha256 status stage created_at updated_at cleaned_text_sha256 warnings error".split()
_SPEECH = "tts total_chunks completed_chunks progress worker last_safe_error".split()
_BINDING = "mode voice_plan_sha256 voice_plan_revision speaker_analysis_sha256 cast_voice_ids voice_registry_revision".split()
_CHUNK = "chapter_index global_index local_index input_hash relative_path duration_seconds".split()
_SPOKEN = "audio_input_hash span_id speaker_id voice_id segment_type source_start source_end".split()
FIELDS = {
    OLD_JOB: _JOB, JOB: [*_JOB, "chapter_plan_sha256"], OLD_GENERATION: [*_JOB, "chapter_plan_sha256", *_SPEECH], GENERATION: [*_JOB, "chapter_plan_sha256", *_SPEECH, "output"],
    INTERACTIVE: [*_JOB, "chapter_plan_sha256", *_SPEECH, "output", *_BINDING],
}
CHUNK_FIELDS = {OLD_GENERATION: _CHUNK, GENERATION: [*_CHUNK, "wav_sha256"], INTERACTIVE: [*_CHUNK, "wav_sha256", *_SPOKEN]}
#: The digest of a sound file that is not there.
NO_FILE = "0" * 64
_RECORD = (
    "chapter_index:int,global_index:int,local_index:int,input_hash:string,relative_path:string,duration_seconds:double,wav_sha256:string,audio_input_hash:string,span_id:string,speaker_id:string,"
    "voice_id:string,segment_type:string,source_start:long,source_end:long"
)
MANIFEST = (
    "schema_version int, conversion_id string, original_display_filename string, source_pdf_sha256 string, status string, stage string, created_at string, updated_at string, cleaned_text_sha256 string, chapter_plan_sha256 string,"
    " warnings array<string>, error string, tts struct<engine:string,voice:string,speed:double,sample_rate:int,chunk_cap:int>, total_chunks int,"
    f" completed_chunks array<struct<{_RECORD}>>, progress struct<completed:int,current:int,total:int>, worker struct<pid:int,started_at:string,updated_at:string>, last_safe_error string,"
    " output struct<filename:string,path:string,size_bytes:long,duration_seconds:double,chapter_count:int,codec:string,sha256:string>, mode string, voice_plan_sha256 string, voice_plan_revision int,"
    " speaker_analysis_sha256 string, cast_voice_ids array<string>, voice_registry_revision string"
)


def recorded_chunks(plan: DataFrame, records: DataFrame, audio: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``(book_id, position, matches)``: plan, log and files side by side, place by place.

    ``plan``: book_id, global_index, chapter_index, local_index and ``fields``; ``records``: the same with
    ord (its place in the log), relative_path and wav_sha256; ``audio``: book_id, relative_path, sha256,
    duration_seconds. The n-th record has to be the n-th chunk, under the path of its chapter and number,
    with the digest of the file that lies there and some duration. A place that only one side has doesn't match.
    """
    by_plan = Window.partitionBy("book_id").orderBy("global_index")
    by_log = Window.partitionBy("book_id").orderBy("ord")
    same = ("global_index", "chapter_index", "local_index", *fields)
    p = plan.select("book_id", (F.row_number().over(by_plan) - 1).alias("position"), F.struct(*same).alias("p"), chunk_path(F.col("chapter_index"), F.col("local_index")).alias("path"))
    r = records.select("book_id", (F.row_number().over(by_log) - 1).alias("position"), F.struct(*same).alias("r"), "relative_path", "wav_sha256")
    a = audio.select("book_id", "relative_path", "sha256", "duration_seconds")
    met = p.join(r, ["book_id", "position"], "full").join(a, ["book_id", "relative_path"], "left")
    holds = (F.col("p") == F.col("r")) & (F.col("relative_path") == F.concat(F.lit("chunks/"), F.col("path"))) & (F.col("wav_sha256") == F.col("sha256")) & (F.col("duration_seconds") > 0)
    return met.select("book_id", "position", F.coalesce(F.col("p.chapter_index"), F.col("r.chapter_index")).alias("chapter_index"), F.col("p").isNotNull().alias("is_planned"), F.coalesce(holds, F.lit(False)).alias("matches"))


def generation_summary(matched: DataFrame) -> DataFrame:
    """Per book: chunks planned, how many are done before the first that doesn't match, chapters done in full, and the one that is next (the last if all are).

    The first mismatch voids all that follows it.
    """
    first = F.min(F.when(~F.col("matches"), F.col("position"))).over(Window.partitionBy("book_id"))
    kept = matched.withColumn("first_mismatch", first).withColumn("done", F.col("first_mismatch").isNull() | (F.col("position") < F.col("first_mismatch")))
    chapters = kept.where("is_planned").groupBy("book_id", "chapter_index").agg(F.bool_and("done").alias("complete"), F.count_if("done").alias("n_done"), F.count(F.lit(1)).alias("n"), F.max("first_mismatch").alias("first_mismatch"))
    return chapters.groupBy("book_id").agg(
        F.sum("n").alias("total_chunks"), F.sum("n_done").alias("completed_chunks"), F.count(F.lit(1)).alias("total_chapters"), F.count_if("complete").alias("completed_chapters"),
        F.coalesce(F.min(F.when(~F.col("complete"), F.col("chapter_index"))), F.max("chapter_index")).alias("current_chapter"), F.max("first_mismatch").alias("first_mismatch"),
    )


def bound_summary(plan: DataFrame, records: DataFrame, manifests: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Per manifest (book_id, total_chunks, stage): its progress, or none with the reason.

    Records may come in any order here, but each has to be the planned chunk of its global index, and the
    manifest has to count as many chunks as the plan.
    """
    same = ("chapter_index", "local_index", *fields)
    p = plan.select("book_id", "global_index", "chapter_index", F.struct(*same).alias("p"), F.concat(F.lit("chunks/"), chunk_path(F.col("chapter_index"), F.col("local_index"))).alias("path"))
    r = records.select("book_id", "global_index", F.struct(*same).alias("r"), "relative_path")
    met = p.join(r, ["book_id", "global_index"], "full")
    good = F.coalesce((F.col("p") == F.col("r")) & (F.col("path") == F.col("relative_path")), F.lit(False))
    chunk = met.groupBy("book_id", "global_index").agg(F.first("chapter_index", True).alias("chapter_index"), F.bool_or(F.col("r").isNotNull()).alias("recorded"), F.bool_and(F.col("r").isNull() | good).alias("fits"), F.bool_or(F.col("p").isNotNull()).alias("is_planned"))
    chapters = chunk.groupBy("book_id", "chapter_index").agg(F.bool_and("recorded").alias("complete"), F.count_if("is_planned").alias("n"), F.count_if("recorded").alias("n_done"), F.bool_and("fits").alias("fits"))
    own = F.col("chapter_index").isNotNull()
    facts = chapters.groupBy("book_id").agg(
        F.sum("n").alias("planned"), F.sum("n_done").alias("completed_chunks"), F.count_if(own).alias("total_chapters"), F.count_if(own & F.col("complete")).alias("completed_chapters"),
        F.coalesce(F.min(F.when(~F.col("complete"), F.col("chapter_index"))), F.max("chapter_index")).alias("current_chapter"), F.bool_and("fits").alias("fits"),
    )
    found = manifests.join(facts, "book_id", "left")
    reason = F.when(F.col("planned").isNull(), "no_plan").when(F.col("planned") != F.col("total_chunks"), "total").when(~F.col("fits"), "record")
    told = [F.when(reason.isNull(), F.col(x)).alias(x) for x in ("completed_chunks", "total_chapters", "completed_chapters", "current_chapter")]
    return found.select("book_id", "stage", "total_chunks", *told, F.coalesce(reason, F.lit("")).alias("reason"))


def read_manifests(rows: DataFrame) -> DataFrame:
    """Manifests (book_id, manifest as JSON text) of all versions in one schema, in one scan; fields that a version lacks are null."""
    return rows.select("book_id", "manifest", F.from_json("manifest", MANIFEST).alias("m")).select("book_id", "manifest", "m.*")


def upgraded(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Manifests as versions 2, 4 and 5: a job gets an empty place for its chapter plan, an old generation the digests of its files.

    ``files``: book_id, relative_path, sha256. A file that isn't there has a digest of zeros, so that its
    chunk is spoken again. ``from_version`` tells what a manifest was; unknown versions are left out.
    """
    there = files.groupBy("book_id").agg(F.map_from_entries(F.collect_list(F.struct("relative_path", "sha256"))).alias("there"))
    old = F.col("schema_version") == OLD_GENERATION
    found = F.transform("completed_chunks", lambda c: c.withField("wav_sha256", F.coalesce(F.try_element_at("there", c["relative_path"]), F.lit(NO_FILE))))
    read = read_manifests(rows).where(F.col("schema_version").isin(*FIELDS)).join(there, "book_id", "left")
    to = F.when(F.col("schema_version") == OLD_JOB, JOB).when(old, GENERATION).otherwise(F.col("schema_version"))
    new = {"from_version": F.col("schema_version"), "completed_chunks": F.when(old, found).otherwise(F.col("completed_chunks")), "schema_version": to}
    return read.withColumns(new).drop("there", "manifest")


def _keys_are(keys: Column, fields: dict[int, list[str]]) -> Column:
    """Whether an object has just the fields of its version."""
    out = F.lit(None).cast("boolean")
    for version, names in fields.items():
        out = F.when(F.col("schema_version") == version, F.array_sort(keys) == F.array(*map(F.lit, sorted(names)))).otherwise(out)
    return out


def _rising(records: Column, rises: Callable[[Column, Column], Column]) -> Column:
    """Whether each record and the one before it are in order."""
    return F.forall(F.filter(F.transform(records, lambda r, i: F.when(i > 0, rises(F.get(records, i - 1), r)).otherwise(True)), lambda x: x.isNotNull()), lambda x: x)


def manifest_violations(rows: DataFrame) -> DataFrame:
    """``(book_id, code, rule, path)`` of manifests (book_id, manifest as JSON text): unknown versions, and what each version may not say.

    Generations count their chunks right, in order and under their folder; a completed one has all of them,
    and output facts if and only if its stage is final. Interactive ones are bound to a plan, an analysis and
    a cast, whose voices their chunks have.
    """
    c, version = F.col, F.col("schema_version")
    read = read_manifests(rows).withColumns({
        "keys": F.json_object_keys("manifest"), "chunk_keys": F.transform(F.from_json(F.get_json_object("manifest", "$.completed_chunks"), "array<map<string,string>>"), lambda x: F.map_keys(x)),
    })
    known, speaks, recorded, plays = (F.coalesce(version.isin(*some), F.lit(False)) for some in (FIELDS, CHUNK_FIELDS, (GENERATION, INTERACTIVE), (INTERACTIVE,)))
    chunks, n = c("completed_chunks"), F.coalesce(F.size("completed_chunks"), F.lit(0))
    each = lambda holds: F.forall(chunks, lambda r: F.coalesce(holds(r), F.lit(False)))
    done, final = c("status") == "completed", c("stage") == "completed"
    at = lambda field: F.lit("$." + field)
    parts = lambda r: F.split(r["relative_path"], "/")
    own_keys = F.lit(True)
    for v, names in CHUNK_FIELDS.items():
        wanted = F.array(*map(F.lit, sorted(names)))
        own_keys = F.when(version == v, F.size(F.array_compact(F.transform("chunk_keys", lambda k: F.nullif(F.array_sort(k), wanted)))) == 0).otherwise(own_keys)  # noqa: B023  (called at once)
    ids = lambda value: (value != "") & (F.length(value) <= 512) & ~value.rlike(r"[\x00-\x1f]")

    def of_generations(rule: str, field: str, holds: Column) -> Check:
        return ("INVALID_MANIFEST", rule, at(field), ~speaks | holds)

    def of_interactive(rule: str, field: str, holds: Column) -> Check:
        return ("INVALID_MANIFEST", rule, at(field), ~plays | holds)

    return broken(read, ["book_id"], [
        ("MALFORMED_MANIFEST", "json", F.lit("$"), c("keys").isNotNull()),
        ("UNSUPPORTED_SCHEMA", "version", at("schema_version"), known | c("keys").isNull()),
        ("INVALID_MANIFEST", "fields", F.lit("$"), ~known | _keys_are(c("keys"), FIELDS)),
        ("INVALID_MANIFEST", "source", at("source_pdf_sha256"), ~known | c("source_pdf_sha256").rlike(SHA256)),
        ("INVALID_MANIFEST", "cleaned", at("cleaned_text_sha256"), ~known | c("cleaned_text_sha256").isNull() | c("cleaned_text_sha256").rlike(SHA256)),
        ("INVALID_MANIFEST", "warnings", at("warnings"), ~known | ~F.exists("warnings", lambda w: w.isNull())),
        ("INVALID_MANIFEST", "error", at("error"), ~known | c("error").isNull() | (c("error") != "")),
        of_generations("tts", "tts", (c("tts.engine") != "") & (c("tts.voice") != "") & c("tts.speed").between(0.5, 2.0) & (c("tts.sample_rate") > 0) & (c("tts.chunk_cap") > 0)),
        of_generations("total", "total_chunks", c("total_chunks") >= 0),
        of_generations("records", "completed_chunks", chunks.isNotNull() & own_keys),
        of_generations("indexes", "completed_chunks", each(lambda r: (r["chapter_index"] >= 1) & (r["global_index"] >= 0) & (r["local_index"] >= 0) & (r["global_index"] < c("total_chunks")))),
        of_generations("order", "completed_chunks", _rising(chunks, lambda p, r: r["global_index"] > p["global_index"])),
        of_generations("hashes", "completed_chunks", each(lambda r: r["input_hash"].rlike(SHA256))),
        of_generations("paths", "completed_chunks", each(lambda r: (F.get(parts(r), F.lit(0)) == "chunks") & ~F.array_contains(parts(r), ".."))),
        of_generations("durations", "completed_chunks", each(lambda r: (r["duration_seconds"] > 0) & ~F.isnan(r["duration_seconds"]))),
        of_generations("progress", "progress", (c("progress.completed") == n) & (c("progress.total") == c("total_chunks")) & c("progress.current").between(0, c("total_chunks"))),
        of_generations("worker", "worker", c("worker").isNull() | ((c("worker.pid") > 0) & c("worker.started_at").rlike(TIMESTAMP) & c("worker.updated_at").rlike(TIMESTAMP))),
        of_generations("last_error", "last_safe_error", c("last_safe_error").isNull() | (c("last_safe_error") != "")),
        ("INVALID_MANIFEST", "files", at("completed_chunks"), ~recorded | each(lambda r: r["wav_sha256"].rlike(SHA256))),
        ("INVALID_MANIFEST", "final_stage", at("stage"), ~recorded | ~done | c("stage").isin("synthesis_complete", "completed")),
        ("INVALID_MANIFEST", "output", at("output"), ~recorded | (c("output").isNotNull() == (done & final))),
        ("INVALID_MANIFEST", "complete", at("progress"), ~recorded | ~done | ((c("progress.completed") == c("total_chunks")) & (c("progress.current") == c("total_chunks")))),
        of_interactive("mode", "mode", c("mode") == "interactive_voices"),
        *(of_interactive("binding", f, c(f).rlike(SHA256)) for f in ("voice_plan_sha256", "speaker_analysis_sha256", "voice_registry_revision")),
        of_interactive("revision", "voice_plan_revision", c("voice_plan_revision") > 0),
        of_interactive("cast", "cast_voice_ids", (F.size("cast_voice_ids") > 0) & F.forall("cast_voice_ids", lambda v: F.coalesce(ids(v), F.lit(False))) & (F.size(F.array_distinct("cast_voice_ids")) == F.size("cast_voice_ids"))),
        of_interactive("voice", "tts.voice", F.array_contains("cast_voice_ids", c("tts.voice"))),
        of_interactive("audio_hashes", "completed_chunks", each(lambda r: r["audio_input_hash"].rlike(SHA256))),
        of_interactive("names", "completed_chunks", each(lambda r: ids(r["span_id"]) & ids(r["speaker_id"]) & ids(r["voice_id"]))),
        of_interactive("voices", "completed_chunks", each(lambda r: F.array_contains("cast_voice_ids", r["voice_id"]))),
        of_interactive("segments", "completed_chunks", each(lambda r: r["segment_type"].isin(*SEGMENTS))),
        of_interactive("ranges", "completed_chunks", each(lambda r: (r["source_start"] >= 0) & (r["source_end"] > r["source_start"]))),
        of_interactive("chapters", "completed_chunks", _rising(chunks, lambda p, r: (r["chapter_index"] > p["chapter_index"]) | ((r["chapter_index"] == p["chapter_index"]) & (r["local_index"] > p["local_index"])))),
    ])


def _configured(jobs: DataFrame, facts: Sequence[str], same: Column, kept: Column, mismatch: Column) -> DataFrame:
    """Jobs with ``new_`` facts applied: the outcome, and what the manifest is after it."""
    spoken = (F.col("status") == "completed") & (F.col("stage") == "synthesis_complete") & ~F.col("published")
    outcome = (
        F.when(spoken & same, "unchanged").when(F.col("status") == "completed", "COMPLETED").when(same & F.col("status").isin(*OPEN, *ACTIVE), "unchanged")
        .when(F.col("status").isin(*ACTIVE), "ACTIVE").when(~F.col("status").isin(*OPEN), "NOT_READY").when(mismatch, "PLAN_MISMATCH").otherwise("configured")
    )
    changed = F.col("outcome") == "configured"
    rows = jobs.withColumn("outcome", outcome)
    return rows.select(
        "book_id", "outcome", F.when(changed, "planned").otherwise(F.col("status")).alias("status"), F.when(changed, "chapter_review").otherwise(F.col("stage")).alias("stage"),
        *(F.when(changed, F.col(f"new_{f}")).otherwise(F.col(f)).alias(f) for f in facts), F.when(changed, kept).otherwise(F.col("completed_chunks")).alias("completed_chunks"),
    )


def configured_generations(jobs: DataFrame) -> DataFrame:
    """Generations bound to new settings: book_id, status, stage, published, tts, total_chunks, completed_chunks, new_tts, new_total_chunks.

    Other settings start a job over without its chunks; the same settings with another count of chunks
    can't be right; a job at work or done doesn't change.
    """
    same_settings, same_total = F.col("tts").eqNullSafe(F.col("new_tts")), F.col("total_chunks").eqNullSafe(F.col("new_total_chunks"))
    none = F.array().cast(jobs.schema["completed_chunks"].dataType)
    return _configured(jobs, ["tts", "total_chunks"], same_settings & same_total, none, same_settings)


def configured_interactive(jobs: DataFrame) -> DataFrame:
    """The same for interactive generations, bound to a voice plan too: chunks within the new total are carried over, since their audio may serve again."""
    facts = ["tts", "total_chunks", "voice_plan_sha256", "voice_plan_revision"]
    same = F.lit(True)
    for f in facts:
        same = same & F.col(f).eqNullSafe(F.col(f"new_{f}"))
    return _configured(jobs, facts, same, F.filter("completed_chunks", lambda c: c["global_index"] < F.col("new_total_chunks")), F.lit(False))
