"""Analyzer output, scopes, generations and manifests: a damaged one for each rule, and small cases."""

from __future__ import annotations

import copy
import json

import pytest
from pyspark.sql import functions as F

from narrata.operators import generation, intake, scope

HASH, TIME = "ab" * 32, "2026-01-02T03:04:05Z"


def chunk(n, version):
    out = {"chapter_index": 1 + n // 2, "global_index": n, "local_index": n % 2, "input_hash": HASH, "relative_path": f"chunks/c{n}.wav", "duration_seconds": 1.5}
    if version > 3:
        out["wav_sha256"] = HASH
    if version > 4:
        out |= {"audio_input_hash": HASH, "span_id": f"s{n}", "speaker_id": "narrator", "voice_id": "v1", "segment_type": "narration", "source_start": n, "source_end": n + 1}
    return out


def manifest(version, status="planned"):
    out = {
        "schema_version": version, "conversion_id": "c", "original_display_filename": "a.pdf", "source_pdf_sha256": HASH, "status": status, "stage": "chapter_review", "created_at": TIME, "updated_at": TIME,
        "cleaned_text_sha256": None, "warnings": ["w"], "error": None,
    }
    if version > 1:
        out["chapter_plan_sha256"] = HASH
    if version > 2:
        out |= {
            "tts": {"engine": "fake", "voice": "v1", "speed": 1.0, "sample_rate": 24000, "chunk_cap": 300, "settings": {}}, "total_chunks": 3, "completed_chunks": [chunk(n, version) for n in range(3)], "progress": {"completed": 3, "current": 3, "total": 3},
            "worker": {"pid": 1, "started_at": TIME, "updated_at": TIME}, "last_safe_error": None,
        }
    if version > 3:
        out["output"] = None
    if version > 4:
        out |= {"mode": "interactive_voices", "voice_plan_sha256": HASH, "voice_plan_revision": 1, "speaker_analysis_sha256": HASH, "cast_voice_ids": ["v1", "v2"], "voice_registry_revision": HASH}
    return out


OUTPUT = {"filename": "a.m4b", "path": "/a.m4b", "size_bytes": 1, "duration_seconds": 1.0, "chapter_count": 1, "codec": "aac", "sha256": HASH}
#: Version, rule, and what is put where.
FAULTS = [
    (2, "version", ["schema_version"], 7), (2, "fields", ["more"], 1), (4, "source", ["source_pdf_sha256"], "x"), (1, "cleaned", ["cleaned_text_sha256"], "x"), (1, "warnings", ["warnings"], [None]), (2, "error", ["error"], ""), (3, "tts", ["tts", "speed"], 2.5),
    (4, "tts", ["tts", "voice"], ""), (4, "total", ["total_chunks"], -1), (4, "records", ["completed_chunks", 0, "more"], 1), (3, "records", ["completed_chunks"], None), (4, "indexes", ["completed_chunks", 2, "global_index"], 3), (4, "order", ["completed_chunks", 1, "global_index"], 0),
    (4, "hashes", ["completed_chunks", 0, "input_hash"], "x"), (4, "paths", ["completed_chunks", 0, "relative_path"], "/x/a.wav"), (4, "paths", ["completed_chunks", 0, "relative_path"], "chunks/../a.wav"), (3, "durations", ["completed_chunks", 0, "duration_seconds"], 0.0),
    (4, "progress", ["progress", "completed"], 2), (4, "worker", ["worker", "pid"], 0), (5, "worker", ["worker", "started_at"], "today"), (4, "last_error", ["last_safe_error"], ""), (4, "files", ["completed_chunks", 1, "wav_sha256"], "x"), (4, "final_stage", ["status"], "completed"),
    (4, "output", ["output"], OUTPUT), (5, "mode", ["mode"], "plain"), (5, "binding", ["voice_plan_sha256"], "x"), (5, "binding", ["voice_registry_revision"], "x"), (5, "revision", ["voice_plan_revision"], 0), (5, "cast", ["cast_voice_ids"], ["v1", "v1"]), (5, "cast", ["cast_voice_ids"], []),
    (5, "voice", ["tts", "voice"], "v9"), (5, "audio_hashes", ["completed_chunks", 0, "audio_input_hash"], None), (5, "names", ["completed_chunks", 0, "span_id"], ""), (5, "voices", ["completed_chunks", 0, "voice_id"], "v9"), (5, "segments", ["completed_chunks", 0, "segment_type"], "song"),
    (5, "ranges", ["completed_chunks", 1, "source_end"], 1), (5, "chapters", ["completed_chunks", 2, "chapter_index"], 1), (5, "complete", ["status"], "completed"),
]


def test_each_rule_of_manifests_has_a_damaged_one(spark):
    rows = [(-v, json.dumps(manifest(v))) for v in range(1, 6)]
    for n, (version, rule, path, value) in enumerate(FAULTS):
        m = copy.deepcopy(manifest(version))
        at = m
        for key in path[:-1]:
            at = at[key]
        at[path[-1]] = value
        if rule == "chapters":
            m["completed_chunks"][2]["local_index"] = 1
        if rule == "complete":
            m |= {"stage": "synthesis_complete", "progress": {"completed": 3, "current": 2, "total": 3}}
        rows.append((n, json.dumps(m)))
    rows += [(1000, "{"), (1001, json.dumps(manifest(4, "completed") | {"stage": "completed", "output": OUTPUT})), (1002, json.dumps(manifest(4, "completed") | {"stage": "completed"})), (1003, json.dumps(manifest(5, "completed") | {"stage": "synthesis_complete"}))]
    found = {}
    for r in generation.manifest_violations(spark.createDataFrame(rows, "book_id long, manifest string")).collect():
        found.setdefault(r["book_id"], set()).add(r["rule"])
    assert not [k for k in (-1, -2, -3, -4, -5, 1001, 1003) if k in found], found
    for n, (_, rule, path, _) in enumerate(FAULTS):
        assert rule in found.get(n, set()), (rule, path, found.get(n))
    assert found[1000] == {"json"} and found[1002] == {"output"}


def test_versions_are_upgraded_in_one_scan(spark):
    rows = spark.createDataFrame([(v, json.dumps(manifest(v))) for v in range(1, 6)] + [(9, json.dumps(manifest(2) | {"schema_version": 9}))], "book_id long, manifest string")
    files = spark.createDataFrame([(3, "chunks/c1.wav", "cd" * 32)], "book_id long, relative_path string, sha256 string")
    got = {r["book_id"]: r for r in generation.upgraded(rows, files).collect()}
    assert {k: (r["from_version"], r["schema_version"]) for k, r in got.items()} == {1: (1, 2), 2: (2, 2), 3: (3, 4), 4: (4, 4), 5: (5, 5)}
    assert [c["wav_sha256"] for c in got[3]["completed_chunks"]] == [generation.NO_FILE, "cd" * 32, generation.NO_FILE]
    assert got[1]["chapter_plan_sha256"] is None and got[5]["mode"] == "interactive_voices"


def test_the_first_mismatch_voids_what_follows(spark):
    plan = [(b, n, 1 + n // 2, n % 2, f"h{n}") for b in range(6) for n in range(4)]
    log, files = [], []
    for b, n, c, k, h in plan:
        path = f"chunks/chapter-{c:03d}-chunk-{k:04d}.wav"
        if b == 1 and n == 3:
            continue
        log.append((b, n, n, c, k, "x" if b == 2 and n == 1 else h, path if not (b == 3 and n == 2) else "chunks/other.wav", HASH))
        files.append((b, path, "y" if b == 4 and n == 0 else HASH, 0.0 if b == 5 and n == 2 else 1.0))
    got = generation.generation_summary(
        generation.recorded_chunks(
            spark.createDataFrame(plan, "book_id long, global_index int, chapter_index int, local_index int, input_hash string"),
            spark.createDataFrame(log, "book_id long, ord int, global_index int, chapter_index int, local_index int, input_hash string, relative_path string, wav_sha256 string"),
            spark.createDataFrame(files, "book_id long, relative_path string, sha256 string, duration_seconds double"), ["input_hash"],
        )
    ).collect()
    assert {r["book_id"]: (r["completed_chunks"], r["completed_chapters"], r["current_chapter"], r["first_mismatch"]) for r in got} == {
        0: (4, 2, 2, None), 1: (3, 1, 2, 3), 2: (1, 0, 1, 1), 3: (2, 1, 2, 2), 4: (0, 0, 1, 0), 5: (2, 1, 2, 2)
    }


def test_configured_jobs(spark):
    records = [(n, HASH) for n in range(4)]
    jobs = [
        ("same", "planned", "x", False, "a", 4, "p", 1, records, "a", 4, "p", 1), ("settings", "failed", "x", False, "a", 4, "p", 1, records, "b", 3, "p", 1), ("total", "cancelled", "x", False, "a", 4, "p", 1, records, "a", 3, "p", 1),
        ("plan", "planned", "x", False, "a", 4, "p", 1, records, "a", 2, "q", 2), ("active", "synthesizing", "x", False, "a", 4, "p", 1, records, "b", 4, "p", 1), ("resumed", "cancelling", "x", False, "a", 4, "p", 1, records, "a", 4, "p", 1),
        ("spoken", "completed", "synthesis_complete", False, "a", 4, "p", 1, records, "a", 4, "p", 1), ("done", "completed", "completed", True, "a", 4, "p", 1, records, "a", 4, "p", 1), ("odd", "broken", "x", False, "a", 4, "p", 1, records, "b", 4, "p", 1),
    ]
    frame = spark.createDataFrame(jobs, "book_id string, status string, stage string, published boolean, tts string, total_chunks int, voice_plan_sha256 string, voice_plan_revision int, completed_chunks array<struct<global_index:int,input_hash:string>>, new_tts string, new_total_chunks int, new_voice_plan_sha256 string, new_voice_plan_revision int")
    plain = {r["book_id"]: (r["outcome"], len(r["completed_chunks"])) for r in generation.configured_generations(frame).collect()}
    assert plain == {"same": ("unchanged", 4), "settings": ("configured", 0), "total": ("PLAN_MISMATCH", 4), "plan": ("PLAN_MISMATCH", 4), "active": ("ACTIVE", 4), "resumed": ("unchanged", 4), "spoken": ("unchanged", 4), "done": ("COMPLETED", 4), "odd": ("NOT_READY", 4)}
    bound = {r["book_id"]: (r["outcome"], r["status"], len(r["completed_chunks"])) for r in generation.configured_interactive(frame).collect()}
    assert bound["plan"] == ("configured", "planned", 2) and bound["settings"] == ("configured", "planned", 3) and bound["total"] == ("configured", "planned", 3) and bound["same"] == ("unchanged", "planned", 4)


def test_each_rule_of_analyzer_output_has_a_damaged_row(spark):
    tokens = [(b, n, str(n), f"w{n}", str(3 * n), str(3 * n + 2)) for b in range(9) for n in range(4)]
    quotes = [(b, n, str(n), str(n + 1), "1") for b in range(9) for n in range(2)]
    hurt = {1: ("tokens", 2, "contiguous", (2, "5")), 2: ("tokens", 1, "word", (3, "")), 3: ("tokens", 0, "offsets", (4, "-1")), 4: ("tokens", 3, "offsets", (5, "3.5")), 5: ("quotes", 0, "range", (3, "4")), 6: ("quotes", 1, "range", (2, "x")), 7: ("quotes", 1, "character", (4, "-2")), 8: ("quotes", 0, "character", (4, "two"))}
    for b, (file, n, _, (field, value)) in hurt.items():
        rows = tokens if file == "tokens" else quotes
        at = next(k for k, r in enumerate(rows) if r[:2] == (b, n))
        rows[at] = (*rows[at][:field], value, *rows[at][field + 1 :])
    read = intake.read_tokens(spark.createDataFrame(tokens, "book_id long, position long, token_ID_within_document string, word string, byte_onset string, byte_offset string"))
    said = intake.read_quotes(spark.createDataFrame([*quotes, (0, 2, "0", "0", "None"), (0, 3, "0", "0", None), (0, 4, "0", "0", "")], "book_id long, position long, quote_start string, quote_end string, char_id string"))
    found = intake.intake_violations(read, said)
    assert {(r["book_id"], r["file"], r["position"], r["rule"]) for r in found.collect()} == {(b, file, n, rule) for b, (file, n, rule, _) in hurt.items()}
    assert {r["coref_id"] for r in intake.sound(said, found).collect()} == {1, -1} and intake.sound(read, found).count() == 4


def test_characters_from_mentions(spark):
    tokens = intake.read_tokens(spark.createDataFrame([(1, n, str(n), "w", str(n), str(n + 1)) for n in range(20)], "book_id long, position long, token_ID_within_document string, word string, byte_onset string, byte_offset string"))
    rows = [
        ("3", "0", "0", "PRON", "PER", "she"), ("3", "1", "2", "PROP", "PER", "Ann Lee"), ("3", "3", "3", "PROP", "PER", "Ann B."), ("3", "5", "6", "PROP", "PER", "Ann Moo"), ("3", "1", "2", "PROP", "PER", "Ann Lee"), ("3", "8", "8", "NOM", "PER", "the tall woman"),
        ("4", "9", "9", "odd", "PER", "him"), ("4", "12", "12", "PROP", "LOC", "Rome"), ("-1", "1", "1", "PROP", "PER", "x"), ("a", "1", "1", "PROP", "PER", "x"), ("5", "19", "20", "PROP", "PER", "out"), ("5", "3", "2", "PROP", "PER", "back"), ("5", "3", "3", "PROP", "PER", ""), ("6", "1", "1", "PROP", "PER", None),
    ]
    entities = spark.createDataFrame([(1, n, *r) for n, r in enumerate(rows)], "book_id long, position long, COREF string, start_token string, end_token string, prop string, cat string, text string")
    quotes = spark.createDataFrame([(1, "0", 1, 2, 3), (1, "1", 4, 4, 3), (1, "2", 5, 6, 9), (1, "3", 5, 6, -1)], "book_id long, quote_id string, start_token long, end_token long, coref_id long")
    people = intake.characters(intake.mentions(entities, tokens), quotes)
    got = {r["coref_id"]: (r["canonical_label"], [(a["alias"], a["kind"], a["token_start"], a["token_end"]) for a in r["aliases"]], r["quote_count"]) for r in people.collect()}
    assert got == {
        3: ("Ann Lee", [("she", "pronoun", 0, 1), ("Ann Lee", "proper", 1, 3), ("Ann B.", "proper", 3, 4), ("Ann Moo", "proper", 5, 7), ("the tall woman", "nominal", 8, 9)], 2), 4: ("him", [("him", "nominal", 9, 10)], 0)
    }
    places = tokens.select("book_id", "token_id", F.col("byte_start").alias("char_start"), F.col("byte_end").alias("char_end"))
    spans = {r["quote_id"]: (r["source_start"], r["source_end"], r["coref_id"], r["label"]) for r in intake.quote_spans(quotes, places, people).collect()}
    assert spans == {"0": (1, 3, 3, "Ann Lee"), "1": (4, 5, 3, "Ann Lee"), "2": (5, 7, None, None), "3": (5, 7, None, None)}


def test_records_of_many_shapes(spark):
    rows = [
        ('{"start": 1, "end": 2, "speaker": "Ann", "confidence": 0.5}', (1, 2, "narration", "Ann", 0.5, "low", [], True)), ('{"source_start": null, "start": 1, "end": 2, "speaker": " "}', (None, 2, "unknown", "narrator", 0.0, "low", [], False)),
        ('{"source_start": 1.5, "source_end": "2", "type": "dialogue", "speaker_id": "A"}', (None, None, "dialogue", "A", 0.0, "low", [], False)), ('{"start_offset": 3, "end_offset": 4, "span_type": "song", "speaker_id": "A", "confidence": {"score": 1, "band": "high", "reasons": ["x"]}}', (3, 4, "unknown", "A", 1.0, "high", ["x"], True)),
        ('{"start": 1, "end": 2, "speaker_id": "UNKNOWN", "speaker": "Ann", "type": "dialogue"}', (1, 2, "unknown", "narrator", 0.0, "low", [], True)), ("not json", (None, None, "unknown", "narrator", 0.0, "low", [], False)), (None, (None, None, "unknown", "narrator", 0.0, "low", [], False)),
    ]
    frame = spark.createDataFrame([(1, n, r) for n, (r, _) in enumerate(rows)], "book_id long, position long, record string")
    got = [(r["source_start"], r["source_end"], r["type"], r["speaker_id"], r["confidence"]["score"], r["confidence"]["band"], r["confidence"]["reasons"], r["is_valid"]) for r in intake.unified_spans(frame, "rules").orderBy("position").collect()]
    assert got == [want for _, want in rows]


@pytest.mark.parametrize(("first", "last"), [(None, None), (1, 1), (2, 3), (3, 3)])
def test_scopes_go_there_and_back(spark, first, last):
    chapters = spark.createDataFrame([(1, k, 10 * k - 10, 10 * k) for k in (1, 2, 3)], "book_id long, chapter_index long, start_offset long, end_offset long")
    spans = spark.createDataFrame([(1, f"s{k}", 1 + k // 10, k, k + 2) for k in range(0, 28, 2)], "book_id long, span_id string, chapter_index long, source_start long, source_end long")
    scoped = scope.scopes(spark.createDataFrame([(1, first, last)], "book_id long, first_chapter int, last_chapter int"), chapters)
    books = spark.createDataFrame([(1, "abcdefghij" * 3)], "book_id long, text string")
    inside = {r["span_id"] for r in spans.collect() if (first or 1) <= r["chapter_index"] <= (last or 3)}
    back = scope.remapped_spans(scoped, scope.scoped_spans(scoped, spans))
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in spans.collect() if r["span_id"] in inside}
    text = scope.scoped_books(scoped, books).first()["text"]
    parts = scope.scoped_chapters(scoped, chapters).orderBy("chapter_index").collect()
    assert [r["chapter_index"] for r in parts] == list(range(1, len(parts) + 1)) and parts[0]["start_offset"] == 0 and parts[-1]["end_offset"] == len(text) == 10 * len(parts)


def test_wrong_ranges(spark):
    chapters = spark.createDataFrame([(b, k, 10 * k - 10, 10 * k) for b in range(5) for k in (1, 2)], "book_id long, chapter_index long, start_offset long, end_offset long")
    ranges = spark.createDataFrame([(0, 1, None), (1, 2, 1), (2, 0, 1), (3, 1, 3), (4, 1, 2), (9, None, None)], "book_id long, first_chapter int, last_chapter int")
    assert {(r["book_id"], r["rule"]) for r in scope.scope_violations(ranges, chapters).collect()} == {(0, "ends"), (1, "range"), (2, "range"), (3, "range"), (9, "chapters")}
    assert [r["book_id"] for r in scope.scopes(ranges, chapters).collect()] == [4]


def test_measures_have_their_domains(spark):
    from narrata.operators import measures

    rows = spark.createDataFrame([("a", 1, 10, 80, 20, 5, 8), ("b", 1, -1, 8, 4, 5, 8), ("c", 1, 1, 8, 0, 0, 8), ("d", 2, 3, 8, 4, 6, None)], "run_id string, g int, generation_ms long, cpu_ms long, wall_ms long, audio_ms long, cores int")
    got = {r["run_id"]: (r["rtf"], r["utilisation"]) for r in measures.run_measures(rows).collect()}
    assert got == {"a": (2.0, 0.5), "b": (None, 0.25), "c": (None, None), "d": (0.5, None)}
    means = measures.run_averages(rows.where("run_id in ('a', 'c')"), "g").first()
    assert (means["runs"], means["generation_seconds"], means["rtf"]) == (2, 0.0055, 11 / 5)
    gold = spark.createDataFrame([(1, "t", ["a"]), (2, "t", ["a"]), (3, None, None)], "book_id long, text string, cast array<string>")
    other = spark.createDataFrame([(2, "u", ["b"]), (3, None, None), (4, "t", [])], "book_id long, text string, cast array<string>")
    assert {tuple(r) for r in measures.corpus_differences(gold, other, ["text", "cast"]).collect()} == {(1, "missing_predictions"), (4, "unknown_book"), (2, "text"), (2, "cast")}
    texts = spark.createDataFrame([("  a b\n\nc  ", ["x"] * 51), ("", []), (None, None)], "t string, w array<string>")
    found = texts.select(measures.short_sample(F.col("t"), 2).alias("s"), measures.capped(F.col("w")).alias("c")).collect()
    assert [r["s"] for r in found] == ["a b", "", None] and [(len(r["c"]["listed"]), r["c"]["total"], r["c"]["truncated"]) for r in found] == [(50, 51, True), (0, 0, False), (0, 0, False)]
