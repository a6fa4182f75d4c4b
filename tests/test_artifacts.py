"""Artifacts: canonical digests against Python's own, and a damaged artifact for each rule."""

from __future__ import annotations

import copy
import hashlib
import json
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from narrata.functions.canonical import canonical_json, quoted
from narrata.operators import artifact_rules, candidates, digests, plan_rules, safety, spans, voice_plans

ANY = "text string, n long, ok boolean, x double, list array<string>, deep array<struct<Z:string,a:struct<`é`:double,B:array<long>>,m:map<string,double>>>"


def python_json(value):
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def plain(value):
    """Rows of Spark as dictionaries, nulls kept."""
    if hasattr(value, "asDict"):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, list):
        return [plain(v) for v in value]
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    return value


def test_canonical_json_of_nested_columns_equals_python(spark):
    rng = random.Random(2)
    texts = ["", "a", 'q"uote\\', "漢字 é 😀", "\x00\x01\x08\t\n\x0b\x0c\r\x1f\x7f\x85 ", None, "line\nfeed/"]

    def number():
        return rng.choice([None, 0.0, -0.0, 1.0, 0.1, 1e16, 1e-5, 123456.789, -2.5e-7, rng.uniform(-1e9, 1e9), 1e300])

    def deep():
        return (rng.choice(texts), rng.choice([None, (number(), rng.choice([None, [], [1, -5, None]]))]), rng.choice([None, {}, {"b": number(), "é": 1.0, "a\n": None}]))

    rows = [(rng.choice(texts), rng.choice([None, 0, -7, 2**62]), rng.choice([None, True, False]), number(), rng.choice([None, [], ["x", None, '"']]), rng.choice([None, [], [deep(), None, deep()]])) for _ in range(400)]
    frame = spark.createDataFrame(rows, ANY)
    got = frame.select("*", canonical_json(F.struct(*frame.columns), frame.schema).alias("j")).collect()
    for r in got:
        want = plain(r)
        want.pop("j")
        assert r["j"] == python_json(want)


def test_floats_have_the_fewest_digits(spark):
    rng = random.Random(5)
    numbers = [struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0] for _ in range(20000)]
    numbers = [x for x in numbers if math.isfinite(x)] + [2.0**k for k in range(-1074, 1024)] + [10.0**k for k in range(-30, 30)] + [k / 1000 for k in range(3000)] + [5e-324, 1.7976931348623157e308, 2e-3, 9007199254740993.0, 2.2250738585072014e-308]
    frame = spark.createDataFrame([(x,) for x in numbers], "x double")
    got = frame.select("x", canonical_json(F.col("x"), frame.schema["x"].dataType).alias("t")).collect()
    wrong = [(r["x"], r["t"]) for r in got if r["t"] != repr(r["x"])]
    assert not wrong, (len(wrong), wrong[:5])


def test_numbers_that_are_not_finite_have_no_canonical_form(spark):
    frame = spark.createDataFrame([([1.0, float("nan")],), ([float("inf")],), ([None, 1.5],)], "x array<double>")
    got = [r[0] for r in frame.select(canonical_json(F.struct("x"), frame.schema)).collect()]
    assert got == [None, None, '{"x":[null,1.5]}']


def test_quoted_text_is_json(spark):
    texts = ["".join(chr(c) for c in range(k, k + 40)) for k in range(0, 400, 40)] + ['\\"', ""]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", quoted(F.col("t")).alias("q")).collect()
    assert all(r["q"] == json.dumps(r["t"], ensure_ascii=False) for r in got)


HASH = "0123456789abcdef" * 4
TIME = "2026-01-02T03:04:05+00:00"
CONFIDENCE = "confidence struct<score:double,band:string,reasons:array<string>>"
HEAD = "book_id long, schema_version int, artifact string, revision int, source_pdf_sha256 string, cleaned_text_sha256 string, chapter_plan_sha256 string, chapter_plan_schema_version int, analyzer struct<id:string,version:string,model_hash:string>"
ANALYSIS = (
    HEAD + ", characters array<struct<character_id:string,canonical_label:string,aliases:array<struct<alias:string,kind:string,confidence:double,provenance:struct<source:string,token_start:int,token_end:int>>>,line_count:int,quote_count:int>>,"
    f" spans array<struct<span_id:string,chapter_index:long,source_start:long,source_end:long,type:string,speaker_id:string,{CONFIDENCE.replace('confidence ', 'confidence:', 1)},provenance:struct<source:string,quote_id:string>>>,"
    " warnings array<string>, chapter_start int, chapter_end int"
)
PLAN = (
    HEAD + ", cast array<struct<cast_id:string,display_label:string,role:string,relationship:string,voice_id:string,voice_settings:struct<speed:double,pitch_semitones:int,tone_preset:string>>>,"
    " aliases array<struct<alias_id:string,text:string,character_id:string,override_state:string>>,"
    " chapters array<struct<chapter_index:long,source_start:long,source_end:long,source_page_start:int,source_page_end:int,spans:array<struct<span_id:string,source_start:long,source_end:long,type:string,speaker_id:string,"
    f"{CONFIDENCE.replace('confidence ', 'confidence:', 1)},provenance:struct<source:string,analysis_revision:int>,override:struct<kind:string,from:string,to:string,actor:string,reason:string>>>>>,"
    " unresolved_policy struct<mode:string,accepted_by_user:boolean,accepted_at:string>, approval struct<state:string,approved_at:string,approved_revision:int>"
)
#: Text, and the offsets of its two chapters.
TEXT, CUT = "One here. “Two,” she said.\nThree is the second part, é.", 27


def head(artifact):
    return {
        "schema_version": 1, "artifact": artifact, "revision": 2, "source_pdf_sha256": HASH, "cleaned_text_sha256": hashlib.sha256(TEXT.encode()).hexdigest(), "chapter_plan_sha256": HASH[::-1],
        "chapter_plan_schema_version": 1, "analyzer": {"id": "rules", "version": "1", "model_hash": None},
    }


def confidence():
    return {"score": 0.5, "band": "low", "reasons": ["quote"]}


def analysis():
    def span(name, chapter, start, end, kind, speaker):
        return {"span_id": name, "chapter_index": chapter, "source_start": start, "source_end": end, "type": kind, "speaker_id": speaker, "confidence": confidence(), "provenance": {"source": "turns", "quote_id": "q.1"}}

    alias = {"alias": "Ann", "kind": "proper", "confidence": 0.9, "provenance": {"source": "names", "token_start": 1, "token_end": 2}}
    return head("speaker-analysis") | {
        "characters": [{"character_id": "ann", "canonical_label": "Ann", "aliases": [alias, alias | {"alias": "she", "kind": "pronoun"}], "line_count": 1, "quote_count": 1}, {"character_id": "bob", "canonical_label": "Bob", "aliases": [], "line_count": 0, "quote_count": 0}],
        "spans": [span("s1", 1, 0, 9, "narration", "narrator"), span("s2", 1, 10, 16, "dialogue", "ann"), span("s3", 2, 27, 40, "unknown", None)],
        "warnings": ["fine"], "chapter_start": 1, "chapter_end": 2,
    }


def voice_plan():
    def span(name, start, end, kind, speaker):
        return {"span_id": name, "source_start": start, "source_end": end, "type": kind, "speaker_id": speaker, "confidence": confidence(), "provenance": {"source": "turns", "analysis_revision": 1}, "override": None}

    def member(name, role, relationship, voice):
        return {"cast_id": name, "display_label": name.title(), "role": role, "relationship": relationship, "voice_id": voice, "voice_settings": {"speed": 1.0, "pitch_semitones": 0, "tone_preset": "warm"}}

    first = [span("s1", 0, 10, "narration", "narrator"), span("s2", 10, 16, "dialogue", "ann"), span("s3", 16, CUT, "narration", "narrator")]
    return head("voice-plan") | {
        "cast": [member("narrator", "narrator", "third_person", "v1"), member("ann", "character", "separate_from_narrator", "v2"), member("me", "character", "same_as_narrator", "v1")],
        "aliases": [{"alias_id": "a1", "text": "Ann", "character_id": "ann", "override_state": "accepted"}, {"alias_id": "a2", "text": "she", "character_id": "ann", "override_state": "accepted"}],
        "chapters": [
            {"chapter_index": 1, "source_start": 0, "source_end": CUT, "source_page_start": 1, "source_page_end": 1, "spans": first},
            {"chapter_index": 2, "source_start": CUT, "source_end": len(TEXT), "source_page_start": 1, "source_page_end": 2, "spans": [span("s4", CUT, len(TEXT), "dialogue", "ann")]},
        ],
        "unresolved_policy": {"mode": "narrator", "accepted_by_user": False, "accepted_at": None}, "approval": {"state": "approved", "approved_at": TIME, "approved_revision": 2},
    }


def put(path, value):
    """A fault: the value at a path of the artifact."""

    def hurt(artifact):
        at = artifact
        for key in path[:-1]:
            at = at[key]
        at[path[-1]] = value

    return hurt


def drop(path):
    def hurt(artifact):
        at = artifact
        for key in path[:-1]:
            at = at[key]
        del at[path[-1]]

    return hurt


def again(path):
    """A fault: the last element of an array stands there twice."""

    def hurt(artifact):
        at = artifact
        for key in path:
            at = at[key]
        at.append(copy.deepcopy(at[-1]))

    return hurt


def both(*faults):
    def hurt(artifact):
        for f in faults:
            f(artifact)

    return hurt


ANY_HEAD = {
    "INVALID_SCHEMA_VERSION": (put(["schema_version"], 2), "$.schema_version"), "INVALID_ARTIFACT_TYPE": (put(["artifact"], "x"), "$.artifact"), "INVALID_SOURCE_PDF_SHA256": (put(["source_pdf_sha256"], HASH.upper()), "$.source_pdf_sha256"),
    "INVALID_CLEANED_TEXT_SHA256": (put(["cleaned_text_sha256"], "x"), "$.cleaned_text_sha256"), "INVALID_CHAPTER_PLAN_SHA256": (put(["chapter_plan_sha256"], None), "$.chapter_plan_sha256"),
    "SOURCE_HASH_MISMATCH": (put(["source_pdf_sha256"], "0" * 64), "$.source_pdf_sha256"), "CHAPTER_PLAN_HASH_MISMATCH": (put(["chapter_plan_sha256"], "0" * 64), "$.chapter_plan_sha256"),
    "CHAPTER_PLAN_SCHEMA_MISMATCH": (put(["chapter_plan_schema_version"], 2), "$.chapter_plan_schema_version"), "CLEANED_TEXT_HASH_MISMATCH": (put(["cleaned_text_sha256"], "0" * 64), "$.cleaned_text_sha256"),
    "INVALID_ANALYZER_ID": (put(["analyzer", "id"], ""), "$.analyzer.id"), "INVALID_ANALYZER_VERSION": (put(["analyzer", "version"], "a\tb"), "$.analyzer.version"), "INVALID_MODEL_HASH": (put(["analyzer", "model_hash"], "x"), "$.analyzer.model_hash"),
}
IN_ANALYSES = ANY_HEAD | {
    "INVALID_REVISION": (put(["revision"], 0), "$.revision"), "INVALID_ANALYSIS": (put(["chapter_end"], None), "$.chapter_start"), "INVALID_CHAPTER_RANGE": (put(["chapter_end"], 3), "$.chapter_start"), "INVALID_CHARACTERS": (put(["characters"], None), "$.characters"), "INVALID_SPANS": (put(["spans"], None), "$.spans"),
    "INVALID_WARNINGS": (put(["warnings"], ["ok", "a\x01"]), "$.warnings"), "INVALID_CHARACTER_ID": (put(["characters", 1, "character_id"], "narrator"), "$.characters[1].character_id"), "DUPLICATE_CHARACTER_ID": (again(["characters"]), "$.characters[2].character_id"),
    "INVALID_CANONICAL_LABEL": (put(["characters", 0, "canonical_label"], "x" * 513), "$.characters[0].canonical_label"), "INVALID_CHARACTER_COUNT": (put(["characters", 0, "quote_count"], -1), "$.characters[0].quote_count"), "INVALID_ALIASES": (put(["characters", 1, "aliases"], None), "$.characters[1].aliases"),
    "INVALID_ALIAS": (put(["characters", 0, "aliases", 1, "alias"], ""), "$.characters[0].aliases[1].alias"), "INVALID_ALIAS_KIND": (put(["characters", 0, "aliases", 0, "kind"], None), "$.characters[0].aliases[0].kind"), "INVALID_ALIAS_CONFIDENCE": (put(["characters", 0, "aliases", 0, "confidence"], 1.5), "$.characters[0].aliases[0].confidence"),
    "INVALID_ALIAS_PROVENANCE_SOURCE": (put(["characters", 0, "aliases", 0, "provenance", "source"], ""), "$.characters[0].aliases[0].provenance.source"), "INVALID_TOKEN_RANGE": (put(["characters", 0, "aliases", 0, "provenance", "token_end"], 1), "$.characters[0].aliases[0].provenance.token_start"),
    "DUPLICATE_ALIAS": (again(["characters", 0, "aliases"]), "$.characters[0].aliases[2]"), "INVALID_SPAN_ID": (put(["spans", 0, "span_id"], "a b"), "$.spans[0].span_id"), "INVALID_RANGE": (put(["spans", 1, "source_end"], 10), "$.spans[1].source_start"),
    "INVALID_SPAN_TYPE": (put(["spans", 0, "type"], "song"), "$.spans[0].type"), "INVALID_PROVENANCE_SOURCE": (put(["spans", 0, "provenance", "source"], None), "$.spans[0].provenance.source"), "INVALID_CONFIDENCE": (put(["spans", 0, "confidence", "score"], -0.1), "$.spans[0].confidence.score"),
    "INVALID_CONFIDENCE_BAND": (put(["spans", 2, "confidence", "band"], "sure"), "$.spans[2].confidence.band"), "INVALID_CONFIDENCE_REASONS": (put(["spans", 0, "confidence", "reasons"], ["ok", ""]), "$.spans[0].confidence.reasons"), "DUPLICATE_SPAN_ID": (put(["spans", 2, "span_id"], "s1"), "$.spans[2].span_id"),
    "UNORDERED_SPANS": (both(put(["spans", 0, "source_start"], 12), put(["spans", 0, "source_end"], 13)), "$.spans[1].source_start"), "OVERLAPPING_SPANS": (put(["spans", 1, "source_start"], 8), "$.spans[1].source_start"), "INVALID_CHAPTER_INDEX": (put(["spans", 2, "chapter_index"], 9), "$.spans[2].chapter_index"),
    "CROSS_CHAPTER": (put(["spans", 1, "source_end"], 28), "$.spans[1].source_start"), "CHAPTER_OUTSIDE_ANALYZED_RANGE": (put(["chapter_end"], 1), "$.spans[2].chapter_index"), "INVALID_SPEAKER_ID": (put(["spans", 0, "speaker_id"], "a/b"), "$.spans[0].speaker_id"),
    "INVALID_QUOTE_ID": (put(["spans", 0, "provenance", "quote_id"], ""), "$.spans[0].provenance.quote_id"), "UNKNOWN_SPEAKER_REFERENCE": (put(["spans", 1, "speaker_id"], "carl"), "$.spans[1].speaker_id"),
}
LAST = ["chapters", 1, "spans", 0]
IN_PLANS = ANY_HEAD | {
    "INVALID_REVISION": (put(["revision"], None), "$.revision"), "INVALID_CAST": (put(["cast"], None), "$.cast"), "INVALID_ALIASES": (put(["aliases"], None), "$.aliases"), "CHAPTER_COVERAGE_MISMATCH": (drop(["chapters", 1]), "$.chapters"), "INVALID_UNRESOLVED_POLICY": (put(["unresolved_policy", "mode"], "x"), "$.unresolved_policy.mode"),
    "INVALID_ACCEPTED_AT": (put(["unresolved_policy", "accepted_at"], TIME), "$.unresolved_policy.accepted_at"), "INVALID_APPROVAL": (put(["approval", "state"], "maybe"), "$.approval.state"), "INVALID_DRAFT_APPROVAL": (put(["approval", "state"], "draft"), "$.approval.approved_at"),
    "INVALID_APPROVED_AT": (put(["approval", "approved_at"], "2026-01-02"), "$.approval.approved_at"), "INVALID_APPROVED_REVISION": (put(["approval", "approved_revision"], 0), "$.approval.approved_revision"), "APPROVAL_REVISION_MISMATCH": (put(["approval", "approved_revision"], 1), "$.approval.approved_revision"),
    "INVALID_CAST_ID": (put(["cast", 2, "cast_id"], ""), "$.cast[2].cast_id"), "DUPLICATE_CAST_ID": (again(["cast"]), "$.cast[3].cast_id"), "INVALID_DISPLAY_LABEL": (put(["cast", 1, "display_label"], None), "$.cast[1].display_label"), "INVALID_ROLE": (put(["cast", 2, "role"], "hero"), "$.cast[2].role"),
    "INVALID_RELATIONSHIP": (put(["cast", 1, "relationship"], "x"), "$.cast[1].relationship"), "INVALID_VOICE_ID": (put(["cast", 1, "voice_id"], "v\n"), "$.cast[1].voice_id"), "INVALID_SPEED": (put(["cast", 1, "voice_settings", "speed"], 2.5), "$.cast[1].voice_settings"),
    "INVALID_PITCH": (put(["cast", 1, "voice_settings", "pitch_semitones"], 4), "$.cast[1].voice_settings"), "INVALID_TONE": (put(["cast", 1, "voice_settings", "tone_preset"], "loud"), "$.cast[1].voice_settings"), "INVALID_VOICE_SETTINGS": (put(["cast", 1, "voice_settings", "tone_preset"], None), "$.cast[1].voice_settings"),
    "MISSING_NARRATOR": (drop(["cast", 0]), "$.cast"), "MISIDENTIFIED_NARRATOR": (put(["cast", 1, "role"], "narrator"), "$.cast"), "NARRATOR_VOICE_MISMATCH": (put(["cast", 2, "voice_id"], "v9"), "$.cast[2].voice_id"), "INVALID_ALIAS_ID": (put(["aliases", 0, "alias_id"], ""), "$.aliases[0].alias_id"),
    "DUPLICATE_ALIAS_ID": (put(["aliases", 1, "alias_id"], "a1"), "$.aliases[1].alias_id"), "INVALID_ALIAS_TEXT": (put(["aliases", 1, "text"], ""), "$.aliases[1].text"), "INVALID_OVERRIDE_STATE": (put(["aliases", 0, "override_state"], "x"), "$.aliases[0].override_state"), "INVALID_CHARACTER_ID": (put(["aliases", 0, "character_id"], None), "$.aliases[0].character_id"),
    "INVALID_ALIAS_CHARACTER": (put(["aliases", 0, "character_id"], "narrator"), "$.aliases[0].character_id"), "INVALID_CHAPTER_RANGE": (put(["chapters", 0, "source_start"], None), "$.chapters[0]"), "INVALID_SPANS": (put(["chapters", 0, "spans"], None), "$.chapters[0].spans"), "INVALID_SPAN_ID": (put([*LAST, "span_id"], None), "$.chapters[1].spans[0].span_id"),
    "INVALID_SPAN_TYPE": (put([*LAST, "type"], "x"), "$.chapters[1].spans[0].type"), "INVALID_RANGE": (put([*LAST, "source_end"], CUT), "$.chapters[1].spans[0].source_start"), "INVALID_CONFIDENCE": (put([*LAST, "confidence", "score"], None), "$.chapters[1].spans[0].confidence.score"),
    "INVALID_ANALYSIS_REVISION": (put([*LAST, "provenance", "analysis_revision"], 0), "$.chapters[1].spans[0].provenance.analysis_revision"), "INVALID_OVERRIDE": (put([*LAST, "override"], {"kind": "speaker", "from": "x", "to": "y", "actor": "u", "reason": "r"}), "$.chapters[1].spans[0].override.to"),
    "INVALID_OVERRIDE_REASON": (put([*LAST, "override"], {"kind": "speaker", "from": "x", "to": "ann", "actor": "u", "reason": ""}), "$.chapters[1].spans[0].override.reason"), "INCOMPLETE_COVERAGE": (put([*LAST, "source_start"], CUT + 1), "$.chapters[1].spans[0].source_start"),
    "OVERLAPPING_SPANS": (put([*LAST, "source_start"], CUT - 1), "$.chapters[1].spans[0].source_start"), "UNRESOLVED_SPANS": (put([*LAST, "type"], "unknown"), "$.chapters[1].spans[0].type"), "UNASSIGNED_SPEAKER": (put([*LAST, "speaker_id"], None), "$.chapters[1].spans[0].speaker_id"),
    "UNKNOWN_SPEAKER_REFERENCE": (put([*LAST, "speaker_id"], "carl"), "$.chapters[1].spans[0].speaker_id"), "DUPLICATE_SPAN_ID": (put([*LAST, "span_id"], "s1"), "$.chapters[1].spans[0].span_id"),
}


def _judged(spark, good, faults, schema, fields, violations):
    rows = []
    for n, (fault, _) in enumerate([(lambda a: None, ""), *faults.values()]):
        artifact = copy.deepcopy(good)
        fault(artifact)
        if artifact.get("revision") is None or True:
            rows.append({"book_id": n} | artifact | {digests.ARTIFACT_HASH: hashlib.sha256((python_json({k: artifact[k] for k in fields}) + "\n").encode()).hexdigest()})
    rows.append({"book_id": len(rows)} | copy.deepcopy(good) | {digests.ARTIFACT_HASH: "0" * 64})
    rows.append({"book_id": len(rows)} | copy.deepcopy(good) | {digests.ARTIFACT_HASH: "x"})
    frame = spark.createDataFrame(rows, schema + f", {digests.ARTIFACT_HASH} string")
    n = len(rows)
    bindings = spark.createDataFrame([(i, HASH, hashlib.sha256(TEXT.encode()).hexdigest(), HASH[::-1], HASH[::-1] if i != n else "other", 2) for i in range(n)], "book_id long, source_pdf_sha256 string, cleaned_text_sha256 string, chapter_plan_sha256 string, current_plan_sha256 string, n_chapters int")
    parts = spark.createDataFrame([(i, k, s, e, 1, k) for i in range(n) for k, s, e in ((1, 0, CUT), (2, CUT, len(TEXT)))], "book_id long, chapter_index long, start_offset long, end_offset long, start_page int, end_page int")
    found = {}
    for r in violations(frame, bindings, parts).collect():
        found.setdefault(r["book_id"], set()).add((r["code"], r["path"]))
    assert 0 not in found, found[0]
    for k, (code, (_, path)) in enumerate(faults.items(), 1):
        assert (code, path) in found.get(k, set()), (code, path, found.get(k))
    assert found[n - 2] == {("ARTIFACT_HASH_MISMATCH", f"$.{digests.ARTIFACT_HASH}")} and found[n - 1] == {("INVALID_ARTIFACT_HASH", f"$.{digests.ARTIFACT_HASH}")}


def test_each_rule_of_analyses_has_a_damaged_one(spark):
    _judged(spark, analysis(), IN_ANALYSES, ANALYSIS, artifact_rules.ANALYSIS_FIELDS, artifact_rules.analysis_violations)


def test_each_rule_of_voice_plans_has_a_damaged_one(spark):
    _judged(spark, voice_plan(), IN_PLANS, PLAN, artifact_rules.VOICE_PLAN_FIELDS, artifact_rules.voice_plan_violations)


def test_drafts_may_leave_spans_open(spark):
    draft = voice_plan() | {"approval": {"state": "draft", "approved_at": None, "approved_revision": None}}
    draft["chapters"][1]["spans"][0] |= {"type": "unknown", "speaker_id": None}
    _judged(spark, draft, {"INVALID_ROLE": IN_PLANS["INVALID_ROLE"]}, PLAN, artifact_rules.VOICE_PLAN_FIELDS, artifact_rules.voice_plan_violations)


CHAPTERS = [(1, "One", 0, CUT, 1, 1, "heading", 5), (2, "Two", CUT, len(TEXT), 2, 2, "custom", 6)]
MAPPING = [(1, 0, CUT), (2, CUT, len(TEXT))]
PLAN_FAULTS = {
    "schema_version": ({"schema_version": 2}, None), "mode": ({"mode": "x"}, None), "hash_form": ({"cleaned_text_sha256": "x"}, None), "hash": ({"cleaned_text_sha256": "0" * 64}, None), "warnings": ({"warnings": [None]}, None), "chapters": ({"chapters": []}, None),
    "requested_count": ({"mode": "custom", "requested_count": 3}, None), "index": ({}, (0, 0, 2)), "title": ({}, (1, 1, "a\x02")), "source_type": ({}, (1, 6, "")), "contiguous": ({}, (1, 2, CUT + 1)), "page_order": ({}, (0, 4, 0)), "word_count": ({}, (0, 7, -1)),
    "range": ({}, (1, 3, len(TEXT) + 1)), "coverage": ({}, (1, 3, len(TEXT) - 1)), "pages": ({}, (0, 5, 2)), "words": ({}, (0, 7, 4)), "boundary": ({}, (1, 2, CUT + 2)),
}


def test_each_rule_of_chapter_plans_has_a_damaged_one(spark):
    rows, books = [], []
    good = {"schema_version": 1, "mode": "original", "requested_count": None, "cleaned_text_sha256": hashlib.sha256(TEXT.encode()).hexdigest(), "warnings": []}
    for n, (more, cell) in enumerate([({}, None), *PLAN_FAULTS.values()]):
        parts = [list(c) for c in CHAPTERS]
        if cell:
            parts[cell[0]][cell[1]] = cell[2]
        rows.append({"book_id": n, **good, "chapters": [tuple(p) for p in parts]} | more)
        books.append((n, TEXT))
    schema = f"book_id long, schema_version int, mode string, requested_count int, cleaned_text_sha256 string, warnings array<string>, chapters array<{plan_rules.CHAPTER}>"
    mapping = spark.createDataFrame([(n, *m) for n, _ in books for m in MAPPING], "book_id long, source_page int, cleaned_start long, cleaned_end long")
    found = {}
    for r in plan_rules.plan_violations(spark.createDataFrame(rows, schema), spark.createDataFrame(books, "book_id long, text string"), mapping).collect():
        found.setdefault(r["book_id"], set()).add(r["rule"])
    assert 0 not in found, found[0]
    for n, rule in enumerate(PLAN_FAULTS, 1):
        assert rule in found.get(n, set()), (rule, found.get(n))


def test_page_at_equals_a_search_over_all_pages(spark):
    rng = random.Random(7)
    pages, asked = [], []
    for book in range(40):
        at = rng.randint(0, 3)
        for page in range(rng.randint(1, 6)):
            end = at + rng.randint(1, 9)
            pages.append((book, page + 1, at, end))
            at = end + rng.choice([0, 0, 1, 2, 5])
        asked += [(book, k) for k in range(0, at + 4)]
    mapping = spark.createDataFrame(pages, "book_id long, source_page int, cleaned_start long, cleaned_end long")
    got = {(r["book_id"], r["offset"]): r["page"] for r in spans.page_at(spark.createDataFrame(asked, "book_id long, offset long"), mapping).collect()}

    def nearest(book, k):
        own = [p for p in pages if p[0] == book]
        inside = [p for p in own if p[2] <= k < p[3]]
        if k >= own[-1][3]:
            return own[-1][1]
        return inside[0][1] if inside else min(own, key=lambda p: min(abs(k - p[2]), abs(k - p[3])))[1]

    assert got == {(b, k): nearest(b, k) for b, k in asked}


def test_ladder_of_candidates(spark):
    text = "Chapter 1\nIt was late. The Straße was empty.\n  The  END of it\nno, not here THE END. Last one."
    rows = [
        ("direct", "CHAPTER 1", "x", None, 0, (0, "direct")), ("folded", "the STRASSE was empty.", "x", None, 23, None), ("wrong offset", "chapter 1", "x", 1, 3, (0, "search")), ("outline", "any", "PDF bookmark", 2, None, (45, "outline")),
        ("spaces", "the end", "x", 2, None, (47, "line")), ("sentence", "no, not", "x", 2, None, (62, "line")), ("first page", "The Straße", "x", 1, None, (23, "search")), ("inside", "late. The", "x", 1, None, (10, "line")), ("none", "nothing", "x", 1, None, None), ("no page", "Chapter 1", "x", 9, None, None), ("blank", "  ", "x", 1, 0, None), ("null", None, None, None, None, None),
    ]
    asked = spark.createDataFrame([(1, *r[:5]) for r in rows], "book_id long, candidate_id string, title string, source string, source_page int, cleaned_offset long")
    books = spark.createDataFrame([(1, text)], "book_id long, text string")
    mapping = spark.createDataFrame([(1, 1, 0, 44), (1, 2, 45, len(text))], "book_id long, source_page int, cleaned_start long, cleaned_end long")
    got = {r["candidate_id"]: (r["offset"], r["step"]) if r["step"] else None for r in candidates.resolved(asked, books, mapping).collect()}
    # Pages are searched in the folded text at offsets of the text itself: behind a letter that folds to two a place is
    # found one letter late, where no cut is safe, and the line decides. An offset's own slice has as many letters as the title.
    assert got == {r[0]: r[5] for r in rows}


def test_line_starts_and_safe_starts():
    text = "  Part\n\n\tline \nxx. Y"
    assert safety.line_starts(text) == {k for k in range(len(text) + 1) if not text[text.rfind("\n", 0, k) + 1 : k].strip()}
    assert {0, 2, 8, text.index("Y"), len(text)} >= safety.safe_starts(text) >= {0, 8, text.index("Y"), len(text)}


def test_reused_audio_is_that_of_the_place_and_digest(spark):
    plan = spark.createDataFrame([(1, 1, 0, 0, "a", "x"), (1, 1, 1, 1, "b", "y"), (1, 1, 2, 2, "c", "x")], "book_id long, chapter_index int, global_index int, local_index int, audio_input_hash string, spoken_sha256 string")
    log = spark.createDataFrame(
        [(1, 1, 0, 0, "a", 0, HASH, 1.0, "x"), (1, 1, 0, 0, "a", 5, HASH[::-1], 2.0, "x"), (1, 1, 1, 1, "b", 1, None, 1.0, "y"), (1, 1, 2, 2, "z", 2, HASH, 1.0, "w"), (1, 1, 2, 2, "c", 3, HASH, 0.0, "w")],
        "book_id long, chapter_index int, global_index int, local_index int, audio_input_hash string, ord int, wav_sha256 string, duration_seconds double, spoken_sha256 string",
    )
    assert {r["global_index"]: r["wav_sha256"] for r in digests.reuse_audio(plan, log).collect()} == {0: HASH[::-1], 1: None, 2: None}
    assert {r["global_index"]: r["wav_sha256"] for r in digests.moved_audio(plan, log).collect()} == {0: HASH, 1: None, 2: HASH}


def test_cast_by_the_rules_of_order(spark):
    """Slugs that collide are merged, genders that differ cancel and can be set again, and the last claim of a name counts."""
    alias = "array<struct<alias_id:string,text:string,kind:string>>"
    people = spark.createDataFrame(
        [
            (1, 0, "Ann", "Ann Lee", "f", None, [("x1", "Annie", "proper"), (None, "", "proper")]), (1, 1, "Ann!", "Ann", "m", None, [(None, "Annie", "proper"), (None, "Nan", "proper")]), (1, 2, "Ann?", "A", "woman", "same_as_narrator", [(None, "N", "proper")]),
            (1, 3, "Bob", "Bob", None, "same_as_narrator", [(None, "he", "pronoun"), (None, "Bo", "proper")]), (1, 4, "Carl", "the butler", None, None, [(None, "Carl", "nominal")]), (1, 5, "Di", "Di", None, None, []), (1, 6, "Eve", "Eve", None, None, [(None, "Bob", "proper")]),
        ],
        f"book_id long, ord int, character_id string, label string, gender string, relationship string, aliases {alias}",
    )
    said = ["Ann", "Ann!", "Ann?", "Bo", "Carl", "Di", "Eve", "Zed", "Zed!", "low", "Zed"] * 2
    spoken = spark.createDataFrame([(1, k, "dialogue", s) for k, s in enumerate(said)], "book_id long, ord int, type string, speaker_id string")
    members = voice_plans.with_voices(voice_plans.cast_members(people, spoken, 2), ["af_n", "am_1", "bf_2"]).orderBy("rank").collect()
    got = [(m["cast_id"], m["label"], m["gender"], m["relationship"], m["voice_id"], [a["text"] for a in m["aliases"]]) for m in members]
    assert got == [
        ("character-Ann", "Annie", "female", "separate_from_narrator", "bf_2", ["Annie", "", "Nan", "N"]), ("character-Bob", "Bo", "male", "same_as_narrator", "af_n", ["he", "Bo"]), ("character-Di", "Di", None, "separate_from_narrator", "bf_2", []),
        ("character-Eve", "Bob", None, "separate_from_narrator", "am_1", ["Bob"]), ("character-Zed", "Zed", None, "separate_from_narrator", "bf_2", []),
    ]
    frame = voice_plans.with_voices(voice_plans.cast_members(people, spoken, 2), ["af_n", "am_1", "bf_2"])
    keys = {r["speaker_id"]: r["cast_id"] for r in voice_plans.cast_keys(frame).collect()}
    assert keys["Bob"] == "character-Eve" and keys["Bo"] == "character-Bob" and keys["Nan"] == "character-Ann" and keys["narrator"] == "narrator" and "Carl" not in keys
    assert {r["alias_id"] for r in voice_plans.plan_aliases(frame).collect()} == {"x1", "alias-character-Ann-3", "alias-character-Ann-4", "alias-character-Bob-1", "alias-character-Bob-2", "alias-character-Eve-1"}
    assert voice_plans.with_voices(frame.drop("voice_id"), ["only"]).select("voice_id").distinct().collect()[0][0] == "only"
    with pytest.raises(ValueError):
        voice_plans.with_voices(frame, [])
