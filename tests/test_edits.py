"""Tables of edits: each kind's effect, each refusal, and approval."""

from __future__ import annotations

import hashlib

import pytest

from narrata.operators import artifact_rules, digests
from narrata.plans import edits
from tests.test_artifacts import PLAN, python_json, voice_plan

NAMES = [f.split(" ")[0] for f in edits.EDIT.split(", ")]
#: An edit, and its outcome.
CASES = [
    ({"kind": "rename_cast", "cast_id": "ann", "label": "Anna"}, "edited"), ({"kind": "rename_cast", "cast_id": "x", "label": "Anna"}, "UNKNOWN_CAST_ID"), ({"kind": "rename_cast", "cast_id": "ann", "label": ""}, "INVALID_DISPLAY_LABEL"),
    ({"kind": "assign_cast", "cast_id": "ann", "voice_id": "v9", "speed": 1.5}, "edited"), ({"kind": "assign_cast", "cast_id": "ann", "relationship": "x"}, "INVALID_RELATIONSHIP"), ({"kind": "assign_cast", "cast_id": "ann", "speed": 3.0}, "INVALID_SPEED"),
    ({"kind": "assign_cast", "cast_id": "ann", "pitch_semitones": 4}, "INVALID_PITCH"), ({"kind": "assign_cast", "cast_id": "ann", "tone_preset": "loud"}, "INVALID_TONE"), ({"kind": "assign_cast", "cast_id": "ann", "relationship": "same_as_narrator"}, "edited"),
    ({"kind": "merge_aliases", "cast_id": "me", "alias_ids": ["a2"]}, "edited"), ({"kind": "merge_aliases", "cast_id": "narrator", "alias_ids": ["a2"]}, "UNKNOWN_CAST_ID"), ({"kind": "merge_aliases", "cast_id": "me", "alias_ids": []}, "INVALID_ALIAS_IDS"), ({"kind": "merge_aliases", "cast_id": "me", "alias_ids": ["a2", "zz"]}, "UNKNOWN_ALIAS_ID"),
    ({"kind": "split_aliases", "alias_ids": ["a2"]}, "edited"), ({"kind": "split_aliases", "alias_ids": ["a2"], "target_id": "ann"}, "AMBIGUOUS_CAST_ID"), ({"kind": "split_aliases"}, "INVALID_ALIAS_IDS"),
    ({"kind": "remove_cast", "cast_id": "ann"}, "edited"), ({"kind": "remove_cast", "cast_id": "narrator"}, "CANNOT_REMOVE_NARRATOR"), ({"kind": "remove_cast", "cast_id": "x"}, "UNKNOWN_CAST_ID"),
    ({"kind": "merge_cast", "cast_id": "ann", "target_id": "me"}, "edited"), ({"kind": "merge_cast", "cast_id": "ann", "target_id": "ann"}, "CANNOT_MERGE_SELF"), ({"kind": "merge_cast", "cast_id": "ann", "target_id": "narrator"}, "CANNOT_MERGE_NARRATOR"), ({"kind": "merge_cast", "cast_id": "ann", "target_id": "x"}, "UNKNOWN_CAST_ID"),
    ({"kind": "override_speaker", "span_id": "s2", "to_value": "me", "reason": "r"}, "edited"), ({"kind": "override_speaker", "span_id": "s2", "to_value": "x", "reason": "r"}, "UNKNOWN_CAST_ID"), ({"kind": "override_speaker", "span_id": "s9", "to_value": "me", "reason": "r"}, "UNKNOWN_SPAN_ID"),
    ({"kind": "override_type", "span_id": "s2", "to_value": "unknown", "reason": "r"}, "edited"), ({"kind": "override_type", "span_id": "s2", "to_value": "song", "reason": "r"}, "INVALID_SPAN_TYPE"), ({"kind": "odd"}, "INVALID_EDIT"), (None, "unchanged"), ({"kind": "remove_cast", "cast_id": "ann", "expected": 1}, "STALE_REVISION"),
]


def plans(spark, artifacts):
    rows = []
    for n, a in enumerate(artifacts):
        body = {k: a[k] for k in artifact_rules.VOICE_PLAN_FIELDS}
        rows.append({"book_id": n} | a | {digests.ARTIFACT_HASH: hashlib.sha256((python_json(body) + "\n").encode()).hexdigest()})
    return spark.createDataFrame(rows, PLAN + f", {digests.ARTIFACT_HASH} string")


@pytest.fixture(scope="module")
def after(spark):
    given = [(n, e.get("expected", 2), *(e.get(c) for c in NAMES)) for n, (e, _) in enumerate(CASES) if e is not None]
    table = spark.createDataFrame(given, f"book_id long, expected_revision int, {edits.EDIT}")
    found = edits.edited(plans(spark, [voice_plan() for _ in CASES]), table)
    return found, {r["book_id"]: r for r in found.collect()}


def test_outcomes(after):
    assert [(CASES[n][0], r["outcome"]) for n, r in sorted(after[1].items())] == CASES
    for r in after[1].values():
        assert (r["revision"], r["approval"]["state"]) == ((3, "draft") if r["outcome"] == "edited" else (2, "approved"))


def test_digests_are_right_after_edits(after):
    assert digests.hash_violations(after[0], ["book_id"], artifact_rules.VOICE_PLAN_FIELDS).count() == 0


def test_effects(after):
    def row(kind, **more):
        return next(after[1][n] for n, (e, outcome) in enumerate(CASES) if e and outcome == "edited" and e["kind"] == kind and more.items() <= e.items())

    def member(r, cast_id):
        return next((c for c in r["cast"] if c["cast_id"] == cast_id), None)

    def span(r, span_id):
        return next(s for c in r["chapters"] for s in c["spans"] if s["span_id"] == span_id)

    assert member(row("rename_cast"), "ann")["display_label"] == "Anna"
    assigned = member(row("assign_cast", voice_id="v9"), "ann")
    assert (assigned["voice_id"], assigned["voice_settings"]["speed"], assigned["voice_settings"]["tone_preset"]) == ("v9", 1.5, "warm")
    assert member(row("assign_cast", relationship="same_as_narrator"), "ann")["voice_id"] == "v1"
    assert [a["character_id"] for a in row("merge_aliases")["aliases"]] == ["ann", "me"]
    split = row("split_aliases")
    assert split["cast"][-1]["cast_id"] == "character-she" and split["cast"][-1]["voice_id"] == "v1" and [a["character_id"] for a in split["aliases"]] == ["ann", "character-she"]
    removed = row("remove_cast")
    assert member(removed, "ann") is None and removed["aliases"] == [] and tuple(span(removed, "s4")["override"]) == ("speaker", "ann", "narrator", "user", "cast_removed") and span(removed, "s4")["speaker_id"] == "narrator"
    merged = row("merge_cast")
    assert member(merged, "ann") is None and {a["character_id"] for a in merged["aliases"]} == {"me"} and span(merged, "s2")["speaker_id"] == "me" and span(merged, "s2")["override"]["reason"] == "cast_merged"
    assert tuple(span(row("override_speaker"), "s2")["override"]) == ("speaker", "ann", "me", "user", "r")
    typed = span(row("override_type"), "s2")
    assert (typed["type"], typed["speaker_id"], typed["override"]["from"]) == ("unknown", "narrator", "dialogue")


def test_approval(spark):
    draft = {"approval": {"state": "draft", "approved_at": None, "approved_revision": None}}
    unknown = voice_plan() | draft
    unknown["chapters"][1]["spans"][0] |= {"type": "unknown", "speaker_id": "narrator"}
    other = voice_plan() | draft
    other["chapters"][1]["spans"][0] |= {"type": "unknown"}
    table = plans(spark, [voice_plan(), voice_plan() | draft, unknown, unknown, other, voice_plan() | draft])
    accepted = spark.createDataFrame([(3,), (4,)], "book_id long")
    broken = spark.createDataFrame([(5, "Z_LATER"), (5, "A_FIRST")], "book_id long, code string")
    got = {r["book_id"]: r for r in edits.approved(table, broken, accepted, "2026-05-06T07:08:09Z").collect()}
    assert [got[n]["outcome"] for n in range(6)] == ["unchanged", "approved", "UNRESOLVED_SPANS", "approved", "UNRESOLVED_SPANS", "A_FIRST"]
    assert got[3]["unresolved_policy"]["accepted_at"] == got[3]["approval"]["approved_at"] == "2026-05-06T07:08:09Z" and got[1]["approval"]["approved_revision"] == 2
    assert not got[1]["unresolved_policy"]["accepted_by_user"] and got[2]["approval"]["state"] == "draft"
