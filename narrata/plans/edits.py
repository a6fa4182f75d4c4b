"""Edits of many voice plans at once: a table of edits against a table of plans, each edit at the revision it was made for.

A plan is an artifact (one row with its nested arrays), an edit a row of the same book. What an edit may
not do is its ``outcome``; a plan whose edit is refused stays as it is, one that is edited gets the next
revision, is a draft again, and has a new digest. All of it happens inside the row, so that books are
brought together with their edit once and nothing is looked at on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrata.functions import text as T
from narrata.operators import digests
from narrata.operators.artifact_rules import BANDS, MOST_TEXT, RELATIONSHIPS, SPAN_TYPES, VOICE_PLAN_FIELDS

#: Columns of edits besides book_id and expected_revision; those that a kind doesn't need are null.
EDIT = "kind string, cast_id string, target_id string, label string, voice_id string, speed double, pitch_semitones int, tone_preset string, relationship string, alias_ids array<string>, span_id string, to_value string, actor string, reason string"
KINDS = ("rename_cast", "assign_cast", "merge_aliases", "split_aliases", "remove_cast", "merge_cast", "override_speaker", "override_type")


def _members(cast_id: Column) -> Column:
    return F.filter("cast", lambda c: c["cast_id"] == cast_id)


def _asked_aliases() -> Column:
    return F.filter("aliases", lambda a: F.array_contains("e_alias_ids", a["alias_id"]))


def _new_id() -> Column:
    """The id of a character that is split off: as given, else from the label or the first alias."""
    return F.coalesce("e_target_id", T.slug(F.coalesce("e_label", F.get(_asked_aliases(), F.lit(0))["text"]), "character"))


def _settings() -> Column:
    """The settings of the member that is assigned, with what the edit gives."""
    own = F.get(_members(F.col("e_cast_id")), F.lit(0))["voice_settings"]
    return F.struct(F.coalesce("e_speed", own["speed"]).alias("speed"), F.coalesce("e_pitch_semitones", own["pitch_semitones"]).alias("pitch_semitones"), F.coalesce("e_tone_preset", own["tone_preset"]).alias("tone_preset"))


def _refusal() -> Column:
    """The code of what an edit may not do, null if it may."""
    kind, e = F.col("e_kind"), lambda name: F.col(f"e_{name}")
    own, target = F.size(_members(e("cast_id"))), F.size(_members(e("target_id")))
    role = F.get(_members(e("cast_id")), F.lit(0))["role"]
    target_role = F.get(_members(e("target_id")), F.lit(0))["role"]
    aliases = F.when(F.coalesce(F.size(e("alias_ids")), F.lit(0)) < 1, "INVALID_ALIAS_IDS").when(F.size(_asked_aliases()) != F.size(e("alias_ids")), "UNKNOWN_ALIAS_ID")
    spans = F.size(F.filter(F.flatten(F.transform("chapters", lambda c: c["spans"])), lambda s: s["span_id"] == e("span_id")))
    span = F.when(spans == 0, "UNKNOWN_SPAN_ID").when(spans > 1, "AMBIGUOUS_SPAN_ID")
    label = F.coalesce((e("label") != "") & (F.length(e("label")) <= MOST_TEXT) & ~e("label").rlike(r"[\x00-\x1f]"), F.lit(False))
    new = _settings()
    settings = (
        F.when(~F.coalesce(new["speed"].between(0.5, 2.0), F.lit(False)), "INVALID_SPEED").when(~F.coalesce(new["pitch_semitones"].between(-3, 3), F.lit(False)), "INVALID_PITCH")
        .when(~F.coalesce(new["tone_preset"].isin(*digests.TONES), F.lit(False)), "INVALID_TONE")
    )
    rules = {
        "rename_cast": F.when(own != 1, "UNKNOWN_CAST_ID").when(~label, "INVALID_DISPLAY_LABEL"),
        "assign_cast": F.when(own != 1, "UNKNOWN_CAST_ID").when(e("relationship").isNotNull() & ~e("relationship").isin(*RELATIONSHIPS), "INVALID_RELATIONSHIP").otherwise(settings),
        "merge_aliases": F.when((own != 1) | (role != "character"), "UNKNOWN_CAST_ID").otherwise(aliases),
        "split_aliases": F.coalesce(aliases, F.when(F.size(_members(_new_id())) > 0, "AMBIGUOUS_CAST_ID")),
        "remove_cast": F.when(own == 0, "UNKNOWN_CAST_ID").when(own > 1, "AMBIGUOUS_CAST_ID").when(role != "character", "CANNOT_REMOVE_NARRATOR"),
        "merge_cast": F.when(e("cast_id") == e("target_id"), "CANNOT_MERGE_SELF").when((own == 0) | (target == 0), "UNKNOWN_CAST_ID").when((own > 1) | (target > 1), "AMBIGUOUS_CAST_ID")
        .when((role != "character") | (target_role != "character"), "CANNOT_MERGE_NARRATOR"),
        "override_speaker": F.coalesce(span, F.when(F.size(_members(e("to_value"))) == 0, "UNKNOWN_CAST_ID")),
        "override_type": F.coalesce(span, F.when(~F.coalesce(e("to_value").isin(*SPAN_TYPES), F.lit(False)), "INVALID_SPAN_TYPE")),
    }
    by_kind = F.when(~F.coalesce(kind.isin(*KINDS), F.lit(False)), "INVALID_EDIT")
    for name, rule in rules.items():
        by_kind = by_kind.when(kind == name, rule)
    return F.when(F.col("revision") != F.col("e_expected_revision"), "STALE_REVISION").otherwise(by_kind)


def _cast_after() -> Column:
    kind, e = F.col("e_kind"), lambda name: F.col(f"e_{name}")
    narrator = F.get(_members(F.lit("narrator")), F.lit(0))
    same = F.coalesce(e("relationship") == "same_as_narrator", F.lit(False))

    def assigned(c: Column) -> Column:
        voice = F.when(same, F.coalesce(narrator["voice_id"], c["voice_id"])).otherwise(F.coalesce(e("voice_id"), c["voice_id"]))
        return F.when(c["cast_id"] == e("cast_id"), c.withField("voice_id", voice).withField("relationship", F.coalesce(e("relationship"), c["relationship"])).withField("voice_settings", _settings())).otherwise(c)

    renamed = F.transform("cast", lambda c: F.when(c["cast_id"] == e("cast_id"), c.withField("display_label", e("label"))).otherwise(c))
    plain = F.struct(F.lit(1.0).alias("speed"), F.lit(0).alias("pitch_semitones"), F.lit("neutral").alias("tone_preset"))
    added = narrator.withField("cast_id", _new_id()).withField("display_label", F.coalesce(e("label"), _new_id())).withField("role", F.lit("character")).withField("relationship", F.lit("separate_from_narrator"))
    added = added.withField("voice_id", F.coalesce(e("voice_id"), narrator["voice_id"])).withField("voice_settings", plain)
    return (
        F.when(kind == "rename_cast", renamed).when(kind == "assign_cast", F.transform("cast", assigned)).when(kind == "split_aliases", F.concat("cast", F.array(added)))
        .when(kind.isin("remove_cast", "merge_cast"), F.filter("cast", lambda c: c["cast_id"] != e("cast_id"))).otherwise(F.col("cast"))
    )


def _aliases_after() -> Column:
    kind, e = F.col("e_kind"), lambda name: F.col(f"e_{name}")
    asked = lambda a: F.array_contains("e_alias_ids", a["alias_id"])
    moved = lambda whose, to: F.transform("aliases", lambda a: F.when(whose(a), a.withField("character_id", to)).otherwise(a))
    return (
        F.when(kind == "merge_aliases", moved(asked, e("cast_id"))).when(kind == "split_aliases", moved(asked, _new_id())).when(kind == "remove_cast", F.filter("aliases", lambda a: a["character_id"] != e("cast_id")))
        .when(kind == "merge_cast", moved(lambda a: a["character_id"] == e("cast_id"), e("target_id"))).otherwise(F.col("aliases"))
    )


def _chapters_after() -> Column:
    kind, e = F.col("e_kind"), lambda name: F.col(f"e_{name}")

    def override(what: str, old: Column, new: Column, actor: Column, reason: Column) -> Column:
        return F.struct(F.lit(what).alias("kind"), old.cast("string").alias("from"), new.alias("to"), actor.alias("actor"), reason.alias("reason"))

    def span(s: Column) -> Column:
        own, asked = s["speaker_id"] == e("cast_id"), s["span_id"] == e("span_id")
        to = F.when(kind == "remove_cast", "narrator").otherwise(e("target_id"))
        why = F.when(kind == "remove_cast", "cast_removed").otherwise("cast_merged")
        actor = F.coalesce(e("actor"), F.lit("user"))
        taken = s.withField("speaker_id", to).withField("override", override("speaker", e("cast_id"), to, F.lit("user"), why))
        spoken = F.when((e("to_value") != "narrator") & (s["type"] == "unknown"), "dialogue").otherwise(s["type"])
        given = s.withField("speaker_id", e("to_value")).withField("type", spoken).withField("override", override("speaker", F.coalesce(s["speaker_id"], F.lit("None")), e("to_value"), actor, e("reason")))
        told = F.when(e("to_value").isin("narration", "unknown"), "narrator").otherwise(s["speaker_id"])
        typed = s.withField("type", e("to_value")).withField("speaker_id", told).withField("override", override("type", s["type"], e("to_value"), actor, e("reason")))
        return F.when(kind.isin("remove_cast", "merge_cast") & own, taken).when((kind == "override_speaker") & asked, given).when((kind == "override_type") & asked, typed).otherwise(s)

    return F.transform("chapters", lambda c: c.withField("spans", F.transform(c["spans"], span)))


def edited(plans: DataFrame, edits: DataFrame) -> DataFrame:
    """Plans with ``outcome``: ``edited``, ``unchanged`` (no edit), or the code of why their edit is refused.

    ``edits``: book_id, expected_revision and :data:`EDIT`, a row a book; edits of books that aren't there go.
    """
    named = edits.select("book_id", *(F.col(c).alias(f"e_{c}") for c in edits.columns if c != "book_id"))
    met = plans.join(named, "book_id", "left").withColumn("outcome", F.when(F.col("e_kind").isNull(), "unchanged").otherwise(F.coalesce(_refusal(), F.lit("edited"))))
    done = F.col("outcome") == "edited"
    draft = F.struct(F.lit("draft").alias("state"), F.lit(None).cast("string").alias("approved_at"), F.lit(None).cast("int").alias("approved_revision")).cast(plans.schema["approval"].dataType)
    after = {"cast": _cast_after(), "aliases": _aliases_after(), "chapters": _chapters_after(), "revision": F.col("revision") + 1, "approval": draft}
    rows = met.withColumns({name: F.when(done, value).otherwise(F.col(name)) for name, value in after.items()}).select(*plans.columns, "outcome")
    return rows.withColumn(digests.ARTIFACT_HASH, F.when(done, digests.digest(rows, VOICE_PLAN_FIELDS, newline=True)).otherwise(F.col(digests.ARTIFACT_HASH)))


def approved(plans: DataFrame, violations: DataFrame, accepted: DataFrame, at: str) -> DataFrame:
    """Drafts as approved plans, with ``outcome``: ``approved``, ``unchanged`` (it was), or why not.

    ``violations``: rules that plans break (book_id, code), of which the first by name is the outcome;
    ``accepted``: books whose unknown spans the narrator may speak (book_id), if they are the narrator's; ``at``: when, as a timestamp text.
    """
    wrong = violations.groupBy("book_id").agg(F.min("code").alias("wrong"))
    fallback = accepted.select("book_id").distinct().withColumn("accepts", F.lit(True))
    open_spans = F.exists("chapters", lambda c: F.exists(c["spans"], lambda s: s["type"] == "unknown"))
    others = F.exists("chapters", lambda c: F.exists(c["spans"], lambda s: (s["type"] == "unknown") & ~s["speaker_id"].eqNullSafe(F.lit("narrator"))))
    met = plans.join(wrong, "book_id", "left").join(fallback, "book_id", "left").withColumns({"open": open_spans, "others": others})
    state = F.col("approval.state")
    outcome = (
        F.when(F.col("wrong").isNotNull(), F.col("wrong")).when(state == "approved", "unchanged").when(F.coalesce(state != "draft", F.lit(True)), "INVALID_APPROVAL")
        .when((F.col("open") & F.col("accepts").isNull()) | F.col("others"), "UNRESOLVED_SPANS").otherwise("approved")
    )
    rows = met.withColumn("outcome", outcome)
    done = F.col("outcome") == "approved"
    policy = F.struct(F.lit("narrator").alias("mode"), F.lit(True).alias("accepted_by_user"), F.lit(at).alias("accepted_at")).cast(plans.schema["unresolved_policy"].dataType)
    approval = F.struct(F.lit("approved").alias("state"), F.lit(at).alias("approved_at"), F.col("revision").alias("approved_revision")).cast(plans.schema["approval"].dataType)
    rows = rows.withColumns({"unresolved_policy": F.when(done & F.col("open"), policy).otherwise(F.col("unresolved_policy")), "approval": F.when(done, approval).otherwise(F.col("approval"))}).select(*plans.columns, "outcome")
    return rows.withColumn(digests.ARTIFACT_HASH, F.when(done, digests.digest(rows, VOICE_PLAN_FIELDS, newline=True)).otherwise(F.col(digests.ARTIFACT_HASH)))


def _in_band(band: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["confidence"]["band"] == band))


def review(plans: DataFrame) -> DataFrame:
    """A row a plan with what a reviewer looks at: cast, spans by band, unknown, overridden and uncast ones, and voices that clash."""
    spans = F.flatten(F.transform("chapters", lambda c: c["spans"]))
    voice = F.get(_members(F.lit("narrator")), F.lit(0))["voice_id"]
    clash = F.filter("cast", lambda c: (c["role"] == "character") & (c["relationship"] != "same_as_narrator") & (c["voice_id"] == voice))
    count = lambda holds: F.size(F.filter("spans", holds))
    rows = plans.withColumn("spans", spans)
    return rows.select(
        "book_id", F.size("cast").alias("cast_count"), F.size("spans").alias("span_count"), *(_in_band(b).alias(f"n_{b}") for b in BANDS), count(lambda s: s["type"] == "unknown").alias("unresolved_count"),
        count(lambda s: s["override"].isNotNull()).alias("override_count"), count(lambda s: F.array_contains(s["confidence"]["reasons"], "speaker_not_cast")).alias("speaker_not_cast_count"), F.size(clash).alias("voice_collision_count"),
        "revision", F.col("approval.state").alias("approval_state"),
    )
