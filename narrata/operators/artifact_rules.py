"""Rules of nested artifacts: speaker analyses and voice plans.

An artifact is one row. Its levels (characters, aliases, cast, chapters, spans) are taken apart once, each
row with its JSON path; what binds an artifact to a book is compared by digest; what has to exist on
another level of the same artifact is found by anti joins, and what has to be unique by counting. Rules
are judged each on its own: ``(book_id, code, rule, path)``, a row for each broken one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from narrata.operators import digests
from narrata.operators.plan_rules import Check, _at, broken
from narrata.operators.rules import SHA256, TIMESTAMP

#: Names and bounds of artifacts.
STABLE_ID = r"^[A-Za-z0-9._:-]{1,512}$"
SPAN_TYPES, BANDS = ("narration", "dialogue", "thought", "unknown"), ("low", "medium", "high")
ALIAS_KINDS, ROLES, RELATIONSHIPS = ("proper", "nominal", "pronoun"), ("narrator", "character"), ("third_person", "same_as_narrator", "separate_from_narrator")
MOST_TEXT, MOST_LONG_TEXT, MOST_WARNINGS = 512, 8 * 1024, 8 * 1024 * 1024
MOST_ENTITIES, MOST_SPANS, MOST_BYTES = 100_000, 2_000_000, 512 * 1024 * 1024
#: Fields that an artifact's digest covers.
ANALYSIS_FIELDS = (
    "schema_version", "artifact", "revision", "source_pdf_sha256", "cleaned_text_sha256", "chapter_plan_sha256", "chapter_plan_schema_version", "analyzer", "characters", "spans", "warnings",
    "chapter_start", "chapter_end",
)
VOICE_PLAN_FIELDS = (
    "schema_version", "artifact", "revision", "source_pdf_sha256", "cleaned_text_sha256", "chapter_plan_sha256", "chapter_plan_schema_version", "analyzer", "cast", "aliases", "chapters",
    "unresolved_policy", "approval",
)


def _sized(value: Column) -> Column:
    return F.coalesce(F.size(value), F.lit(0))


def _text_is(value: Column, most: int | None = MOST_TEXT) -> Column:
    """A text with letters, without control characters, within a length."""
    holds = (value != "") & ~value.rlike(r"[\x00-\x1f]")
    return holds if most is None else holds & (F.length(value) <= most)


def _field(base: Column, name: str) -> Column:
    return F.concat(base, F.lit("." + name))


def _root(name: str) -> Column:
    return F.lit("$." + name)


def _bound(artifacts: DataFrame, bindings: DataFrame) -> DataFrame:
    """Artifacts with what their book is now: ``now_`` source_pdf_sha256, cleaned_text_sha256, chapter_plan_sha256 (expected), current_plan_sha256, plan_schema_version, n_chapters."""
    return artifacts.join(bindings.select("book_id", *(F.col(c).alias(f"now_{c}") for c in bindings.columns if c != "book_id")), "book_id", "left")


def _header_checks(name: str, fields: Sequence[str], bound: DataFrame) -> list[Check]:
    c = F.col
    forms = [(f"INVALID_{f.upper()}", "form", _root(f), c(f).rlike(SHA256)) for f in ("source_pdf_sha256", "cleaned_text_sha256", "chapter_plan_sha256")]
    given = c(digests.ARTIFACT_HASH)
    return [
        ("INVALID_SCHEMA_VERSION", "version", _root("schema_version"), c("schema_version") == 1),
        ("INVALID_ARTIFACT_TYPE", "artifact", _root("artifact"), c("artifact") == name),
        ("INVALID_REVISION", "revision", _root("revision"), c("revision") > 0),
        *forms,
        ("SOURCE_HASH_MISMATCH", "binding", _root("source_pdf_sha256"), c("source_pdf_sha256") == c("now_source_pdf_sha256")),
        ("CHAPTER_PLAN_HASH_MISMATCH", "binding", _root("chapter_plan_sha256"), c("chapter_plan_sha256") == c("now_chapter_plan_sha256")),
        ("CHAPTER_PLAN_HASH_MISMATCH", "current", _root("chapter_plan_sha256"), c("now_current_plan_sha256") == c("now_chapter_plan_sha256")),
        ("CHAPTER_PLAN_SCHEMA_MISMATCH", "version", _root("chapter_plan_schema_version"), c("chapter_plan_schema_version") == 1),
        ("CLEANED_TEXT_HASH_MISMATCH", "binding", _root("cleaned_text_sha256"), c("cleaned_text_sha256") == c("now_cleaned_text_sha256")),
        ("INVALID_ARTIFACT", "canonical", F.lit("$"), c("_canonical").isNotNull()),
        ("INVALID_ARTIFACT_HASH", "form", _root(digests.ARTIFACT_HASH), given.rlike(SHA256)),
        ("ARTIFACT_HASH_MISMATCH", "digest", _root(digests.ARTIFACT_HASH), c("_canonical").isNull() | ~F.coalesce(given.rlike(SHA256), F.lit(False)) | (given == F.sha2("_canonical", 256))),
        ("INVALID_ANALYZER_ID", "analyzer", _root("analyzer.id"), _text_is(c("analyzer.id"))),
        ("INVALID_ANALYZER_VERSION", "analyzer", _root("analyzer.version"), _text_is(c("analyzer.version"))),
        ("INVALID_MODEL_HASH", "analyzer", _root("analyzer.model_hash"), c("analyzer").isNotNull() & F.coalesce(c("analyzer.model_hash").rlike(SHA256), F.lit(True))),
    ]


def _header(name: str, artifacts: DataFrame, bindings: DataFrame, fields: Sequence[str], more: Sequence[Check]) -> DataFrame:
    bound = _bound(artifacts, bindings).withColumn("_canonical", digests.canonical_row(artifacts, fields, newline=True))
    return broken(bound, ["book_id"], [*_header_checks(name, fields, bound), *more])


def _confidence_checks(path: Column) -> list[Check]:
    score, reasons = F.col("confidence.score"), F.col("confidence.reasons")
    length = F.aggregate(reasons, F.lit(0), lambda s, r: s + F.coalesce(F.length(r), F.lit(0)))
    return [
        ("INVALID_CONFIDENCE", "score", _field(path, "confidence.score"), ~F.isnan(score) & score.between(0, 1)),
        ("INVALID_CONFIDENCE_BAND", "band", _field(path, "confidence.band"), F.col("confidence.band").isin(*BANDS)),
        ("INVALID_CONFIDENCE_REASONS", "reasons", _field(path, "confidence.reasons"), (length <= MOST_LONG_TEXT) & F.forall(reasons, lambda r: F.coalesce(_text_is(r, MOST_LONG_TEXT), F.lit(False)))),
    ]


def _span_checks(path: Column) -> list[Check]:
    c = F.col
    return [
        ("INVALID_SPAN_ID", "id", _field(path, "span_id"), c("span_id").rlike(STABLE_ID)),
        ("INVALID_RANGE", "range", _field(path, "source_start"), (c("source_start") >= 0) & (c("source_end") > c("source_start"))),
        ("INVALID_SPAN_TYPE", "type", _field(path, "type"), c("type").isin(*SPAN_TYPES)),
        ("INVALID_PROVENANCE_SOURCE", "provenance", _field(path, "provenance.source"), _text_is(c("provenance.source"), MOST_LONG_TEXT)),
        *_confidence_checks(path),
    ]


def _placed_checks(path: Column) -> list[Check]:
    """Of spans in the order of the artifact, with the chapter they name (``c_start``, ``c_end``) and the one before them."""
    c = F.col
    return [
        ("DUPLICATE_SPAN_ID", "unique", _field(path, "span_id"), c("same_id") == 1),
        ("UNORDERED_SPANS", "order", _field(path, "source_start"), c("source_start") >= F.coalesce(c("before_start"), F.lit(-1))),
        ("OVERLAPPING_SPANS", "overlap", _field(path, "source_start"), (c("source_start") < F.coalesce(c("before_start"), F.lit(-1))) | (c("source_start") >= F.coalesce(c("before_end"), F.lit(-1)))),
        ("INVALID_CHAPTER_INDEX", "chapter", _field(path, "chapter_index"), c("c_start").isNotNull()),
        ("CROSS_CHAPTER", "chapter", _field(path, "source_start"), c("c_start").isNull() | ((c("source_start") >= c("c_start")) & (c("source_end") <= c("c_end")))),
    ]


def _placed(spans: DataFrame, chapters: DataFrame, order: Sequence[str]) -> DataFrame:
    """Spans with the one before them in the artifact, how often their id stands there, and the chapter they name."""
    book = Window.partitionBy("book_id").orderBy(*order)
    seen = spans.withColumns({
        "before_start": F.lag("source_start").over(book), "before_end": F.lag("source_end").over(book), "is_last": F.lead("source_start").over(book).isNull(),
        "same_id": F.row_number().over(Window.partitionBy("book_id", "span_id").orderBy(*order)),
    })
    c = chapters.select("book_id", "chapter_index", F.col("start_offset").alias("c_start"), F.col("end_offset").alias("c_end"))
    return seen.join(c, ["book_id", "chapter_index"], "left")


def _missing(rows: DataFrame, key: str, there: DataFrame, there_key: str, code: str, rule: str, field: str) -> DataFrame:
    """Rows whose ``key`` isn't among the ids of another level of their artifact."""
    ids = there.select(F.col("book_id").alias("_book"), F.col(there_key).alias("_id")).distinct()
    lost = rows.where(F.col(key).isNotNull()).join(ids, (F.col("book_id") == F.col("_book")) & (F.col(key) == F.col("_id")), "left_anti")
    return lost.select("book_id", F.lit(code).alias("code"), F.lit(rule).alias("rule"), _field(F.col("path"), field).alias("path"))


def _numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> Column:
    """The how manieth of its equals a row is."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))


def _level(artifacts: DataFrame, name: str, *more: str) -> DataFrame:
    """The elements of an array of the artifact with their place and path."""
    rows = artifacts.select("book_id", *more, F.posexplode(name).alias("position", "e"))
    return rows.select("book_id", *more, "position", _at(name, F.col("position")).alias("path"), "e.*")


def analysis_violations(analyses: DataFrame, bindings: DataFrame, chapters: DataFrame) -> DataFrame:
    """Broken rules of speaker analyses; ``chapters``: book_id, chapter_index, start_offset, end_offset of the current plan.

    ``bindings``: a row a book with source_pdf_sha256, cleaned_text_sha256, chapter_plan_sha256 (expected),
    current_plan_sha256 and n_chapters. An analysis without chapter_start and chapter_end is of the whole book.
    """
    c = F.col
    first, last = c("chapter_start"), c("chapter_end")
    entities = F.aggregate("characters", F.lit(0), lambda s, x: s + 1 + _sized(x["aliases"]))
    warned = F.aggregate("warnings", F.lit(0), lambda s, x: s + F.coalesce(F.length(x), F.lit(0)))
    header = _header("speaker-analysis", analyses, bindings, ANALYSIS_FIELDS, [
        ("INVALID_ANALYSIS", "scope", _root("chapter_start"), first.isNull() == last.isNull()),
        ("INVALID_CHAPTER_RANGE", "scope", _root("chapter_start"), first.isNull() | last.isNull() | ((first >= 1) & (last >= first) & (last <= c("now_n_chapters")))),
        ("INVALID_CHARACTERS", "list", _root("characters"), c("characters").isNotNull()),
        ("INVALID_SPANS", "list", _root("spans"), c("spans").isNotNull()),
        ("ANALYSIS_TOO_LARGE", "entities", _root("characters"), F.coalesce(entities, F.lit(0)) <= MOST_ENTITIES),
        ("ANALYSIS_TOO_LARGE", "spans", _root("spans"), _sized(c("spans")) <= MOST_SPANS),
        ("ANALYSIS_TOO_LARGE", "bytes", F.lit("$"), F.coalesce(F.octet_length("_canonical"), F.lit(0)) <= MOST_BYTES),
        ("INVALID_WARNINGS", "warnings", _root("warnings"), (warned <= MOST_WARNINGS) & F.forall("warnings", lambda w: F.coalesce((F.length(w) <= MOST_LONG_TEXT) & ~w.rlike(r"[\x00-\x1f]"), F.lit(False)))),
    ])
    people = _level(analyses, "characters")
    unique = _numbered(people, ["book_id", "character_id"], ["position"])
    of_people = broken(people.withColumn("same_id", unique), ["book_id"], [
        ("INVALID_CHARACTER_ID", "id", _field(c("path"), "character_id"), c("character_id").rlike(STABLE_ID) & (c("character_id") != "narrator")),
        ("DUPLICATE_CHARACTER_ID", "unique", _field(c("path"), "character_id"), c("same_id") == 1),
        ("INVALID_CANONICAL_LABEL", "label", _field(c("path"), "canonical_label"), _text_is(c("canonical_label"))),
        ("INVALID_CHARACTER_COUNT", "lines", _field(c("path"), "line_count"), c("line_count") >= 0),
        ("INVALID_CHARACTER_COUNT", "quotes", _field(c("path"), "quote_count"), c("quote_count") >= 0),
        ("INVALID_ALIASES", "list", _field(c("path"), "aliases"), c("aliases").isNotNull()),
    ])
    names = people.select("book_id", F.col("path").alias("owner"), F.posexplode("aliases").alias("place", "a"))
    names = names.select("book_id", "owner", "place", F.concat("owner", F.lit(".aliases["), F.col("place").cast("string"), F.lit("]")).alias("path"), "a.*")
    same = ["book_id", "owner", "alias", "kind", "confidence", "provenance"]
    of_names = broken(names.withColumn("same", _numbered(names, same, ["place"])), ["book_id"], [
        ("INVALID_ALIAS", "text", _field(c("path"), "alias"), _text_is(c("alias"))),
        ("INVALID_ALIAS_KIND", "kind", _field(c("path"), "kind"), c("kind").isin(*ALIAS_KINDS)),
        ("INVALID_ALIAS_CONFIDENCE", "confidence", _field(c("path"), "confidence"), ~F.isnan("confidence") & c("confidence").between(0, 1)),
        ("INVALID_ALIAS_PROVENANCE_SOURCE", "provenance", _field(c("path"), "provenance.source"), _text_is(c("provenance.source"), MOST_LONG_TEXT)),
        ("INVALID_TOKEN_RANGE", "tokens", _field(c("path"), "provenance.token_start"), (c("provenance.token_start") >= 0) & (c("provenance.token_end") > c("provenance.token_start"))),
        ("DUPLICATE_ALIAS", "unique", c("path"), c("same") == 1),
    ])
    spans = _level(analyses, "spans", "chapter_start", "chapter_end")
    inside = c("chapter_start").isNull() | c("chapter_end").isNull() | c("chapter_index").between(c("chapter_start"), c("chapter_end"))
    of_spans = broken(_placed(spans, chapters, ["position"]), ["book_id"], [
        *_span_checks(c("path")),
        *_placed_checks(c("path")),
        ("CHAPTER_OUTSIDE_ANALYZED_RANGE", "scope", _field(c("path"), "chapter_index"), inside),
        ("INVALID_SPEAKER_ID", "speaker", _field(c("path"), "speaker_id"), F.coalesce(c("speaker_id").rlike(STABLE_ID), F.lit(True))),
        ("INVALID_QUOTE_ID", "quote", _field(c("path"), "provenance.quote_id"), F.coalesce(c("provenance.quote_id").rlike(STABLE_ID), F.lit(True))),
    ])
    lost = _missing(spans.where("speaker_id <> 'narrator'"), "speaker_id", people, "character_id", "UNKNOWN_SPEAKER_REFERENCE", "reference", "speaker_id")
    return header.unionByName(of_people).unionByName(of_names).unionByName(of_spans).unionByName(lost)


def voice_plan_violations(plans: DataFrame, bindings: DataFrame, chapters: DataFrame) -> DataFrame:
    """Broken rules of voice plans; ``chapters``: book_id, chapter_index, start_offset, end_offset, start_page, end_page of the current plan.

    A draft may leave spans without a speaker; an approved plan covers its book by spans without gaps,
    all of them spoken by the cast, and unknown ones by the narrator if that was accepted.
    """
    c = F.col
    draft, accepted = c("approval.state") == "draft", c("unresolved_policy.accepted_by_user")
    header = _header("voice-plan", plans, bindings, VOICE_PLAN_FIELDS, [
        ("INVALID_CAST", "list", _root("cast"), c("cast").isNotNull()),
        ("INVALID_ALIASES", "list", _root("aliases"), c("aliases").isNotNull()),
        ("VOICE_PLAN_TOO_LARGE", "entities", _root("cast"), _sized(c("cast")) + _sized(c("aliases")) <= MOST_ENTITIES),
        ("VOICE_PLAN_TOO_LARGE", "spans", _root("chapters"), F.coalesce(F.aggregate("chapters", F.lit(0), lambda s, x: s + _sized(x["spans"])), F.lit(0)) <= MOST_SPANS),
        ("CHAPTER_COVERAGE_MISMATCH", "count", _root("chapters"), (_sized(c("chapters")) > 0) & (_sized(c("chapters")) == c("now_n_chapters"))),
        ("INVALID_UNRESOLVED_POLICY", "policy", _root("unresolved_policy.mode"), (c("unresolved_policy.mode") == "narrator") & accepted.isNotNull()),
        ("INVALID_ACCEPTED_AT", "time", _root("unresolved_policy.accepted_at"), F.when(accepted, c("unresolved_policy.accepted_at").rlike(TIMESTAMP)).otherwise(c("unresolved_policy.accepted_at").isNull())),
        ("INVALID_APPROVAL", "state", _root("approval.state"), c("approval.state").isin("draft", "approved")),
        ("INVALID_DRAFT_APPROVAL", "draft", _root("approval.approved_at"), ~draft | (c("approval.approved_at").isNull() & c("approval.approved_revision").isNull())),
        ("INVALID_APPROVED_AT", "time", _root("approval.approved_at"), draft | c("approval.approved_at").rlike(TIMESTAMP)),
        ("INVALID_APPROVED_REVISION", "revision", _root("approval.approved_revision"), draft | (c("approval.approved_revision") > 0)),
        ("APPROVAL_REVISION_MISMATCH", "revision", _root("approval.approved_revision"), draft | ~(c("approval.approved_revision") > 0) | (c("approval.approved_revision") == c("revision"))),
    ])
    cast = _level(plans, "cast")
    settings = cast.select("*", "voice_settings.*")
    of_cast = broken(cast.withColumn("same_id", _numbered(cast, ["book_id", "cast_id"], ["position"])), ["book_id"], [
        ("INVALID_CAST_ID", "id", _field(c("path"), "cast_id"), _text_is(c("cast_id"), None)),
        ("DUPLICATE_CAST_ID", "unique", _field(c("path"), "cast_id"), c("same_id") == 1),
        ("INVALID_DISPLAY_LABEL", "label", _field(c("path"), "display_label"), _text_is(c("display_label"))),
        ("INVALID_ROLE", "role", _field(c("path"), "role"), c("role").isin(*ROLES)),
        ("INVALID_RELATIONSHIP", "relationship", _field(c("path"), "relationship"), c("relationship").isin(*RELATIONSHIPS)),
        ("INVALID_VOICE_ID", "voice", _field(c("path"), "voice_id"), _text_is(c("voice_id"), None)),
    ])
    voices = digests.settings_violations(settings, ["book_id", "path"]).select("book_id", F.col("rule").alias("code"), F.lit("settings").alias("rule"), _field(c("path"), "voice_settings").alias("path"))
    own = c("cast_id") == "narrator"
    facts = cast.groupBy("book_id").agg(
        F.count_if(own & (c("role") == "narrator")).alias("both"), F.count_if(own).alias("by_id"), F.count_if(c("role") == "narrator").alias("by_role"), F.max(F.when(own, c("voice_id"))).alias("narrator_voice")
    )
    narrated = plans.select("book_id").join(facts, "book_id", "left").na.fill(0, ["both", "by_id", "by_role"])
    of_narrator = broken(narrated, ["book_id"], [
        ("MISSING_NARRATOR", "narrator", _root("cast"), (c("by_id") > 0) | (c("by_role") > 0)),
        ("MISIDENTIFIED_NARRATOR", "narrator", _root("cast"), ((c("by_id") == 0) & (c("by_role") == 0)) | ((c("both") == 1) & (c("by_role") == 1))),
    ])
    like_him = cast.where("role = 'character' and relationship = 'same_as_narrator'").join(facts.select("book_id", "narrator_voice"), "book_id")
    of_likes = broken(like_him, ["book_id"], [("NARRATOR_VOICE_MISMATCH", "voice", _field(c("path"), "voice_id"), c("narrator_voice").isNull() | (c("voice_id") == c("narrator_voice")))])
    names = _level(plans, "aliases")
    of_names = broken(names.withColumn("same_id", _numbered(names, ["book_id", "alias_id"], ["position"])), ["book_id"], [
        ("INVALID_ALIAS_ID", "id", _field(c("path"), "alias_id"), _text_is(c("alias_id"))),
        ("DUPLICATE_ALIAS_ID", "unique", _field(c("path"), "alias_id"), c("same_id") == 1),
        ("INVALID_ALIAS_TEXT", "text", _field(c("path"), "text"), _text_is(c("text"))),
        ("INVALID_OVERRIDE_STATE", "state", _field(c("path"), "override_state"), c("override_state") == "accepted"),
        ("INVALID_CHARACTER_ID", "id", _field(c("path"), "character_id"), _text_is(c("character_id"))),
    ])
    homeless = _missing(names, "character_id", cast.where("role = 'character'"), "cast_id", "INVALID_ALIAS_CHARACTER", "reference", "character_id")
    parts = _level(plans, "chapters", "approval", "unresolved_policy")
    now = chapters.select("book_id", (F.col("chapter_index") - 1).cast("int").alias("position"), F.col("chapter_index").alias("n_index"), F.col("start_offset").alias("n_start"), F.col("end_offset").alias("n_end"), F.col("start_page").alias("n_page"), F.col("end_page").alias("n_last_page"))
    pairs = (("chapter_index", "n_index"), ("source_start", "n_start"), ("source_end", "n_end"), ("source_page_start", "n_page"), ("source_page_end", "n_last_page"))
    agrees = F.lit(True)
    for mine, theirs in pairs:
        agrees = agrees & (c(mine) == c(theirs))
    of_parts = broken(parts.join(now, ["book_id", "position"], "left"), ["book_id"], [
        ("INVALID_CHAPTER_RANGE", "fields", c("path"), F.lit(True) & c("chapter_index").isNotNull() & c("source_start").isNotNull() & c("source_end").isNotNull()),
        ("CHAPTER_COVERAGE_MISMATCH", "chapter", c("path"), c("n_index").isNull() | agrees),
        ("INVALID_SPANS", "list", _field(c("path"), "spans"), c("spans").isNotNull()),
    ])
    spans = parts.select("book_id", "chapter_index", F.col("position").alias("part"), F.col("path").alias("owner"), "approval", "unresolved_policy", F.posexplode("spans").alias("position", "s"))
    spans = spans.select("book_id", "chapter_index", "part", "position", F.concat("owner", F.lit(".spans["), F.col("position").cast("string"), F.lit("]")).alias("path"), "approval", "unresolved_policy", "s.*")
    over = c("override")
    effective = F.when(over["kind"] == "speaker", c("speaker_id")).otherwise(c("type"))
    met = _placed(spans, chapters, ["part", "position"])
    expected = F.coalesce(c("before_end"), F.lit(0))
    unknown = c("type") == "unknown"
    policy = F.when(accepted, c("speaker_id").eqNullSafe(F.lit("narrator"))).otherwise(draft)
    of_spans = broken(met, ["book_id"], [
        *_span_checks(c("path")),
        *_placed_checks(c("path")),
        ("INVALID_ANALYSIS_REVISION", "revision", _field(c("path"), "provenance.analysis_revision"), c("provenance.analysis_revision") > 0),
        ("INVALID_OVERRIDE", "kind", _field(c("path"), "override.kind"), over.isNull() | over["kind"].isin("speaker", "type")),
        *((f"INVALID_OVERRIDE_{f.upper()}", "text", _field(c("path"), f"override.{f}"), over.isNull() | _text_is(over[f], MOST_LONG_TEXT)) for f in ("from", "to", "actor", "reason")),
        ("INVALID_OVERRIDE", "effect", _field(c("path"), "override.to"), over.isNull() | over["to"].eqNullSafe(effective)),
        ("INCOMPLETE_COVERAGE", "gap", _field(c("path"), "source_start"), c("source_start") <= expected),
        ("UNRESOLVED_SPANS", "unknown", _field(c("path"), "type"), ~unknown | policy),
        ("UNASSIGNED_SPEAKER", "speaker", _field(c("path"), "speaker_id"), c("speaker_id").isNotNull() | draft),
    ])
    ends = met.groupBy("book_id").agg(F.max("source_end").alias("reach"))
    goal = chapters.groupBy("book_id").agg(F.max("end_offset").alias("goal"))
    short = broken(plans.select("book_id").join(ends, "book_id", "left").join(goal, "book_id", "left"), ["book_id"], [("INCOMPLETE_COVERAGE", "end", _root("chapters"), F.coalesce(c("reach"), F.lit(0)) >= F.coalesce(c("goal"), F.lit(0)))])
    strangers = _missing(spans, "speaker_id", cast, "cast_id", "UNKNOWN_SPEAKER_REFERENCE", "reference", "speaker_id")
    out = header
    for more in (of_cast, voices, of_narrator, of_likes, of_names, homeless, of_parts, of_spans, short, strangers):
        out = out.unionByName(more)
    return out
