"""Output of analyzers as tables: tokens, quotes and characters from rows of text, and spans from records of many shapes.

Rows come as an analyzer wrote them, all fields texts, with their place in the file. What can't be read
is a violation, and a book with one gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from narrata.operators.artifact_rules import SPAN_TYPES

#: Kinds of mentions, and what stands for no character.
MENTIONS = {"PROP": "proper", "NOM": "nominal", "PRON": "pronoun"}
NO_CHARACTER = ("", "None")


def _number(field: str) -> Column:
    """A field as a whole number, null if it isn't one."""
    return F.when(F.col(field).rlike(r"^\s*[+-]?\d+\s*$"), F.trim(F.regexp_replace(field, r"\s+", "")).try_cast("long"))


def read_tokens(rows: DataFrame) -> DataFrame:
    """``(book_id, position, token_id, word, byte_start, byte_end)`` of rows (book_id, position, token_ID_within_document, word, byte_onset, byte_offset)."""
    return rows.select("book_id", "position", _number("token_ID_within_document").alias("token_id"), "word", _number("byte_onset").alias("byte_start"), _number("byte_offset").alias("byte_end"))


def read_quotes(rows: DataFrame) -> DataFrame:
    """``(book_id, position, quote_id, start_token, end_token, coref_id)`` of rows (book_id, position, quote_start, quote_end, char_id); both ends belong to the quote, and no character is -1."""
    nobody = F.col("char_id").isNull() | F.col("char_id").isin(*NO_CHARACTER)
    return rows.select("book_id", "position", F.col("position").cast("string").alias("quote_id"), _number("quote_start").alias("start_token"), _number("quote_end").alias("end_token"), F.when(nobody, F.lit(-1)).otherwise(_number("char_id")).alias("coref_id"))


def intake_violations(tokens: DataFrame, quotes: DataFrame) -> DataFrame:
    """``(book_id, file, position, rule)``: rows of read tokens and quotes that no analyzer may write."""
    c = F.col
    counts = tokens.groupBy("book_id").agg(F.count(F.lit(1)).alias("n_tokens"))
    of_tokens = F.array(
        F.when(~F.coalesce(c("token_id") == c("position"), F.lit(False)), "contiguous"),
        F.when(F.coalesce(c("word"), F.lit("")) == "", "word"),
        F.when(~F.coalesce((c("byte_start") >= 0) & (c("byte_end") >= 0), F.lit(False)), "offsets"),
    )
    of_quotes = F.array(
        F.when(~F.coalesce((c("start_token") >= 0) & (c("end_token") >= c("start_token")) & (c("end_token") < F.coalesce(c("n_tokens"), F.lit(0))), F.lit(False)), "range"),
        F.when(~F.coalesce(c("coref_id") >= -1, F.lit(False)), "character"),
    )

    def found(rows: DataFrame, file: str, rules: Column) -> DataFrame:
        return rows.select("book_id", F.lit(file).alias("file"), "position", F.explode(F.array_compact(rules)).alias("rule"))

    return found(tokens, "tokens", of_tokens).unionByName(found(quotes.join(counts, "book_id", "left"), "quotes", of_quotes))


def sound(rows: DataFrame, violations: DataFrame) -> DataFrame:
    """Rows of books without a violation."""
    return rows.join(violations.select("book_id").distinct(), "book_id", "left_anti")


def mentions(entities: DataFrame, tokens: DataFrame) -> DataFrame:
    """``(book_id, position, coref_id, alias, kind, token_start, token_end)``: mentions of persons that can be read; the rest is left out.

    ``entities``: book_id, position, COREF, start_token, end_token, prop, cat, text. The end that comes
    belongs to the mention, the end that goes out doesn't.
    """
    counts = tokens.groupBy("book_id").agg(F.count(F.lit(1)).alias("n_tokens"))
    kinds = F.create_map(*(F.lit(x) for pair in MENTIONS.items() for x in pair))
    rows = entities.where("cat = 'PER' and text <> ''").join(counts, "book_id").select(
        "book_id", "position", _number("COREF").alias("coref_id"), F.col("text").alias("alias"), F.coalesce(F.try_element_at(kinds, F.coalesce("prop", F.lit(""))), F.lit("nominal")).alias("kind"),
        _number("start_token").alias("token_start"), (_number("end_token") + 1).alias("token_end"), "n_tokens",
    )
    return rows.where("coref_id >= 0 and token_start >= 0 and token_start < token_end and token_end <= n_tokens").drop("n_tokens")


def characters(named: DataFrame, quotes: DataFrame) -> DataFrame:
    """``(book_id, coref_id, canonical_label, aliases, quote_count)``: mentions grouped by coreference.

    The label is the first mention, or the longest proper one if that is longer. Equal mentions of equal
    places count once, in the order of the file. Quotes are counted where they name the character.
    """
    first = F.struct(F.length("alias"), -F.col("position"))
    grouped = named.groupBy("book_id", "coref_id").agg(
        F.min("position").alias("first_at"), F.min_by("alias", "position").alias("first_alias"),
        F.max_by(F.when(F.col("kind") == "proper", F.col("alias")), F.when(F.col("kind") == "proper", first)).alias("longest"),
    )
    once = named.groupBy("book_id", "coref_id", "alias", "kind", "token_start", "token_end").agg(F.min("position").alias("position"))
    listed = once.groupBy("book_id", "coref_id").agg(F.array_sort(F.collect_list(F.struct("position", "alias", "kind", "token_start", "token_end"))).alias("aliases"))
    said = quotes.where("coref_id >= 0").groupBy("book_id", "coref_id").agg(F.count(F.lit(1)).alias("quote_count"))
    label = F.when(F.length("longest") > F.length("first_alias"), F.col("longest")).otherwise(F.col("first_alias"))
    met = grouped.join(listed, ["book_id", "coref_id"]).join(said, ["book_id", "coref_id"], "left")
    aliases = F.transform("aliases", lambda a: F.struct(a["alias"].alias("alias"), a["kind"].alias("kind"), a["token_start"].alias("token_start"), a["token_end"].alias("token_end")))
    return met.select("book_id", "coref_id", label.alias("canonical_label"), aliases.alias("aliases"), F.coalesce("quote_count", F.lit(0)).alias("quote_count"), "first_at")


def quote_spans(quotes: DataFrame, tokens: DataFrame, people: DataFrame) -> DataFrame:
    """``(book_id, quote_id, source_start, source_end, coref_id, label)``: quotes at the offsets of their first and last token, with who says them; ``tokens`` come with char_start and char_end."""
    t = tokens.select("book_id", "token_id", "char_start", "char_end")
    starts = t.select("book_id", F.col("token_id").alias("start_token"), F.col("char_start").alias("source_start"))
    ends = t.select("book_id", F.col("token_id").alias("end_token"), F.col("char_end").alias("source_end"))
    names = people.select("book_id", "coref_id", F.col("canonical_label").alias("label"))
    met = quotes.join(starts, ["book_id", "start_token"]).join(ends, ["book_id", "end_token"]).join(names, ["book_id", "coref_id"], "left")
    return met.select("book_id", "quote_id", "source_start", "source_end", F.when(F.col("label").isNotNull(), F.col("coref_id")).alias("coref_id"), "label")


def unified_spans(records: DataFrame, analyzer: str) -> DataFrame:
    """Spans of records (book_id, position, record as JSON text) of any of the shapes that analyzers give.

    The first name that is there counts, even if it holds null: offsets are ``source_start``, ``start`` or
    ``start_offset``, the speaker ``speaker_id`` or ``speaker``, the kind ``type`` or ``span_type``. A
    confidence may be an object or its score alone. Without a speaker a span is unknown and the narrator's.
    Offsets that aren't whole numbers are null and ``is_valid`` is false.
    """
    v = F.try_parse_json("record")

    def named(*names: str) -> Column:
        return F.coalesce(*(F.try_variant_get("v", f"$.{n}", "variant") for n in names))

    def kind(value: Column) -> Column:
        return F.schema_of_variant(value)

    def whole(value: Column) -> Column:
        return F.when(kind(value).isin("BIGINT"), F.try_variant_get(value, "$", "long"))

    def text(value: Column) -> Column:
        return F.when(~F.is_variant_null(value), F.try_variant_get(value, "$", "string"))

    rows = records.withColumn("v", v)
    rows = rows.select(
        "book_id", "position", named("source_start", "start", "start_offset").alias("a"), named("source_end", "end", "end_offset").alias("b"), named("speaker_id", "speaker").alias("who"),
        named("type", "span_type").alias("what"), named("confidence").alias("sure"), named("span_id").alias("id"), named("provenance").alias("whence"),
    )
    plain = F.coalesce(kind(F.col("sure")).startswith("OBJECT"), F.lit(False))
    score = F.when(plain, F.try_variant_get("sure", "$.score", "double")).otherwise(F.try_variant_get("sure", "$", "double"))
    speaker = F.trim(F.coalesce(text(F.col("who")), F.lit("")))
    nobody = F.lower(speaker).isin("", "unknown")
    told = F.coalesce(text(F.col("what")), F.when(F.col("what").isNull(), "narration").otherwise(""))
    return rows.select(
        "book_id", "position", F.coalesce(text(F.col("id")), F.format_string("machine-%d", F.col("position") + 1)).alias("span_id"), whole(F.col("a")).alias("source_start"), whole(F.col("b")).alias("source_end"),
        F.when(nobody | ~told.isin(*SPAN_TYPES), "unknown").otherwise(told).alias("type"), F.when(nobody, "narrator").otherwise(text(F.col("who"))).alias("speaker_id"),
        F.struct(
            F.coalesce(score, F.lit(0.0)).alias("score"), F.coalesce(F.when(plain, F.try_variant_get("sure", "$.band", "string")), F.lit("low")).alias("band"),
            F.coalesce(F.when(plain, F.try_variant_get("sure", "$.reasons", "array<string>")), F.array().cast("array<string>")).alias("reasons"),
        ).alias("confidence"),
        F.struct(F.coalesce(F.try_variant_get("whence", "$.source", "string"), F.lit(analyzer)).alias("source"), F.coalesce(F.try_variant_get("whence", "$.analysis_revision", "int"), F.lit(1)).alias("analysis_revision")).alias("provenance"),
        (whole(F.col("a")).isNotNull() & whole(F.col("b")).isNotNull()).alias("is_valid"),
    )


def scope_position(rows: DataFrame, order: str) -> DataFrame:
    """Rows with their place (from 0) in their book's file."""
    return rows.withColumn("position", (F.row_number().over(Window.partitionBy("book_id").orderBy(order)) - 1).cast("long"))
