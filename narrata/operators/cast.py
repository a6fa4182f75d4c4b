"""Cast resolution: which speakers become characters, their labels, genders and voices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from narrata.functions import text as T
from narrata.operators.spans import LEAST_QUOTES, speaking_counts

#: Labels that are pronouns, and genders that pronouns and gender words stand for.
PRONOUNS = (
    "i", "me", "my", "mine", "myself", "we", "us", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves",
    "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself", "they", "them", "their", "theirs", "themselves",
)
PRONOUN_GENDERS = {"he": "male", "him": "male", "his": "male", "himself": "male", "she": "female", "her": "female", "hers": "female", "herself": "female"}
GENDER_WORDS = {"f": "female", "female": "female", "woman": "female", "girl": "female", "m": "male", "male": "male", "man": "male", "boy": "male"}
#: Labels that are titles without a name.
BARE_TITLES = (
    "admiral", "captain", "chief", "coach", "colonel", "commander", "doctor", "dr", "general", "judge", "king", "lady", "lieutenant", "lord", "major",
    "marshal", "miss", "mr", "mrs", "ms", "officer", "private", "professor", "reverend", "sergeant", "sir", "the captain", "the doctor", "the judge", "the officer",
)


def _mapped(value: Column, words: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in words.items() for x in pair))[F.lower(F.trim(value))]


def gender_word(value: Column) -> Column:
    return _mapped(value, GENDER_WORDS)


def looks_like_name(label: Column) -> Column:
    """Starts with a capital, and is no pronoun, bare title or identifier of a machine."""
    low = F.lower(F.trim(label))
    machine = low.rlike(r"^(?:character|speaker|person|entity|id)[-_][a-z0-9]+(?:[-_][a-z0-9]+)*$") | low.rlike(r"^[a-z]+[-_]\d+$") | low.rlike(r"[-_](?:id|uuid)$")
    return F.coalesce((F.trim(label) != "") & ~low.isin(*PRONOUNS, *BARE_TITLES) & F.trim(label).rlike(r"^\p{Lu}") & ~machine, F.lit(False))


def voice_gender(voice_id: Column) -> Column:
    """The gender in a voice's id family: its second letter."""
    return F.when(F.substring(voice_id, 2, 1) == "f", "female").when(F.substring(voice_id, 2, 1) == "m", "male")


def canonical_labels(aliases: DataFrame) -> DataFrame:
    """Per character its label: the first alias, replaced by the longest proper one if that is longer.

    ``aliases``: book_id, character_id, ord, alias, kind. Of equal lengths the first counts.
    """
    first = F.min_by("alias", "ord")
    proper = F.max_by(F.when(F.col("kind") == "proper", F.col("alias")), F.when(F.col("kind") == "proper", F.struct(F.length("alias"), -F.col("ord"))))
    found = aliases.groupBy("book_id", "character_id").agg(first.alias("first_alias"), proper.alias("proper_alias"), F.count_distinct("alias", "kind").alias("n_aliases"))
    label = F.when(F.length("proper_alias") > F.length("first_alias"), F.col("proper_alias")).otherwise(F.col("first_alias"))
    return found.select("book_id", "character_id", label.alias("label"), "n_aliases")


def character_genders(aliases: DataFrame) -> DataFrame:
    """Per character the one gender that its pronoun aliases agree on, else null."""
    gender = F.when(F.col("kind") == "pronoun", _mapped(F.col("alias"), PRONOUN_GENDERS))
    found = aliases.groupBy("book_id", "character_id").agg(F.collect_set(gender).alias("genders"))
    return found.select("book_id", "character_id", F.when(F.size("genders") == 1, F.get("genders", F.lit(0))).alias("gender"))


def resolve_cast(spans: DataFrame, characters: DataFrame, voices: list[str], least_quotes: int = LEAST_QUOTES) -> DataFrame:
    """Characters with enough spoken spans and the voices they get.

    ``characters``: book_id, ord, character_id, label, gender, keys (names that spans may use). A
    character's spans under all its keys count. Voices but the first, the narrator's, are dealt out in
    turn; a voice of the character's gender is preferred, and the turn passes all the same.
    """
    keyed = characters.select("book_id", "ord", "character_id", "label", "gender", F.explode(F.array_distinct("keys")).alias("speaker_id"))
    spoken = keyed.join(speaking_counts(spans), ["book_id", "speaker_id"]).groupBy("book_id", "ord", "character_id", "label", "gender").agg(F.sum("n_spans").alias("n_spans"))
    kept = spoken.where((F.col("n_spans") >= least_quotes) & looks_like_name(F.col("label")))
    rest = F.array(*(F.lit(v) for v in voices[1:])).cast("array<string>")
    turn = F.row_number().over(Window.partitionBy("book_id").orderBy("ord")) - 1
    fallback = F.get(rest, (turn % max(1, len(voices) - 1)).cast("int")) if len(voices) > 1 else F.lit(voices[0])
    gendered = kept.withColumns({"fallback": fallback, "wanted": F.filter(rest, lambda v: voice_gender(v) == F.col("gender"))})
    return gendered.select(
        "book_id", T.slug(F.col("character_id"), "character").alias("cast_id"), "label", "n_spans", "gender", F.coalesce(F.get("wanted", F.lit(0)), F.col("fallback")).alias("voice_id")
    )


def speakers_to_cast(spans: DataFrame, cast_keys: DataFrame) -> DataFrame:
    """Spans with the cast member that speaks; a speaker without one falls to the narrator, and the span is unknown.

    ``cast_keys``: book_id, speaker_id, cast_id.
    """
    met = spans.join(cast_keys, ["book_id", "speaker_id"], "left")
    lost = F.col("cast_id").isNull() & ~F.lower(F.coalesce("speaker_id", F.lit(""))).isin("", "narrator", "unknown")
    return met.select(
        "book_id", "span_id", F.coalesce("cast_id", F.lit("narrator")).alias("speaker_id"), F.when(lost, "unknown").otherwise(F.col("type")).alias("type"),
        F.when(lost, "speaker_not_cast").otherwise("").alias("reason"),
    )
