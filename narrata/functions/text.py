"""Text functions as columns. Offsets are code points, from 0, half open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of words, headings, page numbers and sentence ends.
ASCII_WORD = r"[A-Za-z][A-Za-z'’-]*"
ANY_WORD = r"[^\W\d_]+(?:['-][^\W\d_]+)?"
LATIN_WORD = r"[A-Za-zÀ-ÖØ-öø-ÿ0-9]+(?:['’‑-][A-Za-zÀ-ÖØ-öø-ÿ0-9]+)*"
BENCH_WORD = r"\w+(?:['’.-]\w+)*"
PAGE_NUMBER = r"(?i)^(?:page\s+)?\d+$"
HEADING_PREFIX = r"(?i)^(?:chapter|part|section)\b"
HEADING_LINE = r"(?i)^(?:chapter|part|section)\b(?:\s+.*)?$"
#: Fixed value: what ``\\s`` is in all scripts.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
TERMINAL = r"[.!?:;…][\"'’”»›)\]}]*$"
SENTENCE_FINAL = r"[.!?…][\"'’”»›)\]}]*$"
ENGLISH_MARKERS = tuple(
    "the and of to in a is that for it as with was on by this from or an be are at not which but have has their they you we he she his her "
    "one all can will more would there what when who how were been into than then so if about out up do no my me our your".split()
)
#: What a page of so many words, or a book of so many a minute, counts as.
WORDS_PER_MINUTE, PREVIEW_CHARACTERS, MIXED_MIN_WORDS = 150, 4000, 5


def count_matches(text: Column, pattern: str, unicode: bool = False) -> Column:
    """How often a pattern occurs; ``unicode`` makes ``\\w`` and ``\\d`` mean all scripts."""
    return F.regexp_count(text, F.lit(("(?U)" if unicode else "") + pattern))


def ascii_word_count(text: Column) -> Column:
    return count_matches(text, ASCII_WORD)


def any_words(text: Column) -> Column:
    """Words of letters of any script, in lower case with straight apostrophes."""
    found = F.regexp_extract_all(text, F.lit("(?U)(" + ANY_WORD + ")"), F.lit(1))
    return F.transform(found, lambda w: F.replace(F.lower(w), F.lit("’"), F.lit("'")))


def latin_word_count(text: Column) -> Column:
    return count_matches(text, LATIN_WORD)


def bench_word_count(text: Column) -> Column:
    return count_matches(text, BENCH_WORD, unicode=True)


def strip(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def is_page_number(line: Column) -> Column:
    return line.rlike(PAGE_NUMBER)


def is_heading(line: Column) -> Column:
    return line.rlike(HEADING_LINE)


def starts_as_heading(line: Column) -> Column:
    return line.rlike(HEADING_PREFIX)


def ends_terminal(text: Column) -> Column:
    return text.rlike(TERMINAL)


def ends_sentence(text: Column) -> Column:
    return text.rlike(SENTENCE_FINAL)


def starts_lower(text: Column) -> Column:
    return text.rlike(r"^\p{Ll}")


def page_separator(previous: Column, following: Column) -> Column:
    """What joins two cleaned pages: nothing after a hyphen, a blank inside a sentence, else a blank line."""
    last_line = F.element_at(F.split(previous, "\n"), -1)
    first_line = F.element_at(F.split(following, "\n"), 1)
    inside = previous.rlike(r"(?:\p{Ll}|,)$") & ~starts_as_heading(F.trim(first_line))
    return (
        F.when(F.coalesce(F.length(previous), F.lit(0)) == 0, "\n\n")
        .when(F.coalesce(F.length(following), F.lit(0)) == 0, "\n\n")
        .when(ends_terminal(previous), "\n\n")
        .when(starts_as_heading(F.trim(last_line)), "\n\n")
        .when(starts_lower(following), F.when(previous.rlike("[A-Za-z]-$"), "").otherwise(" "))
        .when(inside, " ")
        .otherwise("\n\n")
    )


def language(text: Column) -> Column:
    """``English``, ``uncertain`` or ``unsupported``, by shares of English markers and of ASCII words."""

    def judge(words: Column) -> Column:
        n = F.size(words)
        markers = F.size(F.filter(words, lambda w: w.isin(*ENGLISH_MARKERS))) / n
        ascii_words = F.size(F.filter(words, lambda w: F.length(w) == F.octet_length(w))) / n
        return (
            F.when(n < 8, "uncertain")
            .when((markers >= 0.08) & (ascii_words >= 0.75), "English")
            .when((markers >= 0.02) & (ascii_words >= 0.45), "uncertain")
            .otherwise("unsupported")
        )

    return F.transform(F.array(any_words(text)), judge)[0]


def page_class(words: Column, has_images: Column, has_letters: Column) -> Column:
    """What kind of page it is, from its word count, images and letters."""
    return (
        F.when((words > 0) & has_images, "mixed")
        .when(words > 0, "text")
        .when(has_images, "scanned")
        .when(has_letters, "unsupported")
        .otherwise("blank")
    )


def ratio(numerator: Column, denominator: Column) -> Column:
    """The quotient at six digits, 0 where the denominator is 0."""
    return F.when(denominator == 0, 0.0).otherwise(F.bround(numerator / denominator, 6))


def slug(value: Column, prefix: str) -> Column:
    """A stable identifier of a label; of one without letters or digits, 12 digits of its hash."""
    raw = strip(F.coalesce(value, F.lit("")))
    core = F.regexp_replace(F.regexp_replace(raw, "[^A-Za-z0-9_-]+", "-"), "^-+|-+$", "")
    return F.concat(F.lit(prefix + "-"), F.when(core == "", F.left(F.sha2(raw, 256), F.lit(12))).otherwise(core))


def source_type(value: Column) -> Column:
    """What a label of a chapter candidate's source stands for."""
    low = F.lower(F.coalesce(value, F.lit("")))
    return (
        F.when(low.contains("outline") | low.contains("bookmark"), "outline")
        .when(low.isin("heading", "explicit"), low)
        .when(low.contains("heading"), "heading")
        .when(low.contains("layout"), "layout")
        .otherwise("candidate")
    )


def source_family(source_type: Column) -> Column:
    """Rank of a chapter candidate's family: outlines before headings before layout before the rest."""
    return F.when(source_type == "outline", 0).when(source_type.isin("heading", "explicit"), 1).when(source_type == "layout", 2).otherwise(3)


def escape_metadata(value: Column) -> Column:
    """With backslash, line feed, ``=``, ``;`` and ``#`` escaped."""
    for plain, escaped in (("\\", "\\\\"), ("\n", "\\n"), ("=", "\\="), (";", "\\;"), ("#", "\\#")):
        value = F.replace(value, F.lit(plain), F.lit(escaped))
    return value


def safe_file_name(value: Column, default: str = "Audiobook") -> Column:
    """A title as a file name: unsafe runs to ``_``, no outer blanks or dots, 120 characters."""
    core = F.left(F.btrim(F.regexp_replace(value, "[^A-Za-z0-9._ -]+", "_"), F.lit(" .")), F.lit(120))
    return F.when(core == "", default).otherwise(core)


def chunk_path(chapter_index: Column, local_index: Column) -> Column:
    return F.format_string("chapter-%03d-chunk-%04d.wav", chapter_index, local_index)
