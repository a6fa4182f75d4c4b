"""Quality rules with cross-document line frequency."""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrata.llm.common import bounded_broadcast, column, cut

#: A line is removed from a host's documents if more distinct documents of the host hold it than this, however large the host.
LINE_LIMIT = 10
#: Ids that several rows have, up to which they are broadcast.
BROADCAST_IDS = 200_000
#: A document is depleted with fewer words left than this, or a smaller share of its words.
WORDS_LEFT, SHARE_LEFT = 10, 0.2
#: Base rules: least words, and the most percent of words that may lie in repeated windows.
LEAST_WORDS, REPEAT_PERCENT, REPEAT_WINDOW = 10, 20, 5

_SPACES = re.compile(r"[\x20\x09-\x0D]")
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_DIGITS = re.compile(rb"[0-9]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)

_FACTS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "text_hash long, line_hashes array<long>, line_words array<long>"
)


class Facts(NamedTuple):
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    text_hash: int
    line_hashes: list[int]
    line_words: list[int]


def _signed(data: bytes) -> int:
    value = xxhash.xxh64_intdigest(data)
    return value - (1 << 64) if value >= 1 << 63 else value


def normal_line(line: str) -> bytes:
    """A line with A-Z lowered, white space runs as one blank, and each run of digits as one 0."""
    return _DIGITS.sub(b"0", b" ".join(line.encode("utf-8", "replace").lower().split()))


def _numbered(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each pair, equal for equal pairs alone."""
    return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1]


def repeated_words(words: list[bytes]) -> int:
    """How many words lie in a window of five that the text has at least twice."""
    n = len(words) - REPEAT_WINDOW + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.uint64, len(words))
    at = (at + np.uint64(1)) * _BASE
    at ^= at >> np.uint64(29)
    grams = np.zeros(n, np.uint64)
    for j in range(REPEAT_WINDOW):
        grams = grams * np.uint64(0xBF58476D1CE4E5B9) + at[j : j + n]
    if len(np.unique(grams)) == n:  # equal windows have equal hashes, so no window is there twice
        return 0
    # Windows by exact number: of pairs of words, of pairs of pairs, and with the fifth word.
    number = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
    pairs = _numbered(number[:-1], number[1:])
    which = _numbered(_numbered(pairs[:-2], pairs[2:])[:n], number[REPEAT_WINDOW - 1 :])
    again = np.bincount(which)[which] > 1
    inside = np.zeros(len(words), bool)
    for j in range(REPEAT_WINDOW):
        inside[j : j + n] |= again
    return int(inside.sum())


def facts_of(text: str | None) -> Facts:
    """Word, symbol, line and repetition counts of a text, with its distinct normalised lines."""
    text = text or ""
    data = text.encode("utf-8", "replace")
    words = data.split()
    seen: set[str] = set()
    repeated = 0
    lines: dict[int, int] = {}
    for line in text.split("\n"):
        if not (count := len(line.encode("utf-8", "replace").split())):
            continue
        repeated += line in seen
        seen.add(line)
        key = _signed(normal_line(line))
        lines[key] = lines.get(key, 0) + count
    return Facts(
        len(words), len(text) - len(_SPACES.findall(text)), len(_SYMBOLS.findall(text)), repeated, repeated_words(words),
        _signed(data), list(lines), list(lines.values()),
    )


def _facts(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([facts_of(t) for t in texts], columns=Facts._fields)


def _without(lines: pd.Series, gone: pd.Series) -> pd.Series:
    out = []
    for text, hashes in zip(lines, gone):
        hashes = set(hashes) if hashes is not None else ()
        out.append("\n".join(x for x in text.split("\n") if not x.split() or _signed(normal_line(x)) not in hashes) if hashes else text)
    return pd.Series(out, dtype="object")


def _rows(docs: DataFrame, others: list[Column], id_col: str, text_col: str, host_col: str) -> DataFrame:
    """Per row ``others``, its document's id as ``key``, its host and its facts."""
    key = column(id_col).alias("key")
    host = F.coalesce(F.concat(F.lit("="), column(host_col).cast("string")), F.lit(""))
    return cut(docs.select(*others, key, host.alias("host"), F.pandas_udf(_facts, _FACTS)(column(text_col)).alias("f")).select("*", "f.*").drop("f"))


def _held(rows: DataFrame) -> DataFrame:
    """``(host, line, documents)``: in how many documents of a host a line stands, those of one id counted once.

    Rows of an id of their own (or of none) are counted as they are, with pre-aggregation; only ids
    that several rows have are brought together.
    """
    several = rows.where("key is not null").groupBy(F.col("key").alias("s_key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("s_key")
    several = bounded_broadcast(cut(several), BROADCAST_IDS)
    lines = rows.select("host", "key", F.explode("line_hashes").alias("line"))
    alone = lines.join(several, F.col("key") == F.col("s_key"), "left_anti").groupBy("host", "line").agg(F.count(F.lit(1)).alias("documents"))
    shared = lines.join(several, F.col("key") == F.col("s_key"), "left_semi").distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("documents"))
    return alone.unionByName(shared).groupBy("host", "line").agg(F.sum("documents").alias("documents"))


def _removed(rows: DataFrame, limit: int) -> DataFrame:
    """By host and text: the words of its common lines, and those lines' hashes."""
    held = _held(rows)
    common = held.where(F.col("documents") > limit).select(F.col("host").alias("common_host"), F.col("line").alias("common_line"))
    pairs = F.explode(F.arrays_zip(F.col("line_hashes").alias("line"), F.col("line_words").alias("words")))
    lines = rows.select("host", "text_hash", pairs.alias("x")).select("host", "text_hash", "x.line", "x.words").distinct()
    met = lines.join(common, (F.col("host") == F.col("common_host")) & (F.col("line") == F.col("common_line")))
    found = met.groupBy("host", "text_hash").agg(F.sum("words").alias("removed"), F.collect_list("line").alias("gone"))
    return found.select(F.col("host").alias("r_host"), F.col("text_hash").alias("r_hash"), "removed", "gone")


def _judged(rows: DataFrame, limit: int) -> DataFrame:
    """``rows`` with ``base_failed``, ``n_removed_words``, ``gone`` (hashes of common lines) and ``kept``."""
    removed = _removed(rows, limit)
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT)
    left = F.col("n_words") - F.col("n_removed_words")
    depleted: Column = (left < WORDS_LEFT) | (left < F.col("n_words") * SHARE_LEFT)
    met = rows.join(removed, (F.col("host") == F.col("r_host")) & (F.col("text_hash") == F.col("r_hash")), "left")
    met = met.withColumns({"base_failed": failed, "n_removed_words": F.coalesce("removed", F.lit(0).cast("long"))})
    return met.withColumn("kept", ~F.col("base_failed") & ~depleted)


def line_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", line_limit: int = LINE_LIMIT) -> DataFrame:
    """Per document its counts, whether it fails the base rules, the words of common lines, and the verdict.

    A normalised line is common in a host if more than ``line_limit`` of the host's documents hold it;
    rows of one id are one document, rows without an id and copies of a text under other ids are documents each. Words of common lines are removed; a document with
    fewer than WORDS_LEFT words or less than SHARE_LEFT of its words left is depleted and rejected.

    Hot lines, hosts and copies: lines are counted with pre-aggregation, words removed are worked out
    once a distinct text of a host, and both joins are plain equi-joins that Spark can split.

    Null and empty texts have zero counts and fail the base rules; null hosts are one host of their
    own; repeated rows give repeated results; extra columns are ignored.
    """
    found = _judged(_rows(docs, [column(id_col).alias("doc_id")], id_col, text_col, host_col), line_limit)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_words", "kept")


def cleaned_documents(docs: DataFrame, text_col: str = "text", host_col: str = "source", line_limit: int = LINE_LIMIT, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without common lines in their texts and without the documents that :func:`line_rules` rejects; all columns stay."""
    rows = _rows(docs, [F.struct(*map(column, docs.columns)).alias("row")], id_col, text_col, host_col)
    kept = _judged(rows, line_limit).where("kept")
    cleaned = F.pandas_udf(_without, "string")(F.col("row")[text_col], F.col("gone"))
    return kept.select(*(cleaned.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))
