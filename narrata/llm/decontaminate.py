"""Benchmark decontamination by winnowing.

Documents and benchmark items are winnowed with k-grams of K words and windows of GUARANTEE - K + 1
k-grams, so each shared span of GUARANTEE words has a fingerprint in common. Spark joins equal
fingerprints; of the documents and items that meet, hits are extended to all words they share.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrata.llm.common import bounded_broadcast, column, cut, lower_ascii

#: Words that a shared span needs to count.
GUARANTEE = 10
#: Words of a k-gram; any window of GUARANTEE words holds GUARANTEE - K + 1 k-grams.
K = 5
#: Rows of a table of fingerprints or hashes that may be broadcast (16 to 100 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Distinct words whose hashes a worker keeps.
MEMO = 100_000

#: Bytes that aren't in words become blanks, A-Z become a-z.
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: The same words as a pattern, over text with A-Z lowered.
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BASE = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """Word to 64-bit hash, worked out once a word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASH = _Hashes()


def words_of(text: str | None) -> list[bytes]:
    """Words of letters, digits and any non-ASCII characters, with A-Z lowered; none for null."""
    return text.encode("utf-8", "replace").translate(_TO_WORDS).split() if text else []


def _grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _BASE + hashes[j : j + n]
    out ^= out >> np.uint64(31)
    return out * _BASE


def winnow(grams: np.ndarray, window: int) -> np.ndarray:
    """Positions whose hash is the least of some window of ``window`` hashes, all of equal ones included."""
    n = len(grams) - window + 1
    if n <= 0:
        return np.flatnonzero(grams == grams.min()) if len(grams) else np.empty(0, np.int64)
    least = grams[:n].copy()
    for j in range(1, window):
        np.minimum(least, grams[j : j + n], out=least)
    chosen = np.zeros(len(grams), bool)
    for j in range(window):
        chosen[j : j + n] |= grams[j : j + n] == least
    return np.flatnonzero(chosen)


def prints_of(words: list[bytes], lengths: tuple[int, ...] = ()) -> np.ndarray:
    """The distinct fingerprints of a text: winnowed k-grams, and all grams of each of ``lengths`` words, which short items have."""
    hashes = np.fromiter(map(_HASH.__getitem__, words), np.uint64, len(words))
    found = []
    if len(words) >= GUARANTEE:
        grams = _grams(hashes, K)
        found.append(grams[winnow(grams, GUARANTEE - K + 1)])
    found += [_grams(hashes, n) ^ np.uint64(n) * _BASE for n in lengths]
    return np.unique(np.concatenate(found)).view(np.int64) if found else np.empty(0, np.int64)


def spans_of(text: str | None, item: str | None) -> list[tuple[int, int]]:
    """Spans [start, end) of words of a text inside windows of an item, in order and apart; compared word by word.

    The time is linear in both texts, however often words or windows repeat.
    """
    words, held = words_of(text), words_of(item)
    k = min(GUARANTEE, len(held))
    if not k:
        return []
    windows = set(zip(*(held[j:] for j in range(k))))
    spans: list[tuple[int, int]] = []
    for p, window in enumerate(zip(*(words[j:] for j in range(k)))):
        if window in windows:
            if spans and p <= spans[-1][1]:
                spans[-1] = (spans[-1][0], p + k)
            else:
                spans.append((p, p + k))
    return spans


def _winnowed(docs: DataFrame, others: list[Column], lengths: tuple[int, ...], text_col: str) -> DataFrame:
    """Per row ``others``, what names its text, its words and its fingerprints; texts are read for it once."""

    @F.pandas_udf("n_words long, prints array<long>")
    def winnowed(texts: pd.Series) -> pd.DataFrame:
        found = ((len(w), prints_of(w, lengths)) for w in map(words_of, texts))
        return pd.DataFrame(found, columns=["n_words", "prints"])

    text = column(text_col)
    return cut(docs.select(*others, *_key(text, "d"), winnowed(text).alias("s")).select("*", "s.*").drop("s"))


def _item_prints(texts: pd.Series) -> pd.Series:
    found = [words_of(t) for t in texts]
    return pd.Series([prints_of(w) if len(w) >= GUARANTEE else prints_of(w, (len(w),) if w else ()) for w in found], dtype="object")


def _spans(texts: pd.Series, items: pd.Series) -> pd.Series:
    return pd.Series([[{"start": a, "end": b} for a, b in spans_of(t, i)] for t, i in zip(texts, items)], dtype="object")


def _key(text: Column, prefix: str) -> list[Column]:
    """What names a text in joins: its hash and its size."""
    return [F.xxhash64(text).alias(f"{prefix}_hash"), F.octet_length(text).alias(f"{prefix}_size")]


def _n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(lower_ascii(text), F.lit(_WORD)), F.lit(0)).cast("long")


def _items(benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text") -> tuple[DataFrame, tuple[int, ...]]:
    """Items with words and what names their texts, and the lengths of those shorter than a window."""
    items = benchmark.select(column(item_col).cast("string").alias("item"), column(item_text_col).alias("item_text")).where("item is not null and item_text is not null").distinct()
    items = items.select("item", "item_text", *_key(F.col("item_text"), "i"), _n_words(F.col("item_text")).alias("n")).where("n > 0")
    return items, tuple(sorted(r["n"] for r in items.where(F.col("n") < GUARANTEE).select("n").distinct().collect()))  # nine at most


def _hits(docs: DataFrame, base: DataFrame, items: DataFrame, text_col: str, broadcast_rows: int) -> DataFrame:
    """``(d_hash, d_size, spans, items)`` of each distinct text of ``docs`` that holds a window of an item.

    Fingerprints (``base``) are joined with those of the items: against a broadcast of checked size,
    else by a shuffle that Spark can split where a fingerprint is in a great many documents. Only texts
    that share a fingerprint are read again, to extend the hits.
    """
    of_items = items.select("i_hash", "i_size", F.explode(F.pandas_udf(_item_prints, "array<long>")("item_text")).alias("i_print")).distinct()
    of_docs = base.select("d_hash", "d_size", F.explode("prints").alias("print"))
    met = of_docs.join(bounded_broadcast(of_items, broadcast_rows), F.col("print") == F.col("i_print"))
    pairs = cut(met.select("d_hash", "d_size", "i_hash", "i_size").distinct())
    wanted = bounded_broadcast(pairs.select("d_hash", "d_size").distinct(), broadcast_rows)
    text = column(text_col)
    texts = docs.where(text.isNotNull()).select(*_key(text, "d"), text.alias("text")).join(wanted, ["d_hash", "d_size"]).dropDuplicates(["d_hash", "d_size"])
    each = pairs.join(texts, ["d_hash", "d_size"]).join(items, ["i_hash", "i_size"])
    found = each.select("d_hash", "d_size", "item", F.pandas_udf(_spans, "array<struct<start:long,end:long>>")("text", "item_text").alias("spans"))
    found = found.where(F.size("spans") > 0).groupBy("d_hash", "d_size")
    return found.agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))


def hits_by_text(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``(d_hash, d_size, spans, items)`` of each distinct text of ``docs`` that holds a window of an item."""
    items, lengths = _items(benchmark, item_col, item_text_col)
    return _hits(docs, _winnowed(docs, [], lengths, text_col), items, text_col, broadcast_rows)


def _same(text: Column) -> Column:
    return (F.xxhash64(text) == F.col("d_hash")) & (F.octet_length(text) == F.col("d_size"))


def with_benchmark_hits(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    broadcast_rows: int = BROADCAST_ROWS, hit_col: str = "benchmark_hit",
) -> DataFrame:
    """``docs`` with a struct ``hit_col``: ``n_words``, the hit word ``spans`` [start, end), ``items`` that occur.

    A window is GUARANTEE consecutive words of an item, or all words of a shorter item.

    Null or empty texts have no words and no hits; items without words never hit; equal item ids with
    different texts count as one item; an item with a null id or text is left out. Repeated documents
    give repeated rows. Other columns of ``docs`` pass through; a column named ``hit_col`` is replaced.
    """
    hits = hits_by_text(docs, benchmark, text_col, item_col, item_text_col, broadcast_rows)
    others = [c for c in docs.columns if c != hit_col]
    rows = docs.select(F.struct(*map(column, others)).alias("row"))
    text = F.col("row")[text_col]
    spans, found = F.coalesce("spans", F.array().cast("array<struct<start:long,end:long>>")), F.coalesce("items", F.array().cast("array<string>"))
    hit = F.struct(_n_words(text).alias("n_words"), spans.alias("spans"), found.alias("items"))
    return rows.join(hits, _same(text), "left").select(*(F.col("row")[c].alias(c) for c in others), hit.alias(hit_col))


def hit_digest(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its words, hit words, items that occur and a digest of their ids."""
    zero = F.lit(0).cast("long")
    # Spans are sorted by start, so a running end gives the size of their union.
    union = F.aggregate(
        "spans",
        F.struct(zero.alias("n"), zero.alias("end")),
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(zero, x["end"] - F.greatest(x["start"], acc["end"]))).alias("n"),
            F.greatest(acc["end"], x["end"]).alias("end"),
        ),
    )
    items, lengths = _items(benchmark)
    base = _winnowed(docs, [column(id_col).alias("doc_id")], lengths, text_col)
    hits = _hits(docs, base, items, text_col, BROADCAST_ROWS).select(
        F.col("d_hash").alias("h_hash"), F.col("d_size").alias("h_size"), union["n"].alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    )
    rows = base.select("doc_id", "n_words", "d_hash", "d_size")
    met = rows.join(bounded_broadcast(cut(hits), BROADCAST_ROWS), (F.col("d_hash") == F.col("h_hash")) & (F.col("d_size") == F.col("h_size")), "left")
    return met.select(
        "doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.coalesce("n_hit", zero) > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without those that hold a benchmark window; all columns stay, and texts aren't shuffled while few distinct ones hit."""
    hits = cut(hits_by_text(docs, benchmark, text_col).select("d_hash", "d_size"))
    rows = docs.select(F.struct(*map(column, docs.columns)).alias("row"))
    kept = rows.join(bounded_broadcast(hits, BROADCAST_ROWS), _same(F.col("row")[text_col]), "left_anti")
    return kept.select(*(F.col("row")[c].alias(c) for c in docs.columns))
