"""Phrase collocation mining: weighted n-grams of distinct pieces, counted out of core by hash bucket.

Equal pieces are told once, with how often they stand. Words, word pairs and longer phrases are then
counted in three rounds: a task sums what its pieces hold, the sums are shuffled by phrase, and duckdb
sums each hash bucket, spilling where it must. A phrase can't be more frequent than the words and
pairs in it, so the second and third round pass over places whose words or pairs are too rare; a
filter of hashed bits tells them, which lets some rare ones through to be counted and then dropped,
but never stops a frequent one. The counts of the parts of a phrase are fetched by shuffled requests.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from narrata.llm.common import bounded_broadcast, column, lower_ascii, removed, shared_folder

#: Occurrences from which a phrase is a candidate, words of the longest, and phrases returned a language.
LEAST, MOST_WORDS, TOP = 100, 5, 2000
#: Bytes of pieces that a task sums at a time, and memory of duckdb beyond which it spills.
BLOCK_BYTES, DUCKDB_MEMORY = 24 << 20, "300MB"
#: Bits of a filter for each frequent phrase, and at most (16 MB); beyond this a filter lets more through.
BITS_EACH, MOST_BITS = 16, 1 << 27
#: Languages whose totals may be broadcast.
BROADCAST_LANGS = 10_000
#: Runs that a language's phrases are ranked in before the best of all runs are.
RUNS = 64

_COUNTS = "lang string, phrase string, f long"
_SCHEMA = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])


def pieces(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Distinct pieces ``(lang, piece, m)`` with how often each stands; words are joined by one blank."""
    rows = docs.select(F.coalesce(column(lang_col).cast("string"), F.lit("und")).alias("lang"), lower_ascii(column(text_col)).alias("text"))
    cut = rows.select("lang", F.explode(F.split("text", r"[.,;:!?\x0A-\x0D]")).alias("piece"))
    words = cut.select("lang", F.trim(F.regexp_replace("piece", r"[\x20\x09]+", " ")).alias("piece")).where("piece != ''")
    return words.groupBy("lang", "piece").agg(F.count(F.lit(1)).alias("m"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together to blocks of about ``BLOCK_BYTES``."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= BLOCK_BYTES:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of pairs of hashes."""
    z = left * np.uint64(0x9E3779B97F4A7C15) + right
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _hashes(langs: list[str], words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(f"{w}\n{g}") for g, w in zip(langs, words)), np.uint64, len(words))


def _passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes the filter lets through: all that were put in, and few others."""
    top = np.uint64(len(bits) * 64 - 1)
    out = np.ones(len(hashes), bool)
    for h in (hashes & top, (hashes >> np.uint64(32)) & top):
        out &= (bits[(h >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63))) & np.uint64(1) == 1
    return out


class _Block:
    """The words of a block's pieces as numbers, one for each language and word."""

    def __init__(self, block: pa.Table) -> None:
        pieces_, self.m = block["piece"].combine_chunks(), block["m"].to_numpy()
        lists = pc.split_pattern(pieces_, " ")
        sizes = pc.list_value_length(lists).to_numpy()
        words, langs = lists.flatten().dictionary_encode(), block["lang"].combine_chunks().dictionary_encode()
        self.words, self.langs = words.dictionary, langs.dictionary
        self.row = np.repeat(np.arange(len(sizes)), sizes)
        key = langs.indices.to_numpy().astype(np.int64)[self.row] * len(self.words) + words.indices.to_numpy()
        self.known, self.ids = np.unique(key, return_inverse=True)

    def hashes(self) -> np.ndarray:
        langs, words = self.langs.to_pylist(), self.words.to_pylist()
        of = [divmod(k, len(words)) for k in self.known.tolist()]
        return _hashes([langs[a] for a, _ in of], [words[b] for _, b in of])

    def summed(self, at: np.ndarray, key: np.ndarray, size: int) -> tuple[np.ndarray, list[pa.RecordBatch]]:
        """Phrases of ``size`` words beginning at ``at``, of which those with equal keys are equal: numbers of them, and sums."""
        _, first, ids = np.unique(key, return_index=True, return_inverse=True)
        f = np.zeros(len(first), np.int64)
        np.add.at(f, ids, self.m[self.row[at]])
        lang, _ = np.divmod(self.known[self.ids[at[first]]], len(self.words))
        parts = [self.words.take(pa.array(self.known[self.ids[at[first] + j]] % len(self.words))) for j in range(size)]
        phrase = pc.binary_join_element_wise(*parts, " ") if size > 1 else parts[0]
        table = pa.Table.from_arrays([self.langs.take(pa.array(lang)), phrase, pa.array(f)], schema=_SCHEMA)
        return ids, table.to_batches(max_chunksize=50_000)


def _sums(batches: Iterator[pa.RecordBatch], most_words: int, words: np.ndarray | None, pairs: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Sums of each block: of words; with a filter of words of pairs; with one of pairs too of longer phrases."""
    for table in _blocks(batches):
        block = _Block(table)
        if words is None:
            yield from block.summed(np.arange(len(block.ids)), block.ids, 1)[1]
            continue
        hashes = block.hashes()
        fits = _passes(words, hashes)[block.ids]
        at = np.flatnonzero(fits[:-1] & fits[1:] & (block.row[:-1] == block.row[1:]))
        wide = len(block.known)
        if pairs is None:
            yield from block.summed(at, block.ids[at] * wide + block.ids[at + 1], 2)[1]
            continue
        at = at[_passes(pairs, _mixed(hashes[block.ids[at]], hashes[block.ids[at + 1]]))]
        paired = np.zeros(len(block.ids) + 1, bool)
        paired[at] = True
        number = np.unique(block.ids[at] * wide + block.ids[at + 1], return_inverse=True)[1]
        for size in range(3, most_words + 1):  # ``number`` tells the phrases of ``size - 1`` words at ``at`` apart
            stays = paired[at + size - 2]
            at, number = at[stays], number[stays]
            number, found = block.summed(at, number * wide + block.ids[at + size - 1], size)
            yield from found


def _bucket(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The sums of a hash bucket's phrases that reach ``least``, by duckdb, which spills into a folder of this task's own."""
    first = next(batches, None)
    if first is None:
        return

    def all_batches() -> Iterator[pa.RecordBatch]:
        yield first.cast(_SCHEMA)
        for batch in batches:
            yield batch.cast(_SCHEMA)

    rows = pa.RecordBatchReader.from_batches(_SCHEMA, all_batches())  # noqa: F841  (duckdb reads it by its name)
    with tempfile.TemporaryDirectory(prefix="narrata-bucket-") as spill, duckdb.connect(config={"threads": 1, "memory_limit": DUCKDB_MEMORY, "temp_directory": spill, "preserve_insertion_order": False}) as db:
        found = db.execute("select lang, phrase, cast(sum(f) as bigint) as f from rows group by lang, phrase having sum(f) >= ?", [least]).to_arrow_reader(50_000)
        for batch in found:
            yield batch.cast(_SCHEMA)


def _marks(batches: Iterator[pa.RecordBatch], size: int, bits: int) -> Iterator[pa.RecordBatch]:
    """The places in a filter of ``bits`` bits of phrases of ``size`` words, as words of 64 bits."""
    top = np.uint64(bits - 1)
    for batch in batches:
        langs, phrases = batch.column(0).to_pylist(), [p.split(" ") for p in batch.column(1).to_pylist()]
        h = _hashes(langs, [p[0] for p in phrases])
        if size == 2:
            h = _mixed(h, _hashes(langs, [p[1] for p in phrases]))
        at = np.concatenate([h & top, (h >> np.uint64(32)) & top])
        yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["word", "mark"])


def _filter(frequent: DataFrame, size: int) -> np.ndarray:
    """A filter of the frequent phrases: at most ``MOST_BITS`` bits, whatever the input, so that it can be broadcast."""
    bits = 1 << 16
    while bits < min(MOST_BITS, BITS_EACH * frequent.count()):
        bits *= 2

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _marks(batches, size, bits)

    found = frequent.select("lang", "phrase").mapInArrow(marks, "word long, mark long").groupBy("word").agg(F.bit_or("mark").alias("mark")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[found["word"].to_numpy()] = found["mark"].to_numpy().view(np.uint64)
    return out


def phrase_counts(found: DataFrame, folder: str, least: int = LEAST, most_words: int = MOST_WORDS) -> DataFrame:
    """Every phrase of up to ``most_words`` words that the pieces ``(lang, piece, m)`` hold ``least`` times or more: ``(lang, phrase, size, f)``.

    Each round's counts are written under ``folder``, which all executors share.
    """
    spark: SparkSession = found.sparkSession

    def counted(name: str, *filters: np.ndarray) -> DataFrame:
        held = [spark.sparkContext.broadcast(f) for f in filters]

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _sums(batches, most_words, *[h.value for h in held], *[None] * (2 - len(held)))

        def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _bucket(batches, least)

        found.mapInArrow(sums, _COUNTS).repartition("lang", "phrase").mapInArrow(bucket, _COUNTS).write.parquet(f"{folder}/{name}")
        return spark.read.schema(_COUNTS).parquet(f"{folder}/{name}")

    words = counted("words")
    word_filter = _filter(words, 1)
    rounds = [words, counted("pairs", word_filter)] if most_words > 1 else [words]
    if most_words > 2:
        rounds.append(counted("longer", word_filter, _filter(rounds[1], 2)))
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    return out.select("lang", "phrase", F.size(F.split("phrase", " ")).alias("size"), "f")


def _score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 a n / (l r)), exact: products are decimals of 38 digits, and too large ones are errors."""
    wide = [c.cast("decimal(18,0)") for c in (a, n, left, right)]
    thousand = F.lit(1000).cast("decimal(4,0)")
    return F.call_function("div", wide[0] * wide[1] * thousand, wide[2] * wide[3])


def scored_phrases(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """Candidates that no longer one of equal count holds, with the parts of their lowest-scoring cut.

    ``counts`` has every phrase that is frequent enough ``(lang, phrase, size, f)``, so all parts of a
    candidate too; ``totals`` has the word occurrences of each language ``(lang, n)``. A request for each
    part of each cut is shuffled to where the part's count lies, and the answers back to the candidate.
    A longer candidate is as frequent as one in it only if one that is a word longer is, so each asks
    about its two beginnings and ends alone.
    """
    asked = counts.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))

    def part(first: Column, size: Column) -> Column:
        return F.array_join(F.slice("words", first, size), " ")

    cuts = F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.struct(k.alias("k"), part(F.lit(1), k).alias("l"), part(k + 1, F.col("size") - k).alias("r")))
    sides = F.array(*[F.struct(F.lit(n).alias("side"), F.col(f"cut.{s}").alias("part")) for n, s in enumerate("lr")])
    cut = asked.select("lang", "phrase", "a", F.explode(cuts).alias("cut")).select("lang", "phrase", "a", "cut.k", F.explode(sides).alias("p"))
    requests = cut.select(F.col("lang").alias("q_lang"), F.col("phrase").alias("whole"), "a", "k", "p.side", "p.part")
    answers = requests.join(counts.select("lang", F.col("phrase").alias("counted"), "f"), (F.col("q_lang") == F.col("lang")) & (F.col("part") == F.col("counted")))
    answers = answers.select("lang", F.col("whole").alias("phrase"), "a", "k", "side", "f")
    by_cut = answers.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    known = by_cut.join(bounded_broadcast(totals, BROADCAST_LANGS).withColumnRenamed("lang", "t_lang"), F.col("lang") == F.col("t_lang"))
    best = known.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(_score(F.col("a"), F.col("n"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r")).alias("least"))
    inner = asked.where("size > 2").select("lang", F.explode(F.array(part(F.lit(1), F.col("size") - 1), part(F.lit(2), F.col("size") - 1))).alias("phrase"), "a")
    held = inner.groupBy(F.col("lang").alias("h_lang"), F.col("phrase").alias("h_phrase")).agg(F.max("a").alias("h_a"))
    free = best.join(held, (F.col("lang") == F.col("h_lang")) & (F.col("phrase") == F.col("h_phrase")) & (F.col("h_a") >= F.col("a")), "left_anti")
    return free.select("lang", "phrase", "a", F.col("least.l").alias("l"), F.col("least.r").alias("r"), "n", F.col("least.score").alias("score"))


def best_phrases(scored: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` phrases of each language by score, count and phrase, with their rank."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    run = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(RUNS))).orderBy(*order)
    some = scored.withColumn("rank", F.row_number().over(run)).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, top: int = TOP, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The best phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    Null texts are empty and have no words, a null language is ``und``; repeated rows count as often as
    they stand; texts without a word and empty tables give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/phrases-{uuid.uuid4().hex}"
    pieces(docs, text_col, lang_col).write.parquet(f"{folder}/pieces")
    found = spark.read.schema("lang string, piece string, m long").parquet(f"{folder}/pieces")
    blanks = F.char_length("piece") - F.char_length(F.translate("piece", " ", ""))
    totals = found.groupBy("lang").agg(F.sum(F.col("m") * (blanks + 1)).alias("n"))
    counts = phrase_counts(found, folder, least, most_words)
    best_phrases(scored_phrases(counts, totals), top).write.parquet(f"{folder}/best")
    for name in ("pieces", "words", "pairs", "longer"):
        removed(spark, f"{folder}/{name}")
    return spark.read.parquet(f"{folder}/best")
