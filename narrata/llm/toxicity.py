"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

All terms of the examples are in the index. A term's weight is its TF-IDF times a relevance factor that
rises with its link with the label and never is zero, so every text with a known word has its true
nearest examples. Examples of either label are indexed alike.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrata.llm.common import labelled_sample

#: Most labelled texts that the index and the calibration are fitted on, and their bytes together.
EXAMPLES, EXAMPLE_BYTES = 4_000, 16 << 20
#: Of them, one in so many only calibrates the score and is no example.
CALIBRATE = 4
#: A term's relevance: this floor, and a share of the deviations by which its label rate exceeds the mean.
RELEVANCE_FLOOR, RELEVANCE_SHARE = 0.1, 0.1
#: Texts that are scored side by side.
BATCH = 128
#: Examples that vote, examples a block, blocks that are scored first, and the similarity that the prior's vote weighs.
NEIGHBOURS, BLOCK, FIRST_BLOCKS, PRIOR_WEIGHT = 16, 64, 8, 0.05
#: A posting list of more than one in so many examples is long: it lies in blocks, with the greatest weight of each.
LONG_LIST = 8
#: Scores from which a text is called toxic.
THRESHOLD = 0.3
#: Lengths of the word beginnings that are terms beside whole words.
STEMS = (4,)
#: Distinct words whose terms a worker keeps.
MEMO = 300_000

_WORD = re.compile(r"\w+")


def held_out(id_col: str) -> Column:
    """Rows whose labels are never learnt from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def terms_of_word(word: str) -> list[str]:
    """A word, and its beginnings, each with a mark that words don't have."""
    return [word, *(word[:n] + "-" for n in STEMS if len(word) > n)]


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _hash(term: str) -> int:
    return xxhash.xxh64_intdigest(term.encode("utf-8", "replace")) >> 1


def _counted(texts: pd.Series) -> pd.DataFrame:
    """The hashes of each text's terms and their counts, as bytes of 64-bit integers."""
    rows = []
    for text in texts:
        counts = Counter(h for w, n in Counter(words_of(text)).items() for t in terms_of_word(w) for h in [_hash(t)] * n)
        rows.append((np.fromiter(counts, "<i8", len(counts)).tobytes(), np.fromiter(counts.values(), "<i8", len(counts)).tobytes()))
    return pd.DataFrame(rows, columns=["terms", "counts"])


class Example(NamedTuple):
    """A labelled example: its id, the hash of its text, hashes of its terms and their counts, and its label."""

    doc_id: object
    text_hash: int
    terms: np.ndarray
    counts: np.ndarray
    label: float


class Index:
    """Examples by term: postings of each term in each block, with their greatest weight there."""

    def __init__(self, examples: list[Example]) -> None:
        n = len(examples)
        self.steps: tuple[np.ndarray, np.ndarray] = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
        self.memo: dict[str, tuple[int, ...]] = {}
        self.ids = [e.doc_id for e in examples]
        self.labels = np.array([e.label for e in examples], float)
        self.rank = np.argsort(np.argsort(np.array([e.text_hash for e in examples], np.int64), kind="stable"), kind="stable")
        self.prior = (self.labels.sum() + 0.1) / (n + 10.0)
        sizes = [len(e.terms) for e in examples]
        every = np.concatenate([e.terms for e in examples]) if n else np.empty(0, np.int64)
        self.terms, at = np.unique(every, return_inverse=True)  # the vocabulary, by hash
        counts = np.concatenate([e.counts for e in examples]) if n else np.empty(0, np.int64)
        of = np.repeat(np.arange(n), sizes)
        df, toxic, rate = np.bincount(at, minlength=len(self.terms)), np.bincount(at, self.labels[of], len(self.terms)), self.labels.mean() if n else 0.0
        beyond = np.maximum(toxic - df * rate, 0.0) / np.sqrt(df * rate * (1 - rate) + 1)
        self.idf = (np.log((1 + n) / (1 + df)) + 1) * (RELEVANCE_FLOOR + RELEVANCE_SHARE * beyond)
        weights = (1 + np.log(counts)) * self.idf[at]
        weights /= np.maximum(np.sqrt(np.bincount(of, weights**2, n)), 1e-12)[of]
        self._order(at, of, weights, n)

    def _order(self, at: np.ndarray, of: np.ndarray, weights: np.ndarray, n: int) -> None:
        """Lay the postings out by term and block; like examples stand in the same block, so that bounds are tight."""
        heavy = np.zeros(n, np.int64)
        by_weight = np.lexsort((-at, weights))
        heavy[of[by_weight]] = at[by_weight]  # the last one written is the heaviest
        common = np.full(n, -1)
        often = np.bincount(at, minlength=len(self.terms))[at] * 50 > n
        by_weight = by_weight[often[by_weight]]
        common[of[by_weight]] = at[by_weight]
        place = np.argsort(np.lexsort((self.rank, heavy, common)))
        back = np.argsort(place)
        self.ids, self.labels, self.rank = [self.ids[i] for i in back], self.labels[back], self.rank[back]
        of = place[of]
        order = np.lexsort((of, at))
        at, self.of, self.weights = at[order], of[order].astype(np.int32), weights[order]
        self.lists = np.searchsorted(at, np.arange(len(self.terms) + 1))  # where each term's postings start
        self.blocks = -(-n // BLOCK)
        self.long = np.full(len(self.terms), -1, np.int32)
        many = np.flatnonzero(np.diff(self.lists) * LONG_LIST > n)
        self.long[many] = np.arange(len(many))

    def unfold(self) -> None:
        """Lay the long posting lists out in blocks: what a worker does once with the index that it was sent."""
        many = np.flatnonzero(self.long >= 0)
        postings = _ranges(self.lists[many], self.lists[many + 1])
        rows = np.repeat(np.arange(len(many)), self.lists[many + 1] - self.lists[many])
        of = self.of[postings]
        self.in_blocks = np.zeros((self.blocks, len(many), BLOCK))
        self.in_blocks[of // BLOCK, rows, of % BLOCK] = self.weights[postings]
        self.most = np.ascontiguousarray(self.in_blocks.max(2).T) if len(many) else np.zeros((0, self.blocks))

    def _known(self, word: str) -> tuple[int, ...]:
        hashes = [_hash(t) for t in terms_of_word(word)]
        places = np.searchsorted(self.terms, hashes).tolist()
        return tuple(p for p, h in zip(places, hashes) if p < len(self.terms) and self.terms[p] == h)

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Terms of a text that are in the index and their weights, of length one."""
        counts: dict[int, int] = {}
        memo = self.memo
        for w, n in Counter(words_of(text)).items():
            known = memo.get(w)
            if known is None:
                if len(memo) >= MEMO:
                    memo.clear()
                known = memo[w] = self._known(w)
            for t in known:
                counts[t] = counts.get(t, 0) + n
        at = np.fromiter(counts, np.int64, len(counts))
        order = np.argsort(at)
        at = at[order]
        weights = (1 + np.log(np.fromiter(counts.values(), float, len(counts))[order])) * self.idf[at]
        return at, weights / max(np.sqrt((weights**2).sum()), 1e-12)

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS) -> list[list[tuple[float, int]]]:
        """Of each query (terms, weights) the k examples of greatest cosine, exactly; of equal ones those whose texts have the least hashes.

        Only the queries' own posting lists are read: short ones whole, long ones block by block. What a
        block can reach at most is its best sum over short lists and its maxima in the long ones. The
        blocks of the greatest reach are scored first; then those that can still reach the k-th best.
        """
        if not len(self.ids):
            return [[] for _ in queries]
        if not hasattr(self, "most"):
            self.unfold()
        dense = np.zeros((len(queries), self.in_blocks.shape[1]))
        sums = np.zeros((len(queries), self.blocks, BLOCK))
        for i, (at, weights) in enumerate(queries):
            rows = self.long[at]
            short = rows < 0
            dense[i, rows[~short]] = weights[~short]
            begin, end = self.lists[at[short]], self.lists[at[short] + 1]
            postings = _ranges(begin, end)
            if len(postings):
                sums[i] = np.bincount(self.of[postings], np.repeat(weights[short], end - begin) * self.weights[postings], self.blocks * BLOCK).reshape(-1, BLOCK)
        reach = sums.max(2) + dense @ self.most
        scores = np.zeros_like(sums)
        best = np.argpartition(-reach, min(FIRST_BLOCKS, self.blocks) - 1, axis=1)[:, :FIRST_BLOCKS]
        now = np.zeros(reach.shape, bool)
        np.put_along_axis(now, best, True, 1)
        self._score_blocks(scores, sums, dense, now)
        least = self._kth(np.take_along_axis(scores, best[:, :, None], 1), k)  # all other blocks are zero so far
        self._score_blocks(scores, sums, dense, ~now & (reach > 0) & (reach >= least[:, None] - 1e-9))
        scores = scores.reshape(len(queries), -1)
        least = np.maximum(np.round(self._kth(scores, k), 12), 1e-12)
        out = []
        for own, worst in zip(scores, least):
            found = np.flatnonzero(own >= worst - 1e-11)
            near = np.round(own[found], 12)  # rounding keeps the order, so only what can be among the nearest is rounded
            found, near = found[near >= worst], near[near >= worst]
            order = np.lexsort((self.rank[found], -near))[:k]
            out.append(list(zip(near[order].tolist(), found[order].tolist())))
        return out

    def _score_blocks(self, scores: np.ndarray, sums: np.ndarray, dense: np.ndarray, wanted: np.ndarray) -> None:
        for b in range(self.blocks):
            some = np.flatnonzero(wanted[:, b])
            if len(some):
                scores[some, b] = sums[some, b] + dense[some] @ self.in_blocks[b]

    @staticmethod
    def _kth(scores: np.ndarray, k: int) -> np.ndarray:
        flat = scores.reshape(len(scores), -1)
        return np.partition(flat, flat.shape[1] - k, axis=1)[:, flat.shape[1] - k]  # a block has more examples than vote

    def vote(self, near: list[tuple[float, int]]) -> float:
        """The neighbours' labels weighted by the square of similarity, with the prior as one more voter."""
        weight = sum(s * s for s, _ in near)
        return float((sum(s * s * self.labels[n] for s, n in near) + PRIOR_WEIGHT * self.prior) / (weight + PRIOR_WEIGHT))

    def calibrate(self, votes: np.ndarray, labels: np.ndarray) -> None:
        """Fit a rising step function from votes to label rates (pool adjacent violators), smoothed a little."""
        order = np.argsort(votes, kind="stable")
        pools: list[list[float]] = []  # weighted label sum, weight, weighted vote sum
        for v, y in zip(votes[order], labels[order]):
            pools.append([float(y), 1.0, float(v)])
            while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last)]
        if pools:
            self.steps = (np.array([p[2] / p[1] for p in pools]), np.array([p[0] / p[1] for p in pools]))

    def score(self, near: list[tuple[float, int]]) -> float:
        """The calibrated score; the vote itself orders what calibrates alike."""
        vote = self.vote(near)
        return float(min(1.0, max(0.0, 0.98 * np.interp(vote, *self.steps) + 0.02 * vote)))


def _ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [begin, end) one after another."""
    sizes = end - begin
    total = int(sizes.sum())
    return np.arange(total) + np.repeat(begin - np.cumsum(sizes) + sizes, sizes)


class Evidence(NamedTuple):
    score: float
    vote: float
    near_ids: list
    near_similarity: list
    near_toxic: list


def train(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> Index:
    """The index of labelled examples. ``docs``: doc_id, text of rows that may be learnt from.

    Of the bounded sample the hashes of terms and their counts come to the driver, where the index is
    laid out; the examples that calibrate are scored by Spark, and their votes come back.
    """
    sample = labelled_sample(docs, labels, "toxic", examples, most_bytes=EXAMPLE_BYTES)
    sample = sample.withColumn("calibrates", F.pmod(F.xxhash64("text", F.lit(7)), F.lit(CALIBRATE)) == 0).persist()
    try:
        counted = F.pandas_udf(_counted, "terms binary, counts binary")("text")
        rows = sample.where("not calibrates").select("doc_id", F.xxhash64("text").alias("h"), "label", counted.alias("c")).orderBy("h").collect()
        index = Index([Example(r["doc_id"], r["h"], np.frombuffer(r["c"]["terms"], "<i8"), np.frombuffer(r["c"]["counts"], "<i8"), r["label"]) for r in rows])
        checks = sample.where("calibrates").select(_scored(index, sample, "doc_id", "text").alias("s"), "label", F.xxhash64("text").alias("h"))
        found = checks.select("s.vote", "label", "h").orderBy("h").collect()
    finally:
        sample.unpersist()
    index.calibrate(np.array([r["vote"] for r in found]), np.array([r["label"] for r in found]))
    return index


#: The index that this worker scored with last.
_LAST: dict[str, Index] = {}


def _score(texts: pd.Series, shared, key: str) -> pd.DataFrame:
    if key not in _LAST:
        _LAST.clear()
        _LAST[key] = shared.value
    index, rows = _LAST[key], []
    vectors = [index.vector(t) for t in texts]
    for near in (n for at in range(0, len(vectors), BATCH) for n in index.nearest(vectors[at : at + BATCH])):
        rows.append(Evidence(index.score(near), index.vote(near), [index.ids[n] for _, n in near], [s for s, _ in near], [int(index.labels[n]) for _, n in near]))
    return pd.DataFrame(rows, columns=Evidence._fields)


def _scored(index: Index, docs: DataFrame, id_col: str, text_col: str) -> Column:
    """A struct of a text's score, vote and nearest examples."""
    shared, key = docs.sparkSession.sparkContext.broadcast(index), uuid.uuid4().hex
    kind = docs.schema[id_col].dataType.simpleString()

    @F.pandas_udf(f"score double, vote double, near_ids array<{kind}>, near_similarity array<double>, near_toxic array<int>")
    def scored(texts: pd.Series) -> pd.DataFrame:
        return _score(texts, shared, key)

    return scored(F.col(text_col))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", examples: int = EXAMPLES, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: whether its label is held out, its score, the prediction, and as evidence all examples that voted.

    A score is a function of the text alone: renaming ids changes none. The broadcast index is bounded
    by ``examples`` and EXAMPLE_BYTES; texts are scored where they lie and never shuffled.

    Null and empty texts, and texts without a known word, get the calibrated prior. Without labelled
    rows every score is near zero. Repeated rows give repeated results; extra columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"))
    index = train(rows.where("not held_out"), labels, examples)
    found = rows.select("doc_id", "held_out", _scored(index, rows, "doc_id", "text").alias("s"))
    return found.select(
        "doc_id", "held_out", "s.score", (F.col("s.score") >= threshold).cast("int").alias("predicted"),
        F.arrays_zip(F.col("s.near_ids").alias("doc_id"), F.col("s.near_similarity").alias("similarity"), F.col("s.near_toxic").alias("toxic")).alias("evidence"),
    )
