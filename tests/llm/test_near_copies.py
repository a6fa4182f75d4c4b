import random

import numpy as np
import pandas as pd

import corpus_pipeline
from narrata.llm import nearcopies
from tests.llm.helpers import DOCS, FOLDER, documents, near_copies, no_docs, odd_docs


def brute(texts):
    """For each text the least place of its component, over all pairs of five-word Jaccard 0.8 or more."""
    words = [(t or "").encode().lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {()} for w in words]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return [root(i) for i in range(len(sets))]


def planted(groups=12, size=6, words=150, seed=7):
    """Groups of texts that differ in one to seven words each from their first text, around 0.8."""
    rng = random.Random(seed)
    out = []
    for g in range(groups):
        base = [f"w{rng.randrange(3000)}" for _ in range(words)]
        for i in range(size):
            w = list(base)
            for at in rng.sample(range(words), min(i, 1 + g % 7)):
                w[at] = f"new{g}x{i}x{at}"
            out.append(" ".join(w))
    return out


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 1, "clash", "clash") for i, t in enumerate(texts)], DOCS)


def test_stage_removes_planted_near_copies(spark):
    texts = planted()
    wanted = sorted(set(brute(texts)))
    assert len(wanted) < len(texts)
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    assert sorted(r["doc_id"] for r in stage(spark, frame(spark, texts), FOLDER).collect()) == wanted


def test_crowded_bands_connect_as_pairs_do(spark):
    texts = [*planted(7, 20), *near_copies(15), "a b c d e f g"]
    got = nearcopies.near_copies_removed(frame(spark, texts), crowd=2)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(brute(texts)))


def test_given_documents_equal_brute_force(spark):
    rows = documents(spark).select("doc_id", "text").orderBy("doc_id").collect()
    wanted = sorted(rows[i]["doc_id"] for i in set(brute([r["text"] for r in rows])))
    assert sorted(r["doc_id"] for r in nearcopies.near_copies_removed(documents(spark)).collect()) == wanted


def test_a_clean_row_stays_whatever_its_id(spark):
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    extra = [(2, "another text with the id two", None, None, None, None, None), (None, "no id either", None, None, None, None, None), (None, "no id", "en", None, None, None, None)]
    docs = odd_docs(spark).unionByName(spark.createDataFrame(extra, DOCS))
    rows = docs.collect()
    got = stage(spark, docs, FOLDER)
    assert got.columns == docs.columns
    kept = [(r["doc_id"], r["text"]) for r in got.collect()]
    assert {(None, "no id"), (None, "no id either"), (2, "another text with the id two"), (0, None)} <= set(kept)
    assert len(kept) == len(set(brute([r["text"] for r in rows])))
    assert stage(spark, no_docs(spark), FOLDER).count() == 0


def test_a_crowd_just_under_the_bound_gives_few_pairs(spark, monkeypatch):
    rng = random.Random(11)
    base = [f"w{rng.randrange(3000)}" for _ in range(150)]
    texts = []
    for i in range(300):  # three words each are new, so most pairs are alike by some 0.66
        w = list(base)
        for at in rng.sample(range(5, 145), 3):
            w[at] = f"new{i}x{at}"
        texts.append(" ".join(w))
    compared, verified = [], nearcopies._verified
    monkeypatch.setattr(nearcopies, "_verified", lambda pairs, sets: compared.append(pairs.count()) or verified(pairs, sets))
    got = nearcopies.near_copies_removed(frame(spark, texts))
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(brute(texts)))
    assert len(compared) == 2 and compared[1] <= len(texts), compared  # the first round's pairs are of small points and heads alone


def test_what_a_text_has_of_its_base_is_whole():
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(-(1 << 63), 1 << 63, 3000))
    for own in (base, base[::2], base[:5], np.append(base[1000:1100], [7, 8]), np.array([], np.int64)):
        for whole in (base, base[:70], base[:1]):
            held, rest, beyond = nearcopies._held(pd.Series([own]), pd.Series([whole])).iloc[0]
            assert len(held) <= nearcopies.PLACES // 64
            assert np.unpackbits(held.view(np.uint8)).sum() + rest == len(np.intersect1d(own, whole))
            assert sorted(beyond) == sorted(set(own) - set(whole))
