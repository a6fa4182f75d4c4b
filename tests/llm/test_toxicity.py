import random
import zlib

import numpy as np
import pytest

from narrata.llm import toxicity
from tests.llm.helpers import documents, labels, no_docs, odd_docs


def corpus(n=400, seed=11):
    """Texts of common words; toxic ones hold two or three of ten bad stems with endings of their own."""
    rng = random.Random(seed)
    stems = ["vilex", "grubo", "scurn", "mordik", "trasho"]
    rows, marks = [], []
    for i in range(n):
        words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 6))) for _ in range(60)]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(stems) + rng.choice(["", "s", "ed", "ly", "ium"])
        rows.append((i, " ".join(words)))
        marks.append((i, 1, int(toxic), "clash"))
    return rows, marks


def test_held_out_documents_are_told_apart(spark):
    rows, marks = corpus()
    got = toxicity.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), labels(spark, marks)).collect()
    out = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in out} == {i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r["predicted"] == (r["doc_id"] % 4 == 0) for r in out) / len(out) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert all(e["doc_id"] not in {r["doc_id"] for r in out} for r in got for e in r["evidence"])


def test_scores_depend_on_the_text_alone(spark):
    rows, marks = corpus(200)
    docs = spark.createDataFrame([*rows, *((1000 + i, t) for i, t in rows)], "doc_id long, text string")
    flipped = [m if zlib.crc32(str(m[0]).encode()) % 4 != 2 else (m[0], 1, 1 - m[2], "") for m in marks]
    a, b = ({r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, labels(spark, x)).collect()} for x in (marks, flipped))
    assert a == b
    assert all(a[i] == pytest.approx(a[1000 + i]) for i, _ in rows)


def exact(texts, k=16):
    """For each text its k nearest of all, by cosine over whole vectors without any index."""
    import xxhash

    index = built(texts)
    full = np.zeros((len(texts), len(index.terms)))
    for n, t in enumerate(texts):
        at, w = index.vector(t)
        full[n, at] = w
    rank = np.argsort(np.argsort([xxhash.xxh64_intdigest(t.encode()) >> 1 for t in texts]))
    scores = np.round(full @ full.T, 10)
    return index, [[(scores[i, j], j) for j in np.lexsort((rank, -scores[i]))[:k] if scores[i, j] > 0] for i in range(len(texts))]


def built(texts, marks=None):
    import xxhash

    counted = toxicity._counted(texts)
    return toxicity.Index([
        toxicity.Example(n, xxhash.xxh64_intdigest(t.encode()) >> 1, np.frombuffer(a, "<i8"), np.frombuffer(b, "<i8"), float(marks[n] if marks else n % 3 == 0))
        for n, (t, a, b) in enumerate(zip(texts, counted["terms"], counted["counts"]))
    ])


def test_search_over_whole_documents_is_exact(spark):
    texts = sorted({r["text"] for r in documents(spark).collect()})
    texts += [" ".join(t.split()[:5]) for t in texts[:40]]
    index, wanted = exact(texts)
    for got, near in zip(index.nearest([index.vector(t) for t in texts]), wanted):
        assert np.allclose([s for s, _ in got], [s for s, _ in near], atol=1e-9)
        clear = near[-1][0] + 1e-8  # at the last place many may tie
        assert {index.ids[n] for s, n in got if s > clear} == {n for s, n in near if s > clear}


def test_every_text_with_a_known_word_has_neighbours(spark):
    index = built(["alpha beta", "gamma delta", "alpha"] * 40)
    known, unknown, none = index.nearest([index.vector(t) for t in ("gamma", "unknown", None)])
    assert [index.ids[n] % 3 for _, n in known] == [1] * 16 and unknown == none == []
    assert built([]).nearest([built([]).vector("gamma")]) == [[]]


def test_renaming_ids_changes_no_score(spark):
    rows, marks = corpus(240)
    rows += [(1000 + i, t) for i, t in rows[:40]]
    learnt = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    moved = dict(zip(learnt, learnt[::-1]))
    first = toxicity.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), labels(spark, marks)).collect()
    renamed = spark.createDataFrame([(moved.get(i, i), t) for i, t in rows], "doc_id long, text string")
    second = toxicity.toxicity(renamed, labels(spark, [(moved.get(m[0], m[0]), *m[1:]) for m in marks])).collect()
    back = {r["doc_id"]: r["score"] for r in second}
    assert all(r["score"] == back[moved.get(r["doc_id"], r["doc_id"])] for r in first)
    assert all(len(r["evidence"]) == toxicity.NEIGHBOURS for r in first)


def test_odd_rows_have_defined_results(spark):
    marks = [(i, 1, i % 2, None) for i in range(12)] + [(None, 1, 1, None), (3, None, None, None), (3, 1, 1, None)]
    got = toxicity.toxicity(odd_docs(spark), labels(spark, marks)).collect()
    assert len(got) == 15 and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (0, 1, 2)}) == 1
    assert all(r["score"] < 0.3 for r in toxicity.toxicity(odd_docs(spark), labels(spark)).collect())
    assert toxicity.toxicity(no_docs(spark), labels(spark, marks)).count() == 0
