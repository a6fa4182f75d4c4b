import math

from pyspark.sql import functions as F

from narrata.llm import mixing
from tests.llm.helpers import FOLDER, documents, labels, no_docs, odd_docs


def test_expected_tokens_match_the_targets(spark):
    marks = spark.read.parquet(f"{FOLDER}/labels.parquet")
    targets = {"en": 0.4, "de": 0.3, "fr": 0.2, "es": 0.1}
    rows = mixing.mixing_rates(documents(spark), marks, targets).collect()
    whole = sum(r["n_tokens"] for r in rows)
    for domain, share in targets.items():
        assert abs(sum(r["n_tokens"] * r["rate"] * r["membership"][domain] for r in rows) - share * whole) <= 2e-4 * whole
    assert all(r["rate"] >= 0 and r["copies"] in (math.floor(r["rate"]), math.floor(r["rate"]) + 1) for r in rows)
    assert all(abs(sum(r["membership"].values()) - 1) < 1e-9 for r in rows)
    langs = {r["doc_id"]: r["lang"] for r in documents(spark).collect()}
    told = [max(r["membership"], key=r["membership"].get) == langs[r["doc_id"]] for r in rows if r["n_tokens"] > 20]
    assert sum(told) / len(told) > 0.97


def test_rates_stay_nonnegative_and_unnamed_domains_go(spark):
    rows = mixing.mixing_rates(documents(spark), spark.read.parquet(f"{FOLDER}/labels.parquet"), {"en": 1.0}).collect()
    assert all(r["rate"] >= 0 for r in rows) and max(r["rate"] for r in rows if r["membership"]["fr"] > 0.99) < 0.02


def test_copies_have_the_rate_as_mean(spark):
    got = spark.range(20_000).select(mixing.copies(F.lit(1.3), F.col("id")).alias("c")).agg(F.avg("c")).first()[0]
    assert abs(got - 1.3) < 0.02


def test_posteriors_equal_brute_force(spark):
    import xxhash

    words = [[math.log((i + 1) / 36) for i in range(8)], [math.log((8 - i) / 36) for i in range(8)], [math.log(1 / 8)] * 8]
    model = mixing.Membership(["a", "b", "c"], [math.log(0.5), math.log(0.2), math.log(0.3)], words)
    texts = ["Kéwi ßñ " * 3, "", "one two three", "  x\n\ty  ", None]
    got = mixing.with_membership(spark.createDataFrame([(t,) for t in texts], "text string"), model, F.col("text"), "p").collect()
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    for r in got:
        grams = [g for w in (r["text"] or "").lower().split() for g in (w[:3] + "-", "-" + w[-3:])]
        at = [signed(xxhash.xxh64_intdigest(g.encode(), 42)) % 8 for g in grams]
        logs = [p + sum(x[i] for i in at) for p, x in zip(model.prior, words)]
        wanted = [math.exp(v - max(logs)) / sum(math.exp(w - max(logs)) for w in logs) for v in logs]
        assert all(abs(g - w) < 1e-9 for g, w in zip(r["p"], wanted)), r


def test_projected_gradient_equals_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    p = rng.dirichlet([0.4, 0.4, 0.4], 60)
    n = rng.integers(1, 500, 60).astype(float)
    rows = spark.createDataFrame([(float(a), b.tolist()) for a, b in zip(n, p)], "n_tokens double, posterior array<double>")
    model = mixing.Membership(["a", "b", "c"], [0.0] * 3, [[]] * 3)
    for targets in ({"a": 0.6, "b": 0.3, "c": 0.1}, {"a": 1.0}):  # one that can be met, and one that can't
        fit = mixing.fit_steps(rows, model, targets, rounds=12)
        start = p.T @ n
        goal = start.sum() * np.array([targets.get(d, 0.0) for d in "abc"])
        rates = np.ones(60)
        for _ in fit.steps:
            rates = np.maximum(0, rates - p @ ((p.T @ (n * rates) - goal) / start))
        got = [r["r"] for r in rows.select(mixing.rate(F.col("posterior"), fit.steps).alias("r")).collect()]
        assert np.allclose(got, rates)
        assert abs(fit.residual - np.abs(p.T @ (n * rates) - goal).max() / start.sum()) < 1e-9


def test_any_column_is_a_domain_and_unknown_targets_are_an_error(spark):
    import pytest

    topics = [f"topic{chr(97 + k % 8)}{chr(97 + k // 8)}" for k in range(40)]
    rows = [(i, " ".join(f"w{(i * 7 + j) % 5}{topics[i % 40]}" for j in range(20)), topics[i % 40], "s", "row") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, topic string, key string, copies string")
    marks = labels(spark, [(i, 1, 0, "") for i in range(0, 400, 2)] + [(i, 1, 0, "") for i in range(1, 400, 40)])
    got = {r["doc_id"]: r for r in mixing.mixing_rates(docs, marks, domain_col="topic").collect()}
    learnt = {rows[r["doc_id"]][2] for r in marks.collect()}
    assert set(got[0]["membership"]) == learnt and len(learnt) > 20
    told = [got[i]["membership"][rows[i][2]] for i in range(0, 400, 2)]  # two of the topics share a bucket
    assert min(told) > 0.49 and sum(t > 0.9 for t in told) >= 180
    assert 0 <= got[0]["residual"] < 0.1
    assert mixing.mixed_documents(docs, marks, domain_col="topic").columns == docs.columns
    with pytest.raises(ValueError, match="nowhere"):
        mixing.mixing_rates(docs, marks, {"topicaa": 0.5, "nowhere": 0.5}, domain_col="topic")


def test_odd_rows_have_defined_results(spark):
    docs, marks = odd_docs(spark), labels(spark, [(i, 1, 0, "") for i in range(12)])
    rows = mixing.mixing_rates(docs, marks).collect()
    assert len(rows) == 15 and all(r["rate"] >= 0 and r["n_tokens"] is not None for r in rows)
    mixed = mixing.mixed_documents(docs, marks)
    assert mixed.columns == docs.columns
    assert mixing.mixed_documents(docs, labels(spark)).count() == 15
    assert all(r["rate"] == 1 for r in mixing.mixing_rates(docs, labels(spark)).collect())
    assert mixing.mixing_rates(no_docs(spark), marks).count() == 0
