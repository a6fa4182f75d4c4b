import random

import numpy as np

from narrata.llm import quality
from tests.llm.helpers import FOLDER, documents, labels, no_docs, odd_docs


def test_labelled_documents_are_told_apart(spark):
    marks = spark.read.parquet(f"{FOLDER}/labels.parquet")
    got = quality.classify(documents(spark), marks).join(marks, "doc_id").collect()
    right = sum(r["kept"] == (r["quality"] == 1) for r in got) / len(got)
    assert right > 0.95 and all(r["kept"] for r in got if r["quality"] == 1)


def test_posterior_equals_brute_force(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["good", "words", "here.", "###", "$$$"][: 3 if i % 3 else 5]) for _ in range(30)) for i in range(60)]
    docs = spark.createDataFrame([(i, t, f"l{i % 2}", f"h{i % 7}") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in quality.classify(docs, labels(spark, [(i, int(i % 3 > 0), 0, "") for i in range(60)])).collect()}
    p = {i: got[i]["p_document"] for i in got}
    mean = sum(p.values()) / 60
    logit = lambda x: np.log(x / (1 - x))

    def weight(groups, prior):
        spread = sum(len(g) * (np.mean(g) - prior(k)) ** 2 for k, g in groups.items() if len(g) > 1)
        chance = {k: prior(k) * (1 - prior(k)) for k, g in groups.items() if len(g) > 1}
        tau = (spread - sum(chance.values())) / (sum(len(groups[k]) * c for k, c in chance.items()) - sum(chance.values()))
        return float(np.clip(1 / tau - 1, 1, 1e4)) if tau > 0 else 1e4

    hosts = {h: [p[i] for i in p if i % 7 == h] for h in range(7)}
    hw = weight(hosts, lambda k: mean)
    host_p = {h: (sum(g) + hw * mean) / (len(g) + hw) for h, g in hosts.items()}
    paths = {(h, m): [p[i] for i in p if (i % 7, i % 2) == (h, m)] for h in range(7) for m in range(2)}
    pw = weight(paths, lambda k: host_p[k[0]])
    for i in p:
        host, path = hosts[i % 7], paths[i % 7, i % 2]
        h = (sum(host) - p[i] + hw * mean) / (len(host) - 1 + hw)
        q = (sum(path) - p[i] + pw * h) / (len(path) - 1 + pw)
        wanted = 1 / (1 + np.exp(-(logit(p[i]) + logit(q) - logit(mean))))
        assert np.allclose([got[i]["p_host"], got[i]["p_path"], got[i]["posterior"]], [h, q, wanted], atol=1e-6), i


def test_odd_rows_have_defined_results(spark):
    docs = odd_docs(spark)
    got = quality.classify(docs, labels(spark, [(4, 0, 0, ""), (10, 1, 0, ""), (11, None, 0, ""), (None, 1, 1, "")])).collect()
    assert len(got) == 15 and all(0 < r["posterior"] < 1 for r in got)
    assert all(r["posterior"] == 0.5 and r["kept"] for r in quality.classify(docs, labels(spark)).collect())
    assert quality.good_documents(docs, labels(spark)).columns == docs.columns
    assert quality.classify(no_docs(spark), labels(spark)).count() == 0


def test_columns_with_inner_names_pass_through(spark):
    from pyspark.sql import functions as F

    names = ["n", "s", "h_n", "h_s", "q_host", "q_path", "_q", "_q_p", "_q_host", "_q_row", "_q_of", "host", "path", "a b.c"]
    docs = odd_docs(spark).drop("host").withColumns({c: F.lit(f"own {c}") for c in names})
    got = quality.good_documents(docs, labels(spark, [(4, 0, 0, ""), (10, 1, 0, "")]), threshold=0.0)
    assert got.columns == docs.columns and got.count() == 15
    assert all(r[c] == f"own {c}" for r in got.collect() for c in names)
    assert quality.classify(docs, labels(spark)).count() == 15
