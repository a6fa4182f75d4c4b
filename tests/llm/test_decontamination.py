import random

from narrata.llm import decontaminate
from narrata.llm.decontaminate import words_of
from tests.llm.helpers import no_docs, odd_docs, plain

ITEMS = "item_id long, text string, n_words long"


def brute(text, items):
    words = words_of(text)
    hit, found = set(), set()
    for item, t in items:
        w = words_of(t)
        k = min(10, len(w))
        windows = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()
        for i in range(len(words) - k + 1):
            if k and tuple(words[i : i + k]) in windows:
                hit |= set(range(i, i + k))
                found.add(str(item))
    return len(words), len(hit), ",".join(sorted(found))


def test_random_texts_equal_brute_force(spark):
    rng = random.Random(4)
    vocab = ["A", "bb", "Ccc", "d1", "é"]  # few words, so that grams repeat and hashes tie

    def some(n):
        return " ".join(rng.choice(vocab) + rng.choice(["", ",", "."]) for _ in range(n))

    items = [(i, some(rng.choice([1, 3, 7, 9, 10, 11, 14, 30]))) for i in range(20)]
    texts = [some(rng.randint(0, 80)) + " " + rng.choice(items)[1] + " " + some(10) for _ in range(60)]
    texts += [items[3][1].upper(), None, "", "x" * 10_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(*x, 1) for x in items], ITEMS)
    for most in (200_000, 0):  # by broadcast, and by shuffle
        hits = decontaminate.with_benchmark_hits(docs, bench, broadcast_rows=most)
        got = {r["doc_id"]: r["benchmark_hit"] for r in hits.collect()}
        for i, t in enumerate(texts):
            n, n_hit, found = brute(t, items)
            covered = {p for s in got[i]["spans"] for p in range(s["start"], s["end"])}
            assert (got[i]["n_words"], len(covered), ",".join(got[i]["items"])) == (n, n_hit, found), (most, t)
    digest = {r["doc_id"]: r for r in decontaminate.hit_digest(docs, bench).collect()}
    assert all((digest[i]["n_words"], digest[i]["n_hit"]) == brute(t, items)[:2] for i, t in enumerate(texts))


def test_repeated_words_take_linear_time():
    import time

    began = time.time()
    assert decontaminate.spans_of("a " * 100_000, "a " * 20_000) == [(0, 100_000)]
    assert len(decontaminate.prints_of(decontaminate.words_of("a " * 100_000), (3,))) == 2
    assert time.time() - began < 10


def test_columns_with_inner_names_pass_through(spark):
    from pyspark.sql import functions as F

    docs = odd_docs(spark).withColumns({c: F.lit(c) for c in ("d_hash", "spans", "items", "row", "n", "item", "a.b")})
    clean = decontaminate.clean_documents(docs, spark.createDataFrame([(1, "same text", 1)], ITEMS))
    assert clean.columns == docs.columns and clean.count() == 12 and all(r["a.b"] == "a.b" and r["row"] == "row" for r in clean.collect())


def test_odd_rows_have_defined_results(spark):
    item = "one two three one two three one two three one two"
    bench = spark.createDataFrame([(1, item, 1), (1, item, 1), (2, None, 1), (None, "a b", 1), (3, "", 1), (4, "z", 1)], ITEMS)
    docs = odd_docs(spark)
    got = decontaminate.hit_digest(docs, bench)
    assert got.count() == 15
    assert plain(got.where("contaminated"), "doc_id", "n_items") == [(7, 1), (8, 1)]
    clean = decontaminate.clean_documents(docs, bench)
    assert clean.count() == 13 and clean.columns == docs.columns
    assert decontaminate.hit_digest(no_docs(spark), bench).count() == 0
    assert decontaminate.hit_digest(docs, bench.limit(0)).where("contaminated").count() == 0
