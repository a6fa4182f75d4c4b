import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from narrata.llm import phrases, queries
from tests.llm.helpers import DOCS, FOLDER, documents, no_docs, odd_docs

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def brute(rows, least, top):
    """What the contract says, by counting every phrase of every text in memory."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(UPPER)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    candidates = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in candidates.items():
        longer = (b for (g, q), b in candidates.items() if g == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))))
        if any(100 * b >= 100 * a for b in longer):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], n[lang]))
    return [(lang, i + 1, p.decode(), -a, left, right, total, -score) for lang, found in sorted(out.items()) for i, (score, a, p, left, right, total) in enumerate(sorted(found)[:top])]


def result(frame):
    return [tuple(r) for r in frame.select(*COLUMNS).orderBy("lang", "rank").collect()]


def made(spark, n=2500, seed=4):
    rng = random.Random(seed)
    words = ["the", "of", "New", "york", "city", "é", "a", "b\x1cc", "漢", *(f"w{i}" for i in range(30))]
    rows = []
    for i in range(n):
        text = "".join(rng.choices(words, [9, 7, 5, 5, 4, 2, 6, 1, 1, *[1] * 30])[0] + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "!"]) for _ in range(rng.randint(0, 40)))
        rows.append((i, text, rng.choice(["en", "de", None]), None, 0, "x", "x"))
    return spark.createDataFrame(rows + rows[:200], DOCS)


@pytest.mark.parametrize(("least", "top"), [(100, 2000), (40, 25), (15, 2000)])
def test_made_texts_equal_brute_force(spark, least, top):
    docs = made(spark)
    want = brute([(r["lang"], r["text"]) for r in docs.collect()], least, top)
    assert want and result(phrases.collocations(docs, least, top=top)) == want


def test_whole_table_equals_brute_force(spark):
    docs = documents(spark)
    want = brute([(r["lang"], r["text"]) for r in docs.collect()], 20, 2000)
    assert want and result(phrases.collocations(docs, 20)) == want


def test_odd_rows_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 100)
    docs = odd_docs(spark, ["one two three. Two three", "AA aa aa aa"])
    want = brute([(r["lang"], r["text"]) for r in docs.collect()], 1, 2000)
    assert result(phrases.collocations(docs, 1)) == want
    assert result(phrases.collocations(no_docs(spark))) == []


def test_sql_gives_the_same_rows(spark):
    """The query's SQL, with a lower limit on both sides as the smallest tables are small."""
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{FOLDER}/documents.parquet'")
    sql = queries.oracle_sql()["op11_phrases"]
    assert sql.count("f >= 100") == 1
    want = db.execute(f"select {', '.join(COLUMNS)} from ({sql.replace('f >= 100', 'f >= 15')}) order by lang, rank").fetchall()
    assert want and result(phrases.collocations(documents(spark), 15)) == want


def test_scores_beyond_64_bits_are_exact(spark):
    rng = random.Random(8)
    rows = [(rng.randint(10**12, 10**14), rng.randint(10**14, 10**16), rng.randint(10**13, 10**15), rng.randint(10**13, 10**15)) for _ in range(300)]
    rows += [(7 * 10**13, 10**16, 10**14, 7 * 10**13), (100, 10**17, 100, 100)]
    frame = spark.createDataFrame(rows, "a long, n long, l long, r long")
    got = frame.select("a", "n", "l", "r", phrases._score(*[frame[c] for c in "anlr"]).alias("s")).collect()
    assert all(1000 * g["a"] * g["n"] // (g["l"] * g["r"]) == g["s"] for g in got)


def test_filters_never_stop_what_was_put_in(spark):
    rows = [("en" if i % 3 else "漢", f"w{i} v{i % 7}", 1) for i in range(5000)]
    frequent = spark.createDataFrame(rows, "lang string, phrase string, f long")
    bits = phrases._filter(frequent, 2)
    langs, words = [r[0] for r in rows], [r[1].split(" ") for r in rows]
    hashes = phrases._mixed(phrases._hashes(langs, [w[0] for w in words]), phrases._hashes(langs, [w[1] for w in words]))
    assert phrases._passes(bits, hashes).all()
    others = np.random.default_rng(1).integers(0, 2**63, 20000).astype(np.uint64)
    assert phrases._passes(bits, others).mean() < 0.05
