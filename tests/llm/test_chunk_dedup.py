import random

from narrata.llm import chunkdedup
from tests.llm.helpers import no_docs, odd_docs


def prose(rng, n):
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_chunks_are_the_text_and_resist_shifts():
    rng = random.Random(6)
    data = prose(rng, 3000).encode()
    ends = chunkdedup.chunk_ends(data)
    assert ends == sorted(set(ends)) and ends[-1] == len(data)
    pieces = [data[a:b] for a, b in zip([0, *ends], ends)]
    assert all(chunkdedup.LEAST <= len(p) <= chunkdedup.MOST for p in pieces[:-1])
    other = b"an insertion " + data
    moved_ends = chunkdedup.chunk_ends(other)
    moved = {other[a:b] for a, b in zip([0, *moved_ends], moved_ends)}
    assert len(set(pieces) - moved) <= 3
    assert chunkdedup.chunk_ends(b"") == [] and chunkdedup.chunk_ends(b"x" * 3000)[-1] == 3000


def test_steps_of_long_texts_cut_alike(monkeypatch):
    data = prose(random.Random(7), 4000).encode()
    whole = chunkdedup.chunk_ends(data)
    monkeypatch.setattr(chunkdedup, "_STEP", 1000)
    assert chunkdedup.chunk_ends(data) == whole


def test_passages_are_caught_and_clean_documents_left_alone(spark):
    rng = random.Random(8)
    passages = [prose(rng, 55) for _ in range(30)]
    rows = [(i, prose(rng, 80) + " " + passages[i // 2] + " " + prose(rng, 60)) for i in range(60)]
    rows += [(i, prose(rng, 150)) for i in range(100, 160)]
    got = chunkdedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in got} == set(range(60))
    texts = dict(rows)
    for r in got:
        assert r["kept"] == (r["doc_id"] % 2 == 0) and r["copy_of"] == r["doc_id"] - r["doc_id"] % 2
        assert texts[r["doc_id"]].encode()[r["start"] : r["end"]] in passages[r["doc_id"] // 2].encode()


def test_repeats_equal_brute_force(spark):
    rng = random.Random(9)
    parts = [prose(rng, 40) for _ in range(6)]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))) for i in range(25)]
    places, first = {}, {}
    for i, t in rows:
        b, ends = t.encode(), chunkdedup.chunk_ends(t.encode())
        places[i] = [(a, e, b[a:e]) for a, e in zip([0, *ends], ends)]
        for a, _, c in places[i]:
            first.setdefault(c, []).append((i, a))
    removed = {i: sum(e - a for a, e, c in p if len(first[c]) > 1 and min(first[c]) != (i, a)) for i, p in places.items()}
    got = {}
    for r in chunkdedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), passage_bytes=0).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["removed_bytes"]
    assert {i: n for i, n in removed.items() if n} == {i: n for i, n in got.items() if n}


def test_texts_without_repeats_equal_brute_force(spark):
    rng = random.Random(10)
    parts = [prose(rng, 60) + " é漢字 " for _ in range(5)]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))) for i in range(20)]
    seen, wanted = set(), {}
    for i, t in rows:
        b, ends, left = t.encode(), chunkdedup.chunk_ends(t.encode()), []
        for a, e in zip([0, *ends], ends):
            if b[a:e] not in seen:
                left.append(b[a:e])
            seen.add(b[a:e])
        wanted[i] = b"".join(left).decode()
    got = chunkdedup.deduplicated_texts(spark.createDataFrame(rows, "doc_id long, text string"), passage_bytes=0)
    assert {r["doc_id"]: r["text"] for r in got.collect()} == wanted


def test_rows_of_one_id_are_told_apart_by_their_texts(spark):
    rng = random.Random(11)
    a, b = prose(rng, 25), prose(rng, 25)
    rows = [(7, a), (7, a), (7, a), (7, b), (None, b), (None, prose(rng, 30)), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["end"]): r for r in chunkdedup.repeated_passages(docs).collect()}
    assert set(got) == {(7, len(a)), (7, len(b)), (None, len(b))}
    assert (got[7, len(a)]["n_rows"], got[7, len(a)]["removed_bytes"]) == (3, 0)
    assert (got[7, len(b)]["removed_bytes"], got[None, len(b)]["removed_bytes"], got[None, len(b)]["copy_of"]) == (0, len(b), 7)
    texts = sorted((r["text"] or "" for r in chunkdedup.deduplicated_texts(docs).collect()), key=len)
    assert texts[:2] == ["", ""] and len(texts) == 7


def test_odd_rows_have_defined_results(spark):
    assert chunkdedup.repeated_passages(odd_docs(spark)).where("doc_id in (6, 7)").count() >= 1
    assert chunkdedup.repeated_passages(no_docs(spark)).count() == 0
    assert chunkdedup.deduplicated_texts(odd_docs(spark)).count() == 15
    assert chunkdedup.deduplicated_texts(no_docs(spark)).count() == 0


def test_equal_rows_are_counted_before_they_are_dealt_out(spark):
    """A great many rows equal in id and text come together as counts, not as rows."""
    text = "some passage that is long enough to be cut into several chunks, " * 8
    docs = spark.createDataFrame([(None, text)] * 300 + [(1, text)], "doc_id long, text string").repartition(4)
    found = chunkdedup.repeated_passages(docs)
    assert {(r["doc_id"], r["n_rows"]) for r in found.collect()} == {(None, 300), (1, 1)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" not in plan
