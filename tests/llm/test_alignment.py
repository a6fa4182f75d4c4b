import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from narrata.llm import alignment
from tests.llm.helpers import DOCS, documents, no_docs, odd_docs

COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def plain():
    """Tokens with their bytes by the libraries alone, on whole texts."""
    a_path, b_path = alignment.default_tokenizers()
    a, b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    a.encode_special_tokens = True
    letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte, extra = {chr(x): x for x in letters}, 0
    for x in range(256):
        if x not in letters:
            byte[chr(256 + extra)] = x
            extra += 1

    def tokens(text):
        if not text:
            return [], []
        one = [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        two = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        whole = (" " + text).encode()
        return (one, two) if b"".join(t for _, t in one) == whole == b"".join(t for _, t in two) else ([], [])

    return tokens


def ends(tokens):
    at, out = 0, []
    for i, data in tokens:
        at += len(data)
        out.append((at, i))
    return out


def brute(rows, tokens):
    count, by_doc = Counter(), []
    for doc_id, text in rows:
        one, two = map(ends, tokens(text))
        common = sorted({e for e, _ in one} & {e for e, _ in two})
        links = [(i, j) for e, i in one for f, j in two if e == f] if len(one) < 300 else [(dict(one)[e], dict(two)[e]) for e in common]
        groups, low = [], 0
        for high in common:
            groups.append("|".join(",".join(str(i) for e, i in side if low < e <= high) for side in (one, two)) if len(one) < 300 else None)
            low = high
        if len(one) >= 300:  # the same by walking once
            groups, p, q = [], 0, 0
            for high in common:
                m = next(k for k in range(p, len(one)) if one[k][0] == high) + 1
                n = next(k for k in range(q, len(two)) if two[k][0] == high) + 1
                groups.append(",".join(str(i) for _, i in one[p:m]) + "|" + ",".join(str(i) for _, i in two[q:n]))
                p, q = m, n
        count.update(links)
        by_doc.append((doc_id, len(one), len(two), groups, links))
    best = {}
    for (_, j), n in count.items():
        best[j] = max(best.get(j, 0), n)
    return sorted(
        ((d, a, b, len(g), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for d, a, b, g, links in by_doc),
        key=str,
    )


def result(frame):
    return sorted((tuple(r) for r in frame.select(*COLUMNS).collect()), key=str)


def fuzzed(n, seed):
    rng = random.Random(seed)
    letters = [*"ab Z9 \n\t  .,'sé漢 <>/s\x1c\x85\xa0　\x00ﬁ①é￼", "<s>", "</s>", "<unk>", "<0x41>", "́", "😀", "\r\n", "<|endoftext|>", "▁", "hello", " the", "‍"]
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 18))) for _ in range(n)]


def test_chunks_give_what_whole_texts_give(plain):
    aligner = alignment.Aligner(*alignment.default_tokenizers())
    texts = fuzzed(12000, 5)
    for at in range(0, len(texts), 200):
        for text, got in zip(texts[at : at + 200], aligner.align(texts[at : at + 200])):
            one, two = plain(text)
            assert (got[2:] if got else (0, 0)) == (len(one), len(two)), repr(text)
            assert got == (aligner.whole(" " + text) if text else ()), repr(text)


def test_made_texts_equal_brute_force(spark, plain):
    rows = [(i, t, None, None, None, "x", "x") for i, t in enumerate(fuzzed(700, 6))]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    assert result(alignment.alignment(docs)) == brute([(r[0], r[1]) for r in rows], plain)


def test_whole_table_equals_brute_force_in_small_blocks(spark, plain, monkeypatch):
    docs = documents(spark)
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], plain)
    assert result(alignment.alignment(docs)) == want
    for name, value in (("BLOCK_LINKS", 3000), ("ROW_ENTRIES", 37), ("MEMO", 500), ("HELD", 2000)):
        monkeypatch.setattr(alignment, name, value)
    assert result(alignment.alignment(docs.repartition(3), share_entries=200)) == want


def test_odd_rows(spark, plain):
    extra = ["the " * 3000, "", "▁x", "a " * 700 + "b", "\n", " ", "x" * 400]
    docs = odd_docs(spark, extra)
    assert result(alignment.alignment(docs)) == brute([(r["doc_id"], r["text"]) for r in docs.collect()], plain)
    assert result(alignment.alignment(no_docs(spark))) == []


def test_counts_of_links_are_kept(spark, plain, tmp_path):
    docs = documents(spark).limit(50)
    assert alignment.alignment(docs, folder=str(tmp_path / "x")).count() == 50
    want = Counter()
    for r in docs.collect():
        one, two = map(ends, plain(r["text"]))
        a, b = dict(one), dict(two)
        want.update((b[e], a[e]) for e in a.keys() & b.keys())
    assert {(r["b"], r["a"]): r["n"] for r in alignment.link_counts(spark.read.parquet(str(tmp_path / "x"))).collect()} == want
