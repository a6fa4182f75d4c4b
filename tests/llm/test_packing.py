import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from narrata.llm import packing
from tests.llm.helpers import DOCS, documents, no_docs, odd_docs


def library():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 1]


def pad(used):
    return 0 if used & (used - 1) == 0 else 2048 - used


def held_to_the_contract(rows, texts):
    """Every id in one piece, crcs as the library's ids give them, sequences without gaps; the share of padding."""
    encode, by_doc, by_sequence = library(), defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(texts)
    for doc_id, pieces in by_doc.items():
        ids, at = np.array(encode(texts[doc_id]), "<u4"), 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : at].tobytes())
        assert at == len(ids)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048 and {r["sequence_tokens"] for r in pieces} == {at} and {r["window"] for r in pieces} == {at + pad(at)}
        padding += pad(at)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    return padding / sum(r["length"] for r in rows)


def test_whole_table_keeps_the_contract_with_little_padding(spark):
    rows = packing.packed_pieces(documents(spark)).collect()
    padding = held_to_the_contract(rows, {r["doc_id"]: r["text"] for r in documents(spark).collect()})
    assert padding < 0.02
    steps = defaultdict(set)
    for r in rows:
        steps[r["window"], r["step_group"]].add(r["sequence_id"])
    for size in {w for w, _ in steps}:
        held = [len(s) for (w, _), s in steps.items() if w == size]
        assert max(held) - min(held) <= 1 and max(held) * size <= packing.STEP_TOKENS
    assert len({g for _, g in steps}) == len(steps)


def test_sequences_have_the_ids_of_their_documents(spark):
    docs, encode = documents(spark).limit(80), library()
    pieces = packing.packed_pieces(docs, keep_ids=True)
    found = defaultdict(list)
    lengths = {(r["doc_id"], r["start"]): r["length"] for r in pieces.collect()}
    for s in packing.sequences(pieces).collect():
        at = 0
        for doc_id, start in zip(s["doc_ids"], s["starts"]):
            found[doc_id].append((start, s["ids"][at : at + lengths[doc_id, start]]))
            at += lengths[doc_id, start]
        assert at == len(s["ids"]) and at + pad(at) == s["window"]
    for r in docs.collect():
        assert [i for _, ids in sorted(found[r["doc_id"]]) for i in ids] == encode(r["text"])


def test_odd_rows(spark):
    docs = odd_docs(spark, ["word " * n for n in (254, 255, 256, 511, 1023, 2047, 2048, 4095, 5000)]).where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = packing.packed_pieces(docs).collect()
    held_to_the_contract(rows, {r["doc_id"]: r["text"] for r in docs.collect()})
    assert sorted(r["length"] for r in rows if r["doc_id"] in (0, 1)) == [1, 1]
    again = packing.packed_pieces(odd_docs(spark)).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in again}) == len(again) and Counter(r["doc_id"] for r in again if r["start"] == 0)[None] == 2
    assert packing.packed_pieces(no_docs(spark)).count() == 0
    assert packing.sequences(packing.packed_pieces(no_docs(spark), keep_ids=True)).count() == 0


def test_equal_lengths_are_cut_and_dealt_out(spark):
    """No two of these fit into a window, so all are cut; what is cut fills windows but for the last."""
    docs = spark.createDataFrame([(i, "word " * (1098 + i % 2), None, None, None, None, None) for i in range(400)], DOCS).repartition(7)
    assert held_to_the_contract(packing.packed_pieces(docs).collect(), {r["doc_id"]: r["text"] for r in docs.collect()}) < 0.01


@pytest.mark.parametrize("seed", range(12))
def test_plans_lay_every_piece_once_and_pad_little(seed):
    rng = random.Random(seed)
    lengths = rng.sample(range(1, 2048), rng.choice([1, 3, 40, 900, 2047]))
    counts = {n: rng.choice([1, 2, 7, 1000, 10**9]) for n in lengths} | ({2048: rng.randint(0, 9)} if seed % 2 else {})
    plan = packing.Plan(dict(counts))
    want, used = [Counter(counts), Counter(), Counter()], Counter()
    for level, table in enumerate(plan.levels):
        seen = Counter()
        for n, first, count, each, sequence, offset, tokens, _, *below in table.tolist():
            assert first == seen[n]
            seen[n] += count
            if sequence >= 0:
                assert count % each == 0 and offset + each * n <= tokens <= 2048
                used[sequence] = tokens
            else:
                parts = [p for p in packing._cuts(n) if p]
                assert all((b >= 0) == (p is not None and (k < 4 if level == 0 else k >= 4)) for k, (b, p) in enumerate(zip(below, packing._cuts(n))))
                for k, (b, p) in enumerate(zip(below, packing._cuts(n))):
                    if b >= 0:
                        want[level + 1][p[1]] += count
                assert parts
        assert +seen == +want[level]
    total = sum(n * c for n, c in counts.items())
    filled = sum(tokens * count // each * (offset == 0) for t in plan.levels for n, _, count, each, sequence, offset, tokens, _, *_ in t.tolist() if sequence >= 0)
    padding = sum(pad(tokens) * count // each for t in plan.levels for n, _, count, each, sequence, offset, tokens, _, *_ in t.tolist() if sequence >= 0 and offset == 0)
    assert filled == total and padding <= 0.01 * total + 2048
    assert sum(len(t) for t in plan.levels) < 40_000
