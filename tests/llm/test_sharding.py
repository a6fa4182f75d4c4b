from collections import Counter

import zlib

from narrata.llm import sharding
from tests.llm.helpers import documents, no_docs, odd_docs


def test_law_slots_and_growth(spark):
    rows = sharding.rendezvous_shards(documents(spark)).collect()
    texts = {r["doc_id"]: r["text"] for r in documents(spark).collect()}
    for r in rows:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 1, zlib.crc32(data), "key")
        assert r["grown_shard"] in (r["shard"], 8)
    for shard in range(8):
        mine = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert mine == list(range(len(mine)))


def test_grown_shard_is_the_shard_with_one_more(spark):
    eight = {r["doc_id"]: r for r in sharding.rendezvous_shards(documents(spark)).collect()}
    nine = {r["doc_id"]: r["shard"] for r in sharding.rendezvous_shards(documents(spark), (1.0,) * 9).collect()}
    assert nine == {i: r["grown_shard"] for i, r in eight.items()}
    moved = sum(r["grown_shard"] == 8 for r in eight.values())
    assert 0 < moved < len(eight) / 4


def test_weights_share_out_rows(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "'t' as text")
    n = Counter(r["shard"] for r in sharding.rendezvous_shards(docs, (1.0, 3.0)).select("shard").collect())
    assert abs(n[1] / 20_000 - 0.75) < 0.02


def test_odd_rows_have_defined_results(spark):
    rows = sharding.rendezvous_shards(odd_docs(spark)).collect()
    assert len(rows) == 15 and all(r["size"] == 1 and r["text_crc32"] == 0 for r in rows if r["doc_id"] in (0, 1))
    assert len({r["shard"] for r in rows if r["doc_id"] == 10}) == 1 and len({(r["shard"], r["slot"]) for r in rows}) == 15
    assert sharding.rendezvous_shards(no_docs(spark)).count() == 0


def test_numbering_spans_many_runs(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_RUN", 10)
    rows = sharding.rendezvous_shards(spark.range(3000).selectExpr("id as doc_id", "'t' as text")).collect()
    for shard in range(8):
        mine = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert mine == list(range(len(mine)))
