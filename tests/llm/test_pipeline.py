import corpus_pipeline
from narrata.llm import decontaminate, quality
from tests.llm.helpers import FOLDER, documents
from tests.llm.test_near_copies import brute


def test_each_stage_does_what_its_operator_says(spark):
    docs = documents(spark)
    marks, bench = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("labels", "benchmark"))
    stage = dict(corpus_pipeline.STAGES)
    ids = lambda frame: sorted(r["doc_id"] for r in frame.select("doc_id").collect())

    good = stage["quality"](spark, docs, FOLDER).cache()
    assert ids(good) == ids(quality.classify(docs, marks).where("kept"))
    one_each = stage["near_duplicates"](spark, good, FOLDER).cache()
    rows = good.select("doc_id", "text").orderBy("doc_id").collect()
    assert ids(one_each) == sorted(rows[i]["doc_id"] for i in set(brute([r["text"] for r in rows])))
    clean = stage["decontamination"](spark, one_each, FOLDER).cache()
    assert ids(clean) == ids(decontaminate.hit_digest(one_each, bench).where("not contaminated"))
    mixed = stage["mixing"](spark, clean, FOLDER).cache()
    assert set(ids(mixed)) <= set(ids(clean)) and mixed.columns == clean.columns == docs.columns
    placed = stage["sharding"](spark, mixed, FOLDER)
    assert ids(placed) == ids(mixed)


def test_run_applies_all_stages(spark):
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert len(rows) > 50 and len({(r["shard"], r["slot"]) for r in rows}) == len(rows)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
