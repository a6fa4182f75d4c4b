"""Streams against the same work on tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from narrata.sources import tables
from narrata.streaming import resume

FOLDER = "/root/testdata/sf0.001"


def test_windowed_counts_of_a_stream_equal_the_table(spark, tmp_path):
    log = tables.status_log(spark, FOLDER)
    log.write.parquet(str(tmp_path / "in"))
    stream = resume.stage_counts(spark.readStream.schema(log.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination()
    rows = lambda f: sorted(map(tuple, f.collect()))
    assert rows(spark.table("counted")) == rows(resume.stage_counts(log))


def test_resumed_stream_speaks_each_chunk_once(spark, tmp_path):
    source, done, checkpoint = (str(tmp_path / x) for x in ("in", "done", "checkpoint"))
    spoken = []

    def speak(rows):
        spoken.append(rows.count())
        return rows.select("input_hash", F.length("text").alias("frames"))

    def run(texts):
        spark.createDataFrame([(t, t) for t in texts], "text string, input_hash string").coalesce(1).write.mode("append").parquet(source)
        resume.speak_new_chunks(spark, source, "text string, input_hash string", done, checkpoint, speak)

    run(["a", "b", "b"])
    run(["b", "c"])
    assert spoken == [2, 1]
    assert sorted(r["input_hash"] for r in spark.read.parquet(done).collect()) == ["a", "b", "c"]
