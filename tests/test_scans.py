"""Texts pass through Python a few at a time, in order and whole."""

from __future__ import annotations

import random

import pyarrow as pa
import regex
from pyspark.sql import functions as F

from narrata.functions import scans
from narrata.operators import boundaries


def test_parts_are_bounded_and_whole():
    texts = pa.array(["x" * (scans.PART_BYTES + 1), None, *["y" * 1000] * 2000, "", "z" * scans.PART_BYTES])
    found = list(scans.parts(texts))
    assert [b for b, _ in found] == [0, *(b + n for b, n in found[:-1])] and sum(n for _, n in found) == len(texts)
    assert all(n == 1 or (n <= scans.PART_ROWS and sum(len(x or "") for x in texts.slice(b, n).to_pylist()) <= scans.PART_BYTES) for b, n in found)
    assert list(scans.parts(pa.array([], pa.string()))) == []


def test_scans_keep_rows_in_order(spark):
    rows = spark.range(0, 3000, 1, 2).withColumn("t", F.when(F.col("id") % 7 > 0, F.repeat(F.lit("ab "), (F.col("id") % 50).cast("int"))))
    found = rows.select("id", "t", boundaries.word_start_column(F.col("t")).alias("at"), scans.scanned(lambda t, n: f"{t}{n}", "string", "t", "id").alias("both")).collect()
    assert len(found) == 3000
    assert all(r["at"] == boundaries.word_starts(r["t"] or "") and r["both"] == f"{r['t']}{r['id']}" for r in found)


def test_sentence_starts_as_by_the_one_pattern():
    space = r"[\s\x1c-\x1f]"
    old = regex.compile(rf"(?<![\p{{L}}.])(?P<token>[\p{{L}}.]*)(?P<stop>[.!?])[{regex.escape(boundaries._CLOSERS)}]*(?={space}|\Z){space}*")
    draw = random.Random(3)
    for _ in range(20_000):
        text = "".join(draw.choices(["a", "é", "Mr", "e.g", "etc", ".", ".", "!", "?", ")", "”", " ", "\n", "\x1c", "3", "_", "漢"], k=draw.randrange(1, 14)))
        stops = {m.end() for m in old.finditer(text) if m["stop"] != "." or not boundaries._abbreviates(m["token"])}
        assert boundaries.sentence_starts(text) == sorted(stops.union(boundaries.paragraph_starts(text))), repr(text)
