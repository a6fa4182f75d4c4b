"""Files as tables: documents by signature, WAV headers, analyzer tables, manifests."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The largest document in bytes, and bounds of a reference recording.
MOST_DOCUMENT_BYTES = 100 * 1024 * 1024
MOST_REFERENCE_BYTES, LEAST_SECONDS, MOST_SECONDS = 25 * 1024 * 1024, 5.0, 60.0


def documents(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """Document files with their digest, and ``rule``: why a file isn't admitted (null if it is).

    The length comes from the listing, so a file that is too large isn't read.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    admitted = files.where(F.col("length") <= MOST_DOCUMENT_BYTES).select(
        "path", "length", F.sha2("content", 256).alias("sha256"), F.when(F.substring(F.col("content"), 1, 5) != F.lit(b"%PDF-"), "INVALID_SIGNATURE").alias("rule")
    )
    refused = files.where(F.col("length") > MOST_DOCUMENT_BYTES).select("path", "length", F.lit(None).cast("string").alias("sha256"), F.lit("SIZE_LIMIT").alias("rule"))
    return admitted.unionByName(refused)


def _wav_facts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, content in zip(batch["path"], batch["content"]):
            facts = [0, 0, 0, 0, "INVALID_WAV"]
            try:
                with wave.open(io.BytesIO(bytes(content))) as w:
                    good = w.getnchannels() == 1 and w.getsampwidth() == 2 and w.getcomptype() == "NONE" and w.getnframes() > 0
                    facts = [w.getframerate(), w.getnchannels(), w.getsampwidth(), w.getnframes(), None if good else "INVALID_WAV"]
            except (wave.Error, EOFError):
                pass
            rows.append([path, *facts])
        yield pd.DataFrame(rows, columns=["path", "sample_rate", "channels", "sample_width", "frames", "rule"])


def wav_files(spark: SparkSession, path: str) -> DataFrame:
    """WAV files with what their headers say; ``rule`` tells files that aren't mono 16-bit PCM."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path).select("path", "content")
    facts = files.mapInPandas(_wav_facts, "path string, sample_rate int, channels int, sample_width int, frames long, rule string")
    return facts.withColumn("duration_seconds", F.when(F.col("sample_rate") > 0, F.col("frames") / F.col("sample_rate")))


def analyzer_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A tab-separated table with a header in which quotes are plain characters."""
    reader = spark.read.option("sep", "\t").option("header", True).option("quote", "")
    return (reader.schema(schema) if schema else reader).csv(path)


def manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON files, one object each; a file that doesn't fit the schema fails the read."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def field_violations(rows: DataFrame, json_col: str, fields: list[str]) -> DataFrame:
    """Rows whose JSON object lacks a field or has one too many."""
    keys, wanted = F.json_object_keys(json_col), F.array(*(F.lit(f) for f in fields))
    checked = rows.withColumns({"missing": F.array_except(wanted, keys), "extra": F.array_except(keys, wanted)})
    return checked.where((F.size("missing") > 0) | (F.size("extra") > 0))
