"""Substring deduplication by content-defined chunking.

A gear hash of the last WINDOW bytes decides where chunks end, so equal passages are cut alike
wherever they stand, and an insertion moves only the cuts around it. Chunks are deduplicated by a
128-bit digest; repeated chunks that touch form a repeated passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from narrata.llm.common import column, cut

#: Bytes that the gear hash sees, bits that have to be zero at a cut, and bounds of a chunk in bytes.
WINDOW, CUT_BITS, LEAST, MOST = 16, 5, 16, 1024
#: Bytes that touching repeated chunks need to count as a repeated passage.
PASSAGE_BYTES = 48
#: Bytes of a text that are hashed at a time.
_STEP = 1 << 22

#: The gear table, by rule: a 32-bit hash of each byte value.
_GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), seed=7) for b in range(256)], np.uint32)


def _candidates(data: bytes) -> np.ndarray:
    """Ends (exclusive) where the gear hash of the WINDOW bytes before has its top bits zero."""
    found = []
    for at in range(0, len(data), _STEP):
        begin = max(0, at - WINDOW + 1)
        h = _GEAR[np.frombuffer(data, np.uint8, min(len(data), at + _STEP) - begin, begin)]
        span = 1
        while span < WINDOW:  # h covers span bytes; shifting it by span covers twice as many
            h[span:] += h[:-span] << np.uint32(span)
            span *= 2
        ends = np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + begin + 1
        ends = ends[(ends > at) & (ends < len(data))]
        found.append(ends[np.frombuffer(data, np.uint8)[ends] & 0xC0 != 0x80])  # characters stay whole
    return np.concatenate(found) if found else np.empty(0, np.int64)


def chunk_ends(data: bytes) -> list[int]:
    """Where the chunks of a text end: at candidates LEAST bytes or more apart, and after MOST bytes at the latest."""
    ends, last = [], 0
    for end in (*_candidates(data).tolist(), len(data)):
        while end - last > MOST:
            last += MOST
            while data[last] & 0xC0 == 0x80:
                last -= 1
            ends.append(last)
        if end - last >= LEAST or (end == len(data) and end > last):
            ends.append(end)
            last = end
    return ends


def _chunks(batches: Iterator[pa.RecordBatch], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", id_type), ("text_hash", pa.int64()), ("high", pa.int64()), ("low", pa.int64()), ("start", pa.int64()), ("size", pa.int64())])
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            some = batch.slice(at, 128)
            counts, starts, sizes, digests = [], [], [], []
            for text in some.column(2).to_pylist():
                data = (text or "").encode("utf-8", "replace")
                ends = np.array(chunk_ends(data), np.int64)
                begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
                counts.append(len(ends))
                starts.append(begins)
                sizes.append(ends - begins)
                digests += [xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(begins.tolist(), ends.tolist())]
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            rows = np.repeat(np.arange(some.num_rows), counts)
            yield pa.RecordBatch.from_arrays([
                some.column(0).take(pa.array(rows)).cast(id_type), some.column(1).take(pa.array(rows)), pa.array(np.ascontiguousarray(halves[:, 0])), pa.array(np.ascontiguousarray(halves[:, 1])),
                pa.array(np.concatenate(starts).astype(np.int64)), pa.array(np.concatenate(sizes).astype(np.int64)),
            ], schema=schema)


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a chunk: its document (the id and a hash of the text), 128-bit digest, first byte and size."""
    from pyspark.sql.pandas.types import to_arrow_type

    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType
    arrow = to_arrow_type(kind)

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _chunks(batches, arrow)

    return rows.mapInArrow(cut_up, f"doc_id {kind.simpleString()}, text_hash long, high long, low long, start long, size long")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passage_bytes: int = PASSAGE_BYTES) -> DataFrame:
    """Passages that repeat within or across documents: one row for each place where one stands.

    ``start`` and ``end`` are bytes of the UTF-8 text. ``removed`` are the ranges of bytes in it that
    stand elsewhere first (in a document of a lesser id, or earlier in this one) and may go as they are,
    ``removed_bytes`` are their bytes, ``kept`` says that there are none; so one copy of each chunk
    stays. ``copy_of`` is the id where the passage's largest chunk stands first. Documents without a
    repeated passage of ``passage_bytes`` have no row; ``deduplicated_texts`` has all documents.

    A digest of a third of all documents is counted with pre-aggregation and joined by Spark's
    splittable join; what is brought together by document is that document's own repeated chunks.

    A document is an id and a text. Rows with one id and different texts are documents of their own,
    rows equal in both are one, and ``n_rows`` says how many they are. Null ids come after all others.
    Null and empty texts have no chunks. Extra columns are ignored.
    """
    all_chunks = chunks(docs, id_col, text_col)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "start")
    repeated = all_chunks.groupBy("high", "low").agg(F.count(F.lit(1)).alias("copies"), F.min(place).alias("first")).where("copies > 1")
    # Cut, so that the join deals out both sides anew and Spark can split a digest that many documents hold.
    repeated = cut(repeated.select(F.col("high").alias("r_high"), F.col("low").alias("r_low"), "first"))
    places = all_chunks.join(repeated, (F.col("high") == F.col("r_high")) & (F.col("low") == F.col("r_low")))
    own = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.text_hash") == F.col("text_hash")) & (F.col("first.start") == F.col("start"))
    marked = places.select("doc_id", "text_hash", "start", "size", F.col("first.doc_id").alias("first_id"), (~own).alias("elsewhere"))
    # Equal rows are counted before they are dealt out by document, however many there are.
    once = marked.groupBy("doc_id", "text_hash", "start", "size", "first_id", "elsewhere").agg(F.count(F.lit(1)).alias("n_rows"))
    once = once.withColumn("end", F.col("start") + F.col("size"))
    in_doc = Window.partitionBy("doc_id", "text_hash").orderBy("start")
    before = F.max("end").over(in_doc.rowsBetween(Window.unboundedPreceding, -1))
    opened = once.withColumn("opens", F.when(F.col("start") <= before, 0).otherwise(1))
    numbered = opened.withColumn("passage", F.sum("opens").over(in_doc.rowsBetween(Window.unboundedPreceding, 0)))
    gone = F.collect_list(F.when(F.col("elsewhere"), F.struct("start", "end")))
    return (
        numbered.groupBy("doc_id", "text_hash", "passage")
        .agg(
            F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n_chunks"), F.max_by("first_id", F.struct("size", -F.col("start"))).alias("copy_of"),
            F.sum(F.when(F.col("elsewhere"), F.col("size")).otherwise(0)).alias("removed_bytes"), F.array_sort(gone).alias("removed"), F.max("n_rows").alias("n_rows"),
        )
        .where(F.col("end") - F.col("start") >= passage_bytes)
        .select("doc_id", "start", "end", "n_chunks", "copy_of", "removed_bytes", (F.col("removed_bytes") == 0).alias("kept"), "n_rows", "removed", "text_hash")
    )


def _cut_out(texts: pd.Series, removed: pd.Series) -> pd.Series:
    out = []
    for text, ranges in zip(texts, removed):
        if ranges is not None and len(ranges):
            data, parts, at = text.encode("utf-8", "replace"), [], 0
            for r in sorted((r["start"], r["end"]) for r in ranges):
                parts.append(data[at : r[0]])
                at = r[1]
            text = b"".join([*parts, data[at:]]).decode("utf-8", "replace")
        out.append(text)
    return pd.Series(out, dtype="object")


def deduplicated_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passage_bytes: int = PASSAGE_BYTES) -> DataFrame:
    """``docs`` with all columns and rows, their texts without the bytes that :func:`repeated_passages` removes.

    Null texts stay null; rows equal in id and text are one document and keep what it keeps.
    """
    found = repeated_passages(docs, id_col, text_col, passage_bytes).where("not kept")
    found = found.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("removed")).alias("_narrata_removed"))
    found = found.select(F.col("doc_id").alias("_narrata_id"), F.col("text_hash").alias("_narrata_hash"), "_narrata_removed")
    keyed = docs.withColumn("_narrata_text", F.xxhash64(text_col))
    met = keyed.join(found, column(id_col).eqNullSafe(F.col("_narrata_id")) & (F.col("_narrata_text") == F.col("_narrata_hash")), "left")
    text = F.pandas_udf(_cut_out, "string")(column(text_col), F.col("_narrata_removed"))
    return met.select(*(text.alias(c) if c == text_col else column(c) for c in docs.columns))
