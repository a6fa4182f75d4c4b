"""Token ids in a binary format: byte planes of fixed-size id blocks, each compressed with zstandard.

A segment is a row of a Parquet table: ids of whole documents in order, cut into blocks of BLOCK_IDS.
A block of 32-bit ids is transposed into four planes (all lowest bytes, then the next ...), and each
plane is compressed alone. ``plane_sizes`` is the chunk index: where each plane of each block starts
follows from it, so a reader can decode any block without the others. Segments lie in Parquet since
Spark then commits them once (lost executors, retries) and on whatever store it is given.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from narrata.llm.common import bounded_broadcast, shared_folder

#: Ids of a block, and ids from which a segment is closed (documents stay whole).
BLOCK_IDS, SEGMENT_IDS = 1 << 16, 1 << 20
#: The id after each document.
END_ID = 2
#: Distinct words whose ids a worker keeps.
MEMO = 1_200_000
#: Rows of the table of parts that may be broadcast (16 bytes each).
BROADCAST_PARTS = 200_000

#: No pre-token of the byte-level scheme spans a place before a blank that something else than white space follows,
_SPLIT = re.compile(r"(?= [^\s\x1c-\x1f])")
#: nor one between a letter or digit and ASCII punctuation,
_INNER = re.compile(r"(?<=[0-9A-Za-zÀ-ÖØ-öø-ÿ])(?=[!-/:-@\[-`{-~])")
#: nor the places round a line feed that no other white space touches.
_OTHER_SPACES = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]


def default_tokenizer() -> str:
    """The path of the byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Texts to ids. A text is cut where the tokenizer's own pre-tokens end, and each distinct piece is encoded once."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel units
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Strings of added tokens have ids of their own: texts that hold one are encoded whole.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.feed = self._single(["\n"])["\n"]
        self.words: dict[str, bytes] = {}  # of words after a blank, which isn't in the key, or with their line feed
        self.parts: dict[str, bytes] = {}  # of pieces as they are

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, with the end id."""
        words, others, places, whole = [], [], [], {}
        for n, t in enumerate(texts):
            if any(token in t for token in self.added):
                whole[n] = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
            else:
                first, *rest = t.replace("\n", " \n").split(" ") if _plain(t) else (None,)
                others += _SPLIT.split(t) if first is None else [first]
                words += rest
            places.append((len(others), len(words)))
        words = _looked_up(self.words, words, self._word_ids)
        others = _looked_up(self.parts, others, self._single)
        end, out, a, b = np.array([END_ID], "<u4").tobytes(), [], 0, 0
        for n, (c, d) in enumerate(places):
            out.append(np.frombuffer(b"".join((whole.get(n, b""), *others[a:c], *words[b:d], end)), "<u4"))
            a, b = c, d
        return out

    def _word_ids(self, words: list[str]) -> dict[str, bytes]:
        """The ids of words, which are cut before their punctuation, so that a word with many endings is encoded once."""
        cut = [_INNER.split(w[1:] if w[:1] == "\n" else " " + w) for w in words]
        flat = [p for parts in cut for p in parts]
        ids = _looked_up(self.parts, flat, self._joint)
        out, at = {}, 0
        for w, parts in zip(words, cut):
            end = at + len(parts)
            out[w] = b"".join(([self.feed] if w[:1] == "\n" else []) + ids[at:end])
            at = end
        return out

    def _single(self, pieces: list[str]) -> dict[str, bytes]:
        return {p: np.array(x.ids, "<u4").tobytes() for p, x in zip(pieces, self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False))}

    def _joint(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of pieces without white space but a blank at the beginning, many in one text between line feeds."""
        out = self._single([p for p in pieces if not p.strip(" ")])
        pieces = [p for p in pieces if p.strip(" ")]
        feed = int(np.frombuffer(self.feed, "<u4")[0])
        groups = [pieces[at : at + 500] for at in range(0, len(pieces), 500)]
        texts = ["\n".join(["", *g, ""]) for g in groups]
        for group, x in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(x.ids, "<u4")
            ends = (np.flatnonzero(ids == feed) * 4).tolist()
            if len(self.feed) != 4 or len(ends) != len(group) + 1:  # a vocabulary without an id for a line feed alone
                out |= self._single(group)
                continue
            data = ids.tobytes()
            out.update(zip(group, [data[a + 4 : b] for a, b in zip(ends, ends[1:])]))
        return out


def _looked_up(known: dict[str, bytes], pieces: list[str], learn: Callable[[list[str]], dict[str, bytes]]) -> list[bytes]:
    """The ids of each piece; those that aren't known are learnt and kept."""
    wanted = set(pieces)
    new = wanted.difference(known)
    if new:
        fresh = learn(list(new))
        if len(known) + len(new) > MEMO:
            kept = {p: known[p] for p in wanted - new}
            known.clear()
            known.update(kept)
        known.update(fresh)
    return list(map(known.__getitem__, pieces))


def _plain(text: str) -> bool:
    """Whether the white space of a text is single blanks and line feeds, no two of them side by side."""
    return not ("  " in text or "\n\n" in text or " \n" in text or "\n " in text or any(c in text for c in _OTHER_SPACES))


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def pack_planes(ids: np.ndarray) -> tuple[bytes, list[int]]:
    """Compressed planes of the blocks of 32-bit ids one after another, and their sizes."""
    press = zstandard.ZstdCompressor(level=3)
    planes = []
    for at in range(0, len(ids), BLOCK_IDS):
        block = np.ascontiguousarray(ids[at : at + BLOCK_IDS], "<u4").view(np.uint8).reshape(-1, 4)
        planes += [press.compress(np.ascontiguousarray(block[:, k]).tobytes()) for k in range(4)]
    return b"".join(planes), [len(p) for p in planes]


def unpack_planes(data: bytes, sizes: list[int], first_block: int = 0, end_block: int | None = None) -> np.ndarray:
    """The ids of some blocks (all by default), found by the chunk index."""
    expand = zstandard.ZstdDecompressor()
    ends = np.cumsum([0, *sizes])
    blocks = []
    for b in range(first_block, len(sizes) // 4 if end_block is None else end_block):
        planes = [np.frombuffer(expand.decompress(data[ends[4 * b + k] : ends[4 * b + k + 1]]), np.uint8) for k in range(4)]
        blocks.append(np.stack(planes, axis=1).reshape(-1).view("<u4"))
    return np.concatenate(blocks) if blocks else np.empty(0, "<u4")


def _segments(batches: Iterator[pa.RecordBatch], path: str, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("part", pa.int32()), ("segment", pa.int32()), ("start_in_part", pa.int64()), ("n_ids", pa.int64()),
        ("doc_ids", pa.list_(id_type)), ("doc_sizes", pa.list_(pa.int64())), ("plane_sizes", pa.list_(pa.int32())), ("planes", pa.binary()),
    ])
    part, segment, start = TaskContext.get().partitionId(), 0, 0
    doc_ids: list = []
    encoded: list[np.ndarray] = []
    held = 0

    def closed() -> pa.RecordBatch:
        planes, sizes = pack_planes(np.concatenate(encoded))
        row = {
            "part": part, "segment": segment, "start_in_part": start, "n_ids": held, "doc_ids": doc_ids,
            "doc_sizes": [len(x) for x in encoded], "plane_sizes": sizes, "planes": planes,
        }
        return pa.RecordBatch.from_pylist([row], schema=schema)

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            some = batch.slice(at, 256)
            for doc_id, ids in zip(some.column(0).to_pylist(), _encoder(path).encode([t or "" for t in some.column(1).to_pylist()])):
                doc_ids.append(doc_id)
                encoded.append(ids)
                held += len(ids)
                if held >= SEGMENT_IDS:
                    yield closed()
                    segment, start, held, doc_ids, encoded = segment + 1, start + held, 0, [], []
    if encoded:
        yield closed()


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text and write the ids in ascending id order as segments under ``folder``.

    Documents are dealt out by ranges of ids, so parts follow one another in that order; a task holds
    one segment and one batch. Null texts are empty and still get the end id; null ids come first; rows
    with equal ids are ordered by a hash of the text, so that a hot id can be dealt out too; extra columns
    are ignored; an empty table gives no segments.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    path = tokenizer or default_tokenizer()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType
    arrow = to_arrow_type(kind)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _segments(batches, path, arrow)

    by_hash = F.xxhash64("text")
    ordered = rows.repartitionByRange("doc_id", by_hash).sortWithinPartitions("doc_id", by_hash)
    ordered.mapInArrow(
        encode,
        f"part int, segment int, start_in_part long, n_ids long, doc_ids array<{kind.simpleString()}>, doc_sizes array<long>, plane_sizes array<int>, planes binary",
    ).write.parquet(folder)


def _documents(batches: Iterator[pa.RecordBatch], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", id_type), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    for batch in batches:
        for k in range(batch.num_rows):
            row = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
            data = memoryview(unpack_planes(row["planes"], row["plane_sizes"]).tobytes())
            ends = np.cumsum([0, *row["doc_sizes"]])
            yield pa.RecordBatch.from_arrays([
                pa.array(row["doc_ids"], id_type), pa.array(ends[:-1] + row["start"], pa.int64()), pa.array(row["doc_sizes"], pa.int64()),
                pa.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(ends, ends[1:])], pa.int64()),
            ], schema=schema)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of the files: where its ids start among all ids, how many they are, and their crc32.

    Starts need the sizes of the parts before: one number a part, summed over the table of parts.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    segments = spark.read.parquet(folder)
    kind = segments.schema["doc_ids"].dataType.elementType
    arrow = to_arrow_type(kind)
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    bases = parts.select(F.col("part").alias("of_part"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    placed = segments.join(bounded_broadcast(bases, BROADCAST_PARTS), F.col("part") == F.col("of_part"))
    rows = placed.select("doc_ids", "doc_sizes", "plane_sizes", "planes", (F.col("base") + F.col("start_in_part")).alias("start"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _documents(batches, arrow)

    return rows.mapInArrow(decode, f"doc_id {kind.simpleString()}, start long, n_tokens long, ids_crc32 long")


def token_file_digest(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """Write the token files of ``docs`` (in the shared folder by default) and give what a reader finds in them."""
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, folder, tokenizer)
    return read_token_files(spark, folder)
