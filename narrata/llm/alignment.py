"""Cross-tokenizer alignment: which tokens of two tokenizers end together, and which links are a token's most common.

A text is cut where both tokenizers surely cut (a blank or line feed after something else than white
space, a mark after a letter), so that each distinct piece is encoded and aligned once by a worker. Links are kept as postings:
for each id of the second tokenizer the ids it is linked with and the documents that hold the link, so
many times. Postings are shuffled by that id, sorted behind the corpus-wide counts of its links; a task
reads this stream once, sees all counts of an id before its postings, and sums what each posting adds to
its document. Postings of an id that fills more than one share are dealt over several, and its counts,
which the vocabularies bound, go along with each.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrata.llm.common import column, shared_folder

#: Links and documents that a worker puts into postings at a time, and entries of one posting row.
BLOCK_LINKS, BLOCK_DOCS, ROW_ENTRIES = 1 << 20, 60_000, 8_192
#: Words whose alignment a worker keeps, and letters of the longest; pieces of words aligned at a time.
MEMO, MEMO_LETTERS, AT_ONCE = 400_000, 60, 1_000
#: Entries of postings that one share of an id has, about.
SHARE_ENTRIES = 4_000_000
#: Sums that a task holds before it adds up equal keys.
HELD = 1 << 21

#: Both tokenizers cut a text here, if no piece of the second goes on over a blank or line feed;
_CUT = re.compile(r"(?<=[^\s\x1c-\x1f])(?=[ \n])")
#: and between a letter and a mark, if none has both side by side.
_LETTER, _MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_OTHER_SPACES = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
_BLANK = "▁"
#: What stands before a piece that is aligned, so that each has a letter before it.
_BEFORE = " a"

#: Groups as text, links as 64-bit numbers (the second's id above the first's), tokens by both; empty if there is no alignment.
Entry = tuple[str, bytes, int, int] | tuple[()]


def default_tokenizers() -> tuple[str, str]:
    """Paths of the byte-level vocabulary (A) and of the model of pieces (B)."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones are themselves, the others follow from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Aligner:
    """Texts to links, by chunks that are aligned once."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel units
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_path)
        byte = byte_of_letter()
        vocabulary = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.a_bytes = [bytes(byte[c] for c in t) if (t := vocabulary.get(i, "")) and all(c in byte for c in t) else t.encode() for i in range(max(vocabulary) + 1)]
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(t[3:5], 16)]) if self.b.is_byte(i) else t.replace(_BLANK, " ").encode() for i, t in enumerate(names)]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.a_text, self.b_text = (list(map(str, range(len(t)))) for t in (self.a_bytes, self.b_bytes))
        self.apart = not any(_BLANK in t.lstrip(_BLANK) or "\n" in t for t in names)
        marks = [m for m in _MARKS if not any(re.search(f"[{_LETTER}]{re.escape(m)}", t) for t in names)]
        self.inner = re.compile(f"(?<=[{_LETTER}])(?=[{re.escape(''.join(marks))}])") if marks else re.compile(r"(?!)")
        self.words: dict[str, Entry] = {}
        self.pieces: dict[str, Entry] = {}

    def links(self, text: str) -> tuple[list[int], list[int], np.ndarray, np.ndarray, np.ndarray] | None:
        """Of a text that begins with the blank: ids by both, the byte offsets where both end, and the tokens of each that end there; None if the ids' bytes aren't the text's."""
        a, b, data = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.b.encode(text[1:]), text.encode()
        if not b"".join(map(self.a_bytes.__getitem__, a)) == data == b"".join(map(self.b_bytes.__getitem__, b)):
            return None
        return a, b, *np.intersect1d(np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b]), assume_unique=True, return_indices=True)

    def _entries(self, text: str, ends: np.ndarray | list[int]) -> list[Entry] | None:
        """Entries of the parts of a text that end at these bytes, where both tokenizers cut."""
        if (found := self.links(text)) is None:
            return None
        a, b, common, i, j = found
        numbers = ((np.array(b, np.int64)[j] << 32) | np.array(a, np.int64)[i]).tobytes()
        x, y = [self.a_text[t] for t in a], [self.b_text[t] for t in b]
        groups, p, q = [], 0, 0
        for m, n in zip((i + 1).tolist(), (j + 1).tolist()):
            groups.append(f"{x[p]}|{y[q]}" if m - p == 1 == n - q else f"{','.join(x[p:m])}|{','.join(y[q:n])}")
            p, q = m, n
        tokens_a, tokens_b = [0, *(i + 1).tolist()], [0, *(j + 1).tolist()]
        out, last = [], 0
        for at in (np.searchsorted(common, ends) + 1).tolist():
            out.append((";".join(groups[last:at]), numbers[8 * last : 8 * at], tokens_a[at] - tokens_a[last], tokens_b[at] - tokens_b[last]))
            last = at
        return out

    def whole(self, text: str) -> Entry:
        """The entry of a text with its blank, without looking at its words."""
        found = self._entries(text, [len(text.encode())])
        return found[0] if found else ()

    def _learnt(self, pieces: list[str]) -> list[Entry]:
        """Entries of pieces, which stand behind one another in one text; one that begins with a mark has a word before it."""
        parts = [part for p in pieces for part in ((p,) if p[0] in " \n" else (_BEFORE, p))]
        text, ends = [_BEFORE, *parts], np.cumsum([len(_BEFORE), *(len(p.encode()) for p in parts)])
        found = self._entries("".join(text), ends)
        if found is None:
            return [()] if len(pieces) == 1 else [self._learnt([p])[0] for p in pieces]
        own = iter(found[1:])
        return [next(own) if p[0] in " \n" else (next(own), next(own))[1] for p in pieces]

    def _of_pieces(self, pieces: set[str]) -> None:
        """Learn pieces that aren't known."""
        new = [p for p in pieces if p not in self.pieces]
        if len(self.pieces) + len(new) > MEMO:
            self.pieces.clear()
            new = list(pieces)
        spaced = [p for p in new if p[-1].isspace()]
        others = [p for p in new if not p[-1].isspace()]
        for group in [others[k : k + AT_ONCE] for k in range(0, len(others), AT_ONCE)] + [[p] for p in spaced]:
            self.pieces.update(zip(group, self._learnt(group)))

    def _of_words(self, words: set[str]) -> dict[str, Entry]:
        """Entries of words, each of which has its blank or line feed before it, put together from those of its pieces."""
        cut = {w: self.inner.split(w) for w in words}
        self._of_pieces({p for pieces in cut.values() for p in pieces})
        out: dict[str, Entry] = {}
        for word, pieces in cut.items():
            found = [self.pieces[p] for p in pieces]
            if len(found) == 1:
                out[word] = found[0]
            elif () in found:
                out[word] = ()
            else:
                groups, numbers, a, b = zip(*found)
                out[word] = (";".join(groups), b"".join(numbers), sum(a), sum(b))
        return out

    def align(self, texts: list[str | None]) -> list[Entry]:
        """For each text its groups, links and numbers of tokens; empty for texts that have no tokens."""
        cut = [self._cut(t) if t else [] for t in texts]
        found = [list(map(self.words.get, words)) for words in cut]
        new = {w for words, entries in zip(cut, found) if None in entries for w, e in zip(words, entries) if e is None}
        fresh = self._of_words(new)
        out = []
        for text, words, entries in zip(texts, cut, found):
            if None in entries:
                entries = [fresh[w] if e is None else e for w, e in zip(words, entries)]
            if not text:
                out.append(())
            elif not words or () in entries:
                out.append(self.whole(" " + text))
            else:
                groups, numbers, a, b = zip(*entries)
                out.append((";".join(groups), b"".join(numbers), sum(a), sum(b)))
        if len(self.words) + len(fresh) > MEMO:
            self.words.clear()
        self.words.update((w, e) for w, e in fresh.items() if len(w) <= MEMO_LETTERS)
        return out

    def _cut(self, text: str) -> list[str]:
        """The words of a text with the blank or line feed before each; none if the pieces of the second tokenizer go on over them."""
        if not self.apart:
            return []
        if text[0] == "\n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or any(c in text for c in _OTHER_SPACES):
            return _CUT.split(" " + text)
        # No two white spaces side by side: a blank before each word says the same, and is quicker to find.
        return [w if w[0] == "\n" else " " + w for w in text.replace("\n", " \n").split(" ")] if text[0] != " " else _CUT.split(" " + text)


@lru_cache(maxsize=1)
def _aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def _schema(id_type: pa.DataType) -> pa.Schema:
    return pa.schema([
        ("kind", pa.int32()), ("block", pa.int64()), ("place", pa.int32()), ("doc_id", id_type), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()),
        ("b", pa.int32()), ("a", pa.int32()), ("n", pa.int64()), ("pair_a", pa.binary()), ("pair_size", pa.binary()), ("docs", pa.binary()), ("times", pa.binary()),
    ])


_COLUMNS = "n_a long, n_b long, n_links long, groups_sha256 string, b int, a int, n long, pair_a binary, pair_size binary, docs binary, times binary"
#: Kinds of rows: what a block's documents get, documents, counts of links, postings; streams are in this order.
SUM, DOCUMENT, COUNT, POSTING = 0, 1, 2, 3


def _rows(schema: pa.Schema, size: int, **columns: pa.Array | list | np.ndarray) -> pa.RecordBatch:
    """A batch of rows of one kind; columns that aren't named are null."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)


def _postings(schema: pa.Schema, block: int, links: np.ndarray, doc: np.ndarray) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
    """Posting rows of a block, with its distinct links and how often they stand."""
    # One number for link and document, so that one sort finds both: ids below 2^23 and 2^24, documents below 2^16.
    entry, times = np.unique((((links >> 32) << 24 | links & 0xFFFFFFFF) << 16) | doc, return_counts=True)
    link, in_doc = entry >> 16, entry & 0xFFFF
    new = np.flatnonzero(np.diff(link, prepend=-1))
    total = np.add.reduceat(times, new) if len(new) else times
    pairs = (link[new] >> 24 << 32) | (link[new] & 0xFFFFFF)
    pieces = -(-times // 255)  # an entry has one byte for how often; what stands oftener has several entries
    last = np.cumsum(pieces) - 1
    each = np.full(pieces.sum(), 255, np.int64)
    each[last] = times - 255 * (pieces - 1)
    link, in_doc = np.repeat(link, pieces), np.repeat(in_doc, pieces)
    # A row holds entries of one id of B, ROW_ENTRIES of them at most.
    b = link >> 24
    new_b = np.flatnonzero(np.diff(b, prepend=-1))
    of_b = np.arange(len(b)) - np.repeat(new_b, np.diff(np.append(new_b, len(b))))
    begins = np.flatnonzero((of_b % ROW_ENTRIES == 0))
    new_pair = np.zeros(len(b), bool)
    new_pair[begins] = True
    new_pair |= np.diff(link, prepend=-1) != 0
    heads = np.flatnonzero(new_pair)
    a = (link[heads] & 0xFFFFFF).astype("<i4").tobytes()
    sizes = np.diff(np.append(heads, len(b))).astype("<u2").tobytes()
    docs, how_often = in_doc.astype("<u2").tobytes(), each.astype("u1").tobytes()
    cuts = np.append(begins, len(b)).tolist()
    head_cuts = np.searchsorted(heads, cuts).tolist()
    spans, head_spans = list(zip(cuts, cuts[1:])), list(zip(head_cuts, head_cuts[1:]))
    rows = _rows(
        schema, len(spans), kind=[POSTING] * len(spans), block=[block] * len(spans), b=b[begins].astype(np.int32), n=[y - x for x, y in spans],
        pair_a=[a[4 * x : 4 * y] for x, y in head_spans], pair_size=[sizes[2 * x : 2 * y] for x, y in head_spans],
        docs=[docs[2 * x : 2 * y] for x, y in spans], times=[how_often[x:y] for x, y in spans],
    )
    return rows, pairs, total


def _summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Values by key, with those of equal keys added up."""
    keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    out = [keys]
    for k in range(1, len(parts[0])):
        sums = np.zeros(len(keys), np.int64)
        np.add.at(sums, at, np.concatenate([p[k] for p in parts]))
        out.append(sums)
    return tuple(out)


def _aligned(batches: Iterator[pa.RecordBatch], paths: tuple[str, str], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """A task's documents, postings and sums of links."""
    schema, block = _schema(id_type), TaskContext.get().partitionId() << 20
    held, counts, n_held, n_counts = [], [], 0, 0

    def posted(all_counts: bool) -> Iterator[pa.RecordBatch]:
        nonlocal counts, n_counts
        if n_held:
            links = np.frombuffer(b"".join(held), np.int64)
            rows, pairs, total = _postings(schema, block, links, np.repeat(np.arange(len(held)), [len(h) // 8 for h in held]))
            counts.append((pairs, total))
            n_counts += len(pairs)
            yield rows
        if counts and (all_counts or n_counts > HELD):
            pairs, total = _summed(counts)
            for at in range(0, len(pairs), 50_000):
                p = pairs[at : at + 50_000]
                yield _rows(schema, len(p), kind=np.full(len(p), COUNT, np.int32), b=(p >> 32).astype(np.int32), a=(p & 0xFFFFFFFF).astype(np.int32), n=total[at : at + 50_000])
            counts, n_counts = [], 0

    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            some = batch.slice(at, 128)
            found = _aligner(*paths).align(some.column(1).to_pylist())
            yield _rows(
                schema, len(found), kind=[DOCUMENT] * len(found), block=[block] * len(found), place=np.arange(len(held), len(held) + len(found), dtype=np.int32), doc_id=some.column(0).cast(id_type), n_a=[f[2] if f else 0 for f in found],
                n_b=[f[3] if f else 0 for f in found], n_links=[len(f[1]) // 8 if f else 0 for f in found],
                groups_sha256=[hashlib.sha256(f[0].encode()).hexdigest() if f else "" for f in found],
            )
            held += [f[1] if f else b"" for f in found]
            n_held += sum(len(f[1]) // 8 for f in found if f)
            if n_held >= BLOCK_LINKS or len(held) > BLOCK_DOCS - 128:
                yield from posted(False)
                block, held, n_held = block + 1, [], 0
    yield from posted(True)


def _bytes(column_: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of byte strings one behind another, and how many each row has."""
    ends = np.frombuffer(column_.buffers()[1], np.int32)[column_.offset : column_.offset + len(column_) + 1]
    width = np.dtype(kind).itemsize
    data = column_.buffers()[2]
    values = np.frombuffer(data, "u1")[ends[0] : ends[-1]].copy().view(kind) if data is not None else np.empty(0, kind)
    return values, np.diff(ends) // width


def _contributions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a sorted stream of counts and postings adds to the documents of each block: links that are their id's best, and counts of links."""
    pairs, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    held: list[tuple[np.ndarray, ...]] = []
    n_held = 0

    def given(keys: np.ndarray, best: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
        blocks, places = keys // BLOCK_DOCS, (keys % BLOCK_DOCS).astype("<u2")
        cuts = np.append(np.flatnonzero(np.diff(blocks, prepend=-1)), len(keys)).tolist()
        spans = list(zip(cuts, cuts[1:]))
        return pa.RecordBatch.from_arrays([pa.array(blocks[cuts[:-1]]), *(pa.array([x[p:q].tobytes() for p, q in spans], pa.binary()) for x in (places, best, total))], names=["block", "docs", "best", "total"])

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        b = batch.column("b").to_numpy()
        new = table.filter(pa.array(batch.column("kind").to_numpy() == COUNT))
        pairs = np.concatenate([pairs, (new["b"].to_numpy().astype(np.int64) << 32) | new["a"].to_numpy().astype(np.int64)])
        counts = np.concatenate([counts, new["n"].to_numpy()])
        pairs, first = np.unique(pairs, return_index=True)  # shares of one id bring the same counts
        counts = counts[first]
        rows = table.filter(pa.array(batch.column("kind").to_numpy() == POSTING)).combine_chunks()
        if rows.num_rows:
            of_b = np.flatnonzero(np.diff(pairs >> 32, prepend=-1))
            most = np.repeat(np.maximum.reduceat(counts, of_b), np.diff(np.append(of_b, len(pairs))))
            a, n_pairs = _bytes(rows["pair_a"].chunk(0), "<i4")
            sizes, _ = _bytes(rows["pair_size"].chunk(0), "<u2")
            docs, n_docs = _bytes(rows["docs"].chunk(0), "<u2")
            times = _bytes(rows["times"].chunk(0), "u1")[0].astype(np.int64)
            at = np.searchsorted(pairs, (np.repeat(rows["b"].to_numpy().astype(np.int64), n_pairs) << 32) | a)
            count, top = np.repeat(counts[at], sizes), np.repeat(counts[at] == most[at], sizes)
            held.append((np.repeat(rows["block"].to_numpy() * BLOCK_DOCS, n_docs) + docs, times * top, times * count))
            n_held += len(docs)
            if n_held > HELD:
                held = [_summed(held)]
                if len(held[0][0]) > HELD // 2:
                    yield given(*held[0])
                    held = []
                n_held = len(held[0][0]) if held else 0
        keep = pairs >> 32 == b[-1]  # only this id can have more postings
        pairs, counts = pairs[keep], counts[keep]
    if held:
        yield given(*_summed(held))


def _finished(batches: Iterator[pa.RecordBatch], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Documents with their sums, from a stream in which the sums of each block come before its documents."""
    block, best, total = -1, np.zeros(BLOCK_DOCS, np.int64), np.zeros(BLOCK_DOCS, np.int64)
    for batch in batches:
        blocks, kinds = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
        cuts = np.append(np.flatnonzero((np.diff(blocks, prepend=-2) != 0) | (np.diff(kinds, prepend=-2) != 0)), len(blocks)).tolist()
        for p, q in zip(cuts, cuts[1:]):
            some = batch.slice(p, q - p)
            if blocks[p] != block:
                block = blocks[p]
                best[:], total[:] = 0, 0
            if kinds[p] == SUM:
                for docs, x, y in zip(some.column("docs").to_pylist(), some.column("best").to_pylist(), some.column("total").to_pylist()):
                    at = np.frombuffer(docs, "<u2")
                    best[at] += np.frombuffer(x, np.int64)
                    total[at] += np.frombuffer(y, np.int64)
                continue
            at = some.column("place").to_numpy()
            columns = [some.column(c) for c in ("doc_id", "n_a", "n_b", "n_links", "n_links")]
            yield pa.RecordBatch.from_arrays([columns[0].cast(id_type), *columns[1:], pa.array(best[at]), pa.array(total[at]), some.column("groups_sha256")], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def alignment(docs: DataFrame, tokenizers: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, share_entries: int = SHARE_ENTRIES) -> DataFrame:
    """Per document ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``; no token is empty, so each group has one link.

    Null and empty texts, and texts of which a tokenizer doesn't keep the bytes, have zeros and an empty
    digest. Rows of equal or null ids are documents of their own, each counted; other columns are ignored;
    an empty table gives no rows. ``link_counts`` of the same ``folder`` gives the corpus-wide counts.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark, paths = docs.sparkSession, tokenizers or default_tokenizers()
    folder = folder or f"{shared_folder(spark)}/alignment-{uuid.uuid4().hex}"
    rows = docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType
    arrow = to_arrow_type(kind)
    schema = f"kind int, block long, place int, doc_id {kind.simpleString()}, {_COLUMNS}"

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _aligned(batches, paths, arrow)

    rows.mapInArrow(aligned, schema).write.parquet(folder)
    found = spark.read.schema(schema).parquet(folder)
    postings = found.where(F.col("kind") == POSTING)
    # A row an id of B at most, so the vocabulary bounds what is broadcast.
    entries = postings.groupBy(F.col("b").alias("of_b")).agg(F.ceil(F.sum("n") / share_entries).cast("int").alias("shares")).where("shares > 1")
    share = F.pmod(F.xxhash64("block", "docs"), F.coalesce(F.col("shares"), F.lit(1)))
    dealt = postings.join(F.broadcast(entries), F.col("b") == F.col("of_b"), "left").withColumn("share", share.cast("int"))
    counts = link_counts(spark.read.schema(schema).parquet(folder)).join(F.broadcast(entries), F.col("b") == F.col("of_b"), "left")
    shares = F.sequence(F.lit(0), F.coalesce(F.col("shares"), F.lit(1)) - 1)
    counts = counts.select(F.lit(COUNT).alias("kind"), "b", "a", "n", F.explode(shares).alias("share"))
    stream = counts.unionByName(dealt.select("kind", "b", "share", "block", "pair_a", "pair_size", "docs", "times"), allowMissingColumns=True)
    stream = stream.repartition("b", "share").sortWithinPartitions("b", "share", "kind")
    added = stream.mapInArrow(_contributions, "block long, docs binary, best binary, total binary").withColumn("kind", F.lit(SUM))
    facts = found.where(F.col("kind") == DOCUMENT).select("block", "kind", "place", "doc_id", "n_a", "n_b", "n_links", "groups_sha256")
    blocks = added.unionByName(facts, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "kind")

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _finished(batches, arrow)

    return blocks.mapInArrow(finished, f"doc_id {kind.simpleString()}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def link_counts(found: DataFrame) -> DataFrame:
    """How often each pair of ids is linked, ``(b, a, n)``, from the table that ``alignment`` writes into its folder."""
    return found.where(F.col("kind") == COUNT).groupBy("b", "a").agg(F.sum("n").alias("n"))
