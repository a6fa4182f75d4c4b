"""Packing: documents into training sequences of several context sizes.

Every document is encoded once. Its whole long windows are sequences of their own; what is left (the
rest) is a piece of a length below the window. A plan is made of nothing but how many pieces have each
length, so its size doesn't depend on the input:

1. rests stay whole: those of a long tier take what shorter tiers have to fill their windows, and pairs
   that fill a shorter window exactly become one;
2. rests that leave a gap are cut into the context sizes in them, each a full window, and a short end;
3. short ends that leave a gap are cut at powers of two, which fill windows exactly but for the last.

Each piece then finds its place by its length and its number among the pieces of that length, which is
counted by the tasks that wrote them; ids aren't shuffled unless sequences with their ids are asked for.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from narrata.llm.common import column, shared_folder
from narrata.llm.tokenfile import _encoder, default_tokenizer

#: Context sizes; all are powers of two, and the first is the one that sequences are padded to.
TIERS = (2048, 1024, 512, 256)
WINDOW, SHORT = TIERS[0], TIERS[-1]
#: The id after each document.
END_ID = 1
#: Tokens of padding that a window may keep before its pieces are cut further.
SLACK = 20
#: Tokens of a step group: windows of one size that are trained on together.
STEP_TOKENS = 64 * WINDOW
#: What a rest can be cut into: context sizes, a short end, and the powers of two in that.
_SIZES = TIERS[1:]
_ENDS = tuple(SHORT >> (k + 1) for k in range(SHORT.bit_length() - 1))
_CRCS = len(_SIZES) + 1 + len(_ENDS)

_PIECES = "length int, start long, ids_crc32 long, doc_tokens long, part int, at long, crcs binary"


def _cuts(rest: int) -> list[tuple[int, int] | None]:
    """Where the parts of a rest lie in it, in the order of the crcs: context sizes, the short end, powers of two in that; None if it has none."""
    high = [((rest // (2 * t)) * 2 * t, t) if rest & t else None for t in (*_SIZES, *_ENDS)]
    short = rest % SHORT
    return [*high[: len(_SIZES)], (rest - short, short) if short else None, *high[len(_SIZES) :]]


def _encoded(batches: Iterator[pa.RecordBatch], path: str, id_type: pa.DataType, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    """Whole windows and the rest of each document, numbered by length among those of this task."""
    numbers: Counter[int] = Counter()
    part, end = TaskContext.get().partitionId(), np.array([END_ID], "<u4").tobytes()
    for batch in batches:
        for first in range(0, batch.num_rows, 256):
            some, rows = batch.slice(first, 256), []
            encoded = _encoder(path).encode([t or "" for t in some.column(1).to_pylist()])
            of = []
            for k, ids in enumerate(encoded):
                data, n = ids[:-1].tobytes() + end, len(ids)
                for start in range(0, n, WINDOW):
                    piece = data[4 * start : 4 * (start + WINDOW)]
                    length = len(piece) // 4
                    crcs = [zlib.crc32(piece[4 * c[0] : 4 * (c[0] + c[1])]) if c else 0 for c in _cuts(length)] if length < WINDOW else [0] * _CRCS
                    rows.append((length, start, zlib.crc32(piece), n, part, numbers[length], np.array(crcs, "<u4").tobytes(), piece if keep_ids else None))
                    numbers[length] += 1
                    of.append(k)
            columns = [some.column(0).take(pa.array(of, pa.int64())).cast(id_type), *map(list, zip(*rows))]
            kinds = [id_type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) if isinstance(c, list) else c for c, t in zip(columns, kinds)], names=["doc_id", "length", "start", "ids_crc32", "doc_tokens", "part", "at", "crcs", "ids"])


@dataclass
class Level:
    """Slots of pieces of one level: pieces ``first`` to ``first + count - 1`` of a length lie ``each`` to a sequence, or are cut.

    A cut slot has in ``below`` the number, among the pieces of the next level, of the part that its
    first piece gives of each kind.
    """

    rows: list[tuple] = field(default_factory=list)

    def add(self, length: int, first: int, count: int, each: int = 1, sequence: int = -1, offset: int = 0, used: int = 0, turn: int = 0, below: tuple[int, ...] = ()) -> None:
        self.rows.append((length, first, count, each, sequence, offset, used, turn, *(below or (-1,) * _CRCS)))

    def table(self) -> np.ndarray:
        return np.array(sorted(self.rows), np.int64).reshape(-1, 8 + _CRCS)


class Plan:
    """Where pieces lie by their length and number, found from how many there are of each length."""

    def __init__(self, counts: dict[int, int], slack: int = SLACK) -> None:
        self.sequences = 0
        #: Sequences of each size, so that each has a turn among those of its size.
        self.of_size: Counter[int] = Counter()
        whole, cut, ends = Level(), Level(), Level()
        self._full(whole, WINDOW, counts.get(WINDOW, 0))
        rests = Counter({n: c for n, c in counts.items() if n < WINDOW and c > 0})
        below, taken = Counter(), Counter()
        self._packed(whole, rests, taken, slack, lambda n: [k for k in range(len(_SIZES) + 1) if _cuts(n)[k]], below, lambda n, k: _cuts(n)[k][1])
        for size in _SIZES:
            self._full(cut, size, below.pop(size, 0))
        last, taken = Counter(), Counter()
        self._packed(cut, below, taken, slack, lambda n: [k for k in range(len(_SIZES) + 1, _CRCS) if _cuts(n)[k]], last, lambda n, k: _cuts(n)[k][1])
        self._packed(ends, last, Counter(), WINDOW, None, Counter(), None)
        self.levels = [whole.table(), cut.table(), ends.table()]

    def _sequences(self, count: int, used: int) -> tuple[int, int]:
        """Numbers for ``count`` more sequences of ``used`` tokens: the first's, and its turn among those of its size."""
        size = window_of(used)
        first, turn = self.sequences, self.of_size[size]
        self.sequences += count
        self.of_size[size] += count
        return first, turn

    def _full(self, level: Level, length: int, count: int) -> None:
        """Pieces that are whole windows of a context size."""
        if count:
            first, turn = self._sequences(count, length)
            level.add(length, 0, count, 1, first, 0, length, turn)

    def _packed(self, level: Level, left: Counter, taken: Counter, slack: int, kinds, below: Counter, part_length) -> None:
        """Pack all of ``left`` (pieces by length); what would leave more than ``slack`` is cut instead, if it can be."""

        def laid(pattern: list[tuple[int, int]], count: int) -> None:
            used = sum(n * each for n, each in pattern)
            first, turn = self._sequences(count, used)
            offset = 0
            for n, each in pattern:
                level.add(n, taken[n], count * each, each, first, offset, used, turn)
                offset += n * each
                taken[n] += count * each
                left[n] -= count * each

        def cut_up(n: int, count: int) -> None:
            numbers = [-1] * _CRCS
            for k in kinds(n):
                numbers[k] = below[part_length(n, k)]
                below[part_length(n, k)] += count
            level.add(n, taken[n], count, below=tuple(numbers))
            taken[n] += count
            left[n] -= count

        for size in TIERS:  # exact windows of each tier: one piece, or one of this tier with one of a shorter
            for n in range(size if size < WINDOW else size - 1, size // 2, -1):
                if left[n] and n == size:
                    laid([(n, 1)], left[n])
                elif (count := min(left[n], left[size - n])) > 0:
                    laid([(n, 1), (size - n, 1)], count)
            if size == SHORT and left[size // 2] > 1:
                laid([(size // 2, 2)], left[size // 2] // 2)
        while lengths := sorted((n for n, c in left.items() if c > 0), reverse=True):
            for at, n in enumerate(lengths):  # long windows: the longest first, gaps filled with the longest that fit
                while left[n] > 0:
                    pattern, gap = [], WINDOW
                    for filler in lengths[at:]:
                        if each := min(gap // filler, left[filler]):
                            pattern.append((filler, each))
                            gap -= filler * each
                            if not gap:
                                break
                    count = min(left[m] // each for m, each in pattern)
                    if gap <= slack or kinds is None:
                        laid(pattern, count)
                    else:
                        cut_up(n, left[n])


def window_of(used: int) -> int:
    """The size of a sequence with its padding: none at a power of two."""
    return used if used & (used - 1) == 0 else WINDOW


def _placed(batches: Iterator[pa.RecordBatch], plan: list[np.ndarray], steps: dict[int, tuple[int, int]], id_type: pa.DataType, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    """The pieces of each row with their places."""
    shift = 1 << 44  # numbers of pieces of a length stay below it
    keys = [t[:, 0] * shift + t[:, 1] for t in plan]
    for batch in batches:
        if not batch.num_rows:
            continue
        c = dict(zip(batch.schema.names, batch.columns))
        crcs = np.frombuffer(b"".join(c["crcs"].to_pylist()), "<u4").reshape(-1, _CRCS).astype(np.int64)
        row, length, number = np.arange(batch.num_rows), c["length"].to_numpy().astype(np.int64), c["number"].to_numpy()
        whole = length
        start, crc = np.zeros(len(row), np.int64), c["ids_crc32"].to_numpy()
        found = []
        for level, table in enumerate(plan):
            slot = table[np.searchsorted(keys[level], length * shift + number, "right") - 1] if len(row) else table[:0]
            lies, d = slot[:, 4] >= 0, number - slot[:, 1]
            found.append(tuple(x[lies] for x in (row, start, length, crc, slot[:, 4] + d // slot[:, 3], slot[:, 5] + d % slot[:, 3] * length, slot[:, 6], slot[:, 7] + d // slot[:, 3])))
            parts = []
            for k in range(_CRCS):
                cut = ~lies & (slot[:, 8 + k] >= 0)
                if cut.any():
                    places = [_cuts(n)[k] for n in whole[row[cut]].tolist()]
                    parts.append((row[cut], np.array([p[0] for p in places]), np.array([p[1] for p in places]), slot[cut, 8 + k] + d[cut], crcs[row[cut], k]))
            row, start, length, number, crc = [np.concatenate([p[j] for p in parts]) if parts else np.empty(0, np.int64) for j in range(5)]
        row, start, length, crc, sequence, offset, used, turn = [np.concatenate(x) for x in zip(*found)]
        at = pa.array(row)
        window = np.where(used & (used - 1) == 0, used, WINDOW)
        step = np.array([steps[w][0] + t % steps[w][1] for w, t in zip(window.tolist(), turn.tolist())], np.int64)
        columns = [
            c["doc_id"].take(at).cast(id_type), pa.array(c["start"].to_numpy()[row] + start), pa.array(length), pa.array(crc), c["doc_tokens"].take(at),
            pa.array(sequence), pa.array(offset), pa.array(used), pa.array(window), pa.array(step),
        ]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "window", "step_group"]
        if keep_ids:
            data = c["ids"].to_pylist()
            columns.append(pa.array([np.frombuffer(data[r], "<i4")[s : s + n] for r, s, n in zip(row.tolist(), start.tolist(), length.tolist())], pa.list_(pa.int32())))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(columns, names=names)


def packed_pieces(docs: DataFrame, keep_ids: bool = False, tokenizer: str | None = None, slack: int = SLACK, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Every piece of every document with its place: the sequence, the offset in it, the sequence's window and step group.

    ``start`` is where the piece lies among its document's ids, ``doc_tokens`` how many those are (the
    end id is one), ``sequence_tokens`` the sequence's length without padding, ``window`` that with it.
    A step group has windows of one size, ``STEP_TOKENS`` of them at most; the groups of a size differ by
    one window at most, and neighbouring sequences lie in different ones. With ``keep_ids`` pieces come
    with their ``ids``.

    Null texts are empty and have the end id alone; rows of equal or null ids are documents of their own;
    other columns are ignored; an empty table gives no pieces.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark, path = docs.sparkSession, tokenizer or default_tokenizer()
    folder = folder or f"{shared_folder(spark)}/packing-{uuid.uuid4().hex}"
    rows = docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType
    arrow, name = to_arrow_type(kind), kind.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _encoded(batches, path, arrow, keep_ids)

    rows.mapInArrow(encode, f"doc_id {name}, {_PIECES}, ids binary").write.parquet(folder)
    pieces = spark.read.schema(f"doc_id {name}, {_PIECES}, ids binary").parquet(folder)
    by_part = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row a length: 2,048 at most
    plan = Plan(counts, slack)
    steps, first = {}, 0
    for size, n in sorted(plan.of_size.items(), reverse=True):
        groups = -(-n * size // STEP_TOKENS)
        steps[size] = (first, groups)
        first += groups
    tables = plan.levels

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _placed(batches, tables, steps, arrow, keep_ids)

    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    bases = by_part.select(F.col("part").alias("of_part"), F.col("length").alias("of_length"), before.alias("base"))
    numbered = pieces.join(bases, (F.col("part") == F.col("of_part")) & (F.col("length") == F.col("of_length")))
    wanted = ["doc_id", "length", "start", "ids_crc32", "doc_tokens", "crcs", *["ids"] * keep_ids]
    numbered = numbered.select(*wanted, (F.col("base") + F.col("at")).alias("number"))
    out = f"doc_id {name}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, window long, step_group long"
    return numbered.mapInArrow(place, out + ", ids array<int>" * keep_ids)


def sequences(pieces: DataFrame) -> DataFrame:
    """The sequences of pieces with their ids: ``(sequence_id, window, step_group, ids, doc_ids, starts)``, without padding.

    A sequence has 2,048 pieces of together 2,048 ids at most, so none is large.
    """
    placed = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "ids")))
    grouped = pieces.groupBy("sequence_id", "window", "step_group").agg(placed.alias("placed"))
    return grouped.select("sequence_id", "window", "step_group", F.flatten("placed.ids").alias("ids"), F.col("placed.doc_id").alias("doc_ids"), F.col("placed.start").alias("starts"))
