"""Small functions of one text as columns: texts go through Python a few at a time, whatever a batch of rows holds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, _parse_datatype_string

#: Bytes of texts, or rows, whose results are Python objects at a time; a single larger text is taken alone.
PART_BYTES, PART_ROWS = 1 << 18, 512


def parts(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Beginnings and lengths of runs of rows that hold PART_BYTES and PART_ROWS at most."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    begin = held = 0
    for n, size in enumerate(sizes):
        if n > begin and (held + size > PART_BYTES or n - begin == PART_ROWS):
            yield begin, n - begin
            begin, held = n, 0
        held += size
    if begin < len(sizes):
        yield begin, len(sizes) - begin


def scanned(scan: Callable[..., object], kind: str | DataType, text: Column | str, *more: Column | str) -> Column:
    """``scan`` of each text (and of ``more`` columns of its row) as a column of type ``kind``."""
    whole = to_arrow_type(_parse_datatype_string(kind) if isinstance(kind, str) else kind)

    def over(*columns: pa.Array) -> pa.Array:
        # What is done stays as compact Arrow data; several of these columns share one worker, which iterators would not.
        done = [pa.array([scan(*row) for row in zip(*(c.slice(begin, n).to_pylist() for c in columns))], whole) for begin, n in parts(columns[0])]
        return pa.concat_arrays(done) if done else pa.array([], whole)

    return F.arrow_udf(over, kind)(text, *more)
