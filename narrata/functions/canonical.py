"""Canonical JSON of columns: keys in order at every depth, no blanks, nulls kept, non-ASCII as it is.

The text is built from the column's type by built-in functions. Floating numbers alone go through
Python, all those of a row at once, since the JVM doesn't always print the fewest digits that give a
number back; a column without them needs no Python. A number that isn't finite makes the whole text
null, since it has no canonical form.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as t

from narrata.functions.scans import scanned

#: What control characters are escaped as (the others below U+0020 as \u00xx).
_SHORT = {8: r"\b", 9: r"\t", 10: r"\n", 12: r"\f", 13: r"\r"}
_ESCAPES = [_SHORT.get(c, f"\\u{c:04x}") for c in range(32)]


def quoted(text: Column) -> Column:
    """A JSON string."""
    plain = F.regexp_replace(text, r'(["\\])', r"\\$1")
    table = F.array(*map(F.lit, _ESCAPES))
    letters = F.transform(F.split(plain, ""), lambda c: F.when((c != "") & (F.ascii(c) < 32), F.get(table, F.ascii(c))).otherwise(c))
    escaped = F.when(plain.rlike(r"[\x00-\x1f]"), F.array_join(letters, "")).otherwise(plain)
    return F.concat(F.lit('"'), escaped, F.lit('"'))


#: Stands for a floating number in a text; a JSON text has no control characters of its own.
_HOLE = "\x01"


def _filled(text: str, numbers: Sequence[float]) -> str | None:
    """A text with the fewest digits of each number in its hole, as Python writes them; None if a number isn't finite."""
    if not all(map(math.isfinite, numbers)):
        return None
    parts = text.split(_HOLE)
    return parts[0] + "".join(repr(float(x)) + p for x, p in zip(numbers, parts[1:]))


def canonical_json(value: Column, kind: t.DataType) -> Column:
    """The canonical text of ``value``, which is of type ``kind``; null if it holds a number that isn't finite."""
    return scanned(_filled, "string", _text(value, kind), _numbers(value, kind)) if _floats(kind) else _text(value, kind)


def _floats(kind: t.DataType) -> bool:
    """Whether values of a type hold floating numbers."""
    if isinstance(kind, t.ArrayType):
        return _floats(kind.elementType)
    if isinstance(kind, t.MapType):
        return _floats(kind.valueType)
    return any(_floats(f.dataType) for f in kind.fields) if isinstance(kind, t.StructType) else isinstance(kind, (t.DoubleType, t.FloatType))


def _sorted_fields(kind: t.StructType) -> list[t.StructField]:
    return sorted(kind.fields, key=lambda f: f.name)


def _entries(value: Column) -> Column:
    """The entries of a map in the order of its keys."""
    return F.array_sort(F.map_entries(value), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))


def _numbers(value: Column, kind: t.DataType) -> Column:
    """All floating numbers of a value, in the order of its text."""
    if isinstance(kind, t.StructType):
        inner = [_numbers(value.getField(f.name), f.dataType) for f in _sorted_fields(kind) if _floats(f.dataType)]
        found = F.concat(*inner)
    elif isinstance(kind, t.ArrayType):
        found = F.flatten(F.transform(value, lambda x: _numbers(x, kind.elementType)))
    elif isinstance(kind, t.MapType):
        found = F.flatten(F.transform(_entries(value), lambda e: _numbers(e["value"], kind.valueType)))
    else:
        found = F.array(value.cast("double"))
    return F.when(value.isNull(), F.array().cast("array<double>")).otherwise(found)


def _text(value: Column, kind: t.DataType) -> Column:
    return F.when(value.isNull(), "null").otherwise(_present(value, kind))


def _present(value: Column, kind: t.DataType) -> Column:
    if isinstance(kind, t.StringType):
        return quoted(value)
    if isinstance(kind, (t.DoubleType, t.FloatType)):
        return F.lit(_HOLE)
    if isinstance(kind, (t.IntegralType, t.BooleanType)):
        return value.cast("string")
    if isinstance(kind, t.ArrayType):
        return F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: _text(x, kind.elementType)), ","), F.lit("]"))
    if isinstance(kind, t.MapType):
        entries = F.transform(_entries(value), lambda e: F.concat(quoted(e["key"]), F.lit(":"), _text(e["value"], kind.valueType)))
        return F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}"))
    if isinstance(kind, t.StructType):
        texts = [F.concat(quoted(F.lit(f.name)), F.lit(":"), _text(value.getField(f.name), f.dataType)) for f in _sorted_fields(kind)]
        commas = [part for text in texts for part in (F.lit(","), text)][1:]
        return F.concat(F.lit("{"), *commas, F.lit("}"))
    raise TypeError(f"no canonical JSON for {kind.simpleString()}")
