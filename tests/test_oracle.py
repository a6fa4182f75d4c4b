"""Every registered query against its SQL on the smallest input."""

from __future__ import annotations

import math
from pathlib import Path

import pytest

from narrata import oracle, oracle_artifacts, oracle_chunks, oracle_generation, queries, queries_artifacts, queries_cast, queries_generation  # noqa: F401

FOLDER = Path("/root/testdata/sf0.001")
SQL = oracle.oracle_sql() | oracle_artifacts.oracle_sql() | oracle_chunks.oracle_sql() | oracle_generation.oracle_sql()


def rows(frame):
    """Rows as sorted tuples of comparable text, columns by name."""
    names = sorted(frame.columns)

    def text(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    return names, sorted(tuple(text(v) for v in r) for r in frame[names].astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in FOLDER.glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    assert rows(queries.queries()[name](spark, str(FOLDER)).toPandas()) == rows(duck.sql(SQL[name]).df())


def test_all_queries_run_or_have_sql():
    assert set(SQL) <= set(queries.queries())


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert queries.queries()[name](spark, str(FOLDER)).count() > 0
