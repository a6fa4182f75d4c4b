"""Queries with SQL against it; all queries give a row for each row of their table."""

import pytest

from narrata.llm import queries
from tests.llm.helpers import FOLDER


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    wanted = con.sql(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, FOLDER).toPandas()
    columns = sorted(got.columns)
    assert columns == sorted(wanted.columns)
    as_rows = lambda f: sorted(map(tuple, f[columns].astype(str).itertuples(index=False, name=None)))
    assert as_rows(got) == as_rows(wanted)


def test_all_thirteen_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
