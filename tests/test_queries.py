"""Every query against its DuckDB oracle, on the smallest tables."""

import os

import duckdb
import pytest

from plumbline import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query_agrees_with_its_oracle(spark, db, name):
    found = queries.QUERIES[name](spark, SF).toArrow()  # noqa: F841  read by name
    if name not in queries.SQL:
        return
    columns = ",".join(f'"{c}"' for c in sorted(found.column_names))
    wanted = db.sql(queries.SQL[name])
    assert sorted(wanted.columns) == sorted(found.column_names)
    for one, two in (("found", f"({queries.SQL[name]})"), (f"({queries.SQL[name]})", "found")):
        assert not db.sql(f"select {columns} from {one} except all select {columns} from {two}").fetchall()


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
