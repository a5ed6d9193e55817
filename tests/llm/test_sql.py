"""The queries that SQL can express, against that SQL in DuckDB."""

import duckdb
import pytest

from ledgerloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    wanted = db.execute(queries.oracle_sql()[name])
    columns = sorted(c[0] for c in wanted.description)
    place = {c[0]: k for k, c in enumerate(wanted.description)}
    wanted = sorted(tuple(row[place[c]] for c in columns) for row in wanted.fetchall())
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == columns
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == wanted and wanted
