"""The queries that SQL can say, on the small tables."""

from pathlib import Path

import pytest

from lexmill.llm import queries

DATA = Path("/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="no test tables here")


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    connection = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    want = connection.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, str(DATA))
    assert sorted(columns) == sorted(got.columns)
    value = lambda x: round(x, 6) if isinstance(x, float) else x
    rows = sorted((tuple(value(r[c]) for c in columns) for r in got.collect()), key=repr)
    assert rows == sorted((tuple(map(value, r)) for r in want.fetchall()), key=repr)
