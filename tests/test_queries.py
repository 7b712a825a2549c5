"""Every registered query against its SQL in DuckDB, on the smallest tables."""

from pathlib import Path

import pytest

from lexmill.plans import answering, law, queries, retrieval, views  # noqa: F401

DATA = Path("/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="no test tables here")


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    value = lambda x: round(x, 6) if isinstance(x, float) else x
    return sorted((tuple(value(r[k]) for k in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return connection


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, str(DATA))
    if name not in queries.ORACLES:
        assert got.count() > 0
        return
    want = duck.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert normal(map(tuple, got.collect()), got.columns) == normal(want.fetchall(), columns)
