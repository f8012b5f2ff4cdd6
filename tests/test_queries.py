"""Every query with SQL against DuckDB on the driver's small tables; the others run."""

import os

import pytest

from corpusmill.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return c


def plain(row):
    return tuple(round(x, 6) if isinstance(x, float) else x if isinstance(x, (int, type(None))) else str(x) for x in row)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    q = QUERIES[name]
    df = q.run(spark, SF)
    columns = sorted(df.columns)
    got = sorted((plain(r[c] for c in columns) for r in df.collect()), key=str)
    if q.sql:
        found = duck.sql(q.sql)
        assert sorted(found.columns) == columns
        assert got == sorted((plain(r) for r in found.select(*[f'"{c}"' for c in columns]).fetchall()), key=str)
