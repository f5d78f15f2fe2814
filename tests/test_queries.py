"""Every query of the library's own operators against its SQL, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from nightframe.plans import library

DATA = Path("/root/testdata/sf0.001")
QUERIES, SQL = library.queries(), library.oracle_sql()

pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def plain(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else round(x, 5) + 0.0
        return str(x) if x is not None and not isinstance(x, bool | int) else x

    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, name):
    got = QUERIES[name](spark, str(DATA))
    want = duck.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(spark, name):
    got = QUERIES[name](spark, str(DATA))
    assert len(set(got.columns)) == len(got.columns)
    got.write.format("noop").mode("overwrite").save()
