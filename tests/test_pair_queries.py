"""Pairs of a frame's stars and detections that are not made, or not shuffled."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from nightframe.operators import views
from nightframe.plans import library, sky

QUERIES, SQL = library.queries(), library.oracle_sql()


def made(spark, folder, keys):
    spark.createDataFrame([(k, k % 50 + 1, "a b", f"Brand#{n % 7}") for n, k in enumerate(keys)], "p_partkey long, p_size int, p_name string, p_brand string").write.parquet(f"{folder}/part.parquet")
    spark.range(1, 40).select(F.col("id").alias("s_suppkey")).write.parquet(f"{folder}/supplier.parquet")
    return str(folder)


def rounded(rows):
    return sorted(tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in rows)


@pytest.mark.parametrize("repeated", [False, True])
@pytest.mark.parametrize("name", ["g24_residuals", "j03_correspondences", "j15_semi_inliers"])
def test_pairs_are_those_of_sql(spark, tmp_path, name, repeated):
    """Also where numbers of stars are repeated."""
    folder = made(spark, tmp_path, [*range(1, 3001), *(range(50, 3000, 60) if repeated else ())])
    con = duckdb.connect()
    for table in ("part", "supplier"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    want = con.execute(SQL[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, folder).select(columns).collect()
    assert len(got) > 100
    assert rounded(map(tuple, got)) == rounded(want.fetchall())


def test_own_pairs_need_no_search(spark, tmp_path, monkeypatch):
    def none(*_):
        raise AssertionError("only own pairs are asked for")

    monkeypatch.setattr(sky, "paired", none)
    monkeypatch.setattr("nightframe.plans.frames.paired", none)
    assert QUERIES["g24_residuals"](spark, made(spark, tmp_path, range(1, 3001))).count() > 100


def test_correspondences_are_not_joined(spark, tmp_path):
    """They leave the frames' tasks as they are asked for."""
    got = QUERIES["j03_correspondences"](spark, made(spark, tmp_path, range(1, 300)))
    assert got._jdf.queryExecution().optimizedPlan().nodeName() == "FlatMapGroupsInArrow"


@pytest.mark.parametrize("n", [0, 1, 30, 3000])
def test_any_near_is_that_of_all_pairs(n):
    rng = np.random.default_rng(n)
    x, y, u, v = rng.random((4, n)) * 20
    want = (((x[:, None] - u) ** 2 + (y[:, None] - v) ** 2) <= 0.5).any(axis=1)
    assert (views.any_near(x, y, u, v, 0.75, 0.5) == want).all()
    assert not views.any_near(x, y, np.zeros(0), np.zeros(0), 0.75, 0.5).any()


def test_any_near_makes_few_pairs_of_a_dense_field(monkeypatch):
    """Of 4000 points there are some 2 million pairs."""
    x, y, u, v = np.random.default_rng(1).random((4, 4000)) * 2
    made, chunks = [], views.near_chunks

    def counted(*args):
        for part in chunks(*args):
            made.append(len(part[0]))
            yield part

    monkeypatch.setattr(views, "near_chunks", counted)
    assert views.any_near(x, y, u, v, 0.75, 0.5).all()
    assert sum(made) < 100_000


def test_unprojected_pixels_are_not_joined(spark, tmp_path):
    """A frame's rotation is where its stars are."""
    folder = made(spark, tmp_path, range(1, 3001))
    con = duckdb.connect()
    for table in ("part", "supplier"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    want = con.execute(SQL["g08_unproject"])
    got = QUERIES["g08_unproject"](spark, folder)
    assert got._jdf.queryExecution().optimizedPlan().nodeName() == "FlatMapGroupsInArrow"
    assert rounded(map(tuple, got.select([c[0] for c in want.description]).collect())) == rounded(want.fetchall())
