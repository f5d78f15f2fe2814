"""Queries over frames on tables made for a case."""

from pyspark.sql import functions as F

from nightframe.operators import views
from nightframe.plans import library


def test_unproject_at_the_pole(spark, tmp_path):
    """Star 0 is the south pole, where the way to the pixel and back leaves no right ascension."""
    spark.createDataFrame([(0, 10, "a b", "Brand#11")], "p_partkey long, p_size int, p_name string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(k,) for k in (5997, 5948, 5895, 5691)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    got = library.queries()["g08_unproject"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(k, 0, 0.0, -90.0) for k in (5691, 5895, 5948, 5997)]


def made(spark, tmp_path, stars, frames):
    spark.createDataFrame([(k, k % 50 + 1, "a b", "Brand#11") for k in range(1, stars + 1)], "p_partkey long, p_size int, p_name string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(1, frames + 1).select(F.col("id").alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")


def test_groups_have_tasks_of_their_own(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(views, "BLOCK", 1)
    made(spark, tmp_path, 50, 300)
    got = library.queries()["p11_in_frame"](spark, str(tmp_path))
    assert got.rdd.getNumPartitions() >= 300


def test_labels_of_a_frame_do_not_need_all_its_stars(spark, tmp_path, monkeypatch):
    """By magnitude, a frame's 40 are among the first few."""
    made(spark, tmp_path, 40000, 60)
    spark.createDataFrame([], "conv_id long, turn int").write.parquet(f"{tmp_path}/conversations.parquet")
    kept, by_frame = [], views.by_frame

    def seen(stars, frames, radius, work, schema, columns=("mag",), **how):
        def counted(of_group):
            return ((v.frame_id, len(v.place), sum(n for _, n, _ in work(iter([v])))) for v in of_group)

        kept.append(by_frame(stars, frames, radius, counted, "frame_id long, looked long, n long", columns, **how).collect())
        return by_frame(stars, frames, radius, work, schema, columns, **how)

    monkeypatch.setattr(views, "by_frame", seen)
    library.queries()["g23_overlay"](spark, str(tmp_path)).collect()
    assert max(r.n for r in kept[0] if r.n) == 40
    assert max(r.looked for r in kept[0] if r.n == 40) < 1000
