"""A finished stream gives the rows of the batch."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from nightframe.streaming import log


def events(spark):
    rows = [(i, i % 3, i * 600, ["solved", "failed", "rejected"][(i * 7) % 3], float(i % 50), i * 10) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, cam long, s long, outcome string, fov double, wall_ms long")
    return df.select("id", "cam", F.timestamp_seconds("s").alias("ts"), "outcome", "fov", "wall_ms")


def test_streams_equal_batches(spark, tmp_path):
    path, batch = str(tmp_path / "log"), events(spark)
    for part in range(3):
        batch.where(F.floor(F.col("id") / 20) == part).coalesce(1).write.mode("append").json(path)
    stream = lambda: log.log_stream(spark, path, files=1)
    got = log.finished(log.rollup(stream()), "counts", "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, log.rollup(batch).collect()))
    hours = log.finished(log.hourly(stream()), "hours").collect()
    every = {r.hour.start: r.n for r in log.hourly(batch).collect()}
    assert len(hours) >= len(every) - 2 and all(every[r.hour.start] == r.n for r in hours)
    before = Window.partitionBy("cam").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    want = batch.select("id", "cam", F.last(F.when(F.col("outcome") == "solved", F.col("fov")), ignorenulls=True).over(before).alias("hint"))
    hints = log.finished(log.carried_hints(stream()), "hints")
    assert sorted(map(str, hints.collect())) == sorted(map(str, want.collect()))
