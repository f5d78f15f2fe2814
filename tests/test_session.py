"""Checkpoints in rounds."""

from pyspark.sql import functions as F

from nightframe.session import checkpointed


def test_estimates_of_size_do_not_grow_in_rounds(spark):
    """Each round joins the rows with themselves, whose estimate is a product."""
    df = spark.range(20, numPartitions=2).withColumn("x", F.col("id") % 7)
    for n in range(1, 8):
        df = checkpointed(df.join(df.select("id", F.col("x").alias("y")), "id").select("id", (F.col("x") + F.col("y")).alias("x")))
        assert "E+" not in df._jdf.logicalPlan().stats().simpleString()
        assert sorted(map(tuple, df.collect())) == [(i, i % 7 << n) for i in range(20)]
