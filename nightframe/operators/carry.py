"""Two passes over the frames of a batch, where a frame that is solved again helps later ones.

In the second pass the failed frames are tried again in the order of their files. Each gets the
median field of view of the first pass, and the attitude of the frame nearest in time that is
solved by then: in the first pass, or earlier in the second. So what a frame gets depends on
what came of others before it.

It is worked out in rounds, not in order. A frame is ready once the nearest frame that could
help it is known to be solved: any frame of the first pass, or one before it in the second that
is not known to have failed again. All that are ready are tried at once. The first open frame of
a batch always is, so rounds are as many as the longest chain of frames that wait for each other.
The nearest one is found on a growing grid of time, so no batch is in one task.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from . import matching


def upper_median(value: Column) -> Column:
    """The value at place n / 2 of the sorted ones."""
    return F.try_element_at(F.array_sort(F.collect_list(value)), (F.floor(F.count(value) / 2) + 1).cast("int"))


def _nearest(open_: DataFrame, known: DataFrame) -> DataFrame:
    """batch, pos, and of the nearest frame in time that may help: source (its pos), state."""
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    points = open_.where("ts is not null").select(F.col("batch").alias("frame_id"), "pos", seconds.alias("t"))
    others = known.where("ts is not null").select(F.col("batch").alias("frame_id"), F.col("pos").alias("source"), seconds.alias("t_2"), "state")
    span = others.agg(F.max("t_2") - F.min("t_2"), F.max("t_2")).first()
    extent = max(float(span[0] or 0.0), 1.0) + 1.0
    may = (F.col("state") == "first") | (F.col("source") < F.col("pos"))
    distance = F.when(may & (F.col("source") != F.col("pos")), F.abs(F.col("t") - F.col("t_2")))
    near = matching.nearest(points, others, "pos", "source", ["t"], distance, 1, extent)
    return near.select(F.col("frame_id").alias("batch"), "pos", "source").join(known.select("batch", F.col("pos").alias("source"), "state"), ["batch", "source"])


def two_passes(frames: DataFrame, resolve: Callable[[DataFrame], DataFrame], carried: list[str]) -> DataFrame:
    """frames: batch, pos (the order of files), ts, solved, fov and the carried columns. resolve
    takes the frames of a round, with hint_fov and hint_<carried> (null without a solved frame),
    and returns batch, pos, solved, fov and the carried columns of each. Gives all frames, with
    `pass` (1 or 2) and, of the second, source: the pos of the frame that helped."""
    first = checkpointed(frames.select("batch", "pos", "ts", "solved", "fov", *carried))
    done = first.where("solved").withColumn("state", F.lit("first"))
    median = checkpointed(done.groupBy("batch").agg(upper_median(F.col("fov")).alias("hint_fov")))  # frozen from here on
    open_ = checkpointed(first.where("not solved"))
    rounds, solved = [], done.where("false")
    while not open_.isEmpty():
        known = done.unionByName(solved).unionByName(open_.withColumn("state", F.lit("open")))
        near = _nearest(open_, known)
        # without a time on either side: the first solved frame of the batch
        least = known.groupBy("batch", (F.col("state") == "first").alias("any")).agg(F.min(F.struct("pos", "state")).alias("l")).select("batch", F.col("l.pos").alias("source"), "l.state")
        some = open_.join(near.select("batch", "pos"), ["batch", "pos"], "left_anti").select("batch", "pos")
        some = some.join(least, "batch").where("source <> pos and (state = 'first' or source < pos)")
        some = some.groupBy("batch", "pos").agg(F.min(F.struct("source", "state")).alias("s")).select("batch", F.col("s.source").alias("source"), "pos", "s.state")
        found = near.unionByName(some)
        waits = found.where("state = 'open'").select("batch", "pos")
        ready = open_.join(waits, ["batch", "pos"], "left_anti").join(found.select("batch", "pos", "source"), ["batch", "pos"], "left")
        hints = known.select("batch", F.col("pos").alias("source"), *[F.col(c).alias(f"hint_{c}") for c in carried])
        ready = checkpointed(ready.join(hints, ["batch", "source"], "left").join(median, "batch", "left"))
        tried = checkpointed(resolve(ready).select("batch", "pos", F.col("solved").alias("again"), F.col("fov").alias("new_fov"), *[F.col(c).alias(f"new_{c}") for c in carried]))
        both = ready.join(tried, ["batch", "pos"])
        keep = lambda c: F.when(F.col("again"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c)
        rows = checkpointed(both.select("batch", "pos", "ts", F.col("again").alias("solved"), keep("fov"), *[keep(c) for c in carried], "source"))
        rounds.append(rows)
        solved = checkpointed(solved.unionByName(rows.where("solved").drop("source").withColumn("state", F.lit("second"))))
        open_ = checkpointed(open_.join(rows.select("batch", "pos"), ["batch", "pos"], "left_anti"))
    one = first.where("solved").withColumn("pass", F.lit(1)).withColumn("source", F.lit(None).cast("long"))
    return reduce(DataFrame.unionByName, [one, *[r.withColumn("pass", F.lit(2)) for r in rounds]])
