"""The solve log as a stream: roll-ups that follow it, and the hint that a camera carries.

The batch roll-ups and these share their columns, so a finished stream gives the rows of the
batch. Tumbling windows with a watermark are an addition; the log's own report has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "id long, cam long, ts timestamp, outcome string, fov double, wall_ms long"


def log_stream(spark: SparkSession, path: str, schema: str = EVENTS, files: int | None = 100) -> DataFrame:
    """JSON lines that are appended to a folder as new files; without a number of files, a batch
    takes all that there are."""
    stream = spark.readStream.schema(schema)
    return (stream if files is None else stream.option("maxFilesPerTrigger", files)).json(path)


def outcome_counts() -> list[Column]:
    done = F.count_if(F.col("outcome") != "rejected")
    return [F.count(F.lit(1)).alias("n"), F.count_if(F.col("outcome") == "solved").alias("solved"), done.alias("completed")]


def rollup(events: DataFrame) -> DataFrame:
    """Counts by outcome; batch or stream (complete mode)."""
    return events.groupBy("outcome").agg(*outcome_counts())


def hourly(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Counts by hour; a stream gives an hour out when no record can be late for it any more."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("hour")).agg(*outcome_counts())


def _carry(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else None
    rows = pd.concat(batches).sort_values(["ts", "id"])
    hints = []
    for outcome, fov in zip(rows["outcome"], rows["fov"], strict=True):
        hints.append(last)
        if outcome == "solved" and pd.notna(fov):
            last = float(fov)
    if last is not None:
        state.update((last,))
    yield pd.DataFrame({"id": rows["id"], "cam": key[0], "hint": pd.Series(hints, index=rows.index, dtype="float64")})


def carried_hints(events: DataFrame) -> DataFrame:
    """id, cam, hint: the field of view that the camera solved last before, across batches. The
    state of a camera is one number."""
    return events.groupBy("cam").applyInPandasWithState(_carry, "id long, cam long, hint double", "fov double", "append", GroupStateTimeout.NoTimeout)


def finished(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that there is, into a table in memory: for tests and small reports."""
    stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name)


def written(stream: DataFrame, path: str) -> DataFrame:
    """Runs a stream over all that there is into Parquet files, with its checkpoint beside them."""
    query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state")
    query.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def append_log(stream: DataFrame, path: str, state: str):
    """Starts a stream that appends its rows as JSON lines to a folder, each batch once, and
    never fails for them: returns the query and the list of its warnings.

    A batch is a folder named after its number, which is published last, by the success mark that
    Spark's writer leaves. A batch that comes again, after a restart, overwrites the same folder,
    so no row is there twice. A batch that cannot be written is left out and told of once; the
    stream goes on. Null fields are left out of the lines."""
    warnings: list[str] = []

    def write(rows: DataFrame, number: int) -> None:
        try:
            rows.write.mode("overwrite").json(f"{path}/batch={number}")
        except Exception as e:  # a log must not stop what it logs
            if not warnings:
                warnings.append(f"batch {number} of the log was not written (more will not be told of): {str(e).splitlines()[0][:200]}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
    return query, warnings


def read_log(spark: SparkSession, path: str, schema: str = EVENTS) -> DataFrame:
    """The lines of all batches that were written whole."""
    return spark.read.schema(schema).json(f"{path}/batch=*")
