"""What needs the session itself: getting the package to the executors, and checkpoints."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for an application, as --py-files would."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp(prefix="nightframe-"))
    shutil.copytree(root, folder / "src" / root.name, ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(str(folder / root.name), "zip", folder / "src"))
    _shipped.add(context.applicationId)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The folder of spark.checkpoint.dir. Where that is unset, a local session gets one of its
    own, as in tests; a cluster needs a folder that all its machines share."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and context.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """df.checkpoint(), after which the shuffle files that made it are deleted: nothing reads
    them again, as the lineage is cut and the rows are in the shared folder. Estimates of size
    are cut, too (see _forgotten)."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        return _forgotten(df.select("*").checkpoint())  # the setting counts when a DataFrame is made
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def _forgotten(df: DataFrame) -> DataFrame:
    """df, a checkpoint, of unknown size if its estimate is beyond 2048 EiB. A checkpoint keeps the
    estimate of the plan that made it, and that of a join is the product of both sides'; so in
    rounds its digits multiply, to hundreds of megabytes in the driver after ten or so."""
    plan = df._jdf.logicalPlan()
    if "E+" not in plan.stats().simpleString():  # Spark writes so what is beyond; the number itself may be too long for Python
        return df
    jvm, session = df.sparkSession._jvm, df.sparkSession._jsparkSession
    none = jvm.scala.Option.empty()
    known = (plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(), plan.stream())
    plan = jvm.org.apache.spark.sql.execution.LogicalRDD(*known, session, none, none)
    return type(df)(jvm.org.apache.spark.sql.classic.Dataset.ofRows(session, plan), df.sparkSession)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """A table of fewer pieces than there are cores, dealt out by columns, as the join to come
    multiplies its rows; larger ones as they are."""
    context = df.sparkSession.sparkContext
    return df.repartition(context.defaultParallelism, *by) if df.rdd.getNumPartitions() < context.defaultParallelism else df


def worked_out(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns as a step of their own. Filters that follow read the values; Spark would
    otherwise move them below the projection and repeat the expressions in each."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))
