"""Cutting a plan's lineage with tables in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> None:
    """Use spark.checkpoint.dir; set a local folder only where nothing is set (tests)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    at = spark.conf.get("spark.checkpoint.dir", None)
    sc.setCheckpointDir(at or "file://" + tempfile.mkdtemp(prefix="graphloom-"))


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: survives the loss of executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(df: DataFrame, into: list[str]) -> DataFrame:
    """df written as a Parquet table to the shared folder and read back; ``into`` collects the path, for ``release``.

    Compressed, and without the partitioning of its plan: joins deal such a table
    anew, into as many tasks as the session says.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    into.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that no later plan reads, and the shuffle files of plans that are gone."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    paths.clear()
    gc.collect()
    jvm.System.gc()  # Spark's cleaner goes by the driver's garbage
