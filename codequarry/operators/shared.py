"""Cutting lineage through the shared checkpoint folder."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _private() -> str:
    """A folder of this process for a local master, removed at its end."""
    path = tempfile.mkdtemp(prefix="codequarry-checkpoints-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def folder(spark: SparkSession) -> str:
    """Where this application's intermediate tables go: below ``spark.checkpoint.dir``.

    Only under a local master may it be unset: no executor of a cluster could read
    a folder of the driver's machine.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(_private())
        root = context.getCheckpointDir()
    return f"{root}/codequarry/{context.applicationId}"


def materialise(frame: DataFrame) -> DataFrame:
    """Write a table once below ``folder`` and read it back.

    Unlike a kept RDD the written table survives lost executors, and later plans
    start from a plain columnar scan with statistics.
    """
    spark = frame.sparkSession
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def apart(frame: DataFrame) -> DataFrame:
    """``frame`` as a side of joins that are shuffled and merged, whatever its size is taken for: no copy passes the driver.

    Spark judges a side by its compressed bytes, and ten of those hold a table of
    short paths that takes a hundred and more once the driver has it as rows.
    """
    return frame.hint("merge")


def forget(spark: SparkSession) -> None:
    """Remove this application's intermediate tables; frames that read them are of no use afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
