"""Cutting lineage in iterative plans."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where the session names none a local folder is set for a local master, as in tests; a cluster is refused."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not root and held.isDefined():
        root = held.get()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = os.path.join(tempfile.gettempdir(), "rasterloom-lineage")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def cut(frame: DataFrame) -> DataFrame:
    """``frame`` read back from a reliable checkpoint in the session's shared folder."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint()


def tasks(frame: DataFrame) -> int:
    """A number of partitions that is kept: a few bytes may be much work, and Spark merges partitions, and cuts files, by their bytes."""
    spark = frame.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
