"""Compute a compact intermediate once instead of once per branch that reads it."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.

    Only a session on a local master may go without: one machine is the whole cluster there.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def materialise(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder: eager, and safe against lost executors.

    Used for aggregated cell tables that several levels read: without it each level would
    scan and aggregate the whole log again.  With spark.cleaner.referenceTracking.cleanCheckpoints
    Spark deletes the files when the frame is no longer referred to.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def dealt(df: DataFrame, keys: Sequence[str], partitions: int | None) -> DataFrame:
    """Rows hashed by the keys of the join to come, in `partitions` if given.

    A join's own partitions are the session's, whatever the size of the table, and adaptive execution joins them to few.
    """
    return df if partitions is None else df.repartition(partitions, *keys)
