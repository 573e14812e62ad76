"""Helpers of this subpackage: shared folders, lineage cuts, null-safe text, Arrow results."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share, from `spark.checkpoint.dir`.

    Only a session on a local master may go without one: there, one machine is the whole cluster.
    """
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    folder = folder.removeprefix("file:") if not folder.startswith("file://") else folder
    return folder if "://" in folder else f"file://{folder}"


def new_folder(spark: SparkSession, name: str) -> str:
    """URI of a new folder below the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Compute once, into the shared folder: later reads survive lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def text_of(col: str | Column) -> Column:
    """A null text counts as the empty text."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


_HELD: list[dict] = []


def hold(cache: dict) -> dict:
    """Register what a Python worker keeps from task to task, so that other operators' tasks can let it go."""
    _HELD.append(cache)
    return cache


def release() -> None:
    """Let go of what earlier operators' tasks kept in this worker: memory is for one operator at a time."""
    for cache in _HELD:
        cache.clear()


def in_arrow(df: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply a function of one record batch to every batch."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in it:
            if batch.num_rows:
                yield step(batch)

    return df.mapInArrow(batches, schema)


def buffers(column: pa.Array):
    """UTF-8 bytes of a string column and the rows' offsets into them, without copying."""
    import numpy as np

    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    raw = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = raw[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets
