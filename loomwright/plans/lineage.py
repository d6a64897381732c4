"""Partitioning and lineage helpers shared by iterative plans."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application inside the one that ``spark.checkpoint.dir`` names.

    Only where the session names none, and runs on this machine alone, the
    folder lies in the machine's temporary one.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), "loomwright-checkpoints")
    folder = f"{base.rstrip('/')}/loomwright-{context.applicationId}"
    if not _FOLDERS:
        atexit.register(_tidy)
    _FOLDERS[folder] = spark
    return folder


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def _tidy() -> None:
    """Tables of sessions that still run when Python ends are deleted."""
    for folder, spark in _FOLDERS.items():
        try:
            _delete(spark, folder)
        except Exception:  # the session is gone
            pass


def cut_lineage(df: DataFrame) -> DataFrame:
    """The same rows, read from a table in the shared folder.

    A written table, unlike a checkpoint, has its true size for the planner
    (sizes guessed by joins would be multiplied from round to round), and its
    readers read only the columns they use.  It outlives lost executors.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(table: DataFrame) -> None:
    """Delete a table that :func:`cut_lineage` wrote and nothing reads any more."""
    spark = table.sparkSession
    for path in {os.path.dirname(f) for f in table.inputFiles()}:
        if path.startswith(tuple(_FOLDERS)):
            _delete(spark, path)


def spread(df: DataFrame) -> DataFrame:
    """Rows over at least as many partitions as there are cores.

    Input that already has enough splits is left alone, so large tables are
    not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
