"""Intermediate tables in the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders written by this process and not yet dropped.
_written: set[str] = set()
_WRITTEN_AS = "_quire_path"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a master that runs in this one process (tests) gets a
    temporary folder, which goes with the process; any other is an error, as its executors would not see that folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="quire-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _written.add(path)
    return path


def materialize(df: DataFrame, tag: str, instead: DataFrame | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage, so a lost executor costs only the tasks that were running on it, and lets later
    readers prune columns, which an RDD checkpoint does not. ``instead``: a materialized table that nothing
    but ``df`` was made from; its folder is removed.
    """
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    setattr(found, _WRITTEN_AS, path)
    if instead is not None:
        drop(instead)
    return found


def drop(df: DataFrame) -> None:
    """Remove the folder of a materialized table; any other table is left alone."""
    path = getattr(df, _WRITTEN_AS, None)
    if path in _written:
        _remove(df.sparkSession, path)


def clear(spark: SparkSession) -> int:
    """Remove every folder that this process wrote, once the results that read them have been consumed; how many."""
    left = list(_written)
    for path in left:
        _remove(spark, path)
    return len(left)


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _written.discard(path)
