"""Helpers shared by the training-data operators: shared storage, worker set-up, Arrow slicing."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.storage import clear, drop, materialize, shared_dir, shared_path

__all__ = ["BATCH_BYTES", "BATCH_ROWS", "WORKER_ENV", "clear", "drop", "fresh", "gathered", "materialize", "parts", "prepare", "row_of", "shared_dir", "shared_path", "slices"]

#: Rows and bytes of an Arrow batch handed to a Python worker; bounds the worker's memory.
BATCH_ROWS = 4000
BATCH_BYTES = 8 << 20

#: Workers give large buffers back as soon as they are freed, which halves what they hold between batches.
WORKER_ENV = {
    "TOKENIZERS_PARALLELISM": "false",
    "ARROW_DEFAULT_MEMORY_POOL": "system",
    "MALLOC_ARENA_MAX": "2",
    "MALLOC_MMAP_THRESHOLD_": "1048576",
    "MALLOC_TRIM_THRESHOLD_": "1048576",
}


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package and keep their Arrow batches small.

    The package's parent folder is added to the workers' PYTHONPATH (it must exist there: a shared
    installation, or the same archive on every node).
    """
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])
    for k, v in WORKER_ENV.items():
        env.setdefault(k, v)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: Rows of a narrow intermediate table that go to one file.
ROWS_PER_FILE = 250_000


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of at most about ``rows`` narrow rows, in as few partitions as its files should be."""
    return df.coalesce(max(1, -(-rows // ROWS_PER_FILE)))


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that no column of ``df`` has, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"{name}_"
        taken.add(name.lower())
        out.append(name)
    return out


def row_of(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct, so that no name of theirs meets another."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns])


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of ``column`` in one are about ``limit`` bytes; a longer text stands alone."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
        begin = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += n
        if begin < len(sizes):
            yield batch.slice(begin)
