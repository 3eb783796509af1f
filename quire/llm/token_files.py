"""Token ids as Parquet list columns: written in document order, read back selectively.

Layout of a folder: one file or more per range of doc_id, rows ascending, columns doc_id, shard, start
(ids before the document in its shard), n_tokens and tokens (list of int). Ids are dictionary coded,
the sorted metadata columns delta coded; row groups and pages are small enough for a reader to skip,
and page indexes (which Spark's writer adds to every file) let a filter on doc_id reach its pages alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import common, tokens

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("shard", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("tokens", T.ArrayType(T.IntegerType(), False)),
    ]
)
_ARROW = pa.schema([("doc_id", pa.int64()), ("shard", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("tokens", pa.list_(pa.field("element", pa.int32(), False)))])
#: Rows of the per-shard table up to which it is sent to every executor; beyond it is joined by shuffle.
BROADCAST_SHARDS = 100_000


def write(
    docs: DataFrame,
    path: str,
    vocabulary: str,
    kind: str = "words",
    end_id: int = 1,
    row_group_bytes: int = 16 << 20,
    page_bytes: int = 256 << 10,
    page_rows: int = 2000,
    token_encoding: str = "dictionary",
    compression: str = "zstd",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Encode whole texts and write them to ``path`` in ascending doc_id order (nulls first).

    ``token_encoding``: "dictionary" or "delta". Equal doc_ids are ordered by a hash of the text, then by
    the text; repeated rows are all written; a null text is an empty one (its end id alone). An empty table gives
    files without rows. Other columns are ignored.
    """
    if token_encoding not in ("dictionary", "delta"):
        raise ValueError(f"token_encoding: dictionary or delta, not {token_encoding}")
    spark = docs.sparkSession
    common.prepare(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(vocabulary, kind).encode
        shard, start = TaskContext.get().partitionId(), 0
        for batch in common.slices(batches, "text", tokens.SLICE):
            ids, at = encode(batch.column("text"))
            offsets = at + np.arange(len(at))
            lengths = np.diff(offsets)
            flat = np.insert(ids, at[1:], end_id)
            values = pa.array(flat)
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values, type=_ARROW.field("tokens").type)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.full(len(lengths), shard, np.int32)), pa.array(start + offsets[:-1]), pa.array(lengths), lists], schema=_ARROW)
            start += int(offsets[-1])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    tie = F.xxhash64("text")
    (
        rows.repartitionByRange(common.parts(spark), F.col("doc_id"), tie)
        .sortWithinPartitions(F.col("doc_id"), tie, F.col("text"))
        .mapInArrow(run, SCHEMA)
        .write.option("compression", compression)
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.block.size", str(row_group_bytes))
        .option("parquet.page.size.row.check.min", "20")
        .option("parquet.page.size", str(page_bytes))
        .option("parquet.page.row.count.limit", str(page_rows))
        .option("parquet.enable.dictionary", "false")
        .option("parquet.enable.dictionary#tokens.list.element", str(token_encoding == "dictionary").lower())
        .parquet(path)
    )


def read(spark: SparkSession, path: str, where: Column | None = None, columns: list[str] | None = None) -> DataFrame:
    """Rows of a folder; a filter on doc_id, shard, start or n_tokens skips row groups and pages, and columns not named are not read."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    if where is not None:
        rows = rows.where(where)
    return rows.select(*columns) if columns else rows


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """shard, base: ids of all shards before it. Reads two metadata columns; the window runs over a row per shard."""
    sums = read(spark, path, columns=["shard", "n_tokens"]).groupBy("shard").agg(F.sum("n_tokens").alias("held"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("shard", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))


def with_starts(rows: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """``start`` counted over the whole folder instead of the shard."""
    bases = common.materialize(shard_starts(spark, path), "token-shards")
    if bases.count() <= BROADCAST_SHARDS:
        bases = F.broadcast(bases)
    return rows.join(bases, "shard").withColumn("start", F.col("base") + F.col("start")).drop("base")


def checksums(rows: DataFrame) -> DataFrame:
    """Per document, from the ids as they were read: doc_id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            crc = pa.array([zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), crc], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    common.prepare(rows.sparkSession)
    return rows.select("doc_id", "start", "n_tokens", "tokens").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
