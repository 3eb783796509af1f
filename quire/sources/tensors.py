"""Tensor files: the directory in a file's JSON header as a relation, and tensors as rows."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIRECTORY = "path string, name string, dtype string, shape array<long>, byte_offset long, byte_len long"
#: Bytes of an element.
WIDTH = {"F32": 4, "F16": 2, "BF16": 2}


def parse_header(data: bytes) -> tuple[int, dict]:
    """(where the payload begins, header): an unsigned 64-bit length, then JSON. Lengths and ranges are checked."""
    if len(data) < 8:
        raise ValueError("too short for a header")
    n = struct.unpack("<Q", data[:8])[0]
    if 8 + n > len(data):
        raise ValueError("the header is longer than the file")
    header = {k: v for k, v in json.loads(data[8 : 8 + n]).items() if k != "__metadata__"}
    for name, t in header.items():
        begin, end = t["data_offsets"]
        if t["dtype"] not in WIDTH:
            raise ValueError(f"{name}: type {t['dtype']} isn't supported")
        if end - begin != int(np.prod(t["shape"], dtype=np.int64)) * WIDTH[t["dtype"]] or 8 + n + end > len(data):
            raise ValueError(f"{name}: its range doesn't fit its shape or the file")
    return 8 + n, header


def widen(raw: bytes, dtype: str) -> np.ndarray:
    """Elements in single precision; the widening is exact."""
    if dtype == "F32":
        return np.frombuffer(raw, "<f4")
    if dtype == "F16":
        return np.frombuffer(raw, "<f2").astype(np.float32)
    return (np.frombuffer(raw, "<u2").astype(np.uint32) << 16).view(np.float32)


def directory(spark: SparkSession, path: str) -> DataFrame:
    """One row per tensor of each file under ``path``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file, content in zip(batch["path"], batch["content"], strict=True):
                start, header = parse_header(content)
                rows += [(file, k, t["dtype"], list(t["shape"]), start + t["data_offsets"][0], t["data_offsets"][1] - t["data_offsets"][0]) for k, t in sorted(header.items())]
            yield pd.DataFrame(rows, columns=["path", "name", "dtype", "shape", "byte_offset", "byte_len"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, DIRECTORY)


def rows(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """name, row, v (array of float): tensors as rows of their last dimension."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                start, header = parse_header(content)
                for k, t in sorted(header.items()):
                    if names is None or k in names:
                        begin, end = t["data_offsets"]
                        m = widen(content[start + begin : start + end], t["dtype"]).reshape(-1, t["shape"][-1] if t["shape"] else 1)
                        yield pd.DataFrame({"name": k, "row": np.arange(len(m)), "v": list(m)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "name string, row long, v array<float>")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, size, sha256 of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
