"""Batch model inference as an extension point: a registry of named backends run by mapInPandas.

No weights are part of this library. A backend is a factory that a worker calls once and whose result maps a batch of
page payloads to texts; the built-in ``stub`` is deterministic and only echoes sizes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Backend = Callable[[], Callable[[list[bytes]], list[str]]]
_BACKENDS: dict[str, tuple[Backend, str]] = {}
OUTPUT = "doc_id string, page int, ok boolean, text string, error_kind string"


def register(name: str, backend: Backend, description: str = "") -> None:
    _BACKENDS[name] = (backend, description)


def models(spark: SparkSession) -> DataFrame:
    """name, description of the registered backends."""
    return spark.createDataFrame([(k, d) for k, (_, d) in sorted(_BACKENDS.items())], "name string, description string")


def recognise(pages: DataFrame, model: str) -> DataFrame:
    """A row per page (doc_id, page, payload): its text, or the reason why it was skipped. An unknown model stops the run."""
    if model not in _BACKENDS:
        raise KeyError(f"model {model!r} isn't registered: {sorted(_BACKENDS)}")
    make = _BACKENDS[model][0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = make()
        for batch in batches:
            rows = []
            for doc_id, page, payload in zip(batch["doc_id"], batch["page"], batch["payload"], strict=True):
                try:
                    rows.append((doc_id, page, True, backend([bytes(payload)])[0], None))
                except ValueError as error:  # a page that can't be read; anything else stops the task
                    rows.append((doc_id, page, False, None, str(error)[:200]))
            yield pd.DataFrame(rows, columns=["doc_id", "page", "ok", "text", "error_kind"])

    return pages.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("page").cast("int").alias("page"), "payload").mapInPandas(run, OUTPUT)


def documents(results: DataFrame) -> DataFrame:
    """doc_id, markdown: good pages in order; a document without any is an error with its first reason."""
    line = F.array_sort(F.collect_list(F.when(F.col("ok"), F.struct("page", "text"))))
    grouped = results.groupBy("doc_id").agg(line.alias("p"), F.min_by("error_kind", F.when(~F.col("ok"), F.col("page"))).alias("first"))
    text = F.array_join(F.transform("p", lambda x: x["text"]), "\n\n")
    return grouped.select("doc_id", F.when(F.size("p") > 0, text).otherwise(F.raise_error(F.coalesce("first", F.lit("no page")))).alias("markdown"))


def _stub() -> Callable[[list[bytes]], list[str]]:
    def run(batch: list[bytes]) -> list[str]:
        if not all(batch):
            raise ValueError("empty page")
        return [f"page of {len(p)} bytes" for p in batch]

    return run


register("stub", _stub, "echoes the size of a page")
