"""Incremental page scanner: page k is emitted when marker k + 1 arrives; its batch twin splits whole texts."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quire.functions import spans

OUTPUT = "key string, page long, body string"


class PageScanner(StatefulProcessor):
    """Per key: the text not yet emitted and the number of the open page (0 before the first marker).

    Chunks of a key are taken in the order of ``seq``; one that was seen before is skipped, so feeding a chunk
    again changes nothing. An empty chunk marked ``last`` flushes the open page.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("scan", "buffer string, page long, seq long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer: Any) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        buffer, page, seen = (held[0], held[1], held[2]) if held else ("", 0, -1)
        out: list[tuple[str, int, str]] = []
        chunks = pd.concat(list(rows)).sort_values("seq")
        for seq, text, last in zip(chunks["seq"], chunks["text"], chunks["last"], strict=True):
            if seq <= seen:
                continue
            seen, buffer = int(seq), buffer + (text or "")
            while True:
                at = buffer.find(spans.PAGE)
                if at < 0:
                    break
                if page:
                    out.append((str(key[0]), page, buffer[:at].strip()))
                buffer, page = buffer[at + len(spans.PAGE) :], page + 1
            if not page:  # what stands before the first marker goes, save for a marker's possible beginning
                buffer = buffer[-len(spans.PAGE) :]
            if last and page:
                out.append((str(key[0]), page, buffer.strip()))
                buffer, page = "", 0
        self.state.update((buffer, page, seen))
        yield pd.DataFrame(out, columns=["key", "page", "body"])

    def close(self) -> None:
        pass


def scan_stream(chunks: DataFrame, key: str = "key") -> DataFrame:
    """key, page, body from a stream of (key, seq, text, last)."""
    return chunks.groupBy(key).transformWithStateInPandas(statefulProcessor=PageScanner(), outputStructType=OUTPUT, outputMode="Append", timeMode="None")


def split_pages(texts: DataFrame, key: str, text: str) -> DataFrame:
    """The batch twin: key, page (from 1), body."""
    return texts.select(key, F.posexplode(spans.pages(F.col(text))).alias("at", "body")).select(key, (F.col("at") + 1).cast("long").alias("page"), "body")


def joined_conversations(turns: DataFrame) -> DataFrame:
    """Each conversation as one stream of marked pages."""
    line = F.array_sort(F.collect_list(F.struct("turn", "text")))
    grouped = turns.groupBy("conv_id").agg(line.alias("t"))
    return grouped.select("conv_id", F.concat(F.lit("lead "), spans.join_pages(F.transform("t", lambda x: x["text"]))).alias("stream"))
