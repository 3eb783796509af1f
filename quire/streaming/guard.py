"""Stateful repetition guard over token streams, and its batch twin."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quire.functions.tokens import measure

#: First checkpoint, distance of the next ones, window, lags, hits in a row that abort.
FIRST, EVERY, WINDOW, LAGS, NEEDED = 8192, 256, 2048, 256, 3
OUTPUT = "key string, checkpoint long, suspicious boolean, tripped boolean"


def suspicious(window: list[int], lags: int = LAGS) -> bool:
    """Nearly periodic (16 matches of 15 comparisons at the best lag) and poor in 4-grams (a quarter distinct)."""
    if len(window) < 4:
        return False
    _, matches, comparisons, unique, total = measure(np.asarray(window), lags, cycles=1)
    return 16 * matches >= 15 * comparisons and 4 * unique <= total


class Guard:
    """Hysteresis: three suspicious checkpoints in a row trip for good, a clean one starts over."""

    def __init__(self, seen: int = 0, hits: int = 0, tripped: bool = False, tail: list[int] | None = None, first: int = FIRST, every: int = EVERY, window: int = WINDOW, lags: int = LAGS) -> None:
        self.seen, self.hits, self.tripped, self.tail = seen, hits, tripped, list(tail or [])
        self.first, self.every, self.window, self.lags = first, every, window, lags

    def feed(self, tokens: list[int]) -> list[tuple[int, bool, bool]]:
        out = []
        for t in tokens:
            self.tail.append(t)
            if len(self.tail) > self.window:
                del self.tail[: len(self.tail) - self.window]
            self.seen += 1
            if self.seen >= self.first and (self.seen - self.first) % self.every == 0:
                bad = suspicious(self.tail, self.lags)
                self.hits = self.hits + 1 if bad else 0
                self.tripped = self.tripped or self.hits >= NEEDED
                out.append((self.seen, bad, self.tripped))
        return out


class GuardProcessor(StatefulProcessor):
    """Per key: the last tokens and the counters. Rows (seq, tokens) of a key are taken in order of seq, repeated ones skipped."""

    def __init__(self, **sizes: int) -> None:
        self.sizes = sizes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("guard", "seq long, seen long, hits int, tripped boolean, tail array<int>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer: Any) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else (-1, 0, 0, False, [])
        last, guard = held[0], Guard(held[1], held[2], held[3], held[4], **self.sizes)
        out = []
        chunks = pd.concat(list(rows)).sort_values("seq")
        for seq, tokens in zip(chunks["seq"], chunks["tokens"], strict=True):
            if seq > last:
                last = int(seq)
                out += [(str(key[0]), *r) for r in guard.feed([int(t) for t in tokens])]
        self.state.update((last, guard.seen, guard.hits, guard.tripped, guard.tail))
        yield pd.DataFrame(out, columns=["key", "checkpoint", "suspicious", "tripped"])

    def close(self) -> None:
        pass


def guard_stream(chunks: DataFrame, **sizes: int) -> DataFrame:
    return chunks.groupBy("key").transformWithStateInPandas(statefulProcessor=GuardProcessor(**sizes), outputStructType=OUTPUT, outputMode="Append", timeMode="None")
