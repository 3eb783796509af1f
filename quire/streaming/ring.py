"""Ring state: a frozen prefix and the last rows of a stream, with checkpoint and rollback; and a bounded ordered iterator."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SIZE = 128


class RingError(ValueError):
    """A checkpoint that this ring can't go back to; the ring is unchanged."""


@dataclass(frozen=True)
class Checkpoint:
    owner: int
    prefix: int
    length: int
    branch: int


@dataclass
class Ring:
    """Rows up to ``freeze()`` are held for good; later ones overwrite the oldest once ``size`` are held."""

    size: int = SIZE
    prefix: list = field(default_factory=list)
    items: list = field(default_factory=list)
    length: int = 0
    branch: int = 0
    frozen: bool = False
    cuts: list[tuple[int, int]] = field(default_factory=list)

    def freeze(self) -> None:
        self.frozen = True

    def append(self, item: Any) -> None:
        if not self.frozen:
            self.prefix.append(item)
            return
        self.items.append(item)
        self.length += 1
        if len(self.items) > self.size:
            self.items.pop(0)

    def held(self) -> list:
        return [*self.prefix, *self.items]

    def checkpoint(self) -> Checkpoint:
        return Checkpoint(id(self), len(self.prefix), self.length, self.branch)

    def rollback(self, to: Checkpoint) -> None:
        """Lossless only: what the checkpoint's window held must not have been overwritten since."""
        if to.owner != id(self):
            raise RingError("the checkpoint belongs to another ring")
        if to.prefix != len(self.prefix):
            raise RingError("the prefix has changed")
        if to.length > self.length:
            raise RingError("the checkpoint lies ahead")
        if any(to.branch <= b and to.length > at for b, at in self.cuts):
            raise RingError("the checkpoint lies on an abandoned branch")
        dropped = self.length - to.length
        if min(to.length, self.size) > len(self.items) - dropped:
            raise RingError("rows of the checkpoint were overwritten")
        del self.items[len(self.items) - dropped :]
        self.cuts.append((self.branch, to.length))
        self.length, self.branch = to.length, self.branch + 1


class RingProcessor(StatefulProcessor):
    """Per key the last ``size`` values; emits the count and the sum of what is held after each batch."""

    def __init__(self, size: int = SIZE) -> None:
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getListState("ring", "seq long, value double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer: Any) -> Iterator[pd.DataFrame]:
        held = list(self.state.get()) if self.state.exists() else []
        last = max((r[0] for r in held), default=-1)
        fresh = pd.concat(list(rows)).sort_values("seq")
        held += [(int(s), float(v)) for s, v in zip(fresh["seq"], fresh["value"], strict=True) if s > last]
        held = held[-self.size :]
        self.state.put(held)
        yield pd.DataFrame([(str(key[0]), held[-1][0] if held else -1, len(held), float(sum(v for _, v in held)))], columns=["key", "seq", "held", "total"])

    def close(self) -> None:
        pass


def ring_stream(rows: DataFrame, size: int = SIZE) -> DataFrame:
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=RingProcessor(size), outputStructType="key string, seq long, held int, total double", outputMode="Update", timeMode="None")


def ordered(results: DataFrame, order: str, cancelled: Callable[[], bool] = lambda: False) -> Iterator:
    """Rows in order on the driver, a partition at a time, the next one prefetched; ends early once ``cancelled()``."""
    for row in results.orderBy(order).toLocalIterator(prefetchPartitions=True):
        if cancelled():
            return
        yield row
