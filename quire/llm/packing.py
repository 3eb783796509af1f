"""Bounded-space online packing of token ids into training sequences.

Each partition keeps at most ``windows`` open windows. A document's ids fill whole sequences first; the
rest goes to the open window whose gap it fits best. If none has room, a further window is opened, and
once all are open the fullest is topped up with the head of the rest and emitted, so what leaves early
leaves full. At a partition's end the leftovers are merged, fullest with emptiest; the single window
that is still short is cut at powers of two, which need no padding. No shuffle, no state between partitions.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quire.llm import common, tokens

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
    ]
)
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
#: Bits of a sequence id that count the sequences of one partition.
SEQUENCE_BITS = 33


class Packer:
    """The windows of one partition. A piece is (doc_id, start, ids as bytes, doc_tokens); 4 bytes an id."""

    def __init__(self, size: int, windows: int, first: int = 0) -> None:
        self.size, self.windows, self.next = size, windows, first
        self.gaps: list[tuple[int, int]] = []  # (gap, window), ascending: the fullest window comes first
        self.open: dict[int, list[tuple]] = {}
        self.serial = 0
        self.out: list[tuple] = []

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            self.out.append((doc_id, start, len(ids) // 4, ids, total, self.next, offset))
            offset += len(ids) // 4
        self.next += 1

    def add(self, doc_id: int | None, ids: bytes) -> None:
        total, at = len(ids) // 4, 0
        while total - at >= self.size:
            self._emit([(doc_id, at, ids[4 * at : 4 * (at + self.size)], total)])
            at += self.size
        while at < total:
            need = total - at
            k = bisect_left(self.gaps, (need, -1))
            if k < len(self.gaps):
                gap, w = self.gaps.pop(k)
                self.open[w].append((doc_id, at, ids[4 * at :], total))
                if gap > need:
                    insort(self.gaps, (gap - need, w))
                else:
                    self._emit(self.open.pop(w))
                return
            if len(self.open) < self.windows:
                self.open[self.serial] = [(doc_id, at, ids[4 * at :], total)]
                insort(self.gaps, (self.size - need, self.serial))
                self.serial += 1
                return
            gap, w = self.gaps.pop(0)
            self._emit([*self.open.pop(w), (doc_id, at, ids[4 * at : 4 * (at + gap)], total)])
            at += gap

    def close(self) -> None:
        """Merge the leftovers: the emptiest window's pieces top up the fullest, until one is left."""
        left = [self.open[w] for _, w in self.gaps]
        gaps = [g for g, _ in self.gaps]
        self.gaps, self.open = [], {}
        lo, hi = 0, len(left) - 1
        while lo < hi:
            doc_id, start, ids, total = left[hi].pop()
            n = min(gaps[lo], len(ids) // 4)
            left[lo].append((doc_id, start, ids[: 4 * n], total))
            gaps[lo] -= n
            if 4 * n < len(ids):
                left[hi].append((doc_id, start + n, ids[4 * n :], total))
            if not gaps[lo]:
                self._emit(left[lo])
                lo += 1
            if not left[hi]:
                hi -= 1
        if lo == hi and left[lo]:
            self._cut(left[lo])

    def _cut(self, pieces: list[tuple]) -> None:
        rest = sum(len(p[2]) // 4 for p in pieces)
        part: list[tuple] = []
        room = 1 << (rest.bit_length() - 1)
        for doc_id, start, ids, total in pieces:
            while ids:
                n = min(room, len(ids) // 4)
                part.append((doc_id, start, ids[: 4 * n], total))
                start, ids, room, rest = start + n, ids[4 * n :], room - n, rest - n
                if not room:
                    self._emit(part)
                    part, room = [], 1 << (rest.bit_length() - 1) if rest else 0


def pack(docs: DataFrame, vocabulary: str, kind: str = "bytes", end_id: int = 0, size: int = 1024, windows: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Every id of every document, with ``end_id`` after each, lies in exactly one piece; a sequence holds
    ``size`` ids or a power of two fewer. A null or empty text is a document of its end id alone; null
    ids, repeated ids and repeated rows are each packed as rows of their own; an empty table gives no
    rows; other columns are ignored. Sequence ids are unique in one run: partition number and count.
    A lost task packs its own partition again, with the same result for the same input split.
    """
    spark = docs.sparkSession
    common.prepare(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(size, windows, TaskContext.get().partitionId() << SEQUENCE_BITS)
        encode = tokens.encoder(vocabulary, kind).encode
        end = np.array([end_id], dtype="<u4").tobytes()

        def flush() -> pa.RecordBatch:
            rows, packer.out = packer.out, []
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)

        for batch in common.slices(batches, "text", tokens.SLICE):
            ids, at = encode(batch.column("text"))
            for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                packer.add(doc_id, ids[a:b].tobytes() + end)
            if packer.out:
                yield flush()
        packer.close()
        if packer.out:
            yield flush()

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, PIECES)
