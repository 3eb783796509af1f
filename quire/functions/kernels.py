"""Numeric kernels that SQL can't say well: resampling, convolution, tiling, sampling, compensated sums. Arrow batches and numpy."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Bits of the fixed-point weights.
PRECISION = 22


def bicubic(x: np.ndarray, a: float = -0.5) -> np.ndarray:
    x = np.abs(x)
    return np.where(x < 1, ((a + 2) * x - (a + 3)) * x * x + 1, np.where(x < 2, (((x - 5) * x + 8) * x - 4) * a, 0.0))


def lanczos(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)


def bilinear(x: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, 1 - np.abs(x))


FILTERS: dict[str, tuple[Callable[[np.ndarray], np.ndarray], float]] = {"bilinear": (bilinear, 1.0), "bicubic": (bicubic, 2.0), "lanczos": (lanczos, 3.0)}


def weights(source: int, target: int, name: str) -> np.ndarray:
    """target x source whole weights of a separable resampling, in units of 2 ** -PRECISION. Shrinking widens the filter."""
    kernel, support = FILTERS[name]
    scale = source / target
    widen = max(1.0, scale)
    out = np.zeros((target, source), np.int64)
    for i in range(target):
        centre = (i + 0.5) * scale
        low, high = max(0, int(centre - support * widen + 0.5)), min(source, int(centre + support * widen + 0.5))
        w = kernel((np.arange(low, high) + 0.5 - centre) / widen)
        w = w / w.sum()
        out[i, low:high] = np.where(w < 0, np.ceil(w * (1 << PRECISION) - 0.5), np.floor(w * (1 << PRECISION) + 0.5))
    return out


def resample(image: np.ndarray, height: int, width: int, name: str) -> np.ndarray:
    """8-bit image (h, w, channels): rows across first, rounded to 8 bits between the passes."""
    cut = lambda x: np.clip((x + (1 << (PRECISION - 1))) >> PRECISION, 0, 255)
    across = cut(np.einsum("tw,hwc->htc", weights(image.shape[1], width, name), image.astype(np.int64)))
    return cut(np.einsum("th,hwc->twc", weights(image.shape[0], height, name), across)).astype(np.uint8)


def resampled_lines(lines: DataFrame, key: str, v: str, source: int, target: int, name: str) -> DataFrame:
    """key, t, v: lines of ``source`` 8-bit pixels brought to ``target`` by the fixed-point weights, a small table that the
    pixels meet by their place."""
    table = weights(source, target, name)
    cells = F.explode(F.array(*[F.array(*[F.struct(F.lit(int(t)).alias("t"), F.lit(int(table[t, s])).alias("w")) for t in np.flatnonzero(table[:, s])]) for s in range(source)])[F.col("s")])
    spread = lines.select(key, F.posexplode(v).alias("s", "v")).select(key, "v", cells.alias("c"))
    sums = spread.groupBy(key, F.col("c.t").alias("t")).agg(F.sum(F.col("c.w") * F.col("v")).alias("v"))
    return sums.withColumn("v", F.least(F.greatest(F.shiftright(F.col("v") + (1 << (PRECISION - 1)), PRECISION), F.lit(0)), F.lit(255)))


def resize(images: DataFrame, height: int, width: int, name: str = "bicubic") -> DataFrame:
    """``images`` (with height, width, channels, pixels binary) at another size; other columns stay."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [resample(np.frombuffer(p, np.uint8).reshape(h, w, c), height, width, name).tobytes() for p, h, w, c in zip(batch["pixels"], batch["height"], batch["width"], batch["channels"], strict=True)]
            yield batch.assign(pixels=out, height=height, width=width)

    return images.mapInPandas(run, images.schema)


def tiles(images: DataFrame, side: int) -> DataFrame:
    """One row per tile of a row-major grid: tile_no, pixels; sizes must be multiples of ``side``."""
    from pyspark.sql import types as T

    schema = T.StructType([*images.schema.fields, T.StructField("tile_no", T.IntegerType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                x = np.frombuffer(row["pixels"], np.uint8).reshape(row["height"], row["width"], row["channels"])
                if x.shape[0] % side or x.shape[1] % side:
                    raise ValueError(f"{x.shape[1]} x {x.shape[0]} isn't a grid of {side}")
                grid = [x[r : r + side, c : c + side].tobytes() for r in range(0, x.shape[0], side) for c in range(0, x.shape[1], side)]
                yield pd.DataFrame([row | {"pixels": p, "height": side, "width": side, "tile_no": i} for i, p in enumerate(grid)])[schema.names]

    return images.mapInPandas(run, schema)


def conv2d(x: np.ndarray, w: np.ndarray, stride: int = 1, padding: int = 0) -> np.ndarray:
    """x (channels, h, w) with w (out, channels, kh, kw), by views and one product."""
    x = np.pad(x, ((0, 0), (padding, padding), (padding, padding)))
    view = np.lib.stride_tricks.sliding_window_view(x, w.shape[2:], axis=(1, 2))[:, ::stride, ::stride]
    return np.einsum("chwij,ocij->ohw", view, w)


def max_pool(x: np.ndarray, side: int, stride: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(x, (side, side), axis=(1, 2))[:, ::stride, ::stride].max(axis=(3, 4))


class Pcg32:
    """The permuted congruential generator with 64 bits of state and 32 of output."""

    def __init__(self, seed: int, stream: int = 54) -> None:
        self.inc = ((stream << 1) | 1) & ((1 << 64) - 1)
        self.state = 0
        self.next()
        self.state = (self.state + seed) & ((1 << 64) - 1)
        self.next()

    def next(self) -> int:
        old = self.state
        self.state = (old * 6364136223846793005 + self.inc) & ((1 << 64) - 1)
        mixed, turn = (((old >> 18) ^ old) >> 27) & 0xFFFFFFFF, old >> 59
        return ((mixed >> turn) | (mixed << (-turn & 31))) & 0xFFFFFFFF


def top_k_sampler(share: float = 0.1, temperature: float = 0.2, seed: int = 0) -> Column:
    """A column function over arrays of logits: one of the ceil(share x size) largest, by a walk along their cumulative odds."""

    @pandas_udf("int")
    def sample(logits: pd.Series) -> pd.Series:
        out = []
        for row in logits:
            v = np.asarray(row, np.float64)
            keep = np.lexsort((np.arange(len(v)), -v))[: max(1, math.ceil(share * len(v)))]
            p = np.exp((v[keep] - v[keep[0]]) / temperature)
            # the generator is seeded by the row, so a task that runs again draws the same
            draw = Pcg32(seed ^ (int.from_bytes(v.tobytes()[:8], "little") & 0xFFFFFFFF)).next() / (1 << 32)
            out.append(int(keep[min(len(keep) - 1, int(np.searchsorted(np.cumsum(p / p.sum()), draw, side="right")))]))
        return pd.Series(out)

    return sample


def exact_sum(values: Column) -> Column:
    """Neumaier's compensated sum of an array: what each addition loses is added at the end."""
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c"))

    def step(a: Column, x: Column) -> Column:
        t = a["s"] + x
        lost = F.when(F.abs(a["s"]) >= F.abs(x), (a["s"] - t) + x).otherwise((x - t) + a["s"])
        return F.struct(t.alias("s"), (a["c"] + lost).alias("c"))

    done = F.aggregate(values, start, step)
    return done["s"] + done["c"]
