"""Vector functions over array columns: routing, norms, quantisation, products, regrouping."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda t, x: t + x)


def bound(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use(x)`` with ``x`` evaluated once; inside a lambda it would be evaluated for every element."""
    return F.get(F.transform(F.array(x), use), 0)


def softmax(v: Column) -> Column:
    shifted = lambda v: bound(F.array_max(v), lambda m: F.transform(v, lambda x: F.exp(x - m)))
    scaled = lambda e: bound(total(e), lambda t: F.transform(e, lambda x: x / t))
    return bound(bound(v, shifted), scaled)


def top_k(v: Column, k: int) -> Column:
    """Array of struct(idx, score): highest first, lower index on ties. A value that isn't finite is an error."""

    def pick(v: Column) -> Column:
        sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        ranked = F.array_sort(F.transform(v, lambda x, i: F.struct((-x).alias("n"), i.alias("idx"))))
        picked = F.transform(F.slice(ranked, 1, k), lambda s: F.struct(s["idx"].alias("idx"), (-s["n"]).alias("score")))
        return F.when(sound, picked).otherwise(F.raise_error(F.lit("non-finite score")).cast("array<struct<idx:int,score:double>>"))

    return bound(v, pick)


def renormalise(weights: Column, scale: float = 1.0) -> Column:
    return bound(weights, lambda ws: bound(total(ws) + 1e-20, lambda t: F.transform(ws, lambda w: w / t * scale)))


def argmax(v: Column) -> Column:
    """0-based; the lowest index wins ties, the first NaN wins."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def margin(v: Column) -> Column:
    s = F.sort_array(v, asc=False)
    return F.get(s, 0) - F.get(s, 1)


def silu(v: Column) -> Column:
    return F.transform(v, lambda x: x / (1 + F.exp(-x)))


def relu(v: Column) -> Column:
    return F.transform(v, lambda x: F.greatest(x, F.lit(0.0)))


def quick_gelu(v: Column) -> Column:
    return F.transform(v, lambda x: x / (1 + F.exp(-1.702 * x)))


def gelu_tanh(v: Column) -> Column:
    return F.transform(v, lambda x: 0.5 * x * (1 + F.tanh(math.sqrt(2 / math.pi) * (x + 0.044715 * x * x * x))))


def erf(x: Column) -> Column:
    """Abramowitz and Stegun 7.1.26; its coefficients are fixed values."""
    t = 1 / (1 + 0.3275911 * F.abs(x))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def gelu(v: Column) -> Column:
    return F.transform(v, lambda x: 0.5 * x * (1 + erf(x / math.sqrt(2))))


def rms_norm(v: Column, eps: float = 1e-6) -> Column:
    scaled = lambda v: bound(total(F.transform(v, lambda x: x * x)) / F.size(v), lambda m: F.transform(v, lambda x: x / F.sqrt(m + eps)))
    return bound(v, scaled)


def layer_norm(v: Column, eps: float = 1e-5) -> Column:
    def centred(c: Column) -> Column:
        return bound(total(F.transform(c, lambda x: x * x)) / F.size(c), lambda d: F.transform(c, lambda x: x / F.sqrt(d + eps)))

    return bound(v, lambda v: bound(total(v) / F.size(v), lambda m: bound(F.transform(v, lambda x: x - m), centred)))


def rope(v: Column, position: Column, base: float = 10000.0) -> Column:
    """Rotates (v[i], v[i + half]) by position * base ** (-2 i / size)."""
    half = (F.size(v) / 2).cast("int")
    angle = lambda i: position * F.pow(F.lit(base), -2.0 * i / F.size(v))
    return F.transform(v, lambda x, i: F.when(i < half, x * F.cos(angle(i)) - F.get(v, i + half) * F.sin(angle(i))).otherwise(x * F.cos(angle(i - half)) + F.get(v, i - half) * F.sin(angle(i - half))))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y))


def int8_rows(v: Column) -> Column:
    """struct(q, scale): symmetric, scale = max|w| / 127 in single precision (1 for a zero row), half to even, within 127."""
    peak = F.array_max(F.transform(v, lambda x: F.abs(x.cast("float"))))
    scale = F.when(peak == 0, F.lit(1.0).cast("float")).otherwise((peak / F.lit(127.0).cast("float")).cast("float"))
    q = F.transform(v, lambda x: F.least(F.greatest(F.rint((x.cast("float") / scale).cast("float").cast("double")), F.lit(-127.0)), F.lit(127.0)).cast("long"))
    return F.struct(q.alias("q"), scale.alias("scale"))


def u8_rows(v: Column) -> Column:
    """struct(q, scale, zero): asymmetric over a range that holds 0, on 0..255."""
    low = F.least(F.array_min(v).cast("double"), F.lit(0.0))
    high = F.greatest(F.array_max(v).cast("double"), F.lit(0.0))
    scale = F.when(high == low, 1.0).otherwise((high - low) / 255.0)
    zero = F.least(F.greatest(F.rint(-low / scale), F.lit(0.0)), F.lit(255.0))
    q = F.transform(v, lambda x: F.least(F.greatest(F.rint(x.cast("double") / scale) + zero, F.lit(0.0)), F.lit(255.0)).cast("long"))
    return F.struct(q.alias("q"), scale.alias("scale"), zero.cast("long").alias("zero"))


def int4_groups(v: Column, group: int) -> Column:
    """struct(packed, scales): per group scale = max|w| / 7 (1 for zeros), half to even, -8..7; the even element is the low nibble."""

    def scales(v: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(v), F.lit(group))
        most = lambda s: F.array_max(F.transform(F.slice(v, s, group), lambda x: F.abs(x.cast("double")))) / 7.0
        return F.transform(F.transform(starts, most), lambda s: F.when(s == 0, 1.0).otherwise(s))

    def packed(v: Column, safe: Column) -> Column:
        q = F.transform(v, lambda x, i: F.least(F.greatest(F.rint(x.cast("double") / F.get(safe, (i / group).cast("int"))), F.lit(-8.0)), F.lit(7.0)).cast("int"))
        nibble = lambda q, i: F.coalesce(F.get(q, i), F.lit(0)).bitwiseAND(15)
        pairs = lambda q: F.transform(F.sequence(F.lit(0), F.size(q) - 1, F.lit(2)), lambda i: nibble(q, i).bitwiseOR(F.shiftleft(nibble(q, i + 1), 4)))
        return F.struct(bound(q, pairs).alias("packed"), safe.alias("scales"))

    return bound(v, lambda v: bound(scales(v), lambda safe: packed(v, safe)))


def int4_unpack(packed: Column) -> Column:
    signed = lambda x: F.when(x > 7, x - 16).otherwise(x)
    return F.flatten(F.transform(packed, lambda b: F.array(signed(b.bitwiseAND(15)), signed(F.shiftright(b, 4).bitwiseAND(15)))))


def int_dot(a: Column, b: Column) -> Column:
    """Exact product sum of whole numbers."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("long"), lambda t, x: t + x)


def space_to_depth(v: Column, side: int, s: int) -> Column:
    """A side x side grid in row order as blocks of s x s in row order, each block's cells in row order."""
    cells = [(br * s + r) * side + bc * s + c for br in range(side // s) for bc in range(side // s) for r in range(s) for c in range(s)]
    flat = F.transform(F.array(*[F.lit(c) for c in cells]), lambda i: F.get(v, i))
    return F.transform(F.sequence(F.lit(0), F.lit((side // s) ** 2 - 1)), lambda b: F.slice(flat, b * s * s + 1, s * s))


def group_norm(v: Column, groups: int, eps: float = 1e-5) -> Column:
    """Each of ``groups`` equal parts of a vector, brought to mean 0 and variance 1 on its own."""
    size = (F.size(v) / groups).cast("int")

    def part(g: Column) -> Column:
        own = F.slice(v, g * size + 1, size)
        return bound(own, lambda o: bound(total(o) / F.size(o), lambda m: bound(total(F.transform(o, lambda x: (x - m) * (x - m))) / F.size(o), lambda d: F.transform(o, lambda x: (x - m) / F.sqrt(d + eps)))))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), part))


def transpose(rows: Column) -> Column:
    """An array of equally long rows as the array of its columns."""
    width = F.size(F.get(rows, 0))
    return F.transform(F.sequence(F.lit(0), width - 1), lambda j: F.transform(rows, lambda r: F.get(r, j)))


def with_column(rows: Column, column: Column) -> Column:
    """Each row with its entry of ``column`` behind it."""
    return F.zip_with(rows, column, lambda r, x: F.concat(r, F.array(x)))


def tile_rows(tiles: Column, columns: int) -> Column:
    """Tiles in row order, each an array of rows, as the rows of the whole picture."""
    height = F.size(F.get(tiles, 0))
    line = lambda t: F.transform(F.sequence(F.lit(0), height - 1), lambda y: F.flatten(F.transform(F.slice(tiles, t * columns + 1, columns), lambda x: F.get(x, y))))
    return F.flatten(F.transform(F.sequence(F.lit(0), (F.size(tiles) / columns).cast("int") - 1), line))
