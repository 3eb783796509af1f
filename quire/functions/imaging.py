"""Pixel arithmetic and tile geometry as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Side of a patch, and patches merged per side.
PATCH, MERGE = 16, 4


def luma(r: Column, g: Column, b: Column) -> Column:
    """Fixed point, weights 19595, 38470, 7471 of 65536, rounded."""
    return F.shiftright(r * 19595 + g * 38470 + b * 7471 + 32768, 16)


def cmyk(c: Column, m: Column, y: Column, k: Column) -> Column:
    """struct(r, g, b) of 8-bit inks."""
    one = lambda ink: F.floor((255 - ink) * (255 - k) / 255).cast("int")
    return F.struct(one(c).alias("r"), one(m).alias("g"), one(y).alias("b"))


def unpack_bits(data: Column, invert: bool = False) -> Column:
    """Bits of a binary column, the highest of each byte first, as 0 or 255."""
    bits = F.split(F.array_join(F.transform(F.sequence(F.lit(1), F.octet_length(data)), lambda i: F.lpad(F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 2), 8, "0")), ""), "")
    on, off = (0, 255) if invert else (255, 0)
    return F.transform(F.filter(bits, lambda b: b != ""), lambda b: F.when(b == "1", on).otherwise(off))


def normalised(pixels: Column) -> Column:
    return F.transform(pixels, lambda p: p / 127.5 - 1.0)


def fit_edge(short: Column, long: Column, size: int) -> Column:
    """The shorter edge once the longer has ``size``, half to even, at least 1."""
    return F.greatest(F.rint(short / long * size), F.lit(1.0)).cast("int")


def centre_offset(size: int, resized: Column) -> Column:
    return F.rint((F.lit(size) - resized) * 0.5).cast("int")


def queries(size: Column) -> Column:
    return F.ceil(F.floor(size / PATCH) / MERGE).cast("int")


def placeholders(base: Column, tile: Column, columns: Column, rows: Column) -> Column:
    """Global rows of queries with a newline each and a separator; with tiles, their rows with a newline each."""
    whole = (queries(base) + 1) * queries(base) + 1
    return whole + F.when(columns * rows > 1, (queries(tile) * columns + 1) * queries(tile) * rows).otherwise(0)
