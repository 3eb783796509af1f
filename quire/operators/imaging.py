"""Images as pixel relations (image, y, x, v): thresholds, profiles, skew, line bands, staves, spreads.

Every step is an aggregation keyed by the image, so a corpus of pages is one job; per-image row counts
after the first step are the image's height or width.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COARSE, FINE = tuple(float(d) for d in range(-5, 6)), tuple(i * 0.25 for i in range(-3, 4))


def otsu(pixels: DataFrame) -> DataFrame:
    """image, threshold: the last dark value of the split with the largest variance between classes, the first on ties."""
    h = pixels.groupBy("image", "v").agg(F.count("*").alias("n"))
    whole, line = Window.partitionBy("image"), Window.partitionBy("image").orderBy("v")
    mass = F.col("n") * F.col("v")
    t = h.select("image", "v", F.sum("n").over(whole).alias("total"), F.sum(mass).over(whole).alias("mass"), F.sum("n").over(line).alias("w0"), F.sum(mass).over(line).alias("s0"))
    dark, light = F.col("w0").cast("double"), (F.col("total") - F.col("w0")).cast("double")
    gap = F.col("s0") / dark - (F.col("mass") - F.col("s0")) / light
    split = t.where("w0 < total").withColumn("var", dark * light * gap * gap)
    best = split.groupBy("image").agg(F.min_by("v", F.struct((-F.col("var")).alias("x"), "v")).alias("threshold"))
    return h.select("image").distinct().join(best, "image", "left").select("image", F.coalesce("threshold", F.lit(0)).alias("threshold"))


def shift(tangent, x):
    """Whole rows by which a column moves; halves away from zero."""
    s = tangent * x
    return (F.signum(s) * F.floor(F.abs(s) + 0.5)).cast("long")


def profiles(ink: DataFrame, sizes: DataFrame, angles: tuple[float, ...]) -> DataFrame:
    """image, angle, y, n: ink per row after shearing by each angle; rows without ink are left out."""
    table = F.explode(F.array(*[F.struct(F.lit(a).alias("angle"), F.lit(math.tan(math.radians(a))).alias("tangent")) for a in angles]))
    moved = ink.withColumn("a", table).select("image", F.col("a.angle").alias("angle"), (F.col("y") - shift(F.col("a.tangent"), F.col("x"))).alias("y"))
    return moved.join(sizes, "image").where((F.col("y") >= 0) & (F.col("y") < F.col("height"))).groupBy("image", "angle", "y").agg(F.count("*").alias("n"))


def scores(ink: DataFrame, sizes: DataFrame, angles: tuple[float, ...]) -> DataFrame:
    """image, angle, score: variance of the row profile over all rows, empty ones too."""
    p = profiles(ink, sizes, angles).groupBy("image", "angle").agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"))
    mean = F.col("s") / F.col("height")
    return p.join(sizes, "image").select("image", "angle", (F.col("q") / F.col("height") - mean * mean).alias("score"))


def skew(ink: DataFrame, sizes: DataFrame) -> DataFrame:
    """image, angle: whole degrees up to 5 first, then quarters up to 0.75 around the best; ties go to 0, then to the coarse
    best, then to the smaller angle."""
    first = scores(ink, sizes, COARSE)
    coarse = first.groupBy("image").agg(F.max_by(F.struct("angle", "score"), F.struct("score", (F.col("angle") == 0).alias("zero"), (-F.col("angle")).alias("low"))).alias("c"))
    near = {a + f for a in COARSE for f in FINE}
    second = scores(ink, sizes, tuple(sorted(near))).join(coarse, "image").where(F.abs(F.col("angle") - F.col("c.angle")) <= 0.75)
    return second.groupBy("image").agg(F.max_by("angle", F.struct("score", (F.col("angle") == F.col("c.angle")).alias("same"), (-F.col("angle")).alias("low"))).alias("angle"))


def bands(profile: DataFrame) -> DataFrame:
    """image, begin, end, centre of runs of rows with at least half of the peak's ink (halves cut)."""
    peak = profile.withColumn("peak", F.max("n").over(Window.partitionBy("image")))
    line = Window.partitionBy("image").orderBy("y")
    inside = peak.where(F.col("n") >= F.greatest(F.floor(F.col("peak") / 2), F.lit(1))).withColumn("run", F.col("y") - F.row_number().over(line))
    runs = inside.groupBy("image", "run").agg(F.min("y").alias("begin"), F.max("y").alias("end"))
    return runs.select("image", "begin", "end", F.floor((F.col("begin") + F.col("end")) / 2).cast("long").alias("centre"))


def staves(centres: DataFrame) -> DataFrame:
    """image, staff, lines: greedy groups of five line centres with gaps within a quarter of their mean, which is at least 2."""
    packed = centres.groupBy("image").agg(F.array_sort(F.collect_list("centre")).alias("c"))
    state = F.struct(F.lit(1).alias("next"), F.array().cast("array<array<bigint>>").alias("found"))

    def step(s, i):
        five = F.slice("c", i, 5)
        gaps = F.zip_with(F.slice(five, 2, 4), F.slice(five, 1, 4), lambda b, a: (b - a).cast("double"))
        mean = F.aggregate(gaps, F.lit(0.0), lambda t, g: t + g) / 4
        fits = (F.size(five) == 5) & (mean >= 2.0) & F.forall(gaps, lambda g: F.abs(g - mean) <= 0.25 * mean)
        taken = F.struct((i + 5).alias("next"), F.concat(s["found"], F.array(five)).alias("found"))
        return F.when((i >= s["next"]) & F.coalesce(fits, F.lit(False)), taken).otherwise(s)

    grouped = packed.select("image", F.aggregate(F.sequence(F.lit(1), F.size("c")), state, step)["found"].alias("f"))
    return grouped.select("image", F.posexplode("f").alias("staff", "lines"))


def gutters(pixels: DataFrame, sizes: DataFrame, dark_below: int = 160) -> DataFrame:
    """image, gutter: the column nearest to the centre (the first on ties) in the middle fifth of a page at least 1.25 times as
    wide as high whose dark share is at most 0.5 % or at least 60 %; null where there is none."""
    wide = sizes.where(F.col("width") / F.col("height") >= 1.25)
    low, high = F.floor(F.col("width") * 2 / 5), F.floor(F.col("width") * 3 / 5)
    columns = pixels.join(wide, "image").where((F.col("x") >= low) & (F.col("x") < high)).groupBy("image", "x", "width", "height").agg(F.count_if(F.col("v") < dark_below).alias("dark"))
    share = F.floor(F.col("dark") * 1000 / F.col("height"))
    fit = columns.where((share <= 5) | (share >= 600)).withColumn("far", F.abs(F.col("x") - F.floor(F.col("width") / 2)))
    best = fit.groupBy("image").agg(F.min_by("x", F.struct("far", "x")).alias("gutter"))
    return sizes.select("image").join(best, "image", "left")


def staff_lines(pixels: DataFrame, sizes: DataFrame) -> DataFrame:
    """Threshold, deskew, bands and staves in one: image, angle, staff, lines."""
    ink = pixels.join(otsu(pixels), "image").where(F.col("v") <= F.col("threshold")).select("image", "y", "x")
    angle = skew(ink, sizes)
    tangent = F.tan(F.radians("angle"))
    turned = ink.join(angle, "image").select("image", (F.col("y") - shift(tangent, F.col("x"))).alias("y"))
    profile = turned.join(sizes, "image").where((F.col("y") >= 0) & (F.col("y") < F.col("height"))).groupBy("image", "y").agg(F.count("*").alias("n"))
    return staves(bands(profile)).join(angle, "image").select("image", "angle", "staff", "lines")


def barlines(pixels: DataFrame, sizes: DataFrame, lines: DataFrame) -> DataFrame:
    """image, bars: centres of vertical bars of a staff from (image, l0, l4), its first and last line.

    A column qualifies if ink covers 92 % of the rows between the lines, touches both lines within 2 rows, and leaves 70 % of
    one line gap above and below free. Runs up to half a gap wide (at least 2) count if the columns beside them are covered
    under 30 % for half a gap (at least 3), two columns off; a run at the edge needs no such flank there.
    """
    staff = lines.join(sizes, "image").where("l4 > l0 AND l4 < height")
    gap = F.floor((F.col("l4") - F.col("l0")) / 4)
    staff = staff.withColumns({"gap": gap, "span": F.col("l4") - F.col("l0") - 1})
    dark = pixels.join(otsu(pixels), "image").join(staff, "image").where(F.col("v") <= F.col("threshold"))
    y, l0, l4 = F.col("y"), F.col("l0"), F.col("l4")
    counts = {
        "cover": y.between(l0 + 1, l4 - 1),
        "top": y.between(l0 - 2, l0 + 2),
        "bottom": y.between(l4 - 2, l4 + 2),
        "above": (y >= l0 - F.col("gap")) & (y < l0 - 2),
        "below": (y >= l4 + 3) & (y < l4 + 1 + F.col("gap")),
    }
    columns = dark.groupBy("image", "x", "width", "height", "l0", "l4", "gap", "span").agg(*[F.count_if(c).alias(n) for n, c in counts.items()])
    above = F.greatest(l0 - 2, F.lit(0)) - F.greatest(l0 - F.col("gap"), F.lit(0))
    below = F.least(l4 + 1 + F.col("gap"), F.col("height")) - F.least(l4 + 3, F.col("height"))
    free = ~((above > 0) & (F.col("above") * 10 > above * 3)) & ~((below > 0) & (F.col("below") * 10 > below * 3))
    need = F.floor(F.col("span") * 92 / 100)
    marked = columns.withColumn("q", (F.col("cover") >= need) & (F.col("top") > 0) & (F.col("bottom") > 0) & free)
    line = Window.partitionBy("image").orderBy("x")
    runs = marked.where("q").withColumn("run", F.col("x") - F.row_number().over(line)).groupBy("image", "width", "gap", "span", "run").agg(F.min("x").alias("s"), (F.max("x") + 1).alias("e"))
    runs = runs.where(F.col("e") - F.col("s") <= F.greatest(F.floor(F.col("gap") / 2), F.lit(2)))
    # only covered columns can spoil a flank; they are few, and a flank is a few columns wide
    busy = marked.where(F.col("cover") * 10 >= F.col("span") * 3).select(F.col("image").alias("i"), F.col("x").alias("bx"))
    reach = F.greatest(F.floor(F.col("gap") / 2), F.lit(3))
    left = (F.col("s") >= 3) & F.col("bx").between(F.greatest(F.col("s") - 2 - reach, F.lit(0)), F.col("s") - 3)
    right = (F.col("e") + 3 < F.col("width")) & F.col("bx").between(F.col("e") + 2, F.col("e") + 1 + reach)
    clear = runs.join(busy, (F.col("image") == F.col("i")) & (left | right), "left_anti")
    return clear.groupBy("image").agg(F.array_sort(F.collect_list(F.floor((F.col("s") + F.col("e") - 1) / 2).cast("long"))).alias("bars"))


def figure_formats(pixels: DataFrame, sample: int = 4096, few: int = 64, poor: float = 0.10) -> DataFrame:
    """image, keys, sampled, format from (image, at, r, g, b), ``at`` the pixel's place in row order: of every ceil(n / sample)-th
    pixel the colours at five bits a channel; few distinct ones, or few per pixel, make a PNG."""
    sizes = pixels.groupBy("image").agg(F.greatest(F.ceil(F.count("*") / sample), F.lit(1)).alias("every"))
    five = lambda c: F.shiftright(F.col(c).cast("int"), 3)
    key = F.shiftleft(five("r"), 10).bitwiseOR(F.shiftleft(five("g"), 5)).bitwiseOR(five("b"))
    seen = pixels.join(sizes, "image").where(F.col("at") % F.col("every") == 0).groupBy("image", key.alias("key")).agg(F.count("*").alias("n"))
    found = seen.groupBy("image").agg(F.count("*").alias("keys"), F.sum("n").alias("sampled"))
    return found.withColumn("format", F.when((F.col("keys") <= few) | (F.col("keys") / F.col("sampled") < poor), "png").otherwise("jpeg"))


def pooled(pixels: DataFrame, side: int, stride: int, height: int, width: int) -> DataFrame:
    """image, y, x, v: the greatest value of each side x side window that lies within the picture."""
    reach = -(-side // stride)
    offsets = F.sequence(F.lit(0), F.lit(reach - 1))
    spots = pixels.withColumn("dy", F.explode(offsets)).withColumn("dx", F.explode(offsets))
    top, left = F.floor(F.col("y") / stride) - F.col("dy"), F.floor(F.col("x") / stride) - F.col("dx")
    inside = (top >= 0) & (left >= 0) & (F.col("y") < top * stride + side) & (F.col("x") < left * stride + side) & (top * stride + side <= height) & (left * stride + side <= width)
    return spots.where(inside).groupBy("image", top.alias("y"), left.alias("x")).agg(F.max("v").alias("v"))


def convolved(pixels: DataFrame, kernel: list[list[float]], height: int, width: int) -> DataFrame:
    """image, y, x, v: the kernel at every place, zeros outside the picture (same padding, odd sides)."""
    half_y, half_x = len(kernel) // 2, len(kernel[0]) // 2
    taps = F.explode(F.array(*[F.struct(F.lit(half_y - i).alias("dy"), F.lit(half_x - j).alias("dx"), F.lit(float(w)).alias("w")) for i, line in enumerate(kernel) for j, w in enumerate(line)]))
    moved = pixels.withColumn("t", taps).select("image", (F.col("y") + F.col("t.dy")).alias("y"), (F.col("x") + F.col("t.dx")).alias("x"), (F.col("v") * F.col("t.w")).alias("v"))
    return moved.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1)).groupBy("image", "y", "x").agg(F.sum("v").alias("v"))


def cropped(pixels: DataFrame, ink: DataFrame, margin: int = 0) -> DataFrame:
    """The pixels of each picture within the box of its ink and ``margin`` around it, from the box's corner on."""
    box = ink.groupBy("image").agg((F.min("y") - margin).alias("y0"), (F.max("y") + margin).alias("y1"), (F.min("x") - margin).alias("x0"), (F.max("x") + margin).alias("x1"))
    held = pixels.join(box, "image").where(F.col("y").between(F.col("y0"), F.col("y1")) & F.col("x").between(F.col("x0"), F.col("x1")))
    return held.select("image", (F.col("y") - F.greatest(F.col("y0"), F.lit(0))).alias("y"), (F.col("x") - F.greatest(F.col("x0"), F.lit(0))).alias("x"), "v")


def squared(pixels: DataFrame, sizes: DataFrame, fill: int = 127) -> DataFrame:
    """Pictures padded to a square with grey, themselves in the middle (the smaller half first)."""
    side = sizes.withColumn("side", F.greatest("height", "width")).withColumns({"oy": F.floor((F.col("side") - F.col("height")) / 2), "ox": F.floor((F.col("side") - F.col("width")) / 2)})
    cells = side.select("image", F.explode(F.sequence(F.lit(0), F.col("side") - 1)).alias("y"), "side").select("image", "y", F.explode(F.sequence(F.lit(0), F.col("side") - 1)).alias("x"))
    moved = pixels.join(side, "image").select("image", (F.col("y") + F.col("oy")).alias("y"), (F.col("x") + F.col("ox")).alias("x"), "v")
    return cells.join(moved, ["image", "y", "x"], "left").select("image", "y", "x", F.coalesce("v", F.lit(fill)).alias("v"))


def tiled(pixels: DataFrame, side: int) -> DataFrame:
    """image, row, column, y, x, v: side x side tiles in row order; the last ones may be smaller."""
    return pixels.select("image", F.floor(F.col("y") / side).alias("row"), F.floor(F.col("x") / side).alias("column"), (F.col("y") % side).alias("y"), (F.col("x") % side).alias("x"), "v")
