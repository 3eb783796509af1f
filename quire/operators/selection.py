"""Selections and lookups: page specifications, spreads, ratio grids, gathers, ordered folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def page_spec(spark: SparkSession, spec: str, count: int) -> DataFrame:
    """page (0-based, distinct, ascending when ordered) from "1,5-9,218"; typed errors for zero, reversed, empty and past-the-end parts."""
    pages: set[range] = set()
    for part in spec.split(","):
        ends = part.strip().split("-")
        if not part.strip() or len(ends) > 2 or not all(e.strip().isdigit() for e in ends):
            raise ValueError(f"page {part!r} isn't a number or a range")
        low, high = int(ends[0]), int(ends[-1])
        if low == 0:
            raise ValueError("pages count from 1")
        if high < low:
            raise ValueError(f"range {part.strip()} is reversed")
        if high > count:
            raise ValueError(f"page {high} is past the end: the document has {count} pages")
        pages.add(range(low - 1, high))
    ranges = F.array(*[F.struct(F.lit(r.start).cast("long").alias("a"), F.lit(r.stop - 1).cast("long").alias("b")) for r in sorted(pages, key=lambda r: (r.start, r.stop))])
    return spark.range(1).select(F.explode(ranges).alias("r")).select(F.explode(F.sequence("r.a", "r.b")).alias("page")).distinct()


def logical_pages(pages: DataFrame, spread: str) -> DataFrame:
    """A spread becomes a left and a right row, any other page one row with a null half."""
    halves = F.when(F.col(spread), F.array(F.lit("left"), F.lit("right"))).otherwise(F.array(F.lit(None).cast("string")))
    return pages.withColumn("half", F.explode(halves))


def ratios(low: int, high: int) -> list[tuple[int, int]]:
    """All (i, j) with low <= i * j <= high, by product, then i and j."""
    return sorted(((i, j) for i in range(1, high + 1) for j in range(1, high + 1) if low <= i * j <= high), key=lambda r: (r[0] * r[1], r))


def ratio_grid(spark: SparkSession, low: int, high: int) -> DataFrame:
    """The same as rows (i, j, product): a bounded range against itself, with the product as condition."""
    side = lambda n: spark.range(1, high + 1).select(F.col("id").cast("int").alias(n))
    joined = side("i").join(side("j"), (F.col("i") * F.col("j")).between(low, high))
    return joined.select("i", "j", (F.col("i") * F.col("j")).alias("product")).orderBy("product", "i", "j")


def nearest_ratio(width: Column, height: Column, tile: float, grid: list[tuple[int, int]]) -> Column:
    """struct(i, j) nearest to width / height; on an exact tie a later one replaces only where the image covers over half
    of its tiles, so the fold follows the grid's order."""
    options = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(float("inf")).alias("d")) for i, j in grid])
    first = F.struct(F.lit(1).alias("i"), F.lit(1).alias("j"), F.lit(float("inf")).alias("d"))

    def step(best: Column, x: Column) -> Column:
        d = F.abs(width / height - x["i"].cast("double") / x["j"])
        larger = width * height > 0.5 * tile * tile * x["i"] * x["j"]
        return F.when((d < best["d"]) | ((d == best["d"]) & larger), F.struct(x["i"].alias("i"), x["j"].alias("j"), d.alias("d"))).otherwise(best)

    return F.aggregate(options, first, step)


def gather(rows: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """Looks ``key`` up; a key that the table lacks is an error, raised where its row is."""
    found = rows.join(table.select(key, value), key, "left")
    return found.withColumn(value, F.when(F.col(value).isNull(), F.raise_error(F.concat(F.lit("no entry for "), F.col(key).cast("string")))).otherwise(F.col(value)))


def equal_keys_join(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Inner join of two tables that must have the same keys; a key on one side only is an error."""
    left, right = a.withColumn("_a", F.lit(True)), b.withColumn("_b", F.lit(True))
    joined = left.join(right, key, "full_outer")
    whole = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return joined.where(F.when(whole, True).otherwise(F.raise_error(F.concat(F.lit("only one side has "), F.col(key).cast("string"))))).drop("_a", "_b")


def meaningful(rungs: DataFrame, order: str, outcome: str) -> DataFrame:
    """Rungs after the first failure aren't meaningful."""
    before = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rungs.withColumn("meaningful", ~F.coalesce(F.bool_or(F.col(outcome) == "fail").over(before), F.lit(False)))
