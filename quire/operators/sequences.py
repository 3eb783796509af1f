"""Ordered scans as window functions: islands, sticky hits, running extremes, products and carried values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire import storage
from quire.functions import vectors


def consecutive_hits(rows: DataFrame, group: list[str], order: list[str], hit: Column, needed: int = 3) -> DataFrame:
    """Adds streak (hits in a row up to here) and tripped (sticky: a streak of ``needed`` was reached here or before)."""
    line = Window.partitionBy(*group).orderBy(*order)
    marked = rows.withColumn("_hit", F.coalesce(hit, F.lit(False)))
    island = F.sum(F.when(F.col("_hit"), 0).otherwise(1)).over(line.rowsBetween(Window.unboundedPreceding, 0))
    streak = F.sum(F.when(F.col("_hit"), 1).otherwise(0)).over(Window.partitionBy(*group, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    counted = marked.withColumn("_island", island).withColumn("streak", streak)
    tripped = F.max(F.col("streak") >= needed).over(line.rowsBetween(Window.unboundedPreceding, 0))
    return counted.withColumn("tripped", tripped).drop("_hit", "_island")


def islands(rows: DataFrame, group: list[str], position: str, inside: Column) -> DataFrame:
    """begin, end and centre (whole number) of each run of consecutive positions that are inside."""
    line = Window.partitionBy(*group).orderBy(position)
    runs = rows.where(inside).withColumn("_run", F.col(position) - F.row_number().over(line))
    bands = runs.groupBy(*group, "_run").agg(F.min(position).alias("begin"), F.max(position).alias("end"))
    return bands.withColumn("centre", F.floor((F.col("begin") + F.col("end")) / 2).cast("long")).drop("_run")


def running_min(rows: DataFrame, group: list[str], order: list[str], x: str) -> Column:
    return F.min(x).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def prefix_min(rows: DataFrame, group: list[str], order: list[str], x: str, name: str) -> DataFrame:
    """Adds the least ``x`` of a group up to each row. Rows lie in ordered ranges; a task works on one range, and only the
    ranges' own minima are put in a row, so a large group is no single task."""
    ranged = storage.materialize(rows.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()), "prefix")
    local = F.min(x).over(Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    lows = ranged.groupBy("_part", *group).agg(F.min(x).alias("_low"))
    before = F.min("_low").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    bases = lows.select(F.col("_part").alias("_p"), *[F.col(g).alias(f"_g_{g}") for g in group], before.alias("_before"))
    same = F.col("_part") == F.col("_p")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return ranged.withColumn("_local", local).join(bases, same).select(*rows.columns, F.least("_local", "_before").alias(name))


def e_process(rows: DataFrame, group: list[str], order: list[str], d: Column, rate: float, null_rate: float, alpha: float) -> DataFrame:
    """Adds log_e (log of the running product of 1 + rate * (d - null_rate)) and crossed (it reached 1 / alpha here or before)."""
    line = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    grown = rows.withColumn("log_e", F.sum(F.log1p(F.lit(rate) * (d - F.lit(null_rate)))).over(line))
    return grown.withColumn("crossed", F.max(F.col("log_e") >= F.log(F.lit(1 / alpha))).over(line))


def carried(x: str, group: list[str], order: list[str]) -> Column:
    """The last value that isn't null, up to here."""
    return F.last(x, ignorenulls=True).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def ring(rows: DataFrame, group: list[str], order: list[str], x: str, size: int = 128, prefix: Column | None = None) -> DataFrame:
    """Adds held: the last ``size`` values up to here in order; where ``prefix`` marks a frozen row it is held for good and
    doesn't enter the ring."""
    frozen = F.lit(False) if prefix is None else prefix
    line = Window.partitionBy(*group, "_frozen").orderBy(*order)
    marked = rows.withColumn("_frozen", frozen)
    recent = F.when(~F.col("_frozen"), F.collect_list(x).over(line.rowsBetween(-(size - 1), 0)))
    first = F.collect_list(F.when(F.col("_frozen"), F.col(x))).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("held", F.concat(first, F.coalesce(recent, F.array().cast(f"array<{dict(rows.dtypes)[x]}>")))).drop("_frozen")


def lower_hull(points: Column) -> Column:
    """Lower convex hull of an array of struct(x, y) in x order, by an ordered fold with the hull as its state."""

    def turn(a: Column, b: Column, c: Column) -> Column:
        return (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])

    def drop(h: Column, p: Column) -> Column:
        return F.when((F.size(h) >= 2) & (turn(F.element_at(h, -2), F.element_at(h, -1), p) <= 0), F.slice(h, 1, F.size(h) - 1)).otherwise(h)

    def step(h: Column, p: Column) -> Column:
        # each fold step drops at most as many points as the hull has
        cleaned = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(h), F.lit(1))), h, lambda s, _: drop(s, p))
        return F.concat(cleaned, F.array(p))

    return F.aggregate(points, F.slice(points, 1, 0), step)


def without_gain(hull: Column, least: float = 1e-6) -> Column:
    """A hull of struct(x, y) without the last points that lower y by no more than ``least``."""
    last = F.array_max(F.transform(F.sequence(F.lit(1), F.size(hull)), lambda i: F.when(i == 1, 1).when(F.get(hull, i - 2)["y"] - F.get(hull, i - 1)["y"] > least, i).otherwise(0)))
    return F.when(F.size(hull) > 0, F.slice(hull, F.lit(1), last)).otherwise(hull)


def farthest_cuts(bars: Column, width: Column, budget: int, least: Column) -> Column:
    """Positions 0, cuts, width so that no piece is wider than ``budget``: each cut is the farthest bar within it that lies more
    than ``least`` behind the last. Null where a piece has no such bar."""
    return vectors.bound(bars, lambda bs: vectors.bound(width, lambda w: _cuts(bs, w, budget, least)))


def _cuts(bars: Column, width: Column, budget: int, least: Column) -> Column:
    start = F.struct(F.array(F.lit(0).cast("long")).alias("cuts"), F.lit(True).alias("open"))
    most = F.ceil(width / F.greatest(least, F.lit(1))).cast("int") + 1

    def on(s: Column, best: Column) -> Column:
        cut = F.struct(F.concat(s["cuts"], F.array(best.cast("long"))).alias("cuts"), F.lit(True).alias("open"))
        return F.when(best.isNull(), F.struct(s["cuts"].alias("cuts"), F.lit(False).alias("open"))).otherwise(cut)

    def step(s: Column, _: Column) -> Column:
        within = lambda at: F.array_max(F.filter(bars, lambda b: (b > at + least) & (b <= at + budget)))
        more = lambda at: s["open"] & (width - at > budget)
        return vectors.bound(F.element_at(s["cuts"], -1), lambda at: F.when(more(at), vectors.bound(within(at), lambda best: on(s, best))).otherwise(s))

    whole = lambda done: F.when(done["open"] & (width - F.element_at(done["cuts"], -1) <= budget), F.concat(done["cuts"], F.array(width.cast("long"))))
    return vectors.bound(F.aggregate(F.sequence(F.lit(1), most), start, step), whole)


def attend(query: Column, keys: Column, values: Column) -> Column:
    """One query over keys and values (arrays of arrays) by online softmax: a fold with running maximum, denominator and sum."""
    start = F.struct(F.lit(float("-inf")).alias("m"), F.lit(0.0).alias("d"), F.transform(F.get(values, 0), lambda _: F.lit(0.0)).alias("o"))
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))

    def moved(s: Column, p: Column, score: Column) -> Column:
        return vectors.bound(F.greatest(s["m"], score), lambda m: vectors.bound(F.exp(s["m"] - m), lambda old: vectors.bound(F.exp(score - m), lambda new: added(s, p, m, old, new))))

    def added(s: Column, p: Column, m: Column, old: Column, new: Column) -> Column:
        return F.struct(m.alias("m"), (s["d"] * old + new).alias("d"), F.zip_with(s["o"], p["v"], lambda o, v: o * old + v * new).alias("o"))

    def step(s: Column, p: Column) -> Column:
        return vectors.bound(vectors.dot(query, p["k"]) / F.sqrt(F.size(query)), lambda score: moved(s, p, score))

    return vectors.bound(F.aggregate(pairs, start, step), lambda done: F.transform(done["o"], lambda o: o / done["d"]))
