"""Rate-distortion allocation: argmin at a price natively, the search over prices on the driver."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire import storage

#: Upgrades that the driver settles at once; while more are left, they are taken by ranges.
FEW = 10_000


def packed(options: DataFrame, key: str) -> DataFrame:
    """The options of each key as one array; a key has a handful. Written once, so that a price is tried without a shuffle."""
    own = F.struct(F.col("rate").cast("double").alias("rate"), F.col("distortion").cast("double").alias("distortion"), "rank")
    return storage.materialize(options.groupBy(key).agg(F.collect_list(own).alias("o")), "options")


def at_price(held: DataFrame, key: str, price: float, slack: float = 1e-12) -> DataFrame:
    """From packed options: the option of each key with the least distortion + price * rate; within ``slack`` the least rank wins."""
    cost = lambda x: x["distortion"] + F.lit(price) * x["rate"]
    low = F.array_min(F.transform("o", cost))
    named = lambda x: F.struct(x["rank"].alias("rank"), x["rate"].alias("rate"), x["distortion"].alias("distortion"))
    best = F.get(F.transform(F.array(low), lambda m: F.array_min(F.transform(F.filter("o", lambda x: cost(x) <= m + slack), named))), 0)
    return held.select(key, best.alias("b")).select(key, "b.rate", "b.distortion", "b.rank")


def totals(chosen: DataFrame) -> tuple[float, float]:
    row = chosen.agg(F.sum("rate"), F.sum("distortion")).first()
    return float(row[0] or 0), float(row[1] or 0)


def waterfill(options: DataFrame, key: str, budget: float, rounds: int = 40) -> DataFrame:
    """Bisects the price until the total rate fits the budget as closely as it can; each round is one aggregation, and only
    its totals come to the driver. What remains of the budget goes to upgrades by gain per unit of rate."""
    held = packed(options, key)
    low, high = 0.0, 1.0
    while totals(at_price(held, key, high))[0] > budget:
        low, high = high, high * 4
        if high > 1e18:
            raise ValueError("the budget is below the cheapest options' total")
    for _ in range(rounds):
        mid = (low + high) / 2
        low, high = (mid, high) if totals(at_price(held, key, mid))[0] > budget else (low, mid)
        if high - low < 1e-9 * max(1.0, high):
            break
    chosen = at_price(held, key, high)
    left = budget - totals(chosen)[0]
    return _top_up(options, chosen, key, left)


def _upgrades(options: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """key, nth, gain, extra, rate, distortion, rank: each key's steps along the lower hull above its chosen option, the
    steepest first, so that a step never gains more per unit of rate than the one before it."""
    o = options.groupBy(key).agg(F.collect_list(F.struct("rate", "distortion", "rank")).alias("o"))
    now = chosen.select(key, F.col("rate").alias("r0"), F.col("distortion").alias("d0")).join(o, key)
    step = "struct<gain:double,less:double,rank:int,extra:double,rate:double,distortion:double>"
    kinds = dict(options.dtypes)
    step = step.replace("rank:int", f"rank:{kinds['rank']}")

    def best(state: Column) -> Column:
        better = F.filter("o", lambda x: (x["rate"] > state["rate"]) & (x["distortion"] < state["distortion"]))
        extra = lambda x: (x["rate"] - state["rate"]).cast("double")
        gain = lambda x: (state["distortion"] - x["distortion"]) / extra(x)
        named = lambda x: F.struct(F.least(gain(x), state["gain"]).alias("gain"), (-x["rate"]).cast("double").alias("less"), x["rank"].alias("rank"), extra(x).alias("extra"), x["rate"].cast("double").alias("rate"), x["distortion"].cast("double").alias("distortion"))
        return F.array_max(F.transform(better, named))

    def on(state: Column, _: Column) -> Column:
        def moved(b: Column) -> Column:
            return F.when(b.isNull(), state).otherwise(F.struct(b["rate"].alias("rate"), b["distortion"].alias("distortion"), b["gain"].alias("gain"), F.concat(state["steps"], F.array(b)).alias("steps")))

        return F.get(F.transform(F.array(best(state)), moved), 0)

    start = F.struct(F.col("r0").cast("double").alias("rate"), F.col("d0").cast("double").alias("distortion"), F.lit(float("inf")).alias("gain"), F.array().cast(f"array<{step}>").alias("steps"))
    steps = now.select(key, F.posexplode(F.aggregate("o", start, on)["steps"]).alias("nth", "s"))
    return steps.select(key, "nth", "s.gain", "s.extra", "s.rate", "s.distortion", "s.rank")


def _top_up(options: DataFrame, chosen: DataFrame, key: str, left: float) -> DataFrame:
    """Upgrades of all keys, the best gain per unit first, each if it still fits and the key's steps before it were taken.

    The steps lie in ordered ranges. A round takes all up to the first that doesn't fit: whole ranges by their sums, and
    part of the range where the budget ends by a running sum. What can't fit any more goes, with the key's later steps.
    Once few are left, the driver settles them in the same order.
    """
    order = [F.col("gain").desc(), F.col(key), F.col("nth")]
    steps = storage.materialize(_upgrades(options, chosen, key).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "upgrades")
    taken, rest = [], steps
    line = Window.partitionBy("_part").orderBy(*order)
    while True:
        gone = rest.where(F.col("extra") > left).groupBy(key).agg(F.min("nth").alias("_gone"))
        rest = storage.materialize(rest.join(gone, key, "left").where(F.col("_gone").isNull() | (F.col("nth") < F.col("_gone"))).drop("_gone"), "upgrades")
        parts = rest.groupBy("_part").agg(F.sum("extra").alias("extra"), F.count("*").alias("n")).orderBy("_part").collect()
        if sum(p.n for p in parts) <= FEW:
            break
        whole, spent = 0, 0.0
        while whole < len(parts) and spent + parts[whole].extra <= left:
            spent += parts[whole].extra
            whole += 1
        if whole == len(parts):
            taken.append(rest.select(key, "nth"))
            rest = rest.limit(0)
            break
        cut = parts[whole]._part
        inside = rest.where(F.col("_part") == cut).withColumn("_run", F.sum("extra").over(line))
        fits = F.col("_run") <= left - spent
        won = storage.materialize(rest.where(F.col("_part") < cut).select(key, "nth", "extra").unionByName(inside.where(fits).select(key, "nth", "extra")), "upgrades")
        left -= float(won.agg(F.sum("extra")).first()[0] or 0)
        taken.append(won.select(key, "nth"))
        rest = rest.where(F.col("_part") > cut).unionByName(inside.where(~fits).drop("_run"))
    stuck, last = set(), {}
    for k, nth, extra in rest.orderBy(*order).select(key, "nth", "extra").toPandas().itertuples(index=False):
        if k not in stuck and extra <= left:
            left -= extra
            last[k] = nth
        else:
            stuck.add(k)
    if last:
        own = T.StructType([steps.schema[key], steps.schema["nth"]])
        taken.append(chosen.sparkSession.createDataFrame([(k, int(n)) for k, n in last.items()], own))
    if not taken:
        return chosen
    picks = reduce(DataFrame.unionByName, taken).groupBy(key).agg(F.max("nth").alias("nth"))
    upgraded = steps.join(picks, [key, "nth"]).select(key, "rate", "distortion", "rank")
    return chosen.join(picks, key, "left_anti").unionByName(upgraded)
