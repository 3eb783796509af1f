"""Routing of token vectors to experts, exact re-scoring of candidates, and batch schedules."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import vectors

Expert = Callable[[int, np.ndarray], np.ndarray]


def routes(tokens: DataFrame, key: str, scores: Column, k: int, renormalise: bool = True, scale: float = 1.0) -> DataFrame:
    """key, slot, expert, weight: softmax, the k best (lower index on ties), in order of score."""
    top = tokens.select(key, vectors.top_k(vectors.softmax(scores), k).alias("t"))
    raw = F.transform("t", lambda x: x["score"])
    weights = vectors.renormalise(raw, scale) if renormalise else F.transform(raw, lambda w: w * scale)
    zipped = F.arrays_zip(F.transform("t", lambda x: x["idx"]).alias("expert"), weights.alias("weight"))
    return top.select(key, F.posexplode(zipped).alias("slot", "r")).select(key, "slot", "r.expert", "r.weight")


def dispatch(tokens: DataFrame, key: str, vector: str, routed: DataFrame, expert: Expert, parts: int = 8) -> DataFrame:
    """key, v: each expert's output for its tokens, weighted and summed in order of slot (floating sums depend on it).

    Work is grouped by expert and a salt of the key, so a favoured expert is spread over ``parts`` tasks.
    """
    rows = tokens.select(key, F.col(vector).alias("v")).join(routed, key).withColumn("salt", F.pmod(F.xxhash64(key), F.lit(parts)))
    kind = dict(tokens.dtypes)[key]

    def apply(frame: pd.DataFrame) -> pd.DataFrame:
        if not len(frame):
            return pd.DataFrame({key: [], "slot": [], "y": []})
        x = np.array(frame["v"].tolist(), dtype=np.float64)
        y = expert(int(frame["expert"].iloc[0]), x) * frame["weight"].to_numpy()[:, None]
        return pd.DataFrame({key: frame[key], "slot": frame["slot"], "y": list(y)})

    done = rows.groupBy("expert", "salt").applyInPandas(apply, f"{key} {kind}, slot int, y array<double>")
    ordered = done.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "y"))), lambda s: s["y"]).alias("ys"))
    added = F.aggregate(F.slice("ys", 2, 1 << 20), F.get("ys", 0), lambda total, y: F.zip_with(total, y, lambda a, b: a + b))
    return ordered.select(key, added.alias("v"))


def rescore(scored: DataFrame, group: str, idx: str, rough: str, exact: str, wide: int, keep: int) -> DataFrame:
    """Of each group's ``wide`` best rows by the rough score the ``keep`` best by the exact one: group, idx, score.

    The lower idx goes first on ties. Every row stands for itself, also where a group holds an idx more than once.
    """
    found = scored.select(group, idx, F.col(rough).alias("_rough"), F.col(exact).alias("score"))
    for score, n in (("_rough", wide), ("score", keep)):
        line = Window.partitionBy(group).orderBy(F.col(score).desc(), idx)
        found = found.withColumn("_n", F.row_number().over(line)).where(F.col("_n") <= n).drop("_n")
    return found.drop("_rough")


def schedule(rows: DataFrame, order: str, length: str, slots: int) -> DataFrame:
    """Continuous batching simulated: order, slot, begin, end. At most ``slots`` run; the next in order enters as soon as one
    ends (the lowest slot on ties). A fold over one queue: the queue is the batch that a single engine serves."""
    packed = rows.agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.greatest(F.col(length).cast("long"), F.lit(1)).alias("n")))).alias("q"))
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), slots).alias("free"), F.array().cast("array<struct<o:bigint,slot:int,begin:bigint,end:bigint>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        begin = F.array_min(s["free"])
        slot = (F.array_position(s["free"], begin) - 1).cast("int")
        free = F.transform(s["free"], lambda f, i: F.when(i == slot, begin + x["n"]).otherwise(f))
        return F.struct(free.alias("free"), F.concat(s["out"], F.array(F.struct(x["o"].cast("long").alias("o"), slot.alias("slot"), begin.alias("begin"), (begin + x["n"]).alias("end")))).alias("out"))

    done = packed.select(F.explode(F.aggregate("q", start, step)["out"]).alias("r"))
    return done.select(F.col("r.o").alias(order), "r.slot", "r.begin", "r.end")


def counters(runs: DataFrame) -> DataFrame:
    """steps (the last end), served, max_active: from begin and end by a running sum over their changes."""
    moves = runs.select(F.explode(F.array(F.struct(F.col("begin").alias("t"), F.lit(1).alias("d")), F.struct(F.col("end").alias("t"), F.lit(-1).alias("d")))).alias("m")).groupBy("m.t").agg(F.sum("m.d").alias("d"))
    active = moves.withColumn("active", F.sum("d").over(Window.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)))
    return active.agg(F.max("t").alias("steps"), F.max("active").alias("max_active")).crossJoin(runs.agg(F.count("*").alias("served")))
