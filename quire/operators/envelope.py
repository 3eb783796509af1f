"""How far repeated runs of a document agree, and decisions under a fitted scaling law."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import stats


def envelope(runs: DataFrame) -> DataFrame:
    """Per doc from rows (doc, run, pos, token, logit): n_runs, compared, first_divergence (compared if there is none),
    n_divergent, divergence_rate, spread_in_prefix, spread. Only positions that every run has are compared."""
    sizes = runs.groupBy("doc", "run").agg(F.count("*").alias("n")).groupBy("doc").agg(F.count("*").alias("n_runs"), F.min("n").alias("compared"))
    at = runs.join(sizes, "doc").where("pos < compared").groupBy("doc", "pos", "n_runs", "compared").agg((F.count_distinct("token") > 1).alias("apart"), (F.max("logit") - F.min("logit")).alias("spread"))
    per_doc = at.groupBy("doc", "n_runs", "compared").agg(F.min(F.when(F.col("apart"), F.col("pos"))).alias("first"), F.count_if("apart").alias("n_divergent"), F.max("spread").alias("spread"))
    first = F.coalesce("first", "compared")
    head = at.join(per_doc.select("doc", first.alias("cut")), "doc").where(F.col("pos") < F.col("cut")).groupBy("doc").agg(F.max("spread").alias("spread_in_prefix"))
    return per_doc.join(head, "doc", "left").select(
        "doc", "n_runs", "compared", first.alias("first_divergence"), "n_divergent", (F.col("n_divergent") / F.col("compared")).alias("divergence_rate"), F.coalesce("spread_in_prefix", F.lit(0.0)).alias("spread_in_prefix"), "spread"
    )


def speedup(n: Column, alpha: Column, beta: Column) -> Column:
    under = 1 + alpha * (n - 1) + beta * n * (n - 1)
    return F.when(under <= 0, 0.0).otherwise(n / under)


def pool_decision(rows: DataFrame, n: str, throughput: str, cpus: int, physical: int, min_r2: float = 0.90) -> DataFrame:
    """One row: alpha, beta, r2, chosen, decision. Falls back to the physical cores for a fit without a peak or with an r2 under
    ``min_r2``; else the better of the whole numbers around the peak, the smaller on ties, within 1..cpus."""
    fit = stats.usl_fit(rows, n, throughput)
    base = rows.agg(F.min(n).alias("n0"))
    points = rows.crossJoin(F.broadcast(fit)).crossJoin(F.broadcast(base)).select("alpha", "beta", "peak", (F.col(throughput) / F.col("base") * F.col("n0")).alias("c"), speedup(F.col(n), F.col("alpha"), F.col("beta")).alias("p"))
    r2 = F.when(F.var_pop("c") > 0, 1 - F.avg((F.col("c") - F.col("p")) * (F.col("c") - F.col("p"))) / F.var_pop("c")).otherwise(1.0)
    one = points.groupBy("alpha", "beta", "peak").agg(r2.alias("r2"))
    degenerate = F.coalesce((F.col("beta") <= 0) | (F.col("alpha") >= 1), F.lit(True))
    inside = lambda c: F.least(F.greatest(c, F.lit(1)), F.lit(cpus)).cast("int")
    low, high = inside(F.floor("peak")), inside(F.ceil("peak"))
    better = F.when(speedup(high, F.col("alpha"), F.col("beta")) > speedup(low, F.col("alpha"), F.col("beta")), high).otherwise(low)
    fallback = degenerate | (F.col("r2") < min_r2)
    chosen = F.when(fallback, physical).otherwise(better)
    return one.select("alpha", "beta", "r2", chosen.alias("chosen"), F.when(fallback, "fallback-physical-cores").when(chosen >= cpus, "no-cap-needed").otherwise("cap-at-usl-peak").alias("decision"))


def expected_accept_loss(p_flip: Column, save: float, flip: float) -> Column:
    return (1 - p_flip) * -save + p_flip * flip


def break_even(save: float, flip: float, full: float) -> float:
    """The rate of disagreement at which accepting costs as much as falling back."""
    return min(1.0, max(0.0, (full + save) / (save + flip))) if save + flip > 0 else 0.0


def guarded(rows: DataFrame, group: str, order: str, threshold: float, cadence: int, rate: float, null_rate: float, alpha: float) -> DataFrame:
    """Per group an ordered fold over struct(margin, full, draft): a step is verified if the margin is low, the cadence is due or the
    guard has tripped; verified steps bet on disagreement and trip once the wealth reaches 1 / alpha. Columns steps (array of
    struct(verified, wealth)), emitted (always the full token) and tripped."""
    line = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), "margin", "full", "draft")))
    packed = rows.groupBy(group).agg(line.alias("s"))
    start = F.struct(F.lit(0).alias("since"), F.lit(1.0).alias("wealth"), F.lit(False).alias("tripped"), F.array().cast("array<struct<verified:boolean,wealth:double>>").alias("steps"))

    def step(state: Column, x: Column) -> Column:
        low = x["margin"].isNull() | F.isnan(x["margin"]) | (F.abs(x["margin"]) == float("inf")) | (x["margin"] < threshold)
        verify = state["tripped"] | low | (state["since"] + 1 >= cadence)
        bet = 1 + rate * (F.when(x["draft"] != x["full"], 1.0).otherwise(0.0) - null_rate)
        wealth = F.when(verify & ~state["tripped"], F.least(F.greatest(state["wealth"] * bet, F.lit(2.2250738585072014e-308)), F.lit(8.98846567431158e307))).otherwise(state["wealth"])
        tripped = state["tripped"] | (wealth >= 1 / alpha)
        return F.struct(F.when(verify, 0).otherwise(state["since"] + 1).alias("since"), wealth.alias("wealth"), tripped.alias("tripped"), F.concat(state["steps"], F.array(F.struct(verify.alias("verified"), wealth.alias("wealth")))).alias("steps"))

    done = packed.select(group, "s", F.aggregate("s", start, step).alias("r"))
    return done.select(group, F.col("r.steps").alias("steps"), F.transform("s", lambda x: x["full"]).alias("emitted"), F.col("r.tripped").alias("tripped"))


def refine(points: DataFrame, group: str, n: str, c: str, alpha: str, beta: str, rounds: int = 12, halvings: int = 8) -> DataFrame:
    """group, alpha, beta, r2, rmse: damped Gauss-Newton on C(n) from a starting fit in the rows; a step that doesn't lower the
    squared error is halved up to ``halvings`` times, then the search ends. A group is one sweep, a handful of rows."""
    kind = dict(points.dtypes)[group]

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        x, y = frame[n].to_numpy(float), frame[c].to_numpy(float)
        a, b = float(frame[alpha].iloc[0]), float(frame[beta].iloc[0])

        def model(p: float, q: float):
            under = 1 + p * (x - 1) + q * x * (x - 1)
            return x / under, under

        def error(p: float, q: float) -> float:
            fit, under = model(p, q)
            return float(((y - fit) ** 2).sum()) if (under > 0).all() else float("inf")

        best = error(a, b)
        for _ in range(rounds):
            fit, under = model(a, b)
            ja, jb, res = -x * (x - 1) / under**2, -x * x * (x - 1) / under**2, y - fit
            aa, ab, bb = float(ja @ ja), float(ja @ jb), float(jb @ jb)
            det = aa * bb - ab * ab
            if abs(det) < 1e-18:
                break
            da, db = (bb * float(ja @ res) - ab * float(jb @ res)) / det, (aa * float(jb @ res) - ab * float(ja @ res)) / det
            for k in range(halvings + 1):
                now = error(a + da / 2**k, b + db / 2**k)
                if now < best:
                    a, b, best = a + da / 2**k, b + db / 2**k, now
                    break
            else:
                break
        total = float(((y - y.mean()) ** 2).sum())
        return pd.DataFrame({group: [frame[group].iloc[0]], "alpha": [a], "beta": [b], "r2": [1 - best / total if total > 0 else 1.0], "rmse": [(best / len(x)) ** 0.5]})

    return points.groupBy(group).applyInPandas(one, f"{group} {kind}, alpha double, beta double, r2 double, rmse double")
