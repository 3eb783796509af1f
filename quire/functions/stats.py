"""Statistics over grouped values: quantiles, tail risk, confidence bounds, fits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Ranges of values into which a group is cut, so that no task holds a whole group.
RANGES = 1024


def cumulated(rows: DataFrame, group: list[str], x: str) -> DataFrame:
    """group, x, count, before, n: the distinct values of each group (nulls left out), how often each occurs, how many values
    are smaller, and how many there are.

    Equal values are counted before anything is ordered; a group is cut into ranges of values, whose counts are summed
    first, so that a task orders the distinct values of one range only.
    """
    counts = rows.where(F.col(x).isNotNull()).groupBy(*group, F.col(x).cast("double").alias(x)).agg(F.count("*").alias("count"))
    ends = counts.groupBy(*group).agg(F.min(x).alias("_low"), F.max(x).alias("_high"), F.sum("count").alias("n"))
    share = (F.col(x) - F.col("_low")) / (F.col("_high") - F.col("_low"))
    ranged = counts.join(ends, group).withColumn("_range", F.when(F.col("_high") > F.col("_low"), F.least(F.floor(share * RANGES), F.lit(RANGES - 1))).otherwise(0).cast("int"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(*group, "_range").agg(F.sum("count").alias("_sum"))
    base = sums.select(*group, "_range", F.coalesce(F.sum("_sum").over(earlier(Window.partitionBy(*group).orderBy("_range"))), F.lit(0)).alias("_base"))
    inside = F.coalesce(F.sum("count").over(earlier(Window.partitionBy(*group, "_range").orderBy(x))), F.lit(0))
    return ranged.withColumn("_inside", inside).join(base, [*group, "_range"]).select(*group, x, "count", (F.col("_base") + F.col("_inside")).alias("before"), "n")


def nearest(p: float) -> tuple[str, float]:
    """The value at rank ceil(p * n), 1 at least."""
    return "nearest", p


def between(q: float) -> tuple[str, float]:
    """The value at (n - 1) * q, between its neighbours in proportion (type 7)."""
    return "between", min(1.0, max(0.0, q))


def quantiles(rows: DataFrame, group: list[str], x: str, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """group and a column for each wanted quantile; exact, by cumulated counts."""
    held, n = cumulated(rows, group, x), F.col("n")
    at = lambda rank: F.max(F.when((F.col("before") < rank) & (rank <= F.col("before") + F.col("count")), F.col(x)))
    found = []
    for name, (kind, q) in wanted.items():
        if kind == "nearest":
            found.append(at(F.greatest(F.ceil(F.lit(q) * n - 1e-9), F.lit(1))).alias(name))
        else:
            place = F.lit(q) * (n - 1)
            found += [at(F.floor(place) + 1).alias(f"_low_{name}"), at(F.ceil(place) + 1).alias(f"_high_{name}"), F.max(place - F.floor(place)).alias(f"_part_{name}")]
    got = held.groupBy(*group).agg(*found)
    mixed = lambda name: F.when(F.col(f"_part_{name}") > 0, F.col(f"_low_{name}") * (1 - F.col(f"_part_{name}")) + F.col(f"_high_{name}") * F.col(f"_part_{name}")).otherwise(F.col(f"_low_{name}"))
    return got.select(*group, *[F.col(name) if kind == "nearest" else mixed(name).alias(name) for name, (kind, _) in wanted.items()])


def sample_stats(rows: DataFrame, group: list[str], x: str, **more: tuple[str, float]) -> DataFrame:
    """n, min, mean, median, p95, p99, cv_pct (null for fewer than two values or a mean that isn't positive), and more quantiles."""
    v = F.col(x)
    cv = F.when((F.count(v) >= 2) & (F.avg(v) > 0), F.stddev_samp(v) / F.avg(v) * 100.0)
    plain = rows.groupBy(*group).agg(F.count(v).alias("n"), F.min(v).alias("min"), F.avg(v).alias("mean"), cv.alias("cv_pct"))
    return plain.join(quantiles(rows, group, x, {"median": between(0.5), "p95": nearest(0.95), "p99": nearest(0.99), **more}), group)


def cvar(rows: DataFrame, group: list[str], x: str, alpha: float) -> DataFrame:
    """Mean of the worst alpha share per group, the last value weighted by its part of the share."""
    n, k, count = F.col("n"), F.col("k"), F.col("count")
    above = n - F.col("before") - count  # values larger than this one
    cut = cumulated(rows, group, x).withColumn("k", F.least(F.greatest(F.ceil(alpha * n - 1e-12), F.lit(1)), n)).withColumn("above", above)
    whole = F.greatest(F.least(count, k - 1 - F.col("above")), F.lit(0))
    last = F.when((F.col("above") < k) & (k <= F.col("above") + count), F.least(F.greatest(alpha * n - (k - 1), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return cut.groupBy(*group, "n").agg((F.sum(F.col(x) * (whole + last)) / (alpha * n)).alias("cvar")).drop("n")


def tail_fit(rows: DataFrame, group: list[str], x: str, share: float) -> DataFrame:
    """Generalised Pareto fit of the excesses over the (1 - share) quantile, by probability-weighted moments with
    plotting positions (j - 0.35) / m. Columns threshold, m, n, xi, beta, usable."""
    threshold = quantiles(rows, group, x, {"threshold": between(1 - share)})
    excess = cumulated(rows, group, x).join(threshold, group).where(F.col(x) > F.col("threshold")).withColumn("e", F.col(x) - F.col("threshold"))
    sums = excess.groupBy(*group, "threshold", "n").agg(F.sum("count").alias("m"), F.sum(F.col("e") * F.col("count")).alias("all"), F.sum(F.col("e") * F.col("count") * (F.col("n") - F.col("before") - (F.col("count") + 1) / 2 + 0.35)).alias("late"))
    # 1 - (j - 0.35) / m summed over equal values, j the place among the excesses from below
    moments = sums.withColumn("b0", F.col("all") / F.col("m")).withColumn("b1", F.col("late") / F.col("m") / F.col("m"))
    under = F.col("b0") - 2 * F.col("b1")
    fit = moments.withColumn("xi", F.when(under != 0, 2 - F.col("b0") / under)).withColumn("beta", F.when(under != 0, 2 * F.col("b0") * F.col("b1") / under))
    return fit.withColumn("usable", (F.col("m") >= 8) & F.coalesce(F.col("beta") > 0, F.lit(False))).select(*group, "threshold", "m", "n", "xi", "beta", "usable")


def tail_quantile(fit: DataFrame, p: float, empirical: Column) -> Column:
    """The fitted quantile or the empirical one, whichever is higher, within 0..1; the empirical one without a usable fit."""
    over = F.col("n") / F.col("m") * (1 - p)
    heavy = F.col("threshold") + F.col("beta") / F.col("xi") * (F.pow(over, -F.col("xi")) - 1)
    light = F.col("threshold") - F.col("beta") * F.log(over)
    q = F.when(F.abs(F.col("xi")) < 1e-9, light).otherwise(heavy)
    clamp = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    return F.when(F.col("usable") & q.isNotNull() & ~F.isnan(q) & (F.abs(q) < float("inf")), clamp(F.greatest(q, empirical))).otherwise(clamp(empirical))


def tail_gate(baseline: DataFrame, candidate: DataFrame, group: list[str], x: str, alpha: float, share: float, p: float, budget: float) -> DataFrame:
    """group, cvar, tail, verdict of the candidate: "pass" if the mean of the worst share and the fitted quantile both stay
    within the budget over the baseline's, "informational" without a baseline, else "fail"."""

    def side(rows: DataFrame) -> DataFrame:
        fit = tail_fit(rows, group, x, share).join(quantiles(rows, group, x, {"empirical": between(p)}), group)
        return cvar(rows, group, x, alpha).join(fit.select(*group, tail_quantile(fit, p, F.col("empirical")).alias("tail")), group)

    known = side(baseline).select(*group, F.col("cvar").alias("_cvar"), F.col("tail").alias("_tail"))
    within = (F.col("cvar") <= F.col("_cvar") + budget + 1e-12) & (F.col("tail") <= F.col("_tail") + budget + 1e-12)
    verdict = F.when(F.col("_cvar").isNull(), "informational").when(within, "pass").otherwise("fail")
    return side(candidate).join(known, group, "left").select(*group, "cvar", "tail", verdict.alias("verdict"))


def hoeffding_lower(passed: Column, n: Column, delta: float) -> Column:
    """Point for fewer than 20 trials, else the Hoeffding bound; cut to six places."""
    point = passed / F.greatest(n, F.lit(1))
    bound = F.greatest(point - F.sqrt(F.lit(math.log(1 / delta)) / (2 * n)), F.lit(0.0))
    return F.floor(F.when(n < 20, point).otherwise(bound) * 1e6) / 1e6


def log_gamma(z: float) -> float:
    return math.lgamma(z)


def beta_quantile(p: float, a: float, b: float) -> float:
    """Quantile of the Beta distribution: 200 bisections on the regularised incomplete beta function (Lentz's continued fraction)."""

    def incomplete(x: float) -> float:
        if x <= 0 or x >= 1:
            return float(x >= 1)
        front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
        if x < (a + 1) / (a + b + 2):
            return front * _fraction(x, a, b) / a
        return 1 - front * _fraction(1 - x, b, a) / b

    lo, hi = 0.0, 1.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if incomplete(mid) < p else (lo, mid)
    return (lo + hi) / 2


def _fraction(x: float, a: float, b: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def majority(rows: DataFrame, group: list[str], key: str) -> DataFrame:
    """The commonest key of each group, the greatest on ties."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(*group, key).agg(F.count("*").alias("n"))
    return counts.groupBy(*group).agg(F.max_by(key, F.struct("n", key)).alias("majority"), F.max("n").alias("votes"), F.sum("n").alias("keyed"))


def usl_fit(rows: DataFrame, n: str, throughput: str) -> DataFrame:
    """Least squares of n / C(n) - 1 on (n - 1) and n (n - 1) without an intercept, C relative to the smallest n. Rows of n <= 1
    or no throughput don't count. Columns base, alpha, beta, peak (null where the determinant or beta isn't positive)."""
    base = rows.agg(F.min_by(throughput, n).alias("base"), F.min(n).alias("n0"))
    points = rows.crossJoin(F.broadcast(base)).where((F.col(n) > 1) & (F.col(throughput) > 0))
    c = F.col(throughput) / F.col("base") * F.col("n0")
    x1, x2, y = F.col(n) - 1, F.col(n) * (F.col(n) - 1), F.col(n) / c - 1
    s = points.groupBy("base").agg(F.sum(x1 * x1).alias("a"), F.sum(x1 * x2).alias("b"), F.sum(x2 * x2).alias("c"), F.sum(x1 * y).alias("d"), F.sum(x2 * y).alias("e"))
    det = F.col("a") * F.col("c") - F.col("b") * F.col("b")
    fit = s.withColumn("alpha", F.when(F.abs(det) > 1e-12, (F.col("d") * F.col("c") - F.col("e") * F.col("b")) / det)).withColumn("beta", F.when(F.abs(det) > 1e-12, (F.col("a") * F.col("e") - F.col("b") * F.col("d")) / det))
    return fit.select("base", "alpha", "beta", F.when(F.col("beta") > 0, F.sqrt((1 - F.col("alpha")) / F.col("beta"))).alias("peak"))
