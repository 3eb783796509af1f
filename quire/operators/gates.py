"""Gates: joins and set differences that compare a candidate with a baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire import storage


def floor6(x: Column) -> Column:
    """Truncated to six decimal places."""
    return F.floor(x * 1e6) / 1e6


def ratchet(baseline: DataFrame, candidate: DataFrame, key: str = "category", value: str = "bound") -> DataFrame:
    """Full outer join of floors and candidate bounds: DROPPED and LOWERED reject; NEW and RAISED raise the ratchet."""
    b = baseline.select(key, F.col(value).alias("floor"))
    c = candidate.select(key, F.col(value).alias("bound"))
    low = floor6(F.col("floor"))
    verdict = F.when(F.col("bound").isNull(), "DROPPED").when(F.col("floor").isNull(), "NEW").when(F.col("bound") < low, "LOWERED").when(F.col("bound") > low, "RAISED").otherwise("HELD")
    joined = b.join(c, key, "full_outer").withColumn("verdict", verdict)
    return joined.withColumn("rejected", F.col("verdict").isin("DROPPED", "LOWERED")).withColumn("raised", F.col("verdict").isin("NEW", "RAISED"))


def ratchet_decision(rows: DataFrame) -> DataFrame:
    return rows.agg((~F.coalesce(F.bool_or("rejected"), F.lit(False))).alias("accepted"), F.coalesce(F.bool_or("raised"), F.lit(False)).alias("raised"))


def guardrail(current: DataFrame, baseline: DataFrame, key: str = "stage", value: str = "best", cv: str = "cv_pct", posture: str = "posture", max_cv: float = 5.0, tolerance: float = 0.10) -> DataFrame:
    """Left join with a ladder of verdicts in fixed order: new_stage, noise_ineligible, posture_mismatch, REGRESSION (beyond the
    tolerance), faster (below 1), ok. The ratio is there for the last three only. Against a baseline of zero there is no
    ratio: anything above zero is a REGRESSION, zero is ok. Postures are compared null-safe."""
    c = current.select(key, F.col(value).alias("now"), F.col(cv).alias("now_cv"), F.col(posture).alias("now_posture"))
    b = baseline.select(key, F.col(value).alias("then"), F.col(cv).alias("then_cv"), F.col(posture).alias("then_posture"), F.lit(True).alias("known"))
    noisy = (F.coalesce("now_cv", F.lit(0.0)) > max_cv) | (F.coalesce("then_cv", F.lit(0.0)) > max_cv)
    early = F.when(F.col("known").isNull(), "new_stage").when(noisy, "noise_ineligible").when(~F.col("now_posture").eqNullSafe(F.col("then_posture")), "posture_mismatch")
    ratio = F.when(early.isNull(), F.try_divide("now", "then"))
    late = F.when(ratio > 1 + tolerance, "REGRESSION").when(ratio < 1.0, "faster").when(ratio.isNull() & (F.col("now") > 0), "REGRESSION").otherwise("ok")
    return c.join(b, key, "left").select(key, "now", "then", ratio.alias("ratio"), F.coalesce(early, late).alias("verdict"))


def census(expected: DataFrame, actual: DataFrame, key: str, checks: dict[str, str]) -> DataFrame:
    """Counts of missing, unexpected and, for each check (name: column), mismatched keys, by a full outer join."""
    e = expected.select(F.col(key).alias("k"), *[F.col(c).alias(f"e_{n}") for n, c in checks.items()], F.lit(True).alias("e"))
    a = actual.select(F.col(key).alias("k"), *[F.col(c).alias(f"a_{n}") for n, c in checks.items()], F.lit(True).alias("a"))
    both = F.col("e").isNotNull() & F.col("a").isNotNull()
    counts = [F.count_if(F.col("a").isNull()).alias("missing"), F.count_if(F.col("e").isNull()).alias("unexpected")]
    counts += [F.count_if(both & ~F.col(f"e_{n}").eqNullSafe(F.col(f"a_{n}"))).alias(f"wrong_{n}") for n in checks]
    return e.join(a, "k", "full_outer").agg(*counts)


def set_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, with the side, by two anti joins."""
    a = left.select(key).distinct().join(right.select(key), key, "left_anti").withColumn("side", F.lit("missing"))
    b = right.select(key).distinct().join(left.select(key), key, "left_anti").withColumn("side", F.lit("unexpected"))
    return a.unionByName(b)


def overlaps(ranges: DataFrame, group: list[str], begin: str, end: str, tie: list[str]) -> DataFrame:
    """Half-open ranges that begin before an earlier one of their group ends; empty ranges are ignored.

    One sort per group and a running maximum, not a range join.
    """
    line = Window.partitionBy(*group).orderBy(begin, end, *tie)
    before = F.max(end).over(line.rowsBetween(Window.unboundedPreceding, -1))
    return ranges.where(F.col(begin) < F.col(end)).withColumn("previous_end", before).where(F.col("previous_end") > F.col(begin))


def verified(files: DataFrame, manifest: DataFrame, key: str = "path") -> DataFrame:
    """Manifest rows whose file is missing or differs in sha256 or size."""
    m = manifest.select(key, F.col("sha256").alias("want_sha"), F.col("size").alias("want_size"))
    f = files.select(key, F.col("sha256").alias("got_sha"), F.col("size").alias("got_size"))
    problem = F.when(F.col("got_sha").isNull(), "missing").when(F.col("got_size") != F.col("want_size"), "size").when(F.col("got_sha") != F.col("want_sha"), "sha256")
    return m.join(f, key, "left").withColumn("problem", problem).where("problem IS NOT NULL").select(key, "problem")


def positional_join(slots: DataFrame, features: DataFrame, slot_order: list[str], feature_order: list[str]) -> DataFrame:
    """The k-th slot receives the k-th feature; positions come from a range sort and per-partition counts. A slot without
    a feature, or a feature without a slot, is an error."""
    left, right = ordinal(slots, slot_order, "k").withColumn("_a", F.lit(True)), ordinal(features, feature_order, "k").withColumn("_b", F.lit(True))
    whole = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    fits = F.when(whole, True).otherwise(F.raise_error(F.concat(F.lit("slots and features differ in number from place "), F.col("k").cast("string"))))
    return left.join(right, "k", "full_outer").where(fits).drop("_a", "_b")


def ordinal(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """0-based position in a total order, without a single-partition window: partitions are ordered ranges, and only
    their row counts are summed globally."""
    ranged = storage.materialize(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ordinal")
    local = Window.partitionBy("_part").orderBy(*order)
    placed = ranged.withColumn("_at", F.row_number().over(local) - 1)
    counts = ranged.groupBy("_part").count()
    base = counts.select("_part", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    return placed.join(base, "_part").withColumn(name, (F.col("_base") + F.col("_at")).cast("long")).drop("_part", "_at", "_base")


def evidence(arms: dict[str, DataFrame], key: str, provenance: str) -> DataFrame:
    """One row per key from arms that must agree: ``provenance`` and the other columns of each arm under its name. A key that an
    arm lacks, or for which two arms come from different sources, is an error."""
    names = list(arms)
    held = None
    for name, rows in arms.items():
        own = rows.select(key, *[F.col(c).alias(f"{name}_{c}") for c in rows.columns if c != key], F.lit(True).alias(f"_has_{name}"))
        held = own if held is None else held.join(own, key, "full_outer")
    has = [F.col(f"_has_{n}").isNotNull() for n in names]
    same = [F.col(f"{names[0]}_{provenance}").eqNullSafe(F.col(f"{n}_{provenance}")) for n in names[1:]]
    whole = F.forall(F.array(*has), lambda x: x)
    says = lambda what: F.raise_error(F.concat(F.lit(f"{what} for "), F.col(key).cast("string"))).cast("boolean")
    agree = F.forall(F.array(F.lit(True), *same), lambda x: x)
    checked = held.where(F.when(~whole, says("an arm is missing")).when(~agree, says("arms of different provenance")).otherwise(True))
    return checked.select(key, F.col(f"{names[0]}_{provenance}").alias(provenance), *[c for c in checked.columns if c != key and not c.startswith("_has_") and not c.endswith(f"_{provenance}")])


def first_existing(wanted: DataFrame, folders: list[str], existing: DataFrame, key: str, names: str) -> DataFrame:
    """key, path: the first folder and, within it, the first name (an array in order of preference) for which a path exists;
    null where none does. ``folders`` are few: they are an array in the plan."""
    place = F.explode(F.array(*[F.struct(F.lit(i).alias("dir"), F.lit(f).alias("folder")) for i, f in enumerate(folders)]))
    tried = wanted.select(key, F.posexplode(names).alias("nth", "name")).withColumn("f", place).select(key, F.struct("f.dir", "nth").alias("order"), F.concat_ws("/", "f.folder", "name").alias("path"))
    found = tried.join(existing.select("path").distinct(), "path").groupBy(key).agg(F.min_by("path", "order").alias("path"))
    return wanted.select(key).join(found, key, "left")
