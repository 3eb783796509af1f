"""Weight conversion: tensors classified by name, their rows quantised, shapes kept apart from values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import tensors, vectors


def convert(rows: DataFrame, switches: dict[str, str] | None = None) -> DataFrame:
    """name, row, policy, q, scale, v: rows of tensors under an int8 policy carry q and scale, the others v. ``switches`` turns
    gated kinds on (truthy text)."""
    kind = tensors.policy(F.col("name"))
    switch = F.try_element_at(F.create_map(*[F.lit(x) for kv in (switches or {"": ""}).items() for x in kv]), kind)
    settled = rows.withColumn("policy", tensors.resolve(kind, switch))
    q = F.when(F.col("policy") == "int8", vectors.int8_rows(F.col("v")))
    return settled.withColumn("r", q).select("name", "row", "policy", F.col("r.q").alias("q"), F.col("r.scale").alias("scale"), F.when(F.col("r").isNull(), F.col("v")).alias("v"))


def restore(q: Column, scale: Column) -> Column:
    return F.transform(q, lambda x: (x * scale).cast("float"))


#: Rows of a head matrix at most; a larger one is multiplied by block_product.
HEAD_ROWS = 4096


def head_product(rows: DataFrame, q: str, head: DataFrame, name: str, w: str) -> DataFrame:
    """Every row with every row of a small matrix: adds ``name`` and product, exact for whole numbers. The matrix goes into the
    expression, so nothing is joined; one of more than HEAD_ROWS rows is an error."""
    held = head.select(name, w).orderBy(name).limit(HEAD_ROWS + 1).collect()
    if len(held) > HEAD_ROWS:
        raise ValueError(f"a head of more than {HEAD_ROWS} rows")
    if not held:
        return rows.limit(0).select("*", F.lit(None).cast(head.schema[name].dataType).alias(name), F.lit(0).cast("long").alias("product"))
    cells = F.array(*[F.struct(F.lit(r[0]).alias("n"), F.array(*[F.lit(int(x)).cast("long") for x in r[1]]).alias("w")) for r in held])
    each = rows.withColumn("_head", F.explode(cells))
    return each.withColumns({name: F.col("_head.n"), "product": vectors.int_dot(F.col(q), F.col("_head.w"))}).drop("_head")


def block_product(left: DataFrame, right: DataFrame) -> DataFrame:
    """i, j, product of the rows of left (i, v) and the columns of right (j, v): cells meet on their place k, products are summed,
    half-way in every task. Works at any size of either side."""
    cells = lambda x, n: x.select(n, F.posexplode("v").alias("k", f"{n}_v"))
    met = cells(left, "i").join(cells(right, "j"), "k")
    return met.groupBy("i", "j").agg(F.sum(F.col("i_v").cast("double") * F.col("j_v")).alias("product"))


def int8_product(left: DataFrame, right: DataFrame) -> DataFrame:
    """i, j, whole, product: exact whole-number products of the rows of left (i, q, scale) and of right (j, q, scale), a layer's
    rows (see head_product), and the same scaled by both."""
    scales = right.select("j", F.col("scale").alias("s"))
    pairs = head_product(left, "q", right, "j", "q").withColumnRenamed("product", "whole").join(scales, "j")
    return pairs.select("i", "j", "whole", (F.col("whole") * F.col("scale") * F.col("s")).alias("product"))


def int4_dot(x: Column, packed: Column, scales: Column, group: int) -> Column:
    """A vector times a row of packed four-bit values: whole sums per group, scaled group by group."""
    w = vectors.int4_unpack(packed)
    part = lambda s, i: F.aggregate(F.zip_with(F.slice(x, i * group + 1, group), F.slice(w, i * group + 1, group), lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v) * s
    return F.aggregate(F.transform(scales, part), F.lit(0.0), lambda t, v: t + v)
