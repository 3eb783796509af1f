"""Queries of statistics, windows, allocation and vectors."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quire.functions import imaging as pixels
from quire.functions import stats, vectors
from quire.functions.tensors import policy
from quire.operators import alloc, envelope, imaging, quantise, sequences
from quire.plans.base import query, table


def r6(c: str):
    return F.round(c, 6).alias(c)


@query("""SELECT event_type, count(value) AS n, min(value) AS min, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99,
round(stddev_samp(value) / avg(value) * 100, 6) AS cv_pct, round(quantile_cont(value, 0.9), 6) AS q90 FROM events GROUP BY event_type""")
def q34_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    found = stats.sample_stats(table(spark, folder, "events"), ["event_type"], "value", q90=stats.between(0.9))
    return found.select("event_type", "n", "min", r6("mean"), r6("median"), "p95", "p99", r6("cv_pct"), r6("q90"))


_SCALED = "SELECT event_type, value / max(value) OVER (PARTITION BY event_type) AS x FROM events"


def scaled(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return e.join(e.groupBy("event_type").agg(F.max("value").alias("top")), "event_type").select("event_type", "event_id", (F.col("value") / F.col("top")).alias("x"))


@query(f"""WITH e AS ({_SCALED}), n AS (SELECT *, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY x DESC) AS r FROM e),
k AS (SELECT *, least(greatest(ceil(0.1::DOUBLE * n - 1e-12::DOUBLE), 1), n) AS k FROM n),
c AS (SELECT event_type, sum(x * CASE WHEN r < k THEN 1.0::DOUBLE ELSE least(greatest(0.1::DOUBLE * n - (k - 1), 0.0::DOUBLE), 1.0::DOUBLE) END) / (0.1::DOUBLE * any_value(n)) AS cvar FROM k WHERE r <= k GROUP BY event_type),
v AS (SELECT event_type, quantile_cont(x, 0.9) AS var FROM e GROUP BY event_type)
SELECT event_type, round(cvar, 6) AS cvar, round(var, 6) AS var FROM c JOIN v USING (event_type)""")
def q35_cvar_var(spark: SparkSession, folder: str) -> DataFrame:
    e = scaled(spark, folder)
    var = stats.quantiles(e, ["event_type"], "x", {"var": stats.between(0.9)})
    return stats.cvar(e, ["event_type"], "x", 0.1).join(var, "event_type").select("event_type", r6("cvar"), r6("var"))


_GPD = f"""e AS ({_SCALED}), c AS (SELECT event_type, quantile_cont(x, 0.85) AS threshold, count(*) AS n, quantile_cont(x, 0.99) AS empirical FROM e GROUP BY event_type),
x AS (SELECT e.event_type, threshold, n, empirical, x - threshold AS e FROM e JOIN c USING (event_type) WHERE x > threshold),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY e) AS j, count(*) OVER (PARTITION BY event_type) AS m FROM x),
b AS (SELECT event_type, threshold, n, m, empirical, avg(e) AS b0, avg((1 - (j - 0.35::DOUBLE) / m) * e) AS b1 FROM r GROUP BY event_type, threshold, n, m, empirical),
g AS (SELECT *, 2 - b0 / (b0 - 2 * b1) AS xi, 2 * b0 * b1 / (b0 - 2 * b1) AS beta FROM b)"""


@query(f"""WITH {_GPD} SELECT event_type, round(threshold, 6) AS threshold, m, n, round(xi, 6) AS xi, round(beta, 6) AS beta,
round(least(greatest(greatest(threshold + beta / xi * (pow(n::DOUBLE / m * 0.01::DOUBLE, -xi) - 1), empirical), 0), 1), 6) AS tail FROM g""")
def q36_gpd_pwm(spark: SparkSession, folder: str) -> DataFrame:
    e = scaled(spark, folder)
    fit = stats.tail_fit(e, ["event_type"], "x", 0.15)
    empirical = stats.quantiles(e, ["event_type"], "x", {"empirical": stats.between(0.99)})
    joined = fit.join(empirical, "event_type")
    return joined.withColumn("tail", stats.tail_quantile(joined, 0.99, F.col("empirical"))).select("event_type", r6("threshold"), "m", "n", r6("xi"), r6("beta"), r6("tail"))


_HALF = """SELECT event_type, sum(x * CASE WHEN r < k THEN 1.0::DOUBLE ELSE least(greatest(0.1::DOUBLE * n - (k - 1), 0.0::DOUBLE), 1.0::DOUBLE) END) / (0.1::DOUBLE * any_value(n)) AS cvar FROM
(SELECT *, least(greatest(ceil(0.1::DOUBLE * n - 1e-12::DOUBLE), 1), n) AS k FROM (SELECT *, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY x DESC) AS r FROM e WHERE event_id % 2 = {0})) WHERE r <= k GROUP BY event_type"""


@query(f"""WITH e AS (SELECT event_type, event_id, value / max(value) OVER (PARTITION BY event_type) AS x FROM events), a AS ({_HALF.format(0)}), b AS ({_HALF.format(1)})
SELECT event_type, round(a.cvar, 6) AS baseline, round(b.cvar, 6) AS candidate, b.cvar <= a.cvar + 0.01::DOUBLE + 1e-12::DOUBLE AS passed FROM a JOIN b USING (event_type)""")
def q37_tail_gate(spark: SparkSession, folder: str) -> DataFrame:
    e = scaled(spark, folder)
    side = lambda k, name: stats.cvar(e.where(F.col("event_id") % 2 == k), ["event_type"], "x", 0.1).withColumnRenamed("cvar", name)
    both = side(0, "baseline").join(side(1, "candidate"), "event_type")
    return both.withColumn("passed", F.col("candidate") <= F.col("baseline") + 0.01 + 1e-12).select("event_type", r6("baseline"), r6("candidate"), "passed")


@query("""WITH s AS (SELECT lang, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS passed FROM documents JOIN labels USING (doc_id) GROUP BY lang)
SELECT lang, n, passed, floor((CASE WHEN n < 20 THEN passed::DOUBLE / n ELSE greatest(passed::DOUBLE / n - sqrt(ln(20::DOUBLE) / (2 * n)), 0) END) * 1e6::DOUBLE) / 1e6::DOUBLE AS bound FROM s""")
def q38_hoeffding_bound(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "documents").select("doc_id", "lang").join(table(spark, folder, "labels"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("passed"))
    return s.withColumn("bound", stats.hoeffding_lower(F.col("passed"), F.col("n"), 0.05))


@query()
def q39_jeffreys_bound(spark: SparkSession, folder: str) -> DataFrame:
    """The lower of the Jeffreys quantile and the Hoeffding bound, per language."""

    @pandas_udf("double")
    def jeffreys(passed: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([stats.beta_quantile(0.05, p + 0.5, m - p + 0.5) for p, m in zip(passed, n, strict=True)])

    s = q38_hoeffding_bound(spark, folder).withColumnRenamed("bound", "hoeffding")
    low = F.floor(F.least(jeffreys("passed", "n"), F.col("hoeffding")) * 1e6) / 1e6
    return s.withColumn("bound", F.when(F.col("n") < 20, F.col("hoeffding")).otherwise(low))


@query("""WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL)
SELECT c_nationkey, max_by(c_mktsegment, (n, c_mktsegment)) AS majority, max(n) AS votes, CAST(sum(n) AS BIGINT) AS keyed FROM c GROUP BY c_nationkey""")
def q40_majority_minority(spark: SparkSession, folder: str) -> DataFrame:
    return stats.majority(table(spark, folder, "customer"), ["c_nationkey"], "c_mktsegment")


@query("""WITH h AS (SELECT CAST(l_quantity * 5 AS INTEGER) AS v, count(*) AS n FROM lineitem GROUP BY 1), t AS (SELECT *, sum(n) OVER () AS total, sum(n * v) OVER () AS mass, sum(n) OVER (ORDER BY v) AS w0, sum(n * v) OVER (ORDER BY v) AS s0 FROM h),
b AS (SELECT v, w0::DOUBLE * (total - w0)::DOUBLE * pow(s0::DOUBLE / w0 - (mass - s0)::DOUBLE / (total - w0), 2) AS var FROM t WHERE w0 < total)
SELECT CAST(arg_min(v, (-var, v)) AS INTEGER) AS threshold FROM b""")
def q41_otsu(spark: SparkSession, folder: str) -> DataFrame:
    h = table(spark, folder, "lineitem").groupBy((F.col("l_quantity") * 5).cast("int").alias("v")).agg(F.count("*").alias("n"))
    whole, line = Window.partitionBy(), Window.orderBy("v")
    t = h.select("v", F.sum("n").over(whole).alias("total"), F.sum(F.col("n") * F.col("v")).over(whole).alias("mass"), F.sum("n").over(line).alias("w0"), F.sum(F.col("n") * F.col("v")).over(line).alias("s0")).where("w0 < total")
    gap = F.col("s0") / F.col("w0") - (F.col("mass") - F.col("s0")) / (F.col("total") - F.col("w0"))
    var = F.col("w0").cast("double") * (F.col("total") - F.col("w0")).cast("double") * gap * gap
    return t.agg(F.min_by("v", F.struct((-var).alias("x"), "v")).alias("threshold"))


_DAYS = "SELECT event_type, CAST(day(ts) AS BIGINT) AS d, count(*) AS n FROM events GROUP BY ALL"


@query(f"""WITH c AS ({_DAYS}), p AS (SELECT *, max(n) OVER (PARTITION BY event_type) AS peak FROM c), i AS (SELECT event_type, d, d - row_number() OVER (PARTITION BY event_type ORDER BY d) AS run FROM p WHERE n * 10 >= peak * 8)
SELECT event_type, min(d) AS begin, max(d) AS end, CAST(floor((min(d) + max(d)) / 2.0) AS BIGINT) AS centre FROM i GROUP BY event_type, run""")
def q42_band_islands(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "events").groupBy("event_type", F.dayofmonth("ts").cast("long").alias("d")).agg(F.count("*").alias("n"))
    p = c.withColumn("peak", F.max("n").over(Window.partitionBy("event_type")))
    return sequences.islands(p, ["event_type"], "d", F.col("n") * 10 >= F.col("peak") * 8)


@query(f"WITH c AS ({_DAYS}) SELECT event_type, round(var_pop(n), 6) AS variance FROM c GROUP BY event_type")
def q43_profile_variance(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "events").groupBy("event_type", F.dayofmonth("ts").alias("d")).agg(F.count("*").alias("n"))
    return c.groupBy("event_type").agg(F.round(F.var_pop("n"), 6).alias("variance"))


@query("""WITH t AS (SELECT l_linenumber::DOUBLE AS n, l_linenumber * 100.0::DOUBLE / (1 + 0.05::DOUBLE * (l_linenumber - 1) + 0.002::DOUBLE * l_linenumber * (l_linenumber - 1)) + (count(*) % 5)::DOUBLE AS c FROM lineitem GROUP BY l_linenumber),
b AS (SELECT arg_min(c, n) AS base, min(n) AS n0 FROM t), p AS (SELECT base, n - 1 AS x1, n * (n - 1) AS x2, n / (c / base * n0) - 1 AS y FROM t, b WHERE n > 1 AND c > 0),
s AS (SELECT base, sum(x1 * x1) AS a, sum(x1 * x2) AS b, sum(x2 * x2) AS c, sum(x1 * y) AS d, sum(x2 * y) AS e FROM p GROUP BY base),
f AS (SELECT base, (d * c - e * b) / (a * c - b * b) AS alpha, (a * e - b * d) / (a * c - b * b) AS beta FROM s)
SELECT round(base, 6) AS base, round(alpha, 6) AS alpha, round(beta, 6) AS beta, round(CASE WHEN beta > 0 THEN sqrt((1 - alpha) / beta) END, 4) AS peak FROM f""")
def q44_usl_fit(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("l_linenumber").cast("double")
    t = table(spark, folder, "lineitem").groupBy("l_linenumber").agg(F.count("*").alias("k")).select(n.alias("n"), (n * 100.0 / (1 + 0.05 * (n - 1) + 0.002 * n * (n - 1)) + (F.col("k") % 5).cast("double")).alias("c"))
    return stats.usl_fit(t, "n", "c").select(r6("base"), r6("alpha"), r6("beta"), F.round("peak", 4).alias("peak"))


@query("""WITH e AS (SELECT user_id, event_id, sum(ln(1 + 0.8::DOUBLE * ((event_type = 'error')::INT - 0.15::DOUBLE))) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS log_e FROM events)
SELECT user_id, round(max(log_e), 6) AS peak, max(log_e) >= ln(20::DOUBLE) AS crossed FROM e GROUP BY user_id""")
def q45_eprocess(spark: SparkSession, folder: str) -> DataFrame:
    e = sequences.e_process(table(spark, folder, "events"), ["user_id"], ["ts", "event_id"], (F.col("event_type") == "error").cast("int"), 0.8, 0.15, 0.05)
    return e.groupBy("user_id").agg(F.round(F.max("log_e"), 6).alias("peak"), F.max("crossed").alias("crossed"))


@query("SELECT p_partkey, min(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS repaired FROM part")
def q46_monotone_repair(spark: SparkSession, folder: str) -> DataFrame:
    return sequences.prefix_min(table(spark, folder, "part"), ["p_brand"], ["p_size", "p_partkey"], "p_retailprice", "repaired").select("p_partkey", "repaired")


@query("""WITH o AS (SELECT p_partkey, b AS bits, r AS rank, p_size * b AS rate, (p_retailprice / 100) / pow(2, b) AS dist FROM part, (VALUES (2, 3), (4, 2), (8, 1), (16, 0)) AS v(b, r)), g AS (SELECT * FROM o, (VALUES (0.001::DOUBLE), (0.01::DOUBLE), (0.1::DOUBLE)) AS l(price)),
c AS (SELECT price, p_partkey, arg_min(rate, (dist + price * rate, rank)) AS rate, arg_min(dist, (dist + price * rate, rank)) AS dist FROM g GROUP BY ALL)
SELECT price, CAST(sum(rate) AS BIGINT) AS rate, round(sum(dist), 4) AS dist FROM c GROUP BY price""")
def q47_lambda_argmin(spark: SparkSession, folder: str) -> DataFrame:
    options = F.explode(F.array(*[F.struct(F.lit(b).alias("bits"), F.lit(r).alias("rank")) for b, r in ((2, 3), (4, 2), (8, 1), (16, 0))]))
    o = table(spark, folder, "part").select("p_partkey", "p_size", "p_retailprice", options.alias("o")).select("p_partkey", F.col("o.rank").alias("rank"), (F.col("p_size") * F.col("o.bits")).alias("rate"), (F.col("p_retailprice") / 100 / F.pow(F.lit(2.0), F.col("o.bits"))).alias("dist"))
    g = o.withColumn("price", F.explode(F.array(F.lit(0.001), F.lit(0.01), F.lit(0.1))))
    cost = F.struct((F.col("dist") + F.col("price") * F.col("rate")).alias("c"), "rank")
    chosen = g.groupBy("price", "p_partkey").agg(F.min_by(F.struct("rate", "dist"), cost).alias("o"))
    return chosen.groupBy("price").agg(F.sum("o.rate").alias("rate"), F.round(F.sum("o.dist"), 4).alias("dist"))


_NAME = """SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'model.layers.' || p_size || '.self_attn.q_proj.weight' WHEN 1 THEN 'model.layers.' || p_size || '.mlp.experts.3.down_proj.weight' WHEN 2 THEN 'model.norm.weight'
WHEN 3 THEN 'model.vision_model.patch_embed.bias' WHEN 4 THEN 'layers.' || p_size || '.mlp.gate.weight' WHEN 5 THEN 'model.layers.' || p_size || '.input_layernorm.weight' ELSE 'lm_head.weight' END AS name FROM part"""


@query(rf"""WITH n AS ({_NAME}) SELECT p_partkey, name, CASE WHEN starts_with(name, 'model.vision_model.') OR ends_with(name, '.mlp.gate.weight') OR contains(name, 'layernorm') OR name = 'model.norm.weight' THEN 'keep'
WHEN regexp_matches(name, '\.self_attn\..*[qkvo]_proj\.weight$') THEN 'gated_attention' WHEN name = 'lm_head.weight' THEN 'gated_lm_head' WHEN regexp_matches(name, '^model\.layers\..*\.mlp\..*(gate|up|down)_proj\.weight$') THEN 'int8' ELSE 'keep' END AS policy FROM n""".replace("\\\\", "\\"))
def q49_tensor_policy(spark: SparkSession, folder: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    around = lambda a, b: F.concat(F.lit(a), size, F.lit(b))
    names = [around("model.layers.", ".self_attn.q_proj.weight"), around("model.layers.", ".mlp.experts.3.down_proj.weight"), F.lit("model.norm.weight"), F.lit("model.vision_model.patch_embed.bias"), around("layers.", ".mlp.gate.weight"), around("model.layers.", ".input_layernorm.weight"), F.lit("lm_head.weight")]
    name = F.element_at(F.array(*names), (F.col("p_partkey") % 7 + 1).cast("int"))
    return table(spark, folder, "part").select("p_partkey", name.alias("name")).withColumn("policy", policy(F.col("name")))


_INT8 = """SELECT vec_id, CASE WHEN m = 0 THEN 1::FLOAT ELSE m / 127::FLOAT END AS scale, embedding AS v FROM (SELECT *, list_max(list_transform(embedding, lambda x: abs(x))) AS m FROM embeddings)"""
_Q8 = "list_transform(v, lambda x: CAST(greatest(least(round_even(CAST(x / scale AS FLOAT)::DOUBLE, 0), 127), -127) AS BIGINT))"


@query(f"SELECT vec_id, scale, array_to_string({_Q8}, ',') AS q FROM ({_INT8})")
def q50_int8_quant(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings").select("vec_id", vectors.int8_rows(F.col("embedding")).alias("r"))
    return e.select("vec_id", F.col("r.scale").alias("scale"), F.array_join(F.transform("r.q", lambda x: x.cast("string")), ",").alias("q"))


@query("""WITH b AS (SELECT vec_id, embedding AS v, least(list_min(embedding)::DOUBLE, 0) AS lo, greatest(list_max(embedding)::DOUBLE, 0) AS hi FROM embeddings), s AS (SELECT *, CASE WHEN hi = lo THEN 1.0::DOUBLE ELSE (hi - lo) / 255.0::DOUBLE END AS scale FROM b),
z AS (SELECT *, greatest(least(round_even(-lo / scale, 0), 255), 0) AS zero FROM s)
SELECT vec_id, round(scale, 9) AS scale, CAST(zero AS BIGINT) AS zero, array_to_string(list_transform(v, lambda x: CAST(greatest(least(round_even(x::DOUBLE / scale, 0) + zero, 255), 0) AS BIGINT)), ',') AS q FROM z""")
def q51_u8_quant(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings").select("vec_id", vectors.u8_rows(F.col("embedding")).alias("r"))
    return e.select("vec_id", F.round("r.scale", 9).alias("scale"), F.col("r.zero").alias("zero"), F.array_join(F.transform("r.q", lambda x: x.cast("string")), ",").alias("q"))


@query(f"""WITH q AS (SELECT vec_id, label, {_Q8} AS q FROM (SELECT i.*, e.label FROM ({_INT8}) i JOIN embeddings e USING (vec_id))), p AS (SELECT label AS probe, arg_min(q, vec_id) AS w FROM q GROUP BY label)
SELECT vec_id, probe, CAST(list_sum(list_transform(range(1, len(q) + 1), lambda i: q[i] * w[i])) AS BIGINT) AS product FROM q, p""")
def q52_int8_gemm(spark: SparkSession, folder: str) -> DataFrame:
    """All quantised rows times a matrix of one row per label, its first; a label's row is what a head would hold."""
    q = table(spark, folder, "embeddings").select("vec_id", "label", vectors.int8_rows(F.col("embedding"))["q"].alias("q"))
    head = q.groupBy(F.col("label").alias("probe")).agg(F.min_by("q", "vec_id").alias("w"))
    return quantise.head_product(q, "q", head, "probe", "w").select("vec_id", "probe", "product")


@query("""WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: exp(x::DOUBLE - list_max(embedding)::DOUBLE)) AS e FROM embeddings), u AS (SELECT vec_id, unnest(range(0, len(e))) AS idx, unnest(list_transform(e, lambda x: x / list_sum(e))) AS w FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY w DESC, idx) AS slot FROM u), t AS (SELECT * FROM r WHERE slot <= 6)
SELECT vec_id, CAST(idx AS INTEGER) AS idx, CAST(slot - 1 AS INTEGER) AS slot, round(w / (sum(w) OVER (PARTITION BY vec_id) + 1e-20::DOUBLE), 6) AS weight FROM t""")
def q53_softmax_topk(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "embeddings").select("vec_id", vectors.top_k(vectors.softmax(F.transform("embedding", lambda x: x.cast("double"))), 6).alias("t"))
    w = vectors.renormalise(F.transform("t", lambda x: x["score"]))
    return p.select("vec_id", F.posexplode(F.arrays_zip(F.transform("t", lambda x: x["idx"]).alias("idx"), w.alias("weight"))).alias("slot", "x")).select("vec_id", F.col("x.idx").alias("idx"), "slot", F.round("x.weight", 6).alias("weight"))


@query("""WITH u AS (SELECT vec_id, label, unnest(range(0, len(embedding))) AS expert, unnest(embedding)::DOUBLE AS x FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, expert) AS slot FROM u)
SELECT CAST(expert AS INTEGER) AS expert, count(*) AS tokens, round(sum(x), 4) AS total FROM r WHERE slot <= 6 GROUP BY expert""")
def q18_expert_dispatch(spark: SparkSession, folder: str) -> DataFrame:
    routed = table(spark, folder, "embeddings").select("vec_id", F.explode(vectors.top_k(F.transform("embedding", lambda x: x.cast("double")), 6)).alias("t"))
    return routed.groupBy(F.col("t.idx").alias("expert")).agg(F.count("*").alias("tokens"), F.round(F.sum("t.score"), 4).alias("total"))


@query("""SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS best, round((list_reverse_sort(embedding)[1] - list_reverse_sort(embedding)[2])::DOUBLE, 5) AS margin FROM embeddings""")
def q54_row_argmax(spark: SparkSession, folder: str) -> DataFrame:
    v = F.col("embedding")
    return table(spark, folder, "embeddings").select("vec_id", vectors.argmax(v).alias("best"), F.round(vectors.margin(v).cast("double"), 5).alias("margin"))


@query("""WITH u AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(embedding) AS x FROM embeddings), c AS (SELECT vec_id, (i // 8) // 2 * 4 + (i % 8) // 2 AS block, (i // 8) % 2 * 2 + i % 2 AS cell, x FROM u)
SELECT vec_id, CAST(block AS INTEGER) AS block, round(sum(x::DOUBLE * (cell + 1)), 6) AS digest FROM c GROUP BY ALL""")
def q55_space_to_depth(spark: SparkSession, folder: str) -> DataFrame:
    b = table(spark, folder, "embeddings").select("vec_id", F.posexplode(vectors.space_to_depth(F.col("embedding"), 8, 2)).alias("block", "cells"))
    digest = F.aggregate(F.transform("cells", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda t, x: t + x)
    return b.select("vec_id", "block", F.round(digest, 6).alias("digest"))


@query("""WITH u AS (SELECT label AS image, vec_id // 10 * 64 + unnest(range(0, 64)) AS place, CAST(floor((unnest(embedding)::DOUBLE + 1) * 127) AS INTEGER) AS v FROM embeddings), n AS (SELECT image, count(*) AS n FROM u GROUP BY image),
s AS (SELECT u.image, n, (v >> 3 << 10) | ((v * v % 256) >> 3 << 5) | ((255 - v) >> 3) AS key FROM u JOIN n USING (image) WHERE place % CAST(greatest(ceil(n / 4096.0), 1) AS BIGINT) = 0), b AS (SELECT image, count(DISTINCT key) AS keys, count(*) AS sampled FROM s GROUP BY image)
SELECT image, keys, sampled, CASE WHEN keys <= 64 OR keys::DOUBLE / sampled < 0.1::DOUBLE THEN 'png' ELSE 'jpeg' END AS format FROM b""")
def q63_figure_format(spark: SparkSession, folder: str) -> DataFrame:
    """The vectors of a label, one below the other, as a figure."""
    v = F.floor((F.col("e").cast("double") + 1) * 127).cast("int")
    u = table(spark, folder, "embeddings").select(F.col("label").alias("image"), "vec_id", F.posexplode("embedding").alias("i", "e")).select("image", (F.floor(F.col("vec_id") / 10) * 64 + F.col("i")).alias("at"), v.alias("v"))
    return imaging.figure_formats(u.select("image", "at", F.col("v").alias("r"), (F.col("v") * F.col("v") % 256).alias("g"), (255 - F.col("v")).alias("b")))


@query("""WITH h AS (SELECT user_id, event_id, ts, event_type IN ('error', 'signup') AS hit FROM events), i AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM h),
s AS (SELECT user_id, ts, event_id, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS streak FROM i)
SELECT user_id, CAST(max(streak) AS BIGINT) AS longest, max(streak) >= 3 AS tripped FROM s GROUP BY user_id""")
def q22_consecutive_hits(spark: SparkSession, folder: str) -> DataFrame:
    s = sequences.consecutive_hits(table(spark, folder, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type").isin("error", "signup"))
    return s.groupBy("user_id").agg(F.max("streak").alias("longest"), F.max("tripped").alias("tripped"))




@query()
def q48_waterfill(spark: SparkSession, folder: str) -> DataFrame:
    """Bits for parts under a total budget: 5 a unit of size on average."""
    options = F.explode(F.array(*[F.struct(F.lit(b).alias("bits"), F.lit(r).alias("rank")) for b, r in ((2, 3), (4, 2), (8, 1), (16, 0))]))
    o = table(spark, folder, "part").select("p_partkey", "p_size", "p_retailprice", options.alias("o"))
    o = o.select("p_partkey", F.col("o.rank").alias("rank"), (F.col("p_size") * F.col("o.bits")).cast("double").alias("rate"), (F.col("p_retailprice") / 100 / F.pow(F.lit(2.0), F.col("o.bits"))).alias("distortion"))
    budget = 5.0 * table(spark, folder, "part").agg(F.sum("p_size")).first()[0]
    return alloc.waterfill(o, "p_partkey", budget)


@query("""WITH r AS (SELECT user_id AS doc, event_id % 3 AS run, row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY ts, event_id) - 1 AS pos, CASE WHEN length(event_type) > 5 THEN 1 ELSE 0 END AS token, value AS logit FROM events),
s AS (SELECT doc, count(*) AS n_runs, min(n) AS compared FROM (SELECT doc, run, count(*) AS n FROM r GROUP BY ALL) GROUP BY doc),
a AS (SELECT doc, pos, n_runs, compared, count(DISTINCT token) > 1 AS apart, max(logit) - min(logit) AS spread FROM r JOIN s USING (doc) WHERE pos < compared GROUP BY ALL),
d AS (SELECT doc, n_runs, compared, coalesce(min(pos) FILTER (WHERE apart), compared) AS first_divergence, count(*) FILTER (WHERE apart) AS n_divergent, max(spread) AS spread FROM a GROUP BY doc, n_runs, compared)
SELECT doc, n_runs, compared, first_divergence, n_divergent, round(n_divergent::DOUBLE / compared, 8) AS divergence_rate, round(coalesce((SELECT max(a.spread) FROM a WHERE a.doc = d.doc AND a.pos < d.first_divergence), 0), 8) AS spread_in_prefix, round(spread, 8) AS spread FROM d""")
def q66_run_envelope(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    run = F.col("event_id") % 3
    line = Window.partitionBy("user_id", run).orderBy("ts", "event_id")
    rows = e.select(F.col("user_id").alias("doc"), run.alias("run"), (F.row_number().over(line) - 1).cast("long").alias("pos"), F.when(F.length("event_type") > 5, 1).otherwise(0).alias("token"), F.col("value").alias("logit"))
    found = envelope.envelope(rows)
    return found.withColumns({c: F.round(c, 8) for c in ("divergence_rate", "spread_in_prefix", "spread")})


@query("""WITH t AS (SELECT DISTINCT l_linenumber::DOUBLE AS n, l_linenumber * 100.0::DOUBLE / (1 + 0.05::DOUBLE * (l_linenumber - 1) + 0.02::DOUBLE * l_linenumber * (l_linenumber - 1)) AS c FROM lineitem),
b AS (SELECT arg_min(c, n) AS base, min(n) AS n0 FROM t), r AS (SELECT n, c / base * n0 AS c FROM t, b), p AS (SELECT n - 1 AS x1, n * (n - 1) AS x2, n / c - 1 AS y FROM r WHERE n > 1 AND c > 0),
s AS (SELECT sum(x1 * x1) AS a, sum(x1 * x2) AS b, sum(x2 * x2) AS c, sum(x1 * y) AS d, sum(x2 * y) AS e FROM p), f AS (SELECT (d * c - e * b) / (a * c - b * b) AS alpha, (a * e - b * d) / (a * c - b * b) AS beta FROM s),
q AS (SELECT alpha, beta, 1 - avg((c - n / (1 + alpha * (n - 1) + beta * n * (n - 1))) * (c - n / (1 + alpha * (n - 1) + beta * n * (n - 1)))) / var_pop(c) AS r2 FROM r, f GROUP BY ALL),
k AS (SELECT *, greatest(least(floor(sqrt((1 - alpha) / beta)), 16), 1) AS low, greatest(least(ceil(sqrt((1 - alpha) / beta)), 16), 1) AS high FROM q),
w AS (SELECT *, CASE WHEN beta <= 0 OR alpha >= 1 OR r2 < 0.9::DOUBLE THEN 8 WHEN high / (1 + alpha * (high - 1) + beta * high * (high - 1)) > low / (1 + alpha * (low - 1) + beta * low * (low - 1)) THEN high ELSE low END AS chosen FROM k)
SELECT round(alpha, 6) AS alpha, round(beta, 6) AS beta, round(r2, 6) AS r2, CAST(chosen AS INTEGER) AS chosen, CASE WHEN beta <= 0 OR alpha >= 1 OR r2 < 0.9::DOUBLE THEN 'fallback-physical-cores' WHEN chosen >= 16 THEN 'no-cap-needed' ELSE 'cap-at-usl-peak' END AS decision FROM w""")
def q67_pool_decision(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("l_linenumber").cast("double")
    t = table(spark, folder, "lineitem").groupBy("l_linenumber").agg(F.count("*").alias("k")).select(n.alias("n"), (n * 100.0 / (1 + 0.05 * (n - 1) + 0.02 * n * (n - 1))).alias("c"))
    return envelope.pool_decision(t, "n", "c", 16, 8).select(r6("alpha"), r6("beta"), r6("r2"), "chosen", "decision")


@query("""WITH g AS (SELECT vec_id AS image, unnest(range(0, 64)) AS i, unnest(embedding) AS e FROM embeddings), p AS (SELECT image, i // 8 AS y, i % 8 AS x, CAST(floor((e::DOUBLE + 1) * 127) AS INTEGER) AS v FROM g),
h AS (SELECT image, v, count(*) AS n FROM p GROUP BY ALL), t AS (SELECT image, v, sum(n) OVER w AS total, sum(n * v) OVER w AS mass, sum(n) OVER l AS w0, sum(n * v) OVER l AS s0 FROM h WINDOW w AS (PARTITION BY image), l AS (PARTITION BY image ORDER BY v)),
b AS (SELECT image, v, w0::DOUBLE * (total - w0)::DOUBLE * ((s0::DOUBLE / w0 - (mass - s0)::DOUBLE / (total - w0)) * (s0::DOUBLE / w0 - (mass - s0)::DOUBLE / (total - w0))) AS var FROM t WHERE w0 < total)
SELECT image, CAST(arg_min(v, (-var, v)) AS INTEGER) AS threshold FROM b GROUP BY image""")
def q68_image_thresholds(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as eight by eight images."""
    return imaging.otsu(_images(spark, folder))


def _images(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "embeddings").select(F.col("vec_id").alias("image"), F.posexplode("embedding").alias("i", "e"))
    return p.select("image", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).alias("x"), F.floor((F.col("e").cast("double") + 1) * 127).cast("int").alias("v"))


@query("""SELECT p_partkey, CAST(greatest(round_even(p_size::DOUBLE / (p_size + p_partkey % 50 + 1) * 640, 0), 1) AS INTEGER) AS edge, CAST(round_even((640 - greatest(round_even(p_size::DOUBLE / (p_size + p_partkey % 50 + 1) * 640, 0), 1)) * 0.5::DOUBLE, 0) AS INTEGER) AS inset,
CAST(17 * 16 + 1 + CASE WHEN (p_size % 3 + 1) * (p_size % 2 + 1) > 1 THEN (10 * (p_size % 3 + 1) + 1) * 10 * (p_size % 2 + 1) ELSE 0 END AS BIGINT) AS placeholders FROM part""")
def q69_tile_geometry(spark: SparkSession, folder: str) -> DataFrame:
    size = F.col("p_size")
    edge = pixels.fit_edge(size, size + F.col("p_partkey") % 50 + 1, 640)
    count = pixels.placeholders(F.lit(1024), F.lit(640), size % 3 + 1, size % 2 + 1)
    return table(spark, folder, "part").select("p_partkey", edge.alias("edge"), pixels.centre_offset(640, edge).alias("inset"), count.cast("long").alias("placeholders"))
