"""Queries of the run ledger, joins as gates, and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import stats
from quire.operators import gates, selection
from quire.plans.base import query, table
from quire.sources import ledger

_RUN = """SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS run_id, epoch_us(ts) // 1000 AS started_at,
  CAST(CASE WHEN event_type = 'error' THEN NULL ELSE epoch_us(ts) // 1000 + CAST(floor(value) AS BIGINT) END AS DOUBLE) AS finished_at,
  'user/' || user_id AS input_path, event_type AS mode,
  CASE WHEN contains(props, '1') THEN 'int8' WHEN contains(props, '2') THEN 'int4' ELSE 'none' END AS quant, 'v1' AS model_version_tag,
  CAST(CASE WHEN event_type = 'error' THEN 1 WHEN event_type = 'signup' THEN 6 ELSE 0 END AS BIGINT) AS exit_code,
  CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'signup' THEN 'cancelled' ELSE 'ok' END AS status
FROM events"""


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """Events as run records."""
    e = table(spark, folder, "events")
    started = F.unix_millis("ts") if dict(e.dtypes)["ts"] == "timestamp" else F.unix_millis(F.col("ts").cast("timestamp"))
    kind = lambda error, cancelled, ok: F.when(F.col("event_type") == "error", error).when(F.col("event_type") == "signup", cancelled).otherwise(ok)
    return e.select(
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("run_id"),
        started.alias("started_at"),
        F.when(F.col("event_type") != "error", started + F.floor("value").cast("long")).alias("finished_at"),
        F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("input_path"),
        F.col("event_type").alias("mode"),
        F.when(F.col("props").contains("1"), "int8").when(F.col("props").contains("2"), "int4").otherwise("none").alias("quant"),
        F.lit("v1").alias("model_version_tag"),
        kind(F.lit(1), F.lit(6), F.lit(0)).cast("long").alias("exit_code"),
        kind(F.lit("error"), F.lit("cancelled"), F.lit("ok")).alias("status"),
    )


def plain(records: DataFrame) -> DataFrame:
    """The one nullable whole number as a double, which both engines hand over alike when some are null."""
    return records.withColumn("finished_at", F.col("finished_at").cast("double"))


@query(f"SELECT * FROM ({_RUN}) ORDER BY started_at DESC, run_id DESC LIMIT 20")
def q01_runs_topk(spark: SparkSession, folder: str) -> DataFrame:
    return plain(ledger.top_runs(runs(spark, folder), 20))


@query(f"SELECT * FROM ({_RUN}) WHERE run_id = '000000000042'")
def q02_run_by_id(spark: SparkSession, folder: str) -> DataFrame:
    return plain(spark.sql("SELECT * FROM {runs} WHERE run_id = :id", args={"id": "000000000042"}, runs=runs(spark, folder)))


@query(_RUN)
def q03_runs_canonical(spark: SparkSession, folder: str) -> DataFrame:
    return plain(ledger.canonical(runs(spark, folder)))


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def q04_upsert_last_wins(spark: SparkSession, folder: str) -> DataFrame:
    """Even events are the store, odd ones the changes; then the last of each user over both."""
    e = table(spark, folder, "events")
    base = ledger.latest(e.where("event_id % 2 = 0"), ["user_id"], ["ts", "event_id"])
    return ledger.latest(base.unionByName(e.where("event_id % 2 = 1")), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query("SELECT event_type, CAST(CASE event_type WHEN 'error' THEN 1 WHEN 'signup' THEN 6 ELSE 0 END AS BIGINT) AS exit_code, CASE event_type WHEN 'error' THEN 'general' WHEN 'signup' THEN 'cancelled' ELSE 'ok' END AS kind, count(*) AS n FROM events GROUP BY event_type")
def q05_outcome_codes(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.when(F.col("exit_code") == 0, "ok").when(F.col("exit_code") == 6, "cancelled").otherwise("general")
    return runs(spark, folder).groupBy(F.col("mode").alias("event_type"), "exit_code").agg(F.count("*").alias("n")).withColumn("kind", kind)


@query("SELECT page_id, url FROM pages WHERE page_id + 1 IN (1, 5, 6, 7, 8, 9, 18)")
def q06_page_spec(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "pages")
    picked = selection.page_spec(spark, "1,5-9,18,6", p.agg(F.count("*")).first()[0])
    return p.join(picked, p.page_id == picked.page, "left_semi").select("page_id", "url")


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN h END AS half FROM pages, (VALUES ('left', 1), ('right', 2)) AS s(h, k) WHERE page_id % 3 = 0 OR k = 1""")
def q07_logical_pages(spark: SparkSession, folder: str) -> DataFrame:
    return selection.logical_pages(table(spark, folder, "pages").select("page_id", (F.col("page_id") % 3 == 0).alias("spread")), "spread").select("page_id", "half")


_QUALITY = """SELECT lang || '-' || CAST(n_chars // 200 AS VARCHAR) AS category, avg(quality::DOUBLE) AS bound FROM documents JOIN labels USING (doc_id) WHERE doc_id % 2 = {0} GROUP BY 1"""


@query(f"""WITH b AS ({_QUALITY.format(0)}), c AS ({_QUALITY.format(1)}),
j AS (SELECT coalesce(b.category, c.category) AS category, b.bound AS floor, c.bound AS bound FROM b FULL JOIN c ON b.category = c.category),
v AS (SELECT *, CASE WHEN bound IS NULL THEN 'DROPPED' WHEN floor IS NULL THEN 'NEW' WHEN bound < floor(floor * 1e6::DOUBLE) / 1e6::DOUBLE THEN 'LOWERED' WHEN bound > floor(floor * 1e6::DOUBLE) / 1e6::DOUBLE THEN 'RAISED' ELSE 'HELD' END AS verdict FROM j)
SELECT category, round(floor, 6) AS floor, round(bound, 6) AS bound, verdict, verdict IN ('DROPPED', 'LOWERED') AS rejected, verdict IN ('NEW', 'RAISED') AS raised FROM v""")
def q08_ratchet_full_outer(spark: SparkSession, folder: str) -> DataFrame:
    """Mean quality by language and length: even documents are the baseline, odd ones the candidate."""
    d = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id")
    d = d.select("doc_id", F.concat_ws("-", "lang", F.floor(F.col("n_chars") / 200).cast("string")).alias("category"), "quality")
    side = lambda k: d.where(F.col("doc_id") % 2 == k).groupBy("category").agg(F.avg(F.col("quality").cast("double")).alias("bound"))
    return gates.ratchet(side(0), side(1)).withColumns({"floor": F.round("floor", 6), "bound": F.round("bound", 6)})


_ARM = """SELECT event_type AS stage, min(value) AS best, stddev_samp(value) / avg(value) * 100 AS cv_pct, CASE WHEN count(*) % 3 = 0 THEN 'x' ELSE 'y' END AS posture FROM events WHERE {0} GROUP BY event_type"""


@query(f"""WITH c AS ({_ARM.format("day(ts) <= 15")}), b AS ({_ARM.format("day(ts) > 15 AND event_type <> 'view'")}),
j AS (SELECT c.stage, c.best AS now, b.best AS "then", CASE WHEN b.stage IS NULL THEN 'new_stage' WHEN coalesce(c.cv_pct, 0) > 100.5::DOUBLE OR coalesce(b.cv_pct, 0) > 100.5::DOUBLE THEN 'noise_ineligible' WHEN c.posture IS DISTINCT FROM b.posture THEN 'posture_mismatch' END AS early FROM c LEFT JOIN b ON c.stage = b.stage),
r AS (SELECT *, CASE WHEN early IS NULL AND "then" <> 0 THEN now / "then" END AS ratio FROM j)
SELECT stage, now, "then", round(ratio, 6) AS ratio, CASE WHEN early IS NOT NULL THEN early WHEN ratio > 1.1::DOUBLE THEN 'REGRESSION' WHEN ratio < 1 THEN 'faster' WHEN ratio IS NULL AND now > 0 THEN 'REGRESSION' ELSE 'ok' END AS verdict FROM r""")
def q10_stage_guardrail(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    arm = lambda x: x.groupBy(F.col("event_type").alias("stage")).agg(F.min("value").alias("best"), (F.stddev_samp("value") / F.avg("value") * 100).alias("cv_pct"), F.when(F.count("*") % 3 == 0, "x").otherwise("y").alias("posture"))
    late = (F.dayofmonth("ts") > 15) & (F.col("event_type") != "view")
    return gates.guardrail(arm(e.where(F.dayofmonth("ts") <= 15)), arm(e.where(late)), max_cv=100.5).withColumn("ratio", F.round("ratio", 6))


@query("""WITH a AS (SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events WHERE user_id % 2 = 0 GROUP BY 1),
b AS (SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events WHERE user_id % 2 = 1 GROUP BY 1)
SELECT event_type, a.p50 AS a_p50, a.p95 AS a_p95, a.p99 AS a_p99, b.p50 AS b_p50, b.p95 AS b_p95, b.p99 AS b_p99, round((b.p50 - a.p50) / a.p50 * 100, 6) AS delta_pct, round(a.p50 / b.p50, 6) AS speedup FROM a JOIN b USING (event_type)""")
def q11_ab_arms(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    ranks = lambda k: {f"{'ab'[k]}_p{n}": stats.nearest(p) for n, p in ((50, 0.5), (95, 0.95), (99, 0.99))}
    arms = selection.equal_keys_join(*[stats.quantiles(e.where(F.col("user_id") % 2 == k), ["event_type"], "value", ranks(k)) for k in (0, 1)], "event_type")
    return arms.withColumns({"delta_pct": F.round((F.col("b_p50") - F.col("a_p50")) / F.col("a_p50") * 100, 6), "speedup": F.round(F.col("a_p50") / F.col("b_p50"), 6)})


@query("""SELECT count(*) FILTER (WHERE l.doc_id IS NULL) AS missing, count(*) FILTER (WHERE d.doc_id IS NULL) AS unexpected, count(*) FILTER (WHERE d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL AND (d.n_chars % 2) IS DISTINCT FROM l.quality) AS wrong_shape,
count(*) FILTER (WHERE d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL AND (d.n_chars % 3 = 0)::INT IS DISTINCT FROM l.toxic) AS wrong_dtype FROM documents d FULL JOIN (SELECT doc_id + 50 AS doc_id, quality, toxic FROM labels) l ON d.doc_id = l.doc_id""")
def q12_census_anti(spark: SparkSession, folder: str) -> DataFrame:
    expected = table(spark, folder, "documents").select("doc_id", (F.col("n_chars") % 2).cast("int").alias("shape"), (F.col("n_chars") % 3 == 0).cast("int").alias("dtype"))
    actual = table(spark, folder, "labels").select((F.col("doc_id") + 50).alias("doc_id"), F.col("quality").alias("shape"), F.col("toxic").alias("dtype"))
    return gates.census(expected, actual, "doc_id", {"shape": "shape", "dtype": "dtype"})


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, epoch_us(l_shipdate) // 86400000000 AS b, epoch_us(l_shipdate) // 86400000000 + CAST(l_quantity AS BIGINT) AS e FROM lineitem),
w AS (SELECT *, max(e) OVER (PARTITION BY l_orderkey ORDER BY b, e, l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM r WHERE b < e)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(b AS BIGINT) AS b, CAST(e AS BIGINT) AS e, CAST(p AS BIGINT) AS previous_end FROM w WHERE p > b""")
def q13_interval_overlap(spark: SparkSession, folder: str) -> DataFrame:
    begin = F.floor(F.unix_millis(F.col("l_shipdate").cast("timestamp")) / 86400000).cast("long")
    ranges = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", begin.alias("b"), (begin + F.col("l_quantity").cast("long")).alias("e"))
    return gates.overlaps(ranges, ["l_orderkey"], "b", "e", ["l_linenumber", "l_partkey", "l_suppkey"])


@query("SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(i * j AS INTEGER) AS product FROM range(1, 33) a(i), range(1, 33) b(j) WHERE i * j BETWEEN 2 AND 32")
def q14_theta_ratios(spark: SparkSession, folder: str) -> DataFrame:
    return selection.ratio_grid(spark, 2, 32)


@query("""WITH g AS (SELECT i, j FROM range(1, 33) a(i), range(1, 33) b(j) WHERE i * j BETWEEN 2 AND 9),
r AS (SELECT i, j, row_number() OVER (ORDER BY i * j, i, j) AS pos FROM g),
p AS (SELECT p_partkey, p_size::DOUBLE AS w, (p_retailprice / 100)::DOUBLE AS h FROM part),
s AS (SELECT p_partkey, w, h, list({'i': i, 'j': j, 'd': abs(w / h - i::DOUBLE / j)} ORDER BY pos) AS c FROM p, r GROUP BY ALL),
f AS (SELECT p_partkey, list_reduce(c, lambda a, x: CASE WHEN x.d < a.d OR (x.d = a.d AND w * h > 0.5::DOUBLE * 10 * 10 * x.i * x.j) THEN x ELSE a END) AS best FROM s)
SELECT p_partkey, CAST(best.i AS INTEGER) AS i, CAST(best.j AS INTEGER) AS j FROM f""")
def q15_nearest_ratio(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part").select("p_partkey", F.col("p_size").cast("double").alias("w"), (F.col("p_retailprice") / 100).alias("h"))
    best = selection.nearest_ratio(F.col("w"), F.col("h"), 10.0, selection.ratios(2, 9))
    return p.withColumn("b", best).select("p_partkey", F.col("b.i").alias("i"), F.col("b.j").alias("j"))


@query("""WITH w AS (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS token FROM documents), v AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) - 1 AS id FROM w GROUP BY token)
SELECT doc_id, count(*) AS tokens, CAST(sum(id) AS BIGINT) AS id_sum, max(id) AS rarest FROM w JOIN v USING (token) GROUP BY doc_id""")
def q16_gather_join(spark: SparkSession, folder: str) -> DataFrame:
    """Every token's place in the corpus vocabulary; the places come from a range sort, not from one task."""
    w = table(spark, folder, "documents").select("doc_id", F.explode(F.split(F.lower("text"), " ")).alias("token"))
    counts = w.groupBy("token").agg((-F.count("*")).alias("rarity"))
    v = gates.ordinal(counts, ["rarity", "token"], "id")
    return selection.gather(w, v, "token", "id").groupBy("doc_id").agg(F.count("*").alias("tokens"), F.sum("id").alias("id_sum"), F.max("id").alias("rarest"))


@query("""WITH s AS (SELECT vec_id AS slot, row_number() OVER (ORDER BY label DESC, vec_id) - 1 AS k FROM embeddings WHERE vec_id % 2 = 0), f AS (SELECT vec_id, label, row_number() OVER (ORDER BY label, vec_id) - 1 AS k FROM embeddings WHERE vec_id % 2 = 1)
SELECT k, slot, vec_id, label FROM s JOIN f USING (k)""")
def q17_positional_scatter(spark: SparkSession, folder: str) -> DataFrame:
    """The even vectors are slots, by falling label; the odd ones, as many, fill them by rising label."""
    e = table(spark, folder, "embeddings")
    slots = e.where("vec_id % 2 = 0").select(F.col("vec_id").alias("slot"), (-F.col("label")).alias("falling"))
    features = e.where("vec_id % 2 = 1").select("vec_id", "label")
    return gates.positional_join(slots, features, ["falling", "slot"], ["label", "vec_id"]).select("k", "slot", "vec_id", "label")


@query("""SELECT doc_id, n_chars, CAST((row_number() OVER (ORDER BY n_chars, doc_id) - 1) // 128 AS BIGINT) AS batch, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS k FROM documents""")
def q56_admission_batches(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").select("doc_id", "n_chars")
    return gates.ordinal(d, ["n_chars", "doc_id"], "k").withColumn("batch", F.floor(F.col("k") / 128).cast("long"))


@query("""WITH r AS (SELECT CAST(user_id % 10 AS BIGINT) AS rung, CASE WHEN bool_or(event_type = 'error' AND value > 320) THEN 'fail' WHEN bool_or(event_type = 'error' AND value > 250) THEN 'xfail' WHEN bool_or(event_type = 'signup' AND value > 330) THEN 'skip' ELSE 'pass' END AS outcome,
max(value) FILTER (WHERE event_type = 'error') AS worst FROM events GROUP BY 1)
SELECT rung, outcome, worst, coalesce(bool_or(outcome = 'fail') OVER (ORDER BY rung ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) = false AS meaningful FROM r""")
def q61_gate_fold(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").withColumn("rung", F.col("user_id") % 10)
    at = lambda kind, over: F.bool_or((F.col("event_type") == kind) & (F.col("value") > over))
    outcome = F.when(at("error", 320), "fail").when(at("error", 250), "xfail").when(at("signup", 330), "skip").otherwise("pass")
    rungs = e.groupBy("rung").agg(outcome.alias("outcome"), F.max(F.when(F.col("event_type") == "error", F.col("value"))).alias("worst"))
    return selection.meaningful(rungs, "rung", "outcome")
