"""Queries of the run store, lines and files, text rates, templates, music strings, decisions and joins as checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import storage
from quire.functions import charts, kernels, music, stats, templates, text
from quire.operators import envelope, gates, routing, sequences
from quire.plans.base import query, table
from quire.plans.relational import _RUN, plain, runs
from quire.plans.texts import _TAGGED, semantics, tagged
from quire.sources import ledger, outputs


@query(f"""WITH r AS ({_RUN}), b AS (SELECT * FROM r WHERE CAST(run_id AS BIGINT) % 2 = 0), c AS (SELECT * REPLACE ('redone' AS status, exit_code + 10 AS exit_code, NULL::DOUBLE AS finished_at) FROM r WHERE CAST(run_id AS BIGINT) % 3 = 0)
SELECT * FROM b WHERE run_id NOT IN (SELECT run_id FROM c) UNION ALL SELECT * FROM c""")
def q72_store_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """A store written twice: even runs, then every third one anew, nulls included."""
    r, number = runs(spark, folder), F.col("run_id").cast("long")
    store = ledger.RunStore(spark, storage.shared_path(spark, "store"))
    store.write(r.where(number % 2 == 0))
    store.write(r.where(number % 3 == 0).withColumns({"status": F.lit("redone"), "exit_code": F.col("exit_code") + 10, "finished_at": F.lit(None).cast("long")}))
    return plain(store.runs())


@query(_RUN)
def q73_json_lines_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = storage.shared_path(spark, "runs-jsonl")
    ledger.export_jsonl(runs(spark, folder), path)
    return plain(ledger.import_jsonl(spark, path).drop("line_no"))


@query(f"""WITH r AS ({_RUN}) SELECT run_id, run_id || '  ' || status || '  ' || mode || '  exit ' || exit_code || '  ' || quant || '  ' || input_path AS plain,
'{{"exit_code":' || exit_code || ',"finished_at":' || coalesce(CAST(CAST(finished_at AS BIGINT) AS VARCHAR), 'null') || ',"input_path":"' || input_path || '","mode":"' || mode || '","model_version_tag":"v1","quant":"' || quant || '","run_id":"' || run_id || '","schema_version":1,"started_at":' || started_at || ',"status":"' || status || '"}}' AS json FROM r""")
def q74_run_listing(spark: SparkSession, folder: str) -> DataFrame:
    r = runs(spark, folder)
    return ledger.plain_lines(r).withColumnRenamed("line", "plain").join(ledger.json_lines(r).withColumnRenamed("line", "json"), "run_id")


@query("""SELECT CAST(event_id AS VARCHAR) AS run_id, CASE WHEN event_id % 5 = 0 THEN 0 ELSE event_id * 10 END AS started_at, CAST(CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN 0 ELSE event_id END AS DOUBLE) AS finished_at, 'p' AS input_path, event_type AS mode, '' AS quant, 'v1' AS model_version_tag, user_id AS exit_code, 'ok' AS status FROM events WHERE event_id % 4 <> 0""")
def q75_rows_by_place(spark: SparkSession, folder: str) -> DataFrame:
    """Events as rows of texts, some short, some with what is no number."""
    k, as_text = F.col("event_id"), lambda c: F.col(c).cast("string")
    started = F.when(k % 5 == 0, F.lit("soon")).otherwise((k * 10).cast("string"))
    finished = F.when(k % 3 == 1, F.lit("12:30")).when(k % 3 == 2, as_text("event_id"))
    whole = F.array(as_text("event_id"), started, finished, F.lit("p"), F.col("event_type"), F.lit(None).cast("string"), F.lit("v1"), as_text("user_id"), F.lit("ok"))
    return plain(ledger.decode(table(spark, folder, "events").select(F.when(k % 4 == 0, F.slice(whole, 1, 7)).otherwise(whole).alias("v")), "v"))


@query(f"""WITH p AS ({_TAGGED}) SELECT doc_id, md5(lft || rgt || ' mid  end \\coloneqq ') AS digest FROM p WHERE tail = ''""")
def q76_reference_transform(spark: SparkSession, folder: str) -> DataFrame:
    return tagged(spark, folder).where("doc_id % 5 <> 0").select("doc_id", F.md5(text.drop_spans(F.col("t")).cast("binary")).alias("digest"))


@query("""SELECT doc_id, md5(regexp_replace(CASE WHEN doc_id % 2 = 0 THEN text || chr(160) ELSE text || ' <｜end▁of▁sentence｜> x' END, '^[\\s\\x{a0}]+|[\\s\\x{a0}]+$', '', 'g')) AS digest FROM documents""")
def q77_end_marks(spark: SparkSession, folder: str) -> DataFrame:
    """A mark at the end goes, with the white space around; one inside stays."""
    marked = F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit(" " + text.END_MARK))).otherwise(F.concat("text", F.lit(f" {text.END_MARK} x")))
    return table(spark, folder, "documents").select("doc_id", F.md5(text.strip_end(marked).cast("binary")).alias("digest"))


@query("""WITH d AS (SELECT item_id, list_filter(string_split_regex(regexp_replace(text, '[^ -~]', '', 'g'), '\\s+'), lambda w: w <> '') AS w FROM benchmark),
p AS (SELECT a.item_id, a.w AS a, b.w AS b, list_distinct(list_concat(a.w, b.w)) AS v FROM d a JOIN d b ON b.item_id = a.item_id + 1),
c AS (SELECT item_id, len(a) AS n, array_to_string(list_transform(a, lambda w: chr(CAST(list_position(v, w) AS INTEGER))), '') AS a, array_to_string(list_transform(b, lambda w: chr(CAST(list_position(v, w) AS INTEGER))), '') AS b FROM p)
SELECT item_id, CAST(n AS INTEGER) AS words, CAST(levenshtein(a, b) AS INTEGER) AS errors, round(levenshtein(a, b)::DOUBLE / greatest(1, n), 6) AS wer FROM c WHERE len(a) > 0""")
def q78_word_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Each benchmark text against the next one, by words."""
    d = table(spark, folder, "benchmark").select("item_id", text.ascii_only(F.col("text")).alias("t"))
    p = d.alias("a").join(d.alias("b"), F.col("b.item_id") == F.col("a.item_id") + 1)
    words = F.size(F.filter(F.split("a.t", r"\s+"), lambda w: w != ""))
    errors = text.word_errors(F.col("a.t"), F.col("b.t"))
    return p.select("a.item_id", words.alias("words"), errors.alias("errors"), F.round(text.rate(errors, words), 6).alias("wer")).where("words > 0")


@query("""SELECT doc_id, md5(array_to_string(list_transform(list_filter(list_concat(['[BOS]', '▁', '[PAD]'], list_transform(string_split(text, ' '), lambda w: '▁' || w)), lambda w: w NOT IN ('[BOS]', '[PAD]')), lambda w: regexp_replace(replace(w, '▁', ' '), '^\\s+|\\s+$', '', 'g')), '|')) AS digest FROM documents""")
def q79_detokenise(spark: SparkSession, folder: str) -> DataFrame:
    """The words of a text as marked tokens among control tokens, an unknown id at the second place."""
    words = F.transform(F.split("text", " "), lambda w: F.concat(F.lit("▁"), w))
    tokens = F.concat(F.array(F.lit("[BOS]"), F.lit(None).cast("string"), F.lit("[PAD]")), words)
    return table(spark, folder, "documents").select("doc_id", F.md5(F.array_join(templates.detokenise(tokens), "|").cast("binary")).alias("digest"))


@query("""WITH p AS (SELECT p_partkey, p_size % 4 + 1 AS r, p_partkey % 3 + 1 AS c FROM part), g AS (SELECT p_partkey, r, c, string_agg(line, chr(10) ORDER BY y) AS grid FROM (SELECT p_partkey, r, c, y, string_agg('<row_' || y || '_col_' || x || '>' || repeat('*', 5), '' ORDER BY x) AS line
FROM (SELECT p_partkey, r, c, unnest(range(1, r + 1)) AS y FROM p) q, LATERAL (SELECT unnest(range(1, c + 1)) AS x) z GROUP BY ALL) GROUP BY ALL)
SELECT p_partkey, 'a ' || repeat('<img>', CAST(r * c AS BIGINT)) || ' b' AS slots, CASE WHEN r * c > 1 THEN grid || chr(10) || chr(10) ELSE '' END || '<global-img>' || repeat('*', 5) AS tiles FROM g""")
def q80_prompt_slots(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part").select("p_partkey", (F.col("p_size") % 4 + 1).alias("r"), (F.col("p_partkey") % 3 + 1).alias("c"))
    return p.select("p_partkey", templates.with_slots("a ", "<img>", F.col("r") * F.col("c"), " b").alias("slots"), templates.tiled(F.col("r"), F.col("c"), "*", 5).alias("tiles"))


@query("""WITH e AS (SELECT l_orderkey, l_linenumber AS n, l_partkey, l_suppkey, CASE WHEN l_linenumber > 1 AND l_linenumber % 3 = 0 THEN '|' WHEN l_partkey % 4 = 0 THEN 'rest-half' ELSE 'note-quarter' END AS r, CASE l_partkey % 5 WHEN 0 THEN '#' WHEN 1 THEN 'bb' ELSE '' END AS l, 'C' || l_suppkey % 6 AS p FROM lineitem),
f AS (SELECT *, CASE WHEN r = '|' THEN '|' WHEN r = 'rest-half' THEN r ELSE p || l || '_quarter' END AS item, row_number() OVER w AS k, lag(r) OVER w AS before FROM e WINDOW w AS (PARTITION BY l_orderkey ORDER BY n, l_partkey, l_suppkey, p, l))
SELECT l_orderkey, string_agg(CASE WHEN r = '|' OR k = 1 OR before = '|' THEN item ELSE '+' || item END, '' ORDER BY k) AS semantic FROM f GROUP BY l_orderkey HAVING arg_min(r, k) <> '|'""")
def q81_merge_streams(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as rhythm, pitch and accidental streams; an order that begins with a chord mark has nothing to fuse with."""
    rhythm = F.when((F.col("l_linenumber") > 1) & (F.col("l_linenumber") % 3 == 0), "|").when(F.col("l_partkey") % 4 == 0, "rest-half").otherwise("note-quarter")
    lift = F.when(F.col("l_partkey") % 5 == 0, "lift_#").when(F.col("l_partkey") % 5 == 1, "lift_bb").otherwise("nonote")
    mark = F.when(F.col("l_partkey") % 5 == 0, "#").when(F.col("l_partkey") % 5 == 1, "bb").otherwise("")
    pitch = F.concat(F.lit("C"), (F.col("l_suppkey") % 6).cast("string"))
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", pitch.alias("p"), mark.alias("m"), rhythm.alias("r"), lift.alias("l"))
    orders = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("e")).where(F.get("e", 0)["r"] != "|")
    of = lambda k: F.transform("e", lambda x: x[k])
    return orders.select("l_orderkey", music.merge_streams(of("r"), of("p"), of("l")).alias("semantic"))


@query("""WITH e AS (SELECT l_orderkey % 997 AS system, l_returnflag AS part, l_linenumber AS n, l_partkey, l_suppkey, l_quantity, CASE CAST(l_quantity AS INTEGER) % 7 WHEN 0 THEN 'quarter' WHEN 1 THEN 'half' WHEN 2 THEN 'eighth' WHEN 3 THEN 'quarter.' WHEN 4 THEN 'whole' WHEN 5 THEN 'sixteenth' ELSE 'x' END AS d FROM lineitem),
v AS (SELECT *, CASE WHEN n % 3 = 0 THEN 'barline' WHEN l_partkey % 5 = 0 THEN 'rest-' || d ELSE 'C4_' || d || '|E4_half' END AS event FROM e)
SELECT system, part, md5(string_agg(event, '+' ORDER BY n, l_partkey, l_suppkey, l_quantity, event)) AS digest FROM v GROUP BY ALL""")
def q82_strip_opening(spark: SparkSession, folder: str) -> DataFrame:
    """Semantic strings as continuations: the opening clef, key and time go."""
    return semantics(spark, folder).select("system", "part", F.md5(music.strip_opening(F.col("semantic")).cast("binary")).alias("digest"))


@query("""WITH n AS (SELECT page_id, CASE page_id % 9 WHEN 0 THEN 'model-' || page_id || '.bin' WHEN 1 THEN '../x' WHEN 2 THEN 'con.txt' WHEN 3 THEN 'a b' WHEN 4 THEN 'name.' WHEN 5 THEN '.hidden' WHEN 6 THEN 'Lpt1' WHEN 7 THEN 'console' ELSE 'com0.log' END AS name, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN replace(url, 'http://', 'https://') ELSE 'https:///x' END AS url, CASE page_id % 2 WHEN 0 THEN sha256(url) ELSE upper(sha256(url)) END AS h FROM pages)
SELECT page_id, page_id % 9 IN (0, 7, 8) AS portable, regexp_matches(url, '^https://[^/?#]') AND NOT regexp_matches(url, '[\\x00-\\x20\\x7f]') AS secure, regexp_matches(h, '^[0-9a-f]{64}$') AS digest FROM n""")
def q83_names_and_addresses(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("page_id")
    names = [F.concat(F.lit("model-"), k.cast("string"), F.lit(".bin")), *map(F.lit, ("../x", "con.txt", "a b", "name.", ".hidden", "Lpt1", "console", "com0.log"))]
    name = F.element_at(F.array(*names), (k % 9 + 1).cast("int"))
    url = F.when(k % 3 == 0, F.col("url")).when(k % 3 == 1, F.replace(F.col("url"), F.lit("http://"), F.lit("https://"))).otherwise("https:///x")
    digest = F.sha2(F.col("url").cast("binary"), 256)
    return table(spark, folder, "pages").select("page_id", text.portable_name(name).alias("portable"), text.https_url(url).alias("secure"), text.hex64(F.when(k % 2 == 0, digest).otherwise(F.upper(digest))).alias("digest"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(value AS VARCHAR) WHEN 1 THEN '1.0,' || CAST(CAST(user_id AS DOUBLE) AS VARCHAR) || ',2.5' WHEN 2 THEN NULL ELSE CAST(value AS VARCHAR) || ',-3.0' END AS leaves FROM events""")
def q84_json_leaves(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers below ``values`` or ``data``, depth first; an array ends the search without a result."""
    k, v, u = F.col("event_id") % 4, F.col("value").cast("string"), F.col("user_id").cast("string")
    doc = F.when(k == 0, F.concat(F.lit('{"values":{"a":{"b":'), v, F.lit("}}}"))).when(k == 1, F.concat(F.lit('{"data":{"a":1,"b":{"c":"('), u, F.lit(') '), u, F.lit(' %"},"z":"2.5 [7]","n":null,"t":true,"x":"none"}}')))
    doc = doc.when(k == 2, F.concat(F.lit('{"values":{"a":['), v, F.lit("]}}"))).otherwise(F.concat(F.lit('{"values":{"a":'), v, F.lit(',"b":"-3"},"data":{"q":9}}')))
    return table(spark, folder, "events").select("event_id", F.array_join(F.transform(charts.leaves(doc), lambda x: x.cast("string")), ",").alias("leaves"))


@query("""SELECT p_partkey, round((1 - p) * -save + p * flip, 6) AS loss, round(least(1, greatest(0, (0.5::DOUBLE + save) / (save + flip))), 6) AS break_even FROM (SELECT p_partkey, p_size / 50.0::DOUBLE AS p, 1.0::DOUBLE AS save, 20.0::DOUBLE AS flip FROM part)""")
def q85_loss_matrix(spark: SparkSession, folder: str) -> DataFrame:
    loss = envelope.expected_accept_loss(F.col("p_size") / 50.0, 1.0, 20.0)
    return table(spark, folder, "part").select("p_partkey", F.round(loss, 6).alias("loss"), F.round(F.lit(envelope.break_even(1.0, 20.0, 0.5)), 6).alias("break_even"))


@query("""WITH v AS (SELECT user_id, list(x ORDER BY event_id) AS v FROM (SELECT user_id, event_id, value * pow(10, event_id % 12)::DOUBLE * CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS x FROM events) GROUP BY user_id),
s AS (SELECT user_id, list_reduce(list_transform(v, lambda x: {'s': x, 'c': 0.0::DOUBLE}), lambda a, x: {'s': a.s + x.s, 'c': a.c + CASE WHEN abs(a.s) >= abs(x.s) THEN (a.s - (a.s + x.s)) + x.s ELSE (x.s - (a.s + x.s)) + a.s END}, {'s': 0.0::DOUBLE, 'c': 0.0::DOUBLE}) AS r FROM v)
SELECT user_id, r.s + r.c AS total FROM s""")
def q86_compensated_sum(spark: SparkSession, folder: str) -> DataFrame:
    """Values of very different size, in order."""
    x = F.col("value") * F.pow(F.lit(10.0), F.col("event_id") % 12) * F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1)
    v = table(spark, folder, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", x.alias("x")))).alias("v"))
    return v.select("user_id", kernels.exact_sum(F.transform("v", lambda p: p["x"])).alias("total"))


@query("""WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, value / 100 AS margin, event_type AS full_, CASE WHEN event_id % 3 = 0 THEN 'view' ELSE event_type END AS draft FROM events),
w AS (SELECT user_id, 0::BIGINT AS k, 0 AS since, 1.0::DOUBLE AS wealth, false AS tripped, 0 AS verified FROM (SELECT DISTINCT user_id FROM e) UNION ALL
SELECT user_id, k, CASE WHEN v THEN 0 ELSE since + 1 END, wealth2, tripped OR wealth2 >= 20, verified + v::INT FROM (SELECT *, CASE WHEN v AND NOT tripped THEN wealth * (1 + 0.5::DOUBLE * ((draft <> full_)::INT - 0.1::DOUBLE)) ELSE wealth END AS wealth2
FROM (SELECT e.user_id, e.k, w.since, w.wealth, w.tripped, w.verified, e.full_, e.draft, w.tripped OR e.margin < 0.5::DOUBLE OR w.since + 1 >= 4 AS v FROM w JOIN e ON e.user_id = w.user_id AND e.k = w.k + 1)))
SELECT user_id, max(k) AS steps, max(verified) AS verified, bool_or(tripped) AS tripped, round(arg_max(wealth, k), 6) AS wealth FROM w GROUP BY user_id""")
def q87_guarded_drafts(spark: SparkSession, folder: str) -> DataFrame:
    """Drafts that are accepted by margin, audited every fourth time, and bet against until the guard trips."""
    e = table(spark, folder, "events").select("user_id", "event_id", (F.col("value") / 100).alias("margin"), F.col("event_type").alias("full"), F.when(F.col("event_id") % 3 == 0, "view").otherwise(F.col("event_type")).alias("draft"))
    g = envelope.guarded(e, "user_id", "event_id", 0.5, 4, 0.5, 0.1, 0.05)
    verified = F.size(F.filter("steps", lambda s: s["verified"]))
    return g.select("user_id", F.size("steps").cast("long").alias("steps"), verified.alias("verified"), "tripped", F.round(F.element_at("steps", -1)["wealth"], 6).alias("wealth"))


@query("""WITH r AS (SELECT epoch_us(ts) // 60000000 AS b, epoch_us(ts) // 60000000 + CAST(floor(value) AS BIGINT) + 1 AS e FROM events), m AS (SELECT t, sum(d) AS d FROM (SELECT b AS t, 1 AS d FROM r UNION ALL SELECT e, -1 FROM r) GROUP BY t), a AS (SELECT t, sum(d) OVER (ORDER BY t) AS active FROM m)
SELECT max(t) AS steps, CAST(max(active) AS BIGINT) AS max_active, (SELECT count(*) FROM r) AS served FROM a""")
def q88_active_counters(spark: SparkSession, folder: str) -> DataFrame:
    """Events as runs from their minute on; how many are active at most."""
    begin = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000)
    r = table(spark, folder, "events").select(begin.alias("begin"), (begin + F.floor("value").cast("long") + 1).alias("end"))
    return routing.counters(r)


@query("""WITH e AS (SELECT user_id, event_id, value, event_id < 200 AS frozen FROM events), r AS (SELECT user_id, event_id, sum(CASE WHEN frozen THEN value END) OVER w AS f, count(CASE WHEN frozen THEN 1 END) OVER w AS nf FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
q AS (SELECT user_id, event_id, sum(value) OVER w AS s, count(*) OVER w AS n FROM e WHERE NOT frozen WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 15 PRECEDING AND CURRENT ROW))
SELECT r.event_id, CAST(nf + coalesce(n, 0) AS INTEGER) AS held, round(coalesce(f, 0) + coalesce(s, 0), 4) AS total FROM r LEFT JOIN q ON q.event_id = r.event_id""")
def q89_ring(spark: SparkSession, folder: str) -> DataFrame:
    """A frozen prefix and the last sixteen values of each user."""
    r = sequences.ring(table(spark, folder, "events").select("user_id", "event_id", "value"), ["user_id"], ["event_id"], "value", 16, F.col("event_id") < 200)
    return r.select("event_id", F.size("held").alias("held"), F.round(F.aggregate("held", F.lit(0.0), lambda t, x: t + x), 4).alias("total"))


@query("""WITH p AS (SELECT p_brand, CAST(p_size AS DOUBLE) AS x, min(p_retailprice / p_size) AS y FROM part GROUP BY ALL),
h AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM p a, p b WHERE a.p_brand = p.p_brand AND b.p_brand = p.p_brand AND a.x < p.x AND p.x < b.x AND (b.x - a.x) * (p.y - a.y) - (b.y - a.y) * (p.x - a.x) >= 0)),
g AS (SELECT *, lag(y) OVER (PARTITION BY p_brand ORDER BY x) - y AS gain, row_number() OVER (PARTITION BY p_brand ORDER BY x) AS k FROM h)
SELECT p_brand, CAST(max(k) FILTER (WHERE k = 1 OR gain > 1e-6::DOUBLE) AS INTEGER) AS points, round(arg_max(x, k) FILTER (WHERE k = 1 OR gain > 1e-6::DOUBLE), 6) AS last_x, round(arg_max(y, k) FILTER (WHERE k = 1 OR gain > 1e-6::DOUBLE), 6) AS last_y FROM g GROUP BY p_brand""")
def q90_hull(spark: SparkSession, folder: str) -> DataFrame:
    """The lower hull of size and price for each brand, without the last points that gain nothing."""
    p = table(spark, folder, "part").groupBy("p_brand", F.col("p_size").cast("double").alias("x")).agg(F.min(F.col("p_retailprice") / F.col("p_size")).alias("y"))
    hull = p.groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("v")).select("p_brand", sequences.without_gain(sequences.lower_hull(F.col("v"))).alias("h"))
    last = F.element_at("h", -1)
    return hull.select("p_brand", F.size("h").alias("points"), F.round(last["x"], 6).alias("last_x"), F.round(last["y"], 6).alias("last_y"))


@query("""WITH RECURSIVE b AS (SELECT l_suppkey AS k, unnest(list_sort(list(DISTINCT CAST(floor(l_extendedprice / 20) AS BIGINT)))) AS bar FROM lineitem GROUP BY 1), t AS (SELECT k, max(bar) + 40 AS width FROM b GROUP BY k),
w AS (SELECT k, 0 AS nth, 0::BIGINT AS at FROM t UNION ALL SELECT w.k, any_value(w.nth) + 1, max(b.bar) FROM w JOIN t ON t.k = w.k JOIN b ON b.k = w.k AND b.bar > w.at + 30 AND b.bar <= w.at + 900 WHERE t.width - w.at > 900 GROUP BY w.k, w.at)
SELECT w.k AS l_suppkey, CASE WHEN any_value(t.width) - max(w.at) <= 900 THEN string_agg(w.at, ',' ORDER BY w.at) || ',' || any_value(t.width) END AS cuts FROM w JOIN t ON t.k = w.k GROUP BY w.k""")
def q91_farthest_cuts(spark: SparkSession, folder: str) -> DataFrame:
    """A supplier's prices as bars of a line that is cut into pieces of at most 900."""
    bars = table(spark, folder, "lineitem").groupBy("l_suppkey").agg(F.sort_array(F.collect_set(F.floor(F.col("l_extendedprice") / 20).cast("long"))).alias("b"))
    cuts = sequences.farthest_cuts(F.col("b"), F.array_max("b") + 40, 900, F.lit(30))
    return bars.select("l_suppkey", F.array_join(F.transform(cuts, lambda c: c.cast("string")), ",").alias("cuts"))


@query("""WITH a AS (SELECT event_type, 'v' || length(event_type) AS build, count(*) AS n FROM events GROUP BY ALL), b AS (SELECT event_type, max(value) AS top FROM events GROUP BY ALL), c AS (SELECT event_type, min(value) AS low FROM events GROUP BY ALL)
SELECT event_type, build, n AS subject_n, top AS reference_top, low AS roof_low FROM a JOIN b USING (event_type) JOIN c USING (event_type)""")
def q92_evidence_rows(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").withColumn("build", F.concat(F.lit("v"), F.length("event_type").cast("string"))).groupBy("event_type", "build")
    arms = {"subject": e.agg(F.count("*").alias("n")), "reference": e.agg(F.max("value").alias("top")), "roof": e.agg(F.min("value").alias("low"))}
    return gates.evidence(arms, "event_type", "build")


@query("""WITH w AS (SELECT p_partkey AS k, unnest([0, 1]) AS nth, unnest(['m' || p_partkey % 50 || '.v2.bin', 'm' || p_partkey % 50 || '.bin']) AS name FROM part), x AS (SELECT DISTINCT 'cache/m' || p_size || '.bin' AS path FROM part UNION SELECT DISTINCT 'home/m' || p_size % 20 || '.v2.bin' FROM part),
t AS (SELECT k, dir, nth, folder || '/' || name AS path FROM w, (VALUES (0, 'home'), (1, 'cache')) AS f(dir, folder)), s AS (SELECT k, arg_min(path, (dir, nth)) AS path FROM t JOIN x USING (path) GROUP BY k) SELECT p_partkey, path FROM part LEFT JOIN s ON k = p_partkey""")
def q93_first_existing(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part")
    name = F.concat(F.lit("m"), (F.col("p_partkey") % 50).cast("string"))
    wanted = p.select("p_partkey", F.array(F.concat(name, F.lit(".v2.bin")), F.concat(name, F.lit(".bin"))).alias("names"))
    there = p.select(F.concat(F.lit("cache/m"), F.col("p_size").cast("string"), F.lit(".bin")).alias("path")).union(p.select(F.concat(F.lit("home/m"), (F.col("p_size") % 20).cast("string"), F.lit(".v2.bin"))))
    return gates.first_existing(wanted, ["home", "cache"], there, "p_partkey", "names")


@query("""WITH u AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY min(ts), user_id) AS k, user_id FROM events GROUP BY event_type, user_id), l AS (SELECT event_type, list(user_id ORDER BY k) AS v FROM u GROUP BY event_type), j AS (SELECT a.event_type, list_concat(a.v, b.v) AS v FROM l a, l b WHERE b.event_type = 'view')
SELECT event_type, md5(array_to_string(list_transform(list_filter(list_transform(range(1, len(v) + 1), lambda i: CASE WHEN list_position(v, v[i]) = i THEN v[i] END), lambda x: x IS NOT NULL), lambda x: x), ',')) AS digest FROM j""")
def q94_ordered_union(spark: SparkSession, folder: str) -> DataFrame:
    """Users by their first event of a kind, then those of views, each at its first place."""
    e = table(spark, folder, "events").groupBy("event_type", "user_id").agg(F.min("ts").alias("ts"))
    lists = e.groupBy("event_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "user_id"))), lambda x: x["user_id"]).alias("v"))
    views = lists.where("event_type = 'view'").select(F.first("v").alias("w"))
    joined = lists.join(F.broadcast(views))  # one row
    return joined.select("event_type", F.md5(F.array_join(F.transform(F.array_union("v", "w"), lambda x: x.cast("string")), ",").cast("binary")).alias("digest"))


@query("""SELECT p_partkey, row_number() OVER (ORDER BY p_size, CASE p_type WHEN 'STANDARD' THEN 0 ELSE length(p_type) END, p_name, p_partkey) - 1 AS place FROM part""")
def q95_option_order(spark: SparkSession, folder: str) -> DataFrame:
    """Several keys in one deterministic order: size, precision rank, name."""
    p = table(spark, folder, "part").withColumn("precision", F.when(F.col("p_type") == "STANDARD", 0).otherwise(F.length("p_type")))
    return gates.ordinal(p.select("p_partkey", "p_size", "precision", "p_name"), ["p_size", "precision", "p_name", "p_partkey"], "place").select("p_partkey", "place")


@query("""SELECT doc_id, len(regexp_extract_all(text, 'then|the|th|an|a')) AS pieces, len(list_filter(regexp_extract_all(text, 'then|the|th|an|a'), lambda x: x = 'the')) AS the FROM documents""")
def q96_longest_first(spark: SparkSession, folder: str) -> DataFrame:
    """Added pieces in a text, the longest first at each place."""
    pattern = F.lit(text.longest_first(["a", "the", "th", "an", "then"]))
    found = table(spark, folder, "documents").select("doc_id", F.regexp_extract_all("text", pattern, F.lit(0)).alias("p"))
    return found.select("doc_id", F.size("p").cast("long").alias("pieces"), F.size(F.filter("p", lambda x: x == "the")).cast("long").alias("the"))


@query("""WITH f AS (SELECT doc_id AS path, CASE WHEN doc_id % 10 = 3 THEN sha256(text || 'x') ELSE sha256(text) END AS sha, strlen(text) + CASE WHEN doc_id % 10 = 4 THEN 1 ELSE 0 END AS size FROM documents WHERE doc_id % 10 <> 5)
SELECT d.doc_id AS path, CASE WHEN f.path IS NULL THEN 'missing' WHEN f.size <> strlen(d.text) THEN 'size' ELSE 'sha256' END AS problem FROM documents d LEFT JOIN f ON f.path = d.doc_id WHERE f.path IS NULL OR f.size <> strlen(d.text) OR f.sha <> sha256(d.text)""")
def q97_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files: some missing, some longer, some changed."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    d = table(spark, folder, "documents").withColumnRenamed("doc_id", "path")
    manifest = d.select("path", sha(F.col("text")).alias("sha256"), F.octet_length("text").alias("size"))
    k = F.col("path") % 10
    files = d.where(k != 5).select("path", F.when(k == 3, sha(F.concat("text", F.lit("x")))).otherwise(sha(F.col("text"))).alias("sha256"), (F.octet_length("text") + F.when(k == 4, 1).otherwise(0)).alias("size"))
    return gates.verified(files, manifest)


@query("""SELECT doc_id, 'missing' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id * 2 FROM labels) UNION ALL SELECT DISTINCT doc_id * 2, 'unexpected' FROM labels WHERE doc_id * 2 NOT IN (SELECT doc_id FROM documents)""")
def q98_set_difference(spark: SparkSession, folder: str) -> DataFrame:
    right = table(spark, folder, "labels").select((F.col("doc_id") * 2).alias("doc_id"))
    return gates.set_difference(table(spark, folder, "documents"), right, "doc_id")


@query("""SELECT page_id, replace(replace('see ![0] and ![1]', '![0]', '![](page' || page_id || '_figure_1.png)'), '![1]', '![](page' || page_id || '_figure_2.jpg)') AS markdown FROM pages""")
def q99_figure_links(spark: SparkSession, folder: str) -> DataFrame:
    figure = lambda token, n, kind: F.struct(F.lit(token).alias("token"), outputs.figure_name(F.col("page_id"), F.lit(n)).alias("name"), F.lit(kind).alias("format"))
    return table(spark, folder, "pages").select("page_id", outputs.link_figures(F.lit("see ![0] and ![1]"), F.array(figure("![0]", 1, "png"), figure("![1]", 2, "jpg"))).alias("markdown"))


@query("SELECT doc_id, text AS markdown FROM documents")
def q100_documents_written(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as JSON by the path's extension, read back."""
    path = storage.shared_path(spark, "documents") + ".JSON"
    outputs.write_documents(table(spark, folder, "documents").select("doc_id", F.col("text").alias("markdown")), path)
    return spark.read.schema("doc_id long, markdown string").json(path)


@query("""WITH e AS (SELECT event_type, event_id, value / max(value) OVER (PARTITION BY event_type) AS x FROM events), h AS (SELECT *, event_id % 2 AS side, count(*) OVER w AS n, row_number() OVER (PARTITION BY event_type, event_id % 2 ORDER BY x DESC) AS r FROM e WINDOW w AS (PARTITION BY event_type, event_id % 2)),
k AS (SELECT *, least(greatest(ceil(0.1::DOUBLE * n - 1e-12::DOUBLE), 1), n) AS k FROM h), c AS (SELECT event_type, side, sum(x * CASE WHEN r < k THEN 1.0::DOUBLE ELSE least(greatest(0.1::DOUBLE * n - (k - 1), 0.0::DOUBLE), 1.0::DOUBLE) END) / (0.1::DOUBLE * any_value(n)) AS cvar FROM k WHERE r <= k GROUP BY ALL),
t AS (SELECT event_type, side, quantile_cont(x, 0.85) AS threshold, quantile_cont(x, 0.99) AS empirical, any_value(n) AS n FROM h GROUP BY ALL), x AS (SELECT h.event_type, h.side, t.threshold, t.empirical, t.n, x - threshold AS e, row_number() OVER (PARTITION BY h.event_type, h.side ORDER BY x) AS j, count(*) OVER (PARTITION BY h.event_type, h.side) AS m FROM h JOIN t ON t.event_type = h.event_type AND t.side = h.side WHERE x > threshold),
b AS (SELECT event_type, side, threshold, empirical, n, m, avg(e) AS b0, avg((1 - (j - 0.35::DOUBLE) / m) * e) AS b1 FROM x GROUP BY ALL), g AS (SELECT *, 2 - b0 / (b0 - 2 * b1) AS xi, 2 * b0 * b1 / (b0 - 2 * b1) AS beta FROM b),
q AS (SELECT event_type, side, least(greatest(greatest(CASE WHEN beta > 0 THEN threshold + beta / xi * (pow(n::DOUBLE / m * 0.01::DOUBLE, -xi) - 1) ELSE empirical END, empirical), 0), 1) AS tail FROM g),
s AS (SELECT event_type, side, cvar, tail FROM c JOIN q USING (event_type, side))
SELECT a.event_type, round(a.cvar, 6) AS cvar, round(a.tail, 6) AS tail, CASE WHEN b.event_type IS NULL THEN 'informational' WHEN a.cvar <= b.cvar + 0.01::DOUBLE + 1e-12::DOUBLE AND a.tail <= b.tail + 0.01::DOUBLE + 1e-12::DOUBLE THEN 'pass' ELSE 'fail' END AS verdict FROM s a LEFT JOIN s b ON b.event_type = a.event_type AND b.side = 0 AND b.event_type <> 'view' WHERE a.side = 1""")
def q101_tail_gate_whole(spark: SparkSession, folder: str) -> DataFrame:
    """Mean and extreme of the tail against a baseline, which one kind lacks."""
    from quire.plans.analytics import r6, scaled

    e = scaled(spark, folder)
    base = e.where((F.col("event_id") % 2 == 0) & (F.col("event_type") != "view"))
    return stats.tail_gate(base, e.where(F.col("event_id") % 2 == 1), ["event_type"], "x", 0.1, 0.15, 0.99, 0.01).select("event_type", r6("cvar"), r6("tail"), "verdict")
