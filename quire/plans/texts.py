"""Queries over document text: scoring, spans, pages, tokens, charts, streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import charts, musicxml, pretok, spans, templates, text, tokens
from quire.operators import bpe, music
from quire.plans.base import query, table
from quire.sources import outputs, vocabularies
from quire.streaming import guard
from quire.streaming import pages as page_stream


@query("""WITH d AS (SELECT item_id, lower(regexp_replace(text, '[^ -~]', '', 'g')) AS t FROM benchmark), r AS (SELECT item_id, t AS ref FROM d), h AS (SELECT item_id - 1 AS item_id, t AS hyp FROM d),
j AS (SELECT item_id, length(ref) AS n, CASE WHEN hyp IS NULL THEN length(ref) ELSE levenshtein(ref, hyp) END AS dist, hyp IS NULL AS missing FROM r LEFT JOIN h USING (item_id))
SELECT count(*) AS pages, count(*) FILTER (WHERE missing) AS missing, count(*) FILTER (WHERE dist = 0) AS exact, CAST(sum(dist) AS BIGINT) AS distance, CAST(sum(n) AS BIGINT) AS chars, round(sum(dist)::DOUBLE / greatest(1, sum(n)), 6) AS cer FROM j""")
def q09_cer_left_join(spark: SparkSession, folder: str) -> DataFrame:
    """Micro-averaged error of each benchmark text against the next one as its hypothesis; the last has none."""
    d = table(spark, folder, "benchmark").select("item_id", F.lower(text.ascii_only(F.col("text"))).alias("t"))
    ref = d.select("item_id", F.col("t").alias("ref"))
    hyp = d.select((F.col("item_id") - 1).alias("item_id"), F.col("t").alias("hyp"))
    j = ref.join(hyp, "item_id", "left").select(F.length("ref").alias("n"), text.char_errors(F.col("ref"), F.col("hyp")).alias("dist"), F.col("hyp").isNull().alias("missing"))
    return j.agg(F.count("*").alias("pages"), F.count_if("missing").alias("missing"), F.count_if(F.col("dist") == 0).alias("exact"), F.sum("dist").alias("distance"), F.sum("n").alias("chars"), F.round(text.rate(F.sum("dist"), F.sum("n")), 6).alias("cer"))


@query("""WITH n AS (SELECT doc_id, text, trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS c FROM documents)
SELECT doc_id, CAST(strlen(text) AS INTEGER) AS bytes, CAST(length(text) AS INTEGER) AS chars, sha256(text) AS sha_raw, CAST(strlen(c) AS INTEGER) AS norm_bytes, CAST(length(c) AS INTEGER) AS norm_chars, sha256(c) AS sha_norm FROM n""")
def q19_ws_normalize(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", text.receipt(F.col("text")).alias("r")).select("doc_id", "r.*")


_TAIL = "SELECT doc_id, list_filter(string_split_regex(lower(text), '[ \\n]+'), lambda x: x <> '') AS a FROM documents"


@query(f"""WITH w AS ({_TAIL}), t AS (SELECT doc_id, len(a) AS n, a[-2048:] AS a FROM w WHERE len(a) >= 2048), p AS (SELECT doc_id, a, unnest(range(1, 257)) AS lag FROM t),
c AS (SELECT doc_id, lag, 2048 - lag AS comparisons, list_sum(list_transform(range(1, 2048 - lag + 1), lambda i: CASE WHEN a[i] = a[i + lag] THEN 1 ELSE 0 END)) AS matches FROM p),
b AS (SELECT doc_id, max_by({{'lag': lag, 'm': matches, 'c': comparisons}}, (matches::DOUBLE / comparisons, -lag)) AS best FROM c GROUP BY doc_id),
g AS (SELECT doc_id, n, len(list_distinct(list_transform(range(1, 2046), lambda i: a[i:i + 3]))) AS u FROM t)
SELECT doc_id, CAST(n AS INTEGER) AS n_tokens, u * 1000000 // 2045 AS novelty_ppm, CAST(CASE WHEN best.m = 0 THEN 1 ELSE best.lag END AS INTEGER) AS lag, CAST(best.m AS BIGINT) AS matches, 16 * best.m >= 15 * best.c AND 4 * u <= 2045 AS suspicious FROM g JOIN b USING (doc_id)""")
def q20_repetition_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Repetition at the end of each document of at least 2,048 words: lags up to 256, novelty of 4-grams."""
    words = F.filter(F.split(F.lower("text"), "[ \n]+"), lambda x: x != "")
    w = table(spark, folder, "documents").select("doc_id", words.alias("a")).where(F.size("a") >= guard.WINDOW)
    p = w.select("doc_id", F.size("a").alias("n_tokens"), tokens.suffix_profile(guard.WINDOW, guard.LAGS)(F.col("a")).alias("p"))
    novelty = F.floor(F.col("p.unique") * 1_000_000 / F.col("p.total")).cast("long")
    return p.select("doc_id", "n_tokens", novelty.alias("novelty_ppm"), "p.lag", "p.matches", tokens.suspicious(F.col("p.matches"), F.col("p.comparisons"), F.col("p.unique"), F.col("p.total")).alias("suspicious"))


@query(f"""WITH w AS ({_TAIL}), h AS (SELECT doc_id, a[-128:] AS a FROM w), g AS (SELECT doc_id, a, list_transform(range(1, len(a) - 1), lambda i: a[i:i + 2]) AS g FROM h)
SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(list_filter(g, lambda x: x[1] = a[-2] AND x[2] = a[-1]), lambda x: x[3]))), ' ') AS banned FROM g""")
def q21_ngram_ban(spark: SparkSession, folder: str) -> DataFrame:
    words = F.filter(F.split(F.lower("text"), "[ \n]+"), lambda x: x != "")
    w = table(spark, folder, "documents").select("doc_id", F.slice(words, F.greatest(F.size(words) - 127, F.lit(1)), 128).alias("a"))
    return w.select("doc_id", F.array_join(tokens.banned(F.col("a"), 3, 128), " ").alias("banned"))


def tagged(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with spans written inside and behind them; every fifth ends in one that is never closed."""
    d = table(spark, folder, "documents")
    k = F.col("doc_id") % 1000
    head = F.regexp_replace("text", "[<>\\[\\]|]", " ")
    half = F.floor(F.length(head) / 2).cast("int")
    pair = F.concat(F.lit("<|ref|>"), F.when(F.col("doc_id") % 3 == 0, "image").otherwise("text"), F.lit("<|/ref|><|det|>[["), k.cast("string"), F.lit(", 5, 900, "), (k % 7).cast("string"), F.lit("00, 7]]<|/det|>"))
    bare = F.concat(F.lit("<|det|>title [1, 2, "), k.cast("string"), F.lit(", 4.9]<|/det|>"))
    tail = F.when(F.col("doc_id") % 5 == 0, " <|ref|>x<|/ref|> <|det|>[[1, 2, 3, 4]]").otherwise("")
    return d.select("doc_id", F.concat(F.substring(head, F.lit(1), half), pair, F.substring(head, half + 1, F.length(head)), F.lit(" mid "), bare, F.lit(" end \\coloneqq "), pair, tail).alias("t"))


_TAGGED = """SELECT doc_id, left(head, length(head) // 2) AS lft, substr(head, length(head) // 2 + 1) AS rgt, pair, bare, tail FROM (SELECT doc_id, regexp_replace(text, '[<>\\[\\]|]', ' ', 'g') AS head, '<|ref|>' || CASE WHEN doc_id % 3 = 0 THEN 'image' ELSE 'text' END || '<|/ref|><|det|>[[' || (doc_id % 1000) || ', 5, 900, ' || ((doc_id % 1000) % 7) || '00, 7]]<|/det|>' AS pair,
'<|det|>title [1, 2, ' || (doc_id % 1000) || ', 4.9]<|/det|>' AS bare, CASE WHEN doc_id % 5 = 0 THEN ' <|ref|>x<|/ref|> <|det|>[[1, 2, 3, 4]]' ELSE '' END AS tail FROM documents)"""


@query(f"""WITH p AS ({_TAGGED}) SELECT doc_id, CAST(k AS INTEGER) AS ord, CASE WHEN doc_id % 3 = 0 THEN 'image' ELSE 'text' END AS label, '[' || (doc_id % 1000) || ',5,900,' || ((doc_id % 1000) % 7 * 100) || ']' AS box FROM p, (VALUES (0), (1)) AS v(k)""")
def q23_span_pass1(spark: SparkSession, folder: str) -> DataFrame:
    s = tagged(spark, folder).select("doc_id", F.posexplode(spans.spans(F.col("t"))).alias("ord", "s")).where("s.label <> 'title'")
    box = F.concat(F.lit("["), F.array_join(F.transform(F.get("s.boxes", 0), lambda x: x.cast("string")), ","), F.lit("]"))
    return s.select("doc_id", "ord", F.col("s.label").alias("label"), box.alias("box"))


@query(f"""WITH p AS ({_TAGGED}) SELECT doc_id, CAST(2 AS INTEGER) AS ord, 'title' AS label, bare AS "full", '1,2,' || (doc_id % 1000) || ',4' AS box FROM p""")
def q24_span_pass2(spark: SparkSession, folder: str) -> DataFrame:
    s = tagged(spark, folder).select("doc_id", F.posexplode(spans.spans(F.col("t"))).alias("ord", "s")).where("s.label = 'title'")
    return s.select("doc_id", "ord", F.col("s.label").alias("label"), F.col("s.full").alias("full"), F.array_join(F.transform(F.get("s.boxes", 0), lambda x: x.cast("string")), ",").alias("box"))


@query("""SELECT p_partkey, CAST(trunc((p_size * 19)::DOUBLE / 999.0::DOUBLE * 1024) AS BIGINT) AS x, CAST(trunc((p_partkey % 1000)::DOUBLE / 999.0::DOUBLE * 640) AS BIGINT) AS y FROM part""")
def q25_box_rescale(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select("p_partkey", spans.rescale(F.col("p_size") * 19, F.lit(1024)).alias("x"), spans.rescale(F.col("p_partkey") % 1000, F.lit(640)).alias("y"))


@query(f"""WITH p AS ({_TAGGED}) SELECT doc_id, lft || CASE WHEN doc_id % 3 = 0 THEN '![](images/p0.jpg)' || chr(10) ELSE '' END || rgt || ' mid  end := ' || CASE WHEN doc_id % 3 = 0 THEN '![](images/p0.jpg)' || chr(10) ELSE '' END || tail AS page FROM p""")
def q26_assemble_page(spark: SparkSession, folder: str) -> DataFrame:
    return tagged(spark, folder).select("doc_id", spans.assemble(F.col("t"), F.lit("p")).alias("page"))


@query("SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS page, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS body FROM conversations")
def q27_page_split(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations written as one marked stream each, then split again."""
    return page_stream.split_pages(page_stream.joined_conversations(table(spark, folder, "conversations")), "conv_id", "stream")


@query(f"""WITH p AS ({_TAGGED}) SELECT doc_id, CAST(k AS INTEGER) AS ordinal, CAST(trunc((doc_id % 1000)::DOUBLE / 999.0::DOUBLE * 640) AS BIGINT) AS x1, CAST(trunc(5.0::DOUBLE / 999.0::DOUBLE * 480) AS BIGINT) AS y1, CAST(trunc(900.0::DOUBLE / 999.0::DOUBLE * 640) AS BIGINT) AS x2, CAST(trunc(((doc_id % 1000) % 7 * 100)::DOUBLE / 999.0::DOUBLE * 480) AS BIGINT) AS y2
FROM p, (VALUES (0), (1)) AS v(k) WHERE doc_id % 3 = 0 AND trunc((doc_id % 1000)::DOUBLE / 999.0::DOUBLE * 640) < trunc(900.0::DOUBLE / 999.0::DOUBLE * 640) AND (doc_id % 1000) % 7 > 0""")
def q28_figure_refs(spark: SparkSession, folder: str) -> DataFrame:
    return tagged(spark, folder).select("doc_id", F.explode(spans.figures(F.col("t"), F.lit(640), F.lit(480))).alias("f")).select("doc_id", "f.*")


@query("""WITH a AS (SELECT doc_id, translate(text, '‘’‚‛“”„‐‑‒–—−', repeat(chr(39), 4) || repeat(chr(34), 3) || '------') AS t FROM documents), l AS (SELECT doc_id, string_split(t, chr(10)) AS l FROM a),
h AS (SELECT doc_id, array_to_string(CASE WHEN len(l) > 1 AND trim(l[1], ' ') <> '' AND upper(l[1]) = l[1] AND regexp_matches(l[1], '[A-Z]') AND trim(array_to_string(l[2:], ''), ' ') <> '' THEN l[2:] ELSE l END, chr(10)) AS t FROM l),
n AS (SELECT doc_id, regexp_replace(t, '\\n[ \\t]*[0-9]+[ \\t]*\\n*$', '') AS t FROM h)
SELECT doc_id, md5(trim(regexp_replace(lower(regexp_replace(t, '([A-Za-z])-\\n([a-z])', '\\1\\2', 'g')), '\\s+', ' ', 'g'), ' ')) AS digest FROM n""")
def q29_text_normalize(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.md5(text.normalise(F.col("text")).cast("binary")).alias("digest"))


@query("SELECT doc_id, len(regexp_extract_all(text, '\\p{N}{1,3}')) AS digit_groups, len(regexp_extract_all(text, '[\\x{4e00}-\\x{9fa5}\\x{3040}-\\x{30ff}]+')) AS cjk_runs FROM documents")
def q30_pretok_digits_cjk(spark: SparkSession, folder: str) -> DataFrame:
    pieces = table(spark, folder, "documents").select("doc_id", pretok.isolate(pretok.isolate(F.array("text"), pretok.DIGITS), pretok.CJK).alias("p"))
    count = lambda pattern: F.size(F.filter("p", lambda x: x.rlike(f"^(?:{pattern})$"))).cast("long")
    return pieces.select("doc_id", count(pretok.DIGITS).alias("digit_groups"), count(pretok.CJK).alias("cjk_runs"))


@query()
def q31_pretok_full(spark: SparkSession, folder: str) -> DataFrame:
    pieces = table(spark, folder, "documents").select("doc_id", "text", pretok.three_stage(F.col("text")).alias("a"), pretok.gpt2(F.col("text")).alias("b"), pretok.digits_apart(F.col("text")).alias("c"))
    whole = lambda c: F.array_join(c, "") == F.col("text")
    return pieces.select("doc_id", F.size("a").alias("three_stage"), F.size("b").alias("gpt2"), F.size("c").alias("digits_apart"), (whole("a") & whole("b") & whole("c")).alias("lossless"))


@query()
def q32_bpe_encode(spark: SparkSession, folder: str, vocabulary: str | None = None) -> DataFrame:
    """The distinct pieces of all texts as ids of a byte-level vocabulary, by its whole merge table."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = "file://" + public_tokenizers.path("byte_bpe_50k.json")
    vocab, merges = vocabularies.tokenizer_json(spark, vocabulary)
    added = {r.token: r.id for r in vocabularies.added_tokens(spark, vocabulary).collect()}  # a handful
    ids, ranks = {r.token: r.id for r in vocab.collect()}, {(r.left, r.right): r["rank"] for r in merges.collect()}  # a vocabulary's size
    pieces = table(spark, folder, "documents").select(F.explode(F.array_distinct(pretok.around_added(F.col("text"), list(added)))).alias("piece")).distinct()
    coded = F.when(F.col("piece").isin(list(added)), F.col("piece")).otherwise(templates.byte_alphabet(F.col("piece").cast("binary")))
    found = pieces.select("piece", bpe.encoder(ranks, ids, added=added)(coded).alias("ids"))
    return found.select("piece", F.size("ids").alias("n_ids"), F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"))


@query("SELECT doc_id, md5(array_to_string(list_filter(string_split(text, ' '), lambda x: x <> ''), ' ')) AS digest FROM documents WHERE len(list_filter(string_split(text, ' '), lambda x: x <> '')) > 0")
def q33_decode_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Every word as an id of a vocabulary built from the corpus, and back by lookup."""
    w = table(spark, folder, "documents").select("doc_id", F.posexplode(F.filter(F.split("text", " "), lambda x: x != "")).alias("pos", "w"))
    vocab = w.select("w").distinct().select(F.xxhash64("w").alias("id"), F.concat("w", F.lit(" ")).alias("w"))
    ids = w.select("doc_id", "pos", F.xxhash64("w").alias("id"))
    return bpe.decode(ids, vocab, "doc_id", "pos", "w").select("doc_id", F.md5(F.regexp_replace("text", " $", "").cast("binary")).alias("digest"))


@query(f"""WITH w AS ({_TAIL}), h AS (SELECT doc_id, a[1:len(a) // 2] AS h, a[len(a) // 2 + 1:] AS rest FROM w), k AS (SELECT *, len(h) AS n FROM h),
p AS (SELECT *, CASE WHEN n > 1 THEN list_max(list_filter(range(1, n), lambda i: h[i] = h[n])) END AS hit FROM k), d AS (SELECT doc_id, rest, CASE WHEN hit IS NULL THEN [] ELSE h[hit + 1:least(hit + 8, n)] END AS draft FROM p)
SELECT doc_id, CAST(len(draft) AS INTEGER) AS drafted, array_to_string(draft, ' ') AS draft, CAST(coalesce(list_min(list_filter(range(1, len(draft) + 1), lambda i: rest[i] IS DISTINCT FROM draft[i])) - 1, len(draft)) AS INTEGER) AS accepted FROM d""")
def q57_draft_ngram(spark: SparkSession, folder: str) -> DataFrame:
    """A draft from the first half's last token, against the second half."""
    words = F.filter(F.split(F.lower("text"), "[ \n]+"), lambda x: x != "")
    w = table(spark, folder, "documents").select("doc_id", words.alias("a")).withColumn("n", F.floor(F.size("a") / 2).cast("int"))
    h = w.select("doc_id", F.slice("a", F.lit(1), F.col("n")).alias("h"), F.slice("a", F.col("n") + 1, F.lit(1 << 30)).alias("rest"))
    d = h.select("doc_id", "rest", tokens.draft(F.col("h"), 1, 8).alias("draft"))
    return d.select("doc_id", F.size("draft").alias("drafted"), F.array_join("draft", " ").alias("draft"), tokens.accepted(F.col("draft"), F.slice("rest", F.lit(1), F.size("draft"))).alias("accepted"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN props WHEN event_id % 4 = 3 THEN substr(props, 1, 3) || '"}' ELSE substr(props, 1, length(props) - CAST(event_id % 4 AS BIGINT)) || '}' END AS repaired FROM events""")
def q58_json_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Properties whole, cut inside a string, or short of their last characters."""
    k = F.col("event_id") % 4
    cut = F.when(k == 3, F.substring("props", 1, 3)).otherwise(F.expr("substring(props, 1, length(props) - CAST(event_id % 4 AS INT))"))
    return table(spark, folder, "events").select("event_id", charts.complete_json(cut).alias("repaired"))


@query("""WITH e AS (SELECT user_id, event_id, CAST(regexp_replace(props, '[^0-9.-]', '', 'g') AS DOUBLE) AS x FROM events), g AS (SELECT user_id, list(x ORDER BY event_id) AS v FROM e GROUP BY user_id),
m AS (SELECT user_id, CASE WHEN len(v) < 2 THEN list_transform(v, lambda x: round_even(x * 1e4::DOUBLE, 0) / 1e4::DOUBLE) ELSE list_transform(v, lambda x: round_even((x - list_min(v)) / (list_max(v) - list_min(v) + 1e-9::DOUBLE) * 1e4::DOUBLE, 0) / 1e4::DOUBLE) END AS s FROM g)
SELECT user_id, CAST(len(s) AS INTEGER) AS n, round(list_sum(s), 4) AS total, round(list_sum(list_transform(range(1, len(s)), lambda i: abs(s[i] - s[i + 1]))) / greatest(len(s) - 1, 1), 6) AS l1 FROM m""")
def q59_chart_values(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers in each user's events, scaled, and the distance of the series from itself one step on."""
    e = table(spark, folder, "events").select("user_id", "event_id", charts.number(F.col("props")).alias("x"))
    series = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "x"))).alias("v"))
    s = series.select("user_id", charts.min_max(F.transform("v", lambda p: p["x"])).alias("s"))
    later = F.slice("s", F.lit(2), F.size("s"))
    return s.select("user_id", F.size("s").alias("n"), F.round(F.aggregate("s", F.lit(0.0), lambda t, x: t + x), 4).alias("total"), F.when(F.size("s") > 1, F.round(charts.mean_l1(F.col("s"), later), 6)).alias("l1"))


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN '{"schema_version":1,"event":"run_error","command":"ocr","error_kind":"general","code":1,"message":"' || replace(props, '"', '\\"') || '"}'
WHEN 'signup' THEN '{"schema_version":1,"event":"page","page":' || event_id || ',"status":"skipped","reason":"blank"}' WHEN 'purchase' THEN '{"schema_version":1,"event":"staff","staff":' || (user_id + 1) || ',"total":9,"status":"' || CASE WHEN event_id % 2 = 0 THEN 'ok' ELSE 'skipped' END || '"}'
WHEN 'click' THEN '{"schema_version":1,"event":"music_warning","kind":"meter","part":0,"measure":' || user_id || ',"detail":"click"}' ELSE '{"schema_version":1,"event":"page","page":' || event_id || ',"status":"decoded","chars":' || length(props) || ',"text":"' || replace(props, '"', '\\"') || '"}' END AS line FROM events""")
def q62_event_ndjson(spark: SparkSession, folder: str) -> DataFrame:
    """Events of five kinds as JSON lines; fields that are null are left out."""
    e = table(spark, folder, "events")
    kinds = {
        "error": outputs.run_error(F.lit("ocr"), F.lit("general"), F.lit(1), F.col("props")),
        "signup": outputs.page_skipped(F.col("event_id"), F.lit("blank")),
        "purchase": outputs.staff(F.col("user_id"), F.lit(9), F.col("event_id") % 2 == 0, F.lit(None).cast("array<int>")),
        "click": outputs.music_warning(F.lit("meter"), F.lit(0), F.col("user_id"), F.lit("click")),
    }
    line = F.to_json(outputs.page_decoded(F.col("event_id"), F.col("props")))
    for kind, event in kinds.items():
        line = F.when(F.col("event_type") == kind, F.to_json(event)).otherwise(line)
    return e.select("event_id", line.alias("line"))


def _outcome(url: Column, html: Column) -> Column:
    return F.when(~html.contains("<article>"), F.struct(F.lit(False).alias("ok"), F.lit("no_article").alias("reason"))).when(url.contains("utm_"), F.struct(F.lit(False).alias("ok"), F.lit("tracked").alias("reason"))).otherwise(F.struct(F.lit(True).alias("ok"), F.lit(None).cast("string").alias("reason")))


@query("""SELECT CASE WHEN NOT contains(html, '<article>') THEN 'no_article' WHEN contains(url, 'utm_') THEN 'tracked' END AS reason, contains(html, '<article>') AND NOT contains(url, 'utm_') AS ok, count(*) AS n, CAST(sum(length(html)) AS BIGINT) AS chars FROM pages GROUP BY ALL""")
def q64_partial_failure(spark: SparkSession, folder: str) -> DataFrame:
    """Pages that fail are skipped with a reason; the run goes on."""
    p = table(spark, folder, "pages").select(_outcome(F.col("url"), F.col("html")).alias("o"), F.length("html").alias("n"))
    return p.groupBy("o.reason", "o.ok").agg(F.count("*").alias("n"), F.sum("n").alias("chars"))


@query("""SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS page, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS digest FROM conversations""")
def q65_page_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The batch twin of the streaming page scanner, with a digest of each page."""
    return q27_page_split(spark, folder).select("conv_id", "page", F.md5(F.col("body").cast("binary")).alias("digest"))


def semantics(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as semantic music strings: an order is a system, a return flag a part."""
    li = table(spark, folder, "lineitem")
    name = F.element_at(F.array(*[F.lit(d) for d in ("quarter", "half", "eighth", "quarter.", "whole", "sixteenth", "x")]), (F.pmod(F.col("l_quantity").cast("int"), F.lit(7)) + 1).cast("int"))
    event = F.when(F.col("l_linenumber") % 3 == 0, "barline").when(F.col("l_partkey") % 5 == 0, F.concat(F.lit("rest-"), name)).otherwise(F.concat(F.lit("C4_"), name, F.lit("|E4_half")))
    line = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", event.alias("e"))))
    parts = li.groupBy((F.col("l_orderkey") % 997).alias("system"), F.col("l_returnflag").alias("part")).agg(line.alias("v"))
    key = F.when(F.col("part") == "A", "CM").when(F.col("system") % 2 == 0, "GM").otherwise("CM")
    head = F.concat(F.lit("clef-G2+keySignature-"), key, F.lit("+timeSignature-"), F.when(F.col("system") % 3 == 0, "C").otherwise("3/4"))
    return parts.select("system", "part", F.concat_ws("+", head, F.array_join(F.transform("v", lambda x: x["e"]), "+")).alias("semantic"))


@query()
def q60_music_sanity(spark: SparkSession, folder: str) -> DataFrame:
    return music.warnings(semantics(spark, folder))


@query()
def q70_musicxml(spark: SparkSession, folder: str) -> DataFrame:
    """Semantic strings as MusicXML: a digest, the number of measures and notes, and what the lint finds."""
    x = semantics(spark, folder).select("system", "part", musicxml.musicxml("semantic").alias("xml"))
    count = lambda path: F.xpath_int("xml", F.lit(f"count({path})"))
    return x.select("system", "part", F.md5(F.col("xml").cast("binary")).alias("digest"), count("//measure").alias("measures"), count("//note").alias("notes"), F.array_join(musicxml.lint(F.col("xml")), ", ").alias("problems"))
