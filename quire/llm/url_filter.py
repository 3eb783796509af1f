"""URL filter: explicit rules first, link-graph propagation for the rest. Native expressions throughout.

Links between hosts are counted from the pages' markup. Trust is a personalised PageRank from hosts with
allowed pages along the links; distrust one from hosts with blocked pages against them. Both are sparse
power iterations over (kind, from, to, share) rows: a join and a partial aggregation each, written to the
shared folder as they go, until what still moves is below the tolerance. What reaches a host without a way
onward returns to the seeds. A host is blocked by the method if its distrust is at least ``min_distrust``
times an even share and above its trust.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import common

DAMPING, TOLERANCE, MIN_DISTRUST = 0.85, 1e-7, 0.5
#: Rounds between two writes of the ranks.
WRITE_EVERY = 8
#: Rules up to which they are one expression, hosts up to which their verdicts are sent to every executor.
EXPRESSION_RULES, BROADCAST_HOSTS = 200, 200_000
LINK = "(?i)href\\s*=\\s*[\"']?\\s*(?:https?:)?//([^/?#\"'\\s>]+)"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or end, A-Z lower-cased; empty where there is none."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or end."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def apply_rules(pages: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Adds rule and rule_verdict from host and path: the longest rule whose host is the page's or a parent domain and
    whose path begins the page's (equal lengths: the smaller text)."""
    ordered = sorted(set(rules), key=lambda r: (-len(r.text), r.text, r.verdict))
    if len(ordered) <= EXPRESSION_RULES:
        fits = [(F.col("host") == r.host) | F.col("host").endswith("." + r.host) for r in ordered]
        fits = [f & F.col("path").startswith(r.path) for f, r in zip(fits, ordered, strict=True)]
        first = F.coalesce(*[F.when(f, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("rule_verdict"))) for f, r in zip(fits, ordered, strict=True)]) if ordered else F.lit(None).cast("struct<rule:string,rule_verdict:string>")
        return pages.withColumn("_r", first).withColumns({"rule": F.col("_r.rule"), "rule_verdict": F.col("_r.rule_verdict")}).drop("_r")
    spark = pages.sparkSession
    listed = spark.createDataFrame([(r.host, r.path, r.text, r.verdict) for r in ordered], "suffix string, rule_path string, rule string, rule_verdict string")
    labels = F.split("host", "\\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    line = F.struct((-F.length("rule")).alias("n"), "rule", "rule_path", "rule_verdict")
    per_host = pages.select("host").distinct().withColumn("suffix", F.explode(parents)).join(listed, "suffix").groupBy("host").agg(F.sort_array(F.collect_list(line)).alias("_all"))
    found = F.get(F.filter("_all", lambda r: F.col("path").startswith(r["rule_path"])), 0)
    joined = pages.join(per_host, "host", "left").withColumn("_r", found)
    return joined.withColumns({"rule": F.col("_r.rule"), "rule_verdict": F.col("_r.rule_verdict")}).drop("_r", "_all")


def host_links(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """source, target, n: absolute links between different hosts, counted before the shuffle."""
    targets = F.explode(F.regexp_extract_all(F.col(html_col), F.lit(LINK), F.lit(1)))
    links = pages.where("host <> ''").select(F.col("host").alias("source"), targets.alias("target")).select("source", ascii_lower(F.regexp_replace("target", "^[^@]*@|:[0-9]*$", "")).alias("target"))
    return links.where("source <> target AND target <> ''").groupBy("source", "target").agg(F.count("*").alias("n"))


def rounds_to(tolerance: float, damping: float) -> int:
    """Steps after which all later ones together hold less than ``tolerance`` of the ranks' sum: a step holds at most
    ``damping`` times the one before."""
    return math.ceil(math.log(tolerance * (1 - damping)) / math.log(damping))


def propagate(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """kind ("trust" or "distrust"), host, rank from links (source, target, n) and seeds (kind, host, seed).

    The ranks of a kind are the stationary shares of a walk that begins at a seed in proportion to its number, goes on
    along a link with probability ``damping`` and starts anew otherwise, also from a host without a way onward. Trust
    flows from source to target in proportion to the source's links, distrust from target to source in proportion to
    the target's. Ranks of a kind sum to 1 and are right to ``tolerance`` of it: a round follows the walks one step
    further, and the rounds end once the steps to come can't hold more. Starting anew from an end without a link
    scales all ranks of the kind alike, so it is done by dividing by their sum. Without seeds there are no rows.
    """
    ends = links.select(F.explode(F.array(F.struct(F.lit("trust").alias("kind"), F.col("source").alias("u"), F.col("target").alias("v"), "n"), F.struct(F.lit("distrust").alias("kind"), F.col("target").alias("u"), F.col("source").alias("v"), "n"))).alias("e")).select("e.*")
    totals = ends.groupBy("kind", "u").agg(F.sum("n").alias("all"))
    edges = common.materialize(ends.join(totals, ["kind", "u"]).select("kind", "u", "v", (F.col("n") / F.col("all")).alias("share")), "url-edges")
    sums = F.broadcast(seeds.groupBy("kind").agg(F.sum("seed").alias("total")))  # two rows
    base = common.materialize(seeds.join(sums, "kind").select("kind", "host", ((1 - damping) * F.col("seed") / F.col("total")).alias("rank")), "url-seeds")
    ranks = flow = base
    rounds = rounds_to(tolerance, damping) if edges.limit(1).count() else 0
    for i in range(rounds):
        # what entered one step ago goes one step further; ranks are the sums of all steps
        flow = flow.withColumnRenamed("host", "u").join(edges, ["kind", "u"]).groupBy("kind", F.col("v").alias("host")).agg((damping * F.sum(F.col("rank") * F.col("share"))).alias("rank"))
        ranks = ranks.unionByName(flow)
        if i % WRITE_EVERY == WRITE_EVERY - 1 or i == rounds - 1:
            # the steps since the last write lie in the plan, each made from the one before
            flow = common.materialize(flow, "url-flow")
            ranks = common.materialize(ranks.groupBy("kind", "host").agg(F.sum("rank").alias("rank")), "url-ranks")
            left = flow.groupBy("kind").agg(F.sum("rank").alias("left")).collect()  # two rows
            if all(r["left"] * damping / (1 - damping) < tolerance * (1 - damping) for r in left):
                break
    scale = F.broadcast(ranks.groupBy("kind").agg(F.sum("rank").alias("total")))  # two rows
    return ranks.join(scale, "kind").select("kind", "host", (F.col("rank") / F.col("total")).alias("rank"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, damping: float = DAMPING, tolerance: float = TOLERANCE, min_distrust: float = MIN_DISTRUST, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust: one row per page.

    The verdict is the rule's where one fits, else the method's for the host. Trust and distrust are in even
    shares (rank times the number of hosts of pages), rounded to six places; a host that nothing reaches has 0 of both and is allowed. Pages with a
    null url or without ``://`` have empty host and path, no links, and are allowed unless a rule fits. Null
    markup has no links. Repeated rows are judged as rows of their own; other columns are ignored.
    """
    plain = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), F.col(html_col).alias("html"))
    ruled = common.materialize(apply_rules(plain.drop("html"), rules), "url-ruled")
    links = host_links(plain, "html")
    kind = F.when(F.col("rule_verdict") == "allow", "trust").otherwise("distrust")
    seeds = ruled.where("rule_verdict IS NOT NULL AND host <> ''").groupBy(kind.alias("kind"), "host").agg(F.count("*").alias("seed"))
    n = ruled.where("host <> ''").agg(F.count_distinct("host")).first()[0]
    ranks = propagate(links, seeds, damping, tolerance)
    value = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("rank"))), F.lit(0.0)) * n
    hosts = common.materialize(ranks.groupBy("host").agg(value("trust").alias("trust"), value("distrust").alias("distrust")), "url-hosts")
    if hosts.count() <= BROADCAST_HOSTS:
        hosts = F.broadcast(hosts)
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    method = F.when((distrust >= min_distrust) & (distrust > trust), "block").otherwise("allow")
    joined = ruled.join(hosts, "host", "left")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", method).alias("verdict"), F.round(trust, 6).alias("trust"), F.round(distrust, 6).alias("distrust"))


def oracle_sql(rules: tuple[Rule, ...] = RULES, damping: float = DAMPING, tolerance: float = TOLERANCE, min_distrust: float = MIN_DISTRUST) -> str:
    """The same in DuckDB: a walk of as many steps, one a recursion. Trust and distrust are rounded to six places."""
    listed = ", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in rules)
    steps = rounds_to(tolerance, damping)
    return f"""
WITH RECURSIVE p AS (SELECT page_id, html, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, row_number() OVER () AS nr FROM pages),
rules(rule_host, rule_path, says) AS (VALUES {listed}),
fits AS (SELECT p.nr, arg_min(rule_host || rule_path, (-length(rule_host || rule_path), rule_host || rule_path)) AS rule, arg_min(says, (-length(rule_host || rule_path), rule_host || rule_path)) AS says
  FROM p JOIN rules ON (p.host = rule_host OR ends_with(p.host, '.' || rule_host)) AND starts_with(p.path, rule_path) GROUP BY p.nr),
ruled AS (SELECT p.*, fits.rule, fits.says FROM p LEFT JOIN fits USING (nr)),
t AS (SELECT host AS source, lower(regexp_replace(regexp_replace(unnest(regexp_extract_all(html, '(?i)href\\s*=\\s*["'']?\\s*(?:https?:)?//([^/?#"''\\s>]+)', 1)), '^[^@]*@', ''), ':[0-9]*$', '')) AS target FROM p WHERE host <> ''),
n AS (SELECT source, target, count(*) AS n FROM t WHERE source <> target AND target <> '' GROUP BY ALL),
ends AS (SELECT 'trust' AS kind, source AS u, target AS v, n FROM n UNION ALL SELECT 'distrust', target, source, n FROM n),
e AS (SELECT kind, u, v, n::DOUBLE / sum(n) OVER (PARTITION BY kind, u) AS share FROM ends),
seeds AS (SELECT CASE WHEN says = 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, count(*) AS seed FROM ruled WHERE says IS NOT NULL AND host <> '' GROUP BY ALL),
f(step, kind, host, rank) AS (SELECT 0, kind, host, {1 - damping}::DOUBLE * seed / sum(seed) OVER (PARTITION BY kind) FROM seeds
  UNION ALL SELECT any_value(f.step) + 1, f.kind, e.v, {damping}::DOUBLE * sum(f.rank * e.share) FROM f JOIN e ON e.kind = f.kind AND e.u = f.host WHERE f.step < {steps} GROUP BY f.kind, e.v),
ranks AS (SELECT kind, host, sum(rank) / sum(sum(rank)) OVER (PARTITION BY kind) AS rank FROM f GROUP BY kind, host),
hosts AS (SELECT host, coalesce(sum(rank) FILTER (WHERE kind = 'trust'), 0) * (SELECT count(DISTINCT host) FROM p WHERE host <> '') AS trust,
  coalesce(sum(rank) FILTER (WHERE kind = 'distrust'), 0) * (SELECT count(DISTINCT host) FROM p WHERE host <> '') AS distrust FROM ranks GROUP BY host)
SELECT page_id, r.host, path, rule, coalesce(says, CASE WHEN coalesce(distrust, 0) >= {min_distrust}::DOUBLE AND coalesce(distrust, 0) > coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict,
  round(coalesce(trust, 0), 6) AS trust, round(coalesce(distrust, 0), 6) AS distrust
FROM ruled r LEFT JOIN hosts h ON h.host = r.host"""
