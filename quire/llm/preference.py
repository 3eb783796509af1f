"""Preference formatting: the turns that chosen and rejected share are rendered once, as the prompt. Native expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a turn is written: before the role, after it, after the text.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"
TRAINED_ROLE = "assistant"


def conversations(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """conv_id, turns (array of struct(role, text)) in turn order; equal turn numbers by role and text, null ids left out.

    A conversation becomes one row because it is rendered as one string.
    """
    line = F.struct(F.col("turn"), F.col("role"), F.col("text"))
    grouped = turns.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("conv_id")).agg(F.sort_array(F.collect_list(line)).alias("t"))
    return grouped.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading turns that are equal in role and text (nulls equal each other)."""
    same = F.zip_with(a, b, lambda x, y: x.isNotNull() & y.isNotNull() & x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _turn), "")


def _turn(t: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(t["role"], F.lit("unknown")), F.lit(MIDDLE), F.coalesce(t["text"], F.lit("")), F.lit(CLOSE))


def trained_spans(turns: Column) -> Column:
    """Array of struct(begin, end): the code points of the rendered turns that count for the loss, text and
    closing mark of the assistant's turns; everything else is masked."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        head = F.length(F.coalesce(t["role"], F.lit("unknown"))) + len(OPEN) + len(MIDDLE)
        end = state["at"] + head + F.length(F.coalesce(t["text"], F.lit(""))) + len(CLOSE)
        span = F.struct((state["at"] + head).alias("begin"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(t["role"] == TRAINED_ROLE, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(turns, start, step)["spans"]


def format_pairs(pairs: DataFrame) -> DataFrame:
    """pair_id, n_prompt_turns, prompt, chosen, rejected, chosen_spans, rejected_spans from (pair_id, chosen, rejected).

    chosen and rejected are arrays of struct(role, text). Their longest common prefix of turns becomes the
    prompt; what follows becomes the two completions, whose spans are counted within the completion. A null
    side is an empty conversation; equal sides give two empty completions; a null role reads "unknown", a
    null text is empty. One row per input row; other columns are ignored.
    """
    empty = F.array().cast("array<struct<role:string,text:string>>")
    sides = pairs.select("pair_id", F.coalesce("chosen", empty).alias("c"), F.coalesce("rejected", empty).alias("r"))
    cut = sides.withColumn("n_prompt_turns", common_prefix(F.col("c"), F.col("r")))
    rest = lambda x: F.slice(x, F.col("n_prompt_turns") + 1, F.greatest(F.size(x), F.lit(1)))
    tails = cut.select("pair_id", "n_prompt_turns", F.slice("c", F.lit(1), F.col("n_prompt_turns")).alias("p"), rest(F.col("c")).alias("c"), rest(F.col("r")).alias("r"))
    return tails.select("pair_id", "n_prompt_turns", render(F.col("p")).alias("prompt"), render(F.col("c")).alias("chosen"), render(F.col("r")).alias("rejected"), trained_spans(F.col("c")).alias("chosen_spans"), trained_spans(F.col("r")).alias("rejected_spans"))


def divergent_pairs(turns: DataFrame, partner: Column | None = None) -> DataFrame:
    """pair_id, chosen, rejected for every conversation with an assistant turn; turns are grouped by one shuffle.

    ``partner``: what a conversation shares with the one that it is paired with; conversations are paired with the next
    of theirs, the last with the first. If left out, whole-number ids are paired as 2 k with 2 k + 1, and others stay
    alone. chosen: the conversation up to its last assistant turn. rejected: its opening, half as many turns as the
    shorter of the two has, then the partner's turns after as many of its own, up to its last assistant turn.
    A conversation that is alone is rejected after its opening, with nothing that follows.
    Null ids, and conversations without an assistant turn, make no pair and are no partner. An empty table gives no rows;
    repeated turns are turns of their own; null roles and texts stay.
    """
    whole = dict(turns.dtypes)["conv_id"] in ("bigint", "int", "smallint", "tinyint")
    key = partner if partner is not None else F.shiftright("conv_id", 1) if whole else F.col("conv_id")
    line = F.struct("conv_id", "turn", "role", "text")
    groups = turns.where(F.col("conv_id").isNotNull()).groupBy(key.alias("k")).agg(F.sort_array(F.collect_list(line)).alias("t"))
    ids = F.array_distinct(F.transform("t", lambda x: x["conv_id"]))

    def upto_last_reply(own: Column) -> Column:
        last = F.array_max(F.transform(own, lambda x, i: F.when(x["role"] == TRAINED_ROLE, i + 1).otherwise(0)))
        return F.transform(F.slice(own, F.lit(1), F.coalesce(last, F.lit(0))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))

    sides = F.transform(ids, lambda c: F.struct(c.alias("conv_id"), upto_last_reply(F.filter("t", lambda x: x["conv_id"] == c)).alias("turns")))
    held = groups.select(F.filter(sides, lambda s: F.size(s["turns"]) > 0).alias("s"))
    each = held.select("s", F.posexplode("s").alias("nth", "own"))
    other = F.when(F.size("s") > 1, F.get("s", F.pmod(F.col("nth") + 1, F.size("s")))["turns"])
    paired = each.select(F.col("own.conv_id").alias("pair_id"), F.col("own.turns").alias("chosen"), other.alias("other"))
    opening = F.floor(F.least(F.size("chosen"), F.when(F.col("other").isNotNull(), F.size("other"))) / 2).cast("int")
    tail = F.coalesce(F.slice("other", F.col("n") + 1, F.greatest(F.size("other"), F.lit(1))), F.slice("chosen", 1, 0))
    return paired.withColumn("n", opening).select("pair_id", "chosen", F.concat(F.slice("chosen", F.lit(1), F.col("n")), tail).alias("rejected"))


def oracle_sql() -> str:
    nl = "chr(10)"
    text = f"'{OPEN}' || coalesce(role, 'unknown') || '|>' || {nl} || coalesce(text, '') || '<|end|>' || {nl}"
    head = f"{len(OPEN) + len(MIDDLE)} + length(coalesce(role, 'unknown'))"
    side = lambda s: f"coalesce((SELECT string_agg(r, '' ORDER BY pos) FROM ends e WHERE e.pair_id = a.conv_id AND side = '{s}' AND pos > k), '')"
    spans = lambda s: f"coalesce((SELECT string_agg(CAST(upto - n + head AS VARCHAR) || '-' || CAST(upto AS VARCHAR), ';' ORDER BY pos) FROM ends e WHERE e.pair_id = a.conv_id AND side = '{s}' AND pos > k AND role = '{TRAINED_ROLE}'), '')"
    return f"""
WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos FROM conversations WHERE conv_id IS NOT NULL),
cuts AS (SELECT conv_id, max(pos) AS n FROM t WHERE role = '{TRAINED_ROLE}' GROUP BY conv_id),
both_ AS (SELECT a.conv_id, a.n, b.conv_id AS other, b.n AS m, least(a.n, coalesce(b.n, a.n)) // 2 AS opening FROM cuts a LEFT JOIN cuts b ON b.conv_id = xor(a.conv_id, 1)),
turns AS (SELECT b.conv_id AS pair_id, 'c' AS side, t.pos, t.role, t.text FROM both_ b JOIN t ON t.conv_id = b.conv_id AND t.pos <= b.n
  UNION ALL SELECT b.conv_id, 'r', t.pos, t.role, t.text FROM both_ b JOIN t ON (t.conv_id = b.conv_id AND t.pos <= b.opening) OR (t.conv_id = b.other AND t.pos > b.opening AND t.pos <= b.m)),
apart AS (SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, min(coalesce(c.pos, r.pos)) AS first FROM (SELECT * FROM turns WHERE side = 'c') c FULL JOIN (SELECT * FROM turns WHERE side = 'r') r ON r.pair_id = c.pair_id AND r.pos = c.pos
  WHERE c.pos IS NULL OR r.pos IS NULL OR c.role IS DISTINCT FROM r.role OR c.text IS DISTINCT FROM r.text GROUP BY 1),
prefix AS (SELECT b.conv_id, coalesce(p.first - 1, b.n) AS k FROM both_ b LEFT JOIN apart p ON p.pair_id = b.conv_id),
written AS (SELECT u.*, {text} AS r, {head} AS head FROM turns u),
ends AS (SELECT w.*, p.k, length(r) AS n, sum(length(r)) OVER (PARTITION BY w.pair_id, side, pos > p.k ORDER BY pos) AS upto FROM written w JOIN prefix p ON p.conv_id = w.pair_id)
SELECT a.conv_id AS pair_id, CAST(k AS INTEGER) AS n_prompt_turns, coalesce((SELECT string_agg(r, '' ORDER BY pos) FROM ends e WHERE e.pair_id = a.conv_id AND side = 'c' AND pos <= a.k), '') AS prompt,
  {side('c')} AS chosen, {side('r')} AS rejected, {spans('c')} AS chosen_spans, {spans('r')} AS rejected_spans FROM prefix a"""
