"""Mixing sources to target weights by Pareto order sampling.

Every document has an expected number of copies, in proportion to its weight, so that its source's expected words are
the source's target; a document whose share would pass the cap gets the cap, and what it leaves goes to the others until
none is above. The whole part is certain copies. The fractions are sampled: a document's rank is its random odds divided
by its inclusion odds, and the lowest ranks are taken until the words left are reached. A source is never sorted: ranks
are counted in buckets, the bucket where the target falls is found on the counts, and only that bucket's documents are
put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import common

#: Buckets of ranks in a source.
BUCKETS = 4096
#: Sources up to which their table is sent to every executor; beyond it is joined by shuffle.
BROADCAST_SOURCES = 100_000
#: Order of a source's documents: rank, id, then text and place, which tell repeated ids and rows apart.
ORDER = ("_rank", "_id", "_mark", "_at")
#: Weights are whole multiples of its inverse, so that their sums don't depend on the order of rows.
WEIGHT_UNIT = 1 << 20
#: Rounds in which shares above the cap are handed on; each settles one more weight at least.
MAX_ROUNDS = 200
WORDS = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def uniform(id_: Column, seed: str) -> Column:
    """A number of (0, 1) from the md5 of seed and id: 52 bits and a half."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("null"))).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def length_weight(text: Column) -> Column:
    """The number of binary digits of a text's word count: a long document is likelier than a short one, slowly so."""
    return F.length(F.bin(word_count(text)))


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: int) -> DataFrame:
    """source, source_size, target from (source, source_size).

    Sources in code point order, null last, take the weights in turn. Their targets are ``share`` of all
    words in proportion to the weights, but at most ``cap`` times a source's size; what is over goes to
    the others by weight, until none is above (found at once, from the order of cap / weight).
    """
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.pmod(F.row_number().over(rank) - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = sizes.withColumn("weight", turn).withColumn("most", F.col("source_size") * cap)
    whole = Window.partitionBy()
    fill = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(whole) * F.lit(float(share))
    level = (total - F.coalesce(F.sum("most").over(before), F.lit(0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    levels = weighed.withColumns({"level": level, "turn": F.row_number().over(fill)})
    free = F.col("most") > F.col("level") * F.col("weight")
    final = F.min(F.when(free, F.struct("turn", "level"))).over(whole)["level"]
    target = F.when(free, final * F.col("weight")).otherwise(F.col("most").cast("double"))
    return levels.withColumn("target", target).select("source", "source_size", "target")


class Mix:
    """A plan for ``docs``; ``decisions()`` gives a row per document, ``documents()`` the mixed rows.

    ``weight``: relative inclusion of documents within their source (a positive expression over docs, rounded to
    multiples of 2 ** -20; equal if left out). Null texts have size 0; a null source is a source; a null weight counts as
    the least; repeated ids, null ones too, have random numbers of their own by text and by count, so that no number is
    shared by many rows. Documents of size 0 get the copies of their weight, for 0 words. An
    empty table gives no rows. Equal input gives equal results. The sum that a source takes misses its target by
    half of one document at most, and no document is taken more than ``cap`` times. Columns may have any name.
    """

    def __init__(self, docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2, seed: str = "mix", weight: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", whole: bool = True) -> None:
        """``whole``: rows are written with their columns, as ``documents()`` needs them; else ``decisions()`` alone works."""
        self.cap, self.whole = cap, whole
        given = F.lit(1) if weight is None else weight
        marks = {
            "_id": F.col(id_col),
            "_source": F.col(source_col),
            "_size": word_count(F.col(text_col)),
            "_w": F.greatest(F.coalesce(F.round(given.cast("double") * WEIGHT_UNIT), F.lit(1.0)), F.lit(1.0)).cast("long"),
            "_u": uniform(F.col(id_col), seed),
            "_mark": F.xxhash64(F.col(text_col)),
            "_at": F.monotonically_increasing_id(),
        }
        row = [common.row_of(docs).alias("_row")] if whole else []
        # written once, so that a row keeps its place and its number whatever is asked of the plan
        rows = common.materialize(docs.select(*[v.alias(k) for k, v in marks.items()], *row), "mix-rows")
        self.rows = _numbered(rows, seed)
        sizes = self.rows.groupBy(F.col("_source").alias("source")).agg(F.sum("_size").alias("source_size"))
        goals = common.materialize(targets(sizes, weights, share, cap), "mix-targets")
        self.small = goals.count() <= BROADCAST_SOURCES
        self.sources = self._levels(goals)
        self.bounds = common.materialize(self._bounds(), "mix-bounds")

    def _with(self, sources: DataFrame) -> DataFrame:
        """The rows with their source's columns."""
        ends = F.broadcast(sources) if self.small else sources
        return self.rows.join(ends, F.col("_source").eqNullSafe(F.col("source")), "inner")

    def _levels(self, goals: DataFrame) -> DataFrame:
        """The sources with level (expected copies per unit of weight; infinite where all documents have the cap) and rest
        (words of the target that certain copies leave)."""
        full = F.when(F.col("target") >= self.cap * F.col("source_size"), float("inf"))
        now = goals.withColumn("level", F.coalesce(full, F.lit(0.0)))
        before = None
        for _ in range(MAX_ROUNDS):
            over = F.col("level") * F.col("_w") > self.cap
            mass = F.col("_size").cast("decimal(20,0)") * F.col("_w").cast("decimal(18,0)")
            zero = F.lit(0).cast("decimal(38,0)")
            sums = self._with(now).groupBy("source", "source_size", "target").agg(F.sum(F.when(over, F.col("_size")).otherwise(0)).alias("over"), F.sum(F.when(over, zero).otherwise(mass)).alias("mass"), F.count_if(over).alias("n"))
            level = (F.col("target") - self.cap * F.col("over")) / F.col("mass").cast("double")
            now = common.materialize(sums.withColumn("level", F.coalesce(full, F.when(F.col("mass") > 0, level), F.lit(0.0))), "mix-levels")
            settled = now.agg(F.sum("n")).first()[0]
            if settled == before:
                break
            before = settled
        else:
            raise RuntimeError(f"shares above the cap were not settled in {MAX_ROUNDS} rounds")
        now = now.select("source", "source_size", "target", "level")
        copies = F.floor(self._expected()).cast("long") * F.col("_size")
        return common.materialize(self._with(now).groupBy("source", "source_size", "target", "level").agg((F.col("target") - F.sum(copies)).alias("rest")), "mix-rests")

    def _expected(self) -> Column:
        return F.least(F.col("level") * F.col("_w"), F.lit(float(self.cap)))

    def _ranked(self, bounds: DataFrame) -> DataFrame:
        """Adds the source's columns, the rank among the fractions and its bucket, null without a fraction."""
        odds = lambda p: p / (1.0 - p)
        fraction = self._expected() - F.floor(self._expected())
        rank = F.when((fraction > 0) & (F.col("rest") > 0), odds(F.col("_u")) / odds(fraction))
        level = F.col("_rank") / (1.0 + F.col("_rank"))
        return self._with(bounds).withColumn("_rank", rank).withColumn("_bucket", F.least(F.floor(level * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))

    def _bounds(self) -> DataFrame:
        """The sources with the bucket where their rest falls, and the last document of it that is taken."""
        ranked = self._ranked(self.sources)
        order = Window.partitionBy("source").orderBy("_bucket")
        counts = ranked.where("_bucket IS NOT NULL").groupBy("source", "rest", "_bucket").agg(F.sum("_size").alias("words"))
        upto = counts.withColumn("upto", F.sum("words").over(order)).withColumn("before", F.col("upto") - F.col("words"))
        cross = upto.where("upto >= rest").groupBy("source").agg(F.min(F.struct("_bucket", "before")).alias("c")).select("source", F.col("c._bucket").alias("bucket"), F.col("c.before").alias("before"))
        ends = common.materialize(self.sources.alias("s").join(cross.alias("c"), F.col("s.source").eqNullSafe(F.col("c.source")), "left").select("s.*", "c.bucket", "c.before"), "mix-cross")
        inside = self._ranked(ends).where("_bucket = bucket")
        line = Window.partitionBy("source").orderBy(*ORDER)
        words = F.col("before") + F.coalesce(F.sum("_size").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        over = F.col("words") + F.col("_size") - F.col("rest")
        taken = inside.withColumn("words", words).where((over <= 0) | ((F.col("words") < F.col("rest")) & (over < F.col("rest") - F.col("words"))))
        last = taken.groupBy("source").agg(F.max(F.struct(*ORDER)).alias("last"))
        return ends.alias("e").join(last.alias("l"), F.col("e.source").eqNullSafe(F.col("l.source")), "left").select("e.*", "l.last")

    def _decide(self) -> DataFrame:
        here = F.struct(*ORDER)
        extra = F.coalesce(F.col("bucket").isNull() | (F.col("_bucket") < F.col("bucket")) | ((F.col("_bucket") == F.col("bucket")) & (here <= F.col("last"))), F.lit(False))
        return self._ranked(self.bounds).withColumn("_copies", F.floor(self._expected()).cast("long") + F.when(F.col("_rank").isNotNull() & extra, 1).otherwise(0))

    def decisions(self) -> DataFrame:
        """doc_id, size, source_size, target, expected, copies, taken (copies x size)."""
        return self._decide().select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target", self._expected().alias("expected"), F.col("_copies").alias("copies"), (F.col("_copies") * F.col("_size")).alias("taken"))

    def documents(self) -> DataFrame:
        """The rows of docs, each as often as it is taken, columns as they were."""
        if not self.whole:
            raise ValueError("the plan was made without whole rows")
        repeated = self._decide().where("_copies > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_nth"))
        return repeated.select("_row.*")


def _numbered(rows: DataFrame, seed: str) -> DataFrame:
    """``rows`` with random numbers of their own for those that share an id: by id, text and the row's count among equals.

    Equals are counted within their file part first, so no task holds all rows of one id.
    """
    shared = common.materialize(rows.groupBy(F.col("_id").alias("id")).agg(F.count("*").alias("n")).where("n > 1").select("id"), "mix-shared")
    if not shared.limit(1).count():
        return rows
    part = F.shiftright("_at", 33)  # of the partition that the row was written from
    again = rows.select("_id", "_mark", "_at").join(shared, F.col("_id").eqNullSafe(F.col("id")), "left_semi").withColumn("_part", part)
    local = Window.partitionBy("_id", "_mark", "_part").orderBy("_at")
    counted = common.materialize(again.withColumn("_nth", F.row_number().over(local) - 1), "mix-again")
    upto = Window.partitionBy("_id", "_mark").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.groupBy("_id", "_mark", "_part").count().withColumn("_base", F.coalesce(F.sum("count").over(upto), F.lit(0)))
    on = [F.col(f"c.{k}").eqNullSafe(F.col(f"b.{k}")) for k in ("_id", "_mark", "_part")]
    own = F.concat_ws(":", F.coalesce(F.col("c._id").cast("string"), F.lit("null")), F.col("c._mark").cast("string"), (F.col("_nth") + F.col("_base")).cast("string"))
    numbers = counted.alias("c").join(bases.alias("b"), on[0] & on[1] & on[2]).select(F.col("c._at").alias("_place"), uniform(own, f"{seed}:again").alias("_own"))
    joined = rows.join(numbers, F.col("_at") == F.col("_place"), "left").withColumn("_u", F.coalesce("_own", "_u"))
    return common.materialize(joined.drop("_own", "_place"), "mix-rows")


def oracle_sql(weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2, seed: str = "mix") -> str:
    """The same mix, by length_weight, in DuckDB: every source sorted by rank as a whole."""
    turns = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(weights))
    return f"""
WITH docs AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
    (CAST(('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
weighed AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} {turns} END AS weight, source_size * {cap} AS most FROM sizes),
levels AS (SELECT *, row_number() OVER fill AS turn,
    (CAST(sum(source_size) OVER () AS DOUBLE) * {float(share)}::DOUBLE - coalesce(CAST(sum(most) OVER (fill ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0))
    / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (fill ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS level
  FROM weighed WINDOW fill AS (ORDER BY most::DOUBLE / weight, source NULLS LAST)),
goals AS (SELECT source, source_size, CASE WHEN most > level * weight THEN (SELECT arg_min(level, turn) FROM levels WHERE most > level * weight) * weight ELSE most::DOUBLE END AS target FROM levels),
kinds AS (SELECT source, CAST(length(bin(size)) AS BIGINT) * {WEIGHT_UNIT} AS w, sum(size) AS words, sum(size * CAST(length(bin(size)) AS HUGEINT) * {WEIGHT_UNIT}) AS mass FROM docs GROUP BY ALL),
steps AS (SELECT k.source, k.w, (g.target - {cap} * coalesce(sum(k.words) OVER before, 0)) / CAST(sum(k.mass) OVER (PARTITION BY k.source) - coalesce(sum(k.mass) OVER before, 0) AS DOUBLE) AS level
  FROM kinds k JOIN goals g ON k.source IS NOT DISTINCT FROM g.source WINDOW before AS (PARTITION BY k.source ORDER BY k.w DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
filled AS (SELECT source, arg_max(level, w) FILTER (WHERE level * w <= {cap}) AS level FROM steps GROUP BY source),
shares AS (SELECT d.doc_id, d.size, d.u, d.source, g.source_size, g.target, CASE WHEN g.target >= {cap} * g.source_size THEN {cap}::DOUBLE ELSE least(coalesce(f.level, 0) * length(bin(d.size)) * {WEIGHT_UNIT}, {cap}::DOUBLE) END AS expected
  FROM docs d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source JOIN filled f ON d.source IS NOT DISTINCT FROM f.source),
rests AS (SELECT *, CAST(floor(expected) AS BIGINT) AS whole, expected - floor(expected) AS part, target - sum(CAST(floor(expected) AS BIGINT) * size) OVER (PARTITION BY source) AS rest FROM shares),
keyed AS (SELECT *, CASE WHEN part > 0 AND rest > 0 THEN (u / (1.0::DOUBLE - u)) / (part / (1.0::DOUBLE - part)) END AS k FROM rests),
lined AS (SELECT *, coalesce(CAST(sum(size) OVER (PARTITION BY source ORDER BY k NULLS LAST, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS words FROM keyed),
taken AS (SELECT *, whole + CASE WHEN k IS NOT NULL AND (words + size <= rest OR (words < rest AND words + size - rest < rest - words)) THEN 1 ELSE 0 END AS n FROM lined)
SELECT doc_id, size, source_size, target, expected, CAST(n AS BIGINT) AS copies, CAST(n * size AS BIGINT) AS taken FROM taken"""
