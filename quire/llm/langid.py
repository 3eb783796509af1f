"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training is one pass that counts n-grams per language in every task and sums the counts by shuffle; the
log-probability matrix (languages x buckets) goes to the workers with the scoring function, which scores
batches of texts with sparse numpy gathers. A matrix holds at most GROUP languages; with more, the languages
are scored group by group, and the best of all and the sum of their odds are carried from pass to pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import common

#: Hash buckets (a power of two), n-gram orders, additive smoothing.
BUCKET_BITS, ORDERS, SMOOTHING = 15, (1, 2, 3), 0.5
#: Languages of a matrix; with more, there are several. Cells of the counts that a task holds before it hands them on.
GROUP, HELD_CELLS = 128, 1 << 22
#: N-grams that count as evidence in a score at most, so that long texts aren't all exactly 1.
EVIDENCE = 64
UNDETERMINED = "und"
_TEXTS = 1 << 20
_DOCS = -1


def codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of lower-cased texts, each after two zeros and all before two more; where each text begins.
    An n-gram of up to three never spans two texts."""
    blocks = ["\0\0" + t.lower() if t else "\0\0" for t in texts]
    lengths = np.fromiter(map(len, blocks), np.int64, len(blocks))
    points = np.frombuffer(("".join(blocks) + "\0\0").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return points, np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(blocks) else lengths


def grams(points: np.ndarray, orders: tuple[int, ...] = ORDERS, bits: int = BUCKET_BITS) -> Iterator[np.ndarray]:
    """Bucket of the n-gram that begins at each code point, for each order."""
    n = len(points) - 2
    mixed = points.astype(np.uint32) * np.uint32(0x9E3779B1)
    h = np.full(n, 0x2545F491, np.uint32)
    for order in range(1, max(orders) + 1):
        h = (h ^ mixed[order - 1 : order - 1 + n]) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        if order in orders:
            yield (h >> np.uint32(32 - bits)).astype(np.int32)


@dataclass(frozen=True)
class Model:
    """langs ascending; prior[lang] and table[bucket, lang] are log-probabilities, the table of the first ``group``
    languages. ``counts`` (lang, bucket, n) has those of all."""

    langs: list[str]
    table: np.ndarray
    prior: np.ndarray
    bits: int = BUCKET_BITS
    orders: tuple[int, ...] = ORDERS
    counts: DataFrame | None = None
    group: int = GROUP

    def parts(self) -> Iterator["Model"]:
        """A model for each group of languages, without the counts; their priors are those among all languages."""
        for k in range(0, max(1, len(self.langs)), self.group):
            own = self.langs[k : k + self.group]
            table = self.table if k == 0 else log_table(self.counts, own, self.bits)
            yield replace(self, langs=own, table=table, prior=self.prior[k : k + self.group], counts=None)


def log_table(counts: DataFrame, langs: list[str], bits: int) -> np.ndarray:
    """Smoothed log-probabilities of the buckets for some languages, filled from Arrow columns."""
    size = 1 << bits
    table = np.full((size, len(langs)), SMOOTHING)
    if not langs:
        return table
    found = counts.where((F.col("bucket") != _DOCS) & F.col("lang").between(langs[0], langs[-1])).toArrow()  # at most size x GROUP rows
    lang = pc.index_in(found.column("lang"), pa.array(langs, pa.string())).to_numpy()
    table[found.column("bucket").to_numpy(), lang] += found.column("n").to_numpy()
    return np.log(table / table.sum(axis=0))


def train(docs: DataFrame, where: Column, text_col: str = "text", lang_col: str = "lang", bits: int = BUCKET_BITS, orders: tuple[int, ...] = ORDERS, group: int = GROUP) -> Model:
    """Counts over all rows for which ``where`` holds and neither text nor language is null; without any (an empty
    table), a model of no language. What comes to the driver is the distinct languages and one matrix."""
    common.prepare(docs.sparkSession)
    size = 1 << bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(np.where(at == size, _DOCS, at).astype(np.int32)), pa.array(counts[at])], names=["lang", "bucket", "n"])
            held.clear()

        for batch in common.slices(batches, "text", _TEXTS):
            langs = batch.column("lang").to_pylist()
            texts = batch.column("text").to_pylist()
            for lang in set(langs):
                own = [t for t, k in zip(texts, langs, strict=True) if k == lang]
                counts = held.setdefault(lang, np.zeros(size + 1, np.int64))
                points, _ = codes(own)
                for g in grams(points, orders, bits):
                    counts[:size] += np.bincount(g, minlength=size)
                counts[size] += len(own)
            if len(held) * size > HELD_CELLS:
                yield from flush()
        yield from flush()

    rows = docs.where(where).select(docs[text_col].alias("text"), docs[lang_col].cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    sums = rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    sums = common.materialize(sums, "langid-counts")
    per_lang = sorted((r["lang"], r["n"]) for r in sums.where(F.col("bucket") == _DOCS).select("lang", "n").collect())  # a row for each language
    langs, docs_of = [k for k, _ in per_lang], np.array([n for _, n in per_lang], float)
    return Model(langs, log_table(sums, langs[:group], bits), np.log(docs_of / max(1.0, docs_of.sum())), bits, orders, sums, group)


@dataclass
class Standing:
    """Of each text, over the languages scored so far: the best one (empty for a text without a letter), its
    log-posterior, its log-posterior with the evidence of long texts scaled down, and the log of the sum of all such."""

    lang: np.ndarray
    best: np.ndarray
    scaled: np.ndarray
    total: np.ndarray

    @staticmethod
    def start(n: int) -> "Standing":
        none = np.full(n, -np.inf)
        return Standing(np.full(n, "", dtype=object), none, none.copy(), none.copy())

    def probability(self) -> np.ndarray:
        live = self.lang != ""
        return np.where(live, np.exp(np.where(live, self.scaled, 0.0) - np.where(live, self.total, 0.0)), 0.0)

    def predicted(self) -> list[str]:
        return np.where(self.lang != "", self.lang, UNDETERMINED).tolist()


def advance(model: Model, texts: list[str | None], at: Standing) -> Standing:
    """The standing after the languages of ``model``, which come after those scored before; ties stay with the smaller."""
    live = np.array([i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if model.langs else [], np.int64)
    if not len(live):
        return at
    points, begins = codes([texts[i] for i in live])
    total = np.zeros((len(live), len(model.langs)))
    for g in grams(points, model.orders, model.bits):
        for k in range(len(model.langs)):
            total[:, k] += np.add.reduceat(model.table[:, k][g], begins)
    count = np.diff(np.append(begins, len(points) - 2)) * len(model.orders)
    each, line = np.arange(len(live)), model.prior + total
    top = np.argmax(line, axis=1)
    scaled = model.prior + total * np.minimum(1.0, EVIDENCE / count)[:, None]
    high = scaled.max(axis=1)
    at.total[live] = np.logaddexp(at.total[live], high + np.log(np.exp(scaled - high[:, None]).sum(axis=1)))
    better = line[each, top] > at.best[live]
    won, top, each = live[better], top[better], each[better]
    at.lang[won], at.best[won], at.scaled[won] = np.array(model.langs, dtype=object)[top], line[each, top], scaled[each, top]
    return at


def score(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Predicted language and its posterior probability, with the evidence of long texts scaled down to EVIDENCE n-grams."""
    at = Standing.start(len(texts))
    for part in model.parts():
        at = advance(part, texts, at)
    return at.predicted(), at.probability()


def predict(docs: DataFrame, model: Model, text_col: str = "text", lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its score appended under the names given, which docs must not have.

    A null text or one without a letter is ``und`` with score 0, as is every text where no language was
    learned. Ties go to the smallest language. Rows, other columns and repeated rows are kept as they are; an
    empty table gives no rows.
    """
    common.prepare(docs.sparkSession)
    if common.fresh(docs, lang_name, score_name) != [lang_name, score_name]:
        raise ValueError(f"a column is already named {lang_name} or {score_name}")
    if len(model.langs) <= model.group:
        return _passes(docs, next(model.parts()), text_col, lang_name, score_name)
    # more languages than one matrix holds: a pass for each group, its standing written with the rows
    state = common.fresh(docs, "lang_", "best_", "scaled_", "total_")
    rows = docs.select("*", F.lit("").alias(state[0]), *[F.lit(float("-inf")).alias(c) for c in state[1:]])
    names = docs.columns
    fields = [*docs.schema.fields, T.StructField(state[0], T.StringType()), *[T.StructField(c, T.DoubleType()) for c in state[1:]]]
    for part in model.parts():

        def run(batches: Iterator[pa.RecordBatch], part: Model = part) -> Iterator[pa.RecordBatch]:
            for batch in common.slices(batches, text_col, _TEXTS):
                held = [batch.column(c).to_numpy(zero_copy_only=False).copy() for c in state]
                at = advance(part, batch.column(text_col).to_pylist(), Standing(held[0].astype(object), *held[1:]))
                new = [pa.array(at.lang, pa.string()), pa.array(at.best), pa.array(at.scaled), pa.array(at.total)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *new], names=[*names, *state])

        rows = common.materialize(rows.mapInArrow(run, T.StructType(fields)), "langid-pass")
    lang, _, scaled, total = (F.col(c) for c in state)
    none = lang == ""
    return rows.select(*[rows[c] for c in docs.columns], F.when(none, UNDETERMINED).otherwise(lang).alias(lang_name), F.when(none, 0.0).otherwise(F.exp(scaled - total)).alias(score_name))


def _passes(docs: DataFrame, model: Model, text_col: str, lang_name: str, score_name: str) -> DataFrame:
    schema = T.StructType([*docs.schema.fields, T.StructField(lang_name, T.StringType()), T.StructField(score_name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, text_col, _TEXTS):
            langs, probs = score(model, batch.column(text_col).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(probs)], names=[*batch.schema.names, lang_name, score_name])

    return docs.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    """Whether crc32 of the id as text falls into the held-out fold; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; trained on the rows that aren't held out.

    A row with a null id is neither held out nor trained on.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model = train(rows, ~held_out())
    scored = predict(rows.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
