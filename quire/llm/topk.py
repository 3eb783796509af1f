"""Exact top-k by inner product from an impact-ordered index, score at a time.

Vectors are dealt into shards. A shard keeps, per dimension, one posting list of its vectors by quantised component,
cut into segments of equal component; read from the top it is the list for a positive query component, from the bottom
for a negative one. The index is built once and written; queries, in blocks of bounded size, are joined with its shards
in one stage.

For a query the segments of all lists are processed by descending impact: the most that a vector of the segment can add
to the score. A vector gets at most the next impact from each list where it hasn't been met, and the k-th best exact
score of the vectors that look best so far is one that members must reach; so it is proven which can't be members. Processing stops once scoring all possible members exactly is less work than the
next round of segments; it never depends on how large a shard is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import common

#: Components of a shard, queries of a block, quantised components of a list, rounds in which a query's segments are processed.
SHARD_CELLS, QUERY_BLOCK, LEVELS, ROUNDS = 1 << 21, 1024, 256, 16
#: Vectors scored exactly in each round for a bound from below, in multiples of k.
SOUNDED = 4
_INDEX = "dims int, shard int, width int, ids binary, xs binary, order binary, begins binary, low binary, step binary"


@dataclass
class Stops:
    """How searches ended: their number, those that left segments unprocessed, postings met and in all, rows scored exactly."""

    searches: int = 0
    early: int = 0
    met: int = 0
    postings: int = 0
    rescored: int = 0


@dataclass
class ShardIndex:
    """The posting lists of one shard: order[d] has its rows by rising quantised component of dimension d, the rows of
    level l from begins[d, l] to begins[d, l + 1]; level l holds components low + l * step and up to step - 1 more."""

    ids: np.ndarray
    x: np.ndarray
    order: np.ndarray
    begins: np.ndarray
    low: np.ndarray
    step: np.ndarray

    @staticmethod
    def build(ids: np.ndarray, x: np.ndarray, levels: int = LEVELS) -> "ShardIndex":
        by_id = np.argsort(ids, kind="stable")
        ids, x = ids[by_id], x[by_id]
        low, high = x.min(axis=0), x.max(axis=0)
        step = (high - low) // levels + 1
        level = (x - low) // step
        order = np.argsort(level, axis=0, kind="stable").T.copy()
        counts = np.stack([np.bincount(c, minlength=levels) for c in level.T])
        begins = np.concatenate([np.zeros((len(counts), 1), np.int64), np.cumsum(counts, axis=1)], axis=1)
        return ShardIndex(ids, x, order, begins, low, step)

    def row(self, dims: int, shard: int) -> dict:
        """The index as one row of its table."""
        narrow = len(self.x) and np.abs(self.x).max() < 1 << 31
        xs = self.x.astype("<i4" if narrow else "<i8")
        held = {"ids": self.ids.astype("<i8"), "xs": xs, "order": self.order.astype("<u4"), "begins": self.begins.astype("<u4"), "low": self.low.astype("<i8"), "step": self.step.astype("<i8")}
        return {"dims": dims, "shard": shard, "width": 4 if narrow else 8} | {k: v.tobytes() for k, v in held.items()}

    @staticmethod
    def of(row: dict) -> "ShardIndex":
        dims = row["dims"]
        get = lambda k, kind: np.frombuffer(row[k], kind)
        x = get("xs", f"<i{row['width']}").reshape(-1, dims).astype(np.int64)
        return ShardIndex(get("ids", "<i8"), x, get("order", "<u4").reshape(dims, -1).astype(np.intp), get("begins", "<u4").reshape(dims, -1).astype(np.int64), get("low", "<i8"), get("step", "<i8"))

    def search(self, query: np.ndarray, k: int, skip: np.ndarray, stops: Stops | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows and exact scores of every possible member of the k best for a query; the rows ``skip`` are left out."""
        n, levels = len(self.ids), self.begins.shape[1] - 1
        dims = np.flatnonzero(query)
        open_ = np.ones(n, bool)
        open_[skip] = False
        if not len(dims) or open_.sum() <= k:
            rest = np.flatnonzero(open_)
            return rest, self.x[rest] @ query
        q = query[dims].astype(float)
        first = self.low[dims, None] + np.arange(levels)[None, :] * self.step[dims, None]
        ends = np.stack([first, first + self.step[dims, None] - 1]).astype(float)
        adds = np.sort(q[None, :, None] * ends, axis=0)  # least and most that a vector of each segment adds
        # every list from its greatest impact on
        turn = np.where(q > 0, -1, 1)
        line = lambda a: np.where(turn[:, None] < 0, a[:, ::-1], a)
        least, most = line(adds[0]), line(adds[1])
        sizes = line(np.diff(self.begins[dims], axis=1))
        by_impact = np.argsort(-most, axis=None, kind="stable")
        done = np.cumsum(sizes.ravel()[by_impact])
        cuts = np.unique(np.searchsorted(done, done[-1] * np.arange(1, ROUNDS + 1) / ROUNDS) + 1)
        at = np.zeros(len(dims), np.int64)
        # of the lists where a vector was met: the sum of the least that it adds, and their number
        sums, met = np.zeros(n), np.zeros(n, np.float32)
        sums[skip] = -np.inf
        slack, last = 0.0, 0
        room = 1.0 + 1e-12 * np.abs(adds).max(axis=(0, 2)).sum()  # for rounding of sums in doubles
        some = min(n, SOUNDED * k + len(skip))
        for cut in cuts.tolist():
            upto = at + np.bincount(by_impact[last:cut] // levels, minlength=len(dims))
            for i in np.flatnonzero(upto > at):
                a, b = at[i], upto[i]
                found = self.begins[dims[i]]
                if turn[i] < 0:
                    lo, hi, held = found[levels - b], found[levels - a], slice(a, b)
                    values = np.repeat(least[i, held][::-1], sizes[i, held][::-1])
                else:
                    lo, hi = found[a], found[b]
                    values = np.repeat(least[i, a:b], sizes[i, a:b])
                rows = self.order[dims[i], lo:hi]
                sums[rows] += values
                met[rows] += 1
            slack += float(((most - least)[:, 0] * ((at == 0) & (upto > 0))).sum())
            at, last = upto, cut
            left = int(done[-1] - done[cut - 1])
            # a list where a vector wasn't met adds the next impact at most; the k-th exact score of some is a bound from below
            upper = sums + (len(dims) - met) * (most.flat[by_impact[cut]] if left else 0.0) + (slack + room)
            best = np.argpartition(-upper, some - 1)[:some]
            exact = self.x[best[open_[best]]] @ query
            rest = np.flatnonzero(upper >= np.partition(exact, len(exact) - k)[len(exact) - k])
            if len(rest) * len(dims) <= min(left, done[-1] / ROUNDS):
                break
        if stops is not None:
            stops.searches, stops.early, stops.met = stops.searches + 1, stops.early + (left > 0), stops.met + int(done[cut - 1])
            stops.postings, stops.rescored = stops.postings + int(done[-1]), stops.rescored + len(rest)
        return rest, self.x[rest] @ query


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id, x (array of long, floor(scale * component)); rows with a null id, a null or empty vector, or a null or non-finite component are left out."""
    v = F.col(vector_col)
    sound = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & sound).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda c: F.floor(c.cast("double") * scale)).alias("x"))


def _dealt(rows: DataFrame, name: str, salt: int, numbers: dict[int, int]) -> DataFrame:
    """``rows`` with a part number by hash of the id, of as many as ``numbers`` has for their vector length."""
    of = F.element_at(F.create_map(*[F.lit(v) for d, c in numbers.items() for v in (d, c)]), F.col("dims"))
    return rows.withColumn(name, F.pmod(F.xxhash64("id", F.lit(salt)), of).cast("int"))


def _matrix(found: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
    dims = found.column("dims")[0].as_py()
    flat = found.column("x").combine_chunks().values.to_numpy(zero_copy_only=False)
    return dims, found.column("id").combine_chunks().to_numpy(), flat.reshape(-1, dims)


def index(rows: DataFrame, sizes: dict[int, int], shard_cells: int = SHARD_CELLS) -> DataFrame:
    """The index table, a row per shard of about ``shard_cells`` components, from (id, x, dims) and the number of rows of each vector length."""

    def build(found: pa.Table) -> pa.Table:
        dims, ids, x = _matrix(found)
        row = ShardIndex.build(ids, x).row(dims, found.column("shard")[0].as_py())
        return pa.Table.from_pylist([row], schema=_ARROW_INDEX)

    dealt = _dealt(rows, "shard", 3, {d: -(-c * d // shard_cells) for d, c in sizes.items()})
    return dealt.groupBy("dims", "shard").applyInArrow(build, _INDEX)


_ARROW_INDEX = pa.schema([(f.split()[0], pa.binary() if f.endswith("binary") else pa.int32()) for f in _INDEX.split(", ")])


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", shard_cells: int = SHARD_CELLS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query with every other vector.

    ``is_query`` is a condition over the column id. Ties go to the smaller vec_id; a query with fewer than k
    others gets all. A query's own row is no candidate for it, nor are other rows of its id; of query rows that share an
    id, equal ones are one query, and the results of unequal ones are ranked together. Rows that repeat another id are
    candidates of their own. Vectors of different length aren't compared. Unsound vectors (see quantised) take no part.
    Scores must fit 64 bits. An empty table gives no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    common.prepare(spark)
    rows = common.materialize(quantised(vectors, id_col, vector_col, scale).withColumn("dims", F.size("x")), "topk-rows")
    asked = common.materialize(rows.where(is_query).distinct(), "topk-queries")
    sizes = {r["dims"]: r["count"] for r in rows.groupBy("dims").count().collect()}  # a row for each vector length
    n_asked = {r["dims"]: r["count"] for r in asked.groupBy("dims").count().collect()}
    if not n_asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    shards = common.materialize(index(rows, sizes, shard_cells), "topk-index")
    n_shards = {r["dims"]: r["count"] for r in shards.groupBy("dims").count().collect()}

    def pack(found: pa.Table) -> pa.Table:
        dims, ids, x = _matrix(found)
        return pa.table({"dims": pa.array([dims], pa.int32()), "block": pa.array([found.column("block")[0].as_py()], pa.int32()), "qids": pa.array([ids.astype("<i8").tobytes()], pa.binary()), "qxs": pa.array([x.astype("<i8").tobytes()], pa.binary())})

    # few shards are read by several tasks each, which take the blocks in turn
    tasks = spark.sparkContext.defaultParallelism
    turns = {d: -(-tasks // n_shards[d]) for d in n_asked}
    blocks = {d: max(-(-c // query_block), min(turns[d], -(-c // 8))) for d, c in n_asked.items()}
    packed = _dealt(asked, "block", 5, blocks).groupBy("dims", "block").applyInArrow(pack, "dims int, block int, qids binary, qxs binary")
    of = lambda numbers: F.element_at(F.create_map(*[F.lit(v) for d in n_asked for v in (d, min(numbers[d], 1 << 30))]), F.col("dims"))
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = shards.where(F.col("dims").isin(*n_asked)).withColumn("turn", upto(F.least(of(turns), of(blocks))))
    # a block goes to every shard; its turn says which of the shard's readers takes it
    right = packed.withColumn("turn", F.pmod("block", F.least(of(turns), of(blocks)))).withColumn("shard", upto(of({d: -(-sizes[d] * d // shard_cells) for d in n_asked})))
    units = left.join(right.hint("shuffle_hash"), ["dims", "shard", "turn"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, shard = None, None
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                if known != (row["dims"], row["shard"]):
                    known, shard = (row["dims"], row["shard"]), ShardIndex.of(row)
                qids, qxs = np.frombuffer(row["qids"], "<i8"), np.frombuffer(row["qxs"], "<i8").reshape(-1, row["dims"])
                out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 3]
                for qid, x in zip(qids, qxs, strict=True):
                    own = np.arange(np.searchsorted(shard.ids, qid), np.searchsorted(shard.ids, qid, side="right"))
                    rest, scores = shard.search(x, k, own)
                    best = np.lexsort((shard.ids[rest], -scores))[:k]
                    out.append((np.full(len(best), qid), shard.ids[rest[best]], scores[best]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

    found = units.drop("turn", "block").mapInArrow(run, "query_id long, vec_id long, score long")
    line = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def oracle_sql(k: int = 10, scale: int = 1024, every: int = 100) -> str:
    """Brute force: every query against every row."""
    return f"""
WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM s a JOIN s b ON a.vec_id % {every} = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM p)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= {k}"""
