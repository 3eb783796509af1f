"""Embedding near-duplicates by a forest of random-projection trees.

Equal vectors of a label are one class from the start. Each tree, fitted on a bounded sample, splits along a random
direction, where few vectors lie near the split; one within a margin of it goes to both sides (spill). A label uses a
tree as deep as its size asks for. Classes of one label that share a leaf are compared exactly. A pair that shares
several leaves is counted in the first of them only, which a task finds from the two vectors and the trees, so a
class goes to a leaf with its vector and nothing else, link counts are sums, and a task returns counts and a spanning
forest, never all pairs. A leaf beyond ``block`` classes is compared in pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import common
from quire.llm.components import components, forest

#: Trees, half the width of the strip that goes to both sides (of unit vectors, along a direction of unit variance per
#: component), classes of a label that a leaf should hold.
TREES, MARGIN, LEAF = 8, 0.1, 400
#: Levels with splits of their own for each node; the splits of deeper levels are one for all nodes.
FITTED, MAX_DEPTH = 12, 40
#: Classes on which the trees are fitted, and classes of a leaf beyond which it is compared in blocks.
SAMPLE, BLOCK = 8192, 2048
#: Labels, and large leaves, up to which their table is sent to every executor; beyond it is joined by shuffle.
BROADCAST_ROWS = 100_000


def classes(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """label, v, rep (smallest vec_id), copies: one row per distinct sound vector of a label.

    Unsound: null id, label or vector, a null or non-finite component, or no length.
    """
    v = F.col(vector_col)
    sound = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull() & sound)
    plain = rows.select(F.col(label_col).cast("string").alias("label"), _plain(vectors, vector_col).alias("v"), F.col(id_col).cast("long").alias("vec_id"))
    return plain.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))


def _plain(vectors: DataFrame, vector_col: str):
    """The components as floats if they are floats, else as doubles; adding 0 makes -0 and 0 one value."""
    of = vectors.schema[vector_col].dataType.elementType
    kind = "float" if isinstance(of, T.FloatType) else "double"
    return F.transform(F.col(vector_col), lambda c: c.cast(kind) + F.lit(0.0).cast(kind))


class Trees:
    """Directions of each level and, in heap order, the split of each node down to level FITTED (none where no split parts
    the sample's vectors without cutting through most of them); the splits of deeper levels are the sample's medians."""

    def __init__(self, sample: np.ndarray, depth: int, trees: int, margin: float, seed: int = 13) -> None:
        rng = np.random.default_rng(seed)
        self.depth, self.trees, self.margin = depth, trees, margin
        self.fitted = min(depth, FITTED)
        self.direction = rng.standard_normal((trees, depth, sample.shape[1]))
        self.split = np.full((trees, (1 << self.fitted) - 1), np.nan)
        self.deep = np.zeros((trees, depth))
        for t in range(trees):
            p = sample @ self.direction[t].T
            self.deep[t] = np.median(p, axis=0) if len(sample) else 0.0
            held = {0: np.arange(len(sample))}
            for node in range(self.split.shape[1]):
                own = held.pop(node, None)
                if own is None:
                    continue
                along = p[own, (node + 1).bit_length() - 1]
                at = _quiet(along, margin)
                if at is not None:
                    self.split[t, node] = at
                    held[2 * node + 1], held[2 * node + 2] = own[along <= at], own[along > at]

    def _at(self, t: int, k: int, node: np.ndarray) -> np.ndarray:
        return self.split[t, node] if k < self.fitted else np.full(len(node), self.deep[t, k])

    def project(self, t: int, x: np.ndarray) -> np.ndarray:
        return x @ self.direction[t].T

    def leaves(self, t: int, x: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, node) of every leaf that a vector is in, its label's tree ending at ``depth``."""
        p = self.project(t, x)
        row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        for k in range(int(depth.max(initial=0))):
            first = (1 << k) - 1
            on = (node >= first) & (depth[row] > k)
            on[on] = ~np.isnan(self._at(t, k, node[on]))
            at, along = self._at(t, k, node[on]), p[row[on], k]
            left, right = along <= at + self.margin, along >= at - self.margin
            row = np.concatenate([row[~on], row[on][left], row[on][right]])
            node = np.concatenate([node[~on], 2 * node[on][left] + 1, 2 * node[on][right] + 2])
        return row, node

    def first_common(self, t: int, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
        """The first leaf that both vectors of each pair are in, from their projections; -1 where there is none."""
        pair, node = np.arange(len(a)), np.zeros(len(a), np.int64)
        for k in range(depth):
            on = node >= (1 << k) - 1
            on[on] = ~np.isnan(self._at(t, k, node[on]))
            at, low, high = self._at(t, k, node[on]), np.minimum(a[pair[on], k], b[pair[on], k]), np.maximum(a[pair[on], k], b[pair[on], k])
            left, right = high <= at + self.margin, low >= at - self.margin
            pair = np.concatenate([pair[~on], pair[on][left], pair[on][right]])
            node = np.concatenate([node[~on], 2 * node[on][left] + 1, 2 * node[on][right] + 2])
        first = np.full(len(a), np.iinfo(np.int64).max)
        np.minimum.at(first, pair, node)
        return np.where(first == np.iinfo(np.int64).max, -1, first)


def _quiet(along: np.ndarray, margin: float, places: int = 13) -> float | None:
    """Of some quantiles between the fifths, that with the fewest values in its strip, near the middle at that; none where
    every strip holds over half of the values, as within a group of copies."""
    if len(along) < 2:
        return None
    line = np.sort(along)
    at = np.quantile(line, np.linspace(0.2, 0.8, places))
    inside = (np.searchsorted(line, at + margin, "right") - np.searchsorted(line, at - margin)) / len(line)
    best = np.argmin(inside + 0.3 * np.abs(np.searchsorted(line, at, "right") / len(line) - 0.5))
    return float(at[best]) if inside[best] <= 0.5 else None


def near_duplicates(
    vectors: DataFrame,
    threshold: float = 0.93,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    trees: int = TREES,
    margin: float = MARGIN,
    leaf: int = LEAF,
    block: int = BLOCK,
    sample: int = SAMPLE,
) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of ``vectors``.

    Links: other vectors of the same label with cosine (in doubles) of at least ``threshold``, as far as a tree
    brings them together; none below it. component_id: the smallest vec_id reachable over links. kept: vec_id
    equals component_id. Vectors that are null, zero, or hold a null or non-finite component, and those with a
    null label, have 0 links and are components of their own; a row with a null vec_id has 0 links, no component
    and isn't kept. Rows that share a vec_id are one node of the graph; repeated rows link with each other. An empty table
    gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    common.prepare(spark)
    marked = classes(vectors, id_col, vector_col, label_col).withColumns({"dims": F.size("v"), "mark": F.xxhash64("v")})
    found = common.materialize(marked, "embed-classes")
    labels = found.groupBy("dims", "label").agg(F.count("*").alias("n"))
    levels = F.greatest(F.ceil(F.log2(F.col("n") / float(leaf))), F.lit(0))
    labels = common.materialize(labels.withColumn("depth", F.least(levels, F.lit(MAX_DEPTH)).cast("int")), "embed-labels")
    shapes = labels.groupBy("dims").agg(F.max("depth").alias("depth")).collect()  # a row for each vector length
    rows = found.join(_small(labels.select("dims", "label", "depth")), ["dims", "label"])
    counted = edges = None
    for s in shapes:
        got = found.where(F.col("dims") == s["dims"]).orderBy("mark", "rep").limit(sample).select("v").collect()
        x = np.array([r[0] for r in got], np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        c, e = _links(rows.where(F.col("dims") == s["dims"]), Trees(x, s["depth"], trees, margin), threshold, block)
        counted, edges = (c, e) if counted is None else (counted.unionByName(c), edges.unionByName(e))
    if counted is None:
        ids = vectors.select(F.col(id_col).cast("long").alias("vec_id"))
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    # links of a class to others come from the leaves, links among its copies from their number
    sums = counted.groupBy("label", "rep", "mark").agg(F.sum("links").alias("links"))
    totals = found.select("label", "rep", "mark", "copies").join(sums, ["label", "rep", "mark"], "left").select("label", "rep", "mark", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    # a class is a star around its smallest id, and so are rows that share an id
    ids = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), _plain(vectors, vector_col).alias("v"))
    own = found.select(F.col("label").alias("l"), F.col("v").alias("w"), "rep", "mark")
    members = ids.join(own, (F.col("label") == F.col("l")) & (F.col("v") == F.col("w")) & F.col("vec_id").isNotNull(), "left").select("vec_id", "label", "rep", "mark")
    members = common.materialize(members.join(totals, ["label", "rep", "mark"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "rep"), "embed-members")
    stars = members.where("rep IS NOT NULL AND rep <> vec_id").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    linked = components(edges.unionByName(stars)).withColumnRenamed("node", "vec_id")
    result = members.join(linked, "vec_id", "left").withColumn("component_id", F.coalesce("root", "vec_id"))
    return result.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _small(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _unit(v: pa.Array | pa.ChunkedArray, n: int) -> np.ndarray:
    """The vectors as a matrix of doubles."""
    return v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def _links(own: DataFrame, forest_: Trees, threshold: float, block: int) -> tuple[DataFrame, DataFrame]:
    """(label, rep, mark, links) partial sums, and (a, b) a forest of the links between classes."""

    def placed(rows: DataFrame, keep: bool) -> DataFrame:
        """A row for each leaf of each tree that a class is in, with its vector or without."""
        fields = [f for f in rows.schema.fields if f.name != "v" or keep]
        names = [f.name for f in fields]

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _unit(batch.column("v"), len(batch))
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                depth = batch.column("depth").to_numpy()
                for t in range(forest_.trees):
                    at, node = forest_.leaves(t, x, depth)
                    take = pa.array(at)
                    yield pa.RecordBatch.from_arrays([*[batch.column(c).take(take) for c in names], pa.array(np.full(len(at), t, np.int32)), pa.array(node)], names=[*names, "tree", "leaf"])

        return rows.mapInArrow(deal, T.StructType([*fields, T.StructField("tree", T.IntegerType()), T.StructField("leaf", T.LongType())]))

    # sizes of the leaves first, without the vectors: few leaves are large
    sizes = placed(own.select("label", "depth", "v"), False).groupBy("label", "tree", "leaf").count()
    large = common.materialize(sizes.select("label", "tree", "leaf", F.ceil(F.col("count") / block).cast("int").alias("blocks")).where("blocks > 1"), "embed-large")
    rows = placed(own.select("label", "depth", "rep", "mark", "copies", "v"), True).withColumn("blocks", F.lit(1))
    if large.limit(1).count():
        rows = rows.drop("blocks").join(_small(large), ["label", "tree", "leaf"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.col("mark"), F.col("blocks")).cast("int"))
    # a pair of blocks i <= j is a unit of work: a vector of block b goes to (b, j) for j >= b and (i, b) for i < b
    unit = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, "own").alias("i"), F.greatest(o, "own").alias("j"))))
    work = rows.withColumn("unit", unit).select("label", "tree", "leaf", F.col("unit.i").alias("i"), F.col("unit.j").alias("j"), "own", "depth", "rep", "mark", "copies", "v")

    def compare(rows: pa.Table) -> pa.Table:
        return _compare(rows, forest_, threshold)

    links = common.materialize(work.groupBy("label", "tree", "leaf", "i", "j").applyInArrow(compare, "label string, rep long, mark long, links long, a long, b long"), "embed-links")
    return links.where("links > 0").select("label", "rep", "mark", "links"), links.where("a IS NOT NULL").select("a", "b")


def _compare(rows: pa.Table, forest_: Trees, threshold: float) -> pa.Table:
    first = {c: rows.column(c)[0].as_py() for c in ("label", "tree", "leaf", "i", "j", "depth")}
    rep, mark, copies, block = (rows.column(c).combine_chunks().to_numpy() for c in ("rep", "mark", "copies", "own"))
    n, tree = len(rep), first["tree"]
    x = _unit(rows.column("v").combine_chunks(), n)
    norm = np.sqrt((x * x).sum(axis=1))
    along = [forest_.project(t, x / norm[:, None]) for t in range(tree + 1)]
    links, roots = np.zeros(n, np.int64), np.arange(n)
    for k in range(0, n, 512):
        part = slice(k, min(n, k + 512))
        close = (x[part] @ x.T) / (norm[part, None] * norm[None, :]) >= threshold
        a, b = np.nonzero(close)
        a += k
        ok = (a < b) & ((first["i"] == first["j"]) | (block[a] != block[b]))
        a, b = a[ok], b[ok]
        # counted elsewhere: an earlier tree has them together, or this one in an earlier leaf
        for t in range(tree + 1):
            for s in range(0, len(a), 1 << 16):
                p, q = a[s : s + (1 << 16)], b[s : s + (1 << 16)]  # views: what is counted elsewhere is marked in place
                at = forest_.first_common(t, along[t][p], along[t][q], first["depth"])
                p[at != (first["leaf"] if t == tree else -1)] = -1
            a, b = a[a >= 0], b[a >= 0]
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        roots = forest(np.concatenate([a, np.arange(n)]), np.concatenate([b, roots]), n)
    child = roots != np.arange(n)
    held = np.flatnonzero((links > 0) | child)
    a = pa.array(rep[held], mask=~child[held])
    b = pa.array(rep[roots[held]], mask=~child[held])
    return pa.table({"label": pa.array([first["label"]] * len(held), pa.string()), "rep": pa.array(rep[held]), "mark": pa.array(mark[held]), "links": pa.array(links[held]), "a": a, "b": b})


def oracle_sql(threshold: float = 0.93) -> str:
    """Brute force over all pairs of a label; equal to the forest's result where that finds every link."""
    return f"""
WITH RECURSIVE s AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM s a JOIN s b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= {threshold}::DOUBLE),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings WHERE vec_id IS NOT NULL UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS low FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.low AS component_id, coalesce(e.vec_id = c.low, false) AS kept FROM embeddings e LEFT JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id"""
