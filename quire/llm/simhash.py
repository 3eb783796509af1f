"""SimHash near-duplicates, found with vantage-point trees over 64-bit fingerprints.

A top tree is fitted on a bounded sample of distinct fingerprints: each node holds a vantage point and the
median distance to it. Every distinct fingerprint has one home shard; where its distance lies within the
radius of a node's boundary it also visits the farther side, so by the triangle bound no pair within the
radius is missed. Inside a shard the same splitting goes on, for all visitors at once, down to small
leaves that are compared bit by bit. A shard emits a spanning forest of its links, never all pairs.
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

#: Distinct fingerprints on which the top tree is fitted.
SAMPLE = 8192
#: Distinct fingerprints that a shard should hold, and the most levels of the top tree. Every level adds visits, so
#: shards are as large as a task handles with ease: a member is 8 bytes.
SHARD, MAX_DEPTH = 65536, 14
#: Members of a shard beyond which it is compared in blocks, and queries of a unit of work.
BLOCK, CHUNK = 131072, 32768
#: Members of a leaf inside a shard.
LEAF = 96
#: Bitmaps of kept rows, of 4 KB each, that are sent to every executor at most.
BITMAPS = 16384
#: Links held in a task before they are reduced to a forest.
HELD = 500_000
_RADIUS_BITS = 64


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fingerprint (long, the 64 bits): a row per document, whole texts; then the columns ``keep`` of docs.

    A bit is 1 if set in over half of the XXH64 hashes of the word shingles (A-Z lower-cased, words cut at
    ASCII white space, repeats included; with fewer words the whole sequence is one shingle). A null, empty
    or blank text has fingerprint 0. An empty table gives no rows; repeated rows and null ids are rows of their own.
    """
    common.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text", 1 << 20):
            found = [fingerprint(t, shingle, seed) if t else 0 for t in batch.column("text").to_pylist()]
            prints = pa.array(np.array(found, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), prints, *[batch.column(c) for c in keep]], names=["doc_id", "fingerprint", *keep])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), *keep)
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("fingerprint", T.LongType()), *[rows.schema[c] for c in keep]]
    return rows.mapInArrow(run, T.StructType(fields))


def fingerprint(text: str, shingle: int, seed: int) -> int:
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = [0, *(ends[:-1] + 1).tolist()]
    hashes = np.fromiter((xxh64_intdigest(joined[i:j], seed) for i, j in zip(begins, ends[shingle - 1 :].tolist(), strict=False)), np.uint64, len(words) - shingle + 1)
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 8192):
        part = hashes[k : k + 8192].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).astype(np.int16)


def vantage(points: np.ndarray, rng: np.random.Generator, tries: int = 8) -> tuple[np.uint64, int]:
    """A vantage point whose boundary strip holds few of the points, and the distance that halves them."""
    best = (np.inf, points[0], 0)
    for p in rng.choice(points, min(tries, len(points)), replace=False):
        d = distance(points, p)
        mu = int(np.median(d))
        if (d > mu).any():
            best = min(best, (float(np.mean(np.abs(d - mu - 0.5) < 3.5)) + abs(float(np.mean(d <= mu)) - 0.5), p, mu), key=lambda x: x[0])
    return (best[1], best[2]) if best[0] < np.inf else (points[0], _RADIUS_BITS)


def top_tree(sample: np.ndarray, depth: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Vantage points and boundaries of a full tree, in heap order; a boundary of 64 sends all to the left."""
    rng = np.random.default_rng(seed)
    points, bounds = np.zeros((1 << depth) - 1, np.uint64), np.full((1 << depth) - 1, _RADIUS_BITS, np.int16)
    held = {0: sample}
    for node in range(len(points)):
        own = held.pop(node)
        if len(own) > 1:
            points[node], bounds[node] = vantage(own, rng)
        near = distance(own, points[node]) <= bounds[node]
        held[2 * node + 1], held[2 * node + 2] = own[near], own[~near]
    return points, bounds


def route(found: np.ndarray, points: np.ndarray, bounds: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, indices, whether at home): each fingerprint's home, and the later shards that it must visit."""
    inner = len(points)
    stack = [(0, np.arange(len(found)), np.ones(len(found), bool))]
    while stack:
        node, at, home = stack.pop()
        if not len(at):
            continue
        if node >= inner:
            yield node - inner, at, home
            continue
        d = distance(found[at], points[node])
        near = d <= bounds[node]
        left = np.where(home, near, d <= bounds[node] + radius)
        right = d > bounds[node] - radius
        stack.append((2 * node + 1, at[left], home[left]))
        stack.append((2 * node + 2, at[right], home[right] & ~near[right]))


class Links:
    """Links within one task, reduced to a forest whenever many are held."""

    def __init__(self, n: int) -> None:
        self.n, self.a, self.b, self.held = n, [], [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.a.append(a)
        self.b.append(b)
        self.held += len(a)
        if self.held > HELD:
            self.roots()

    def roots(self) -> np.ndarray:
        root = forest(np.concatenate([np.zeros(0, np.int64), *self.a]), np.concatenate([np.zeros(0, np.int64), *self.b]), self.n)
        child = np.flatnonzero(root != np.arange(self.n))
        self.a, self.b, self.held = [child], [root[child]], 0
        return root


def search(values: np.ndarray, members: np.ndarray, queries: np.ndarray, radius: int, links: Links, rng: np.random.Generator) -> None:
    """Links every query to every member within the radius; members and queries index ``values``."""
    stack = [(members, queries)]
    while stack:
        t, q = stack.pop()
        if not len(t) or not len(q):
            continue
        point, mu = vantage(values[t], rng, 3) if len(t) > LEAF else (None, _RADIUS_BITS)
        if mu == _RADIUS_BITS:
            step = max(1, (1 << 20) // len(t))
            for k in range(0, len(q), step):
                i, j = np.nonzero(np.bitwise_count(values[q[k : k + step], None] ^ values[t][None, :]) <= radius)
                apart = q[k + i] != t[j]
                links.add(q[k + i[apart]], t[j[apart]])
            continue
        near, dq = distance(values[t], point) <= mu, distance(values[q], point)
        stack.append((t[near], q[dq <= mu + radius]))
        stack.append((t[~near], q[dq > mu - radius]))


def near_links(found: DataFrame, radius: int = 3) -> DataFrame:
    """a, b: a forest whose components are those of all pairs of distinct fingerprints within ``radius`` bits.

    ``found``: one long column, fingerprint, distinct and not null.
    """
    spark = found.sparkSession
    common.prepare(spark)
    n = found.count()
    depth = max(0, min(MAX_DEPTH, int(np.ceil(np.log2(max(1, n / SHARD))))))
    sample = np.array([r[0] for r in found.orderBy(F.xxhash64("fingerprint"), "fingerprint").limit(SAMPLE).collect()], dtype=np.int64).view(np.uint64)
    if not n:
        return spark.createDataFrame([], "a long, b long")
    points, bounds = top_tree(sample, depth)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy().view(np.uint64)
            for shard, at, home in route(own, points, bounds, radius):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), shard, np.int32)), pa.array(own[at].view(np.int64)), pa.array(home)], names=["shard", "fingerprint", "home"])

    dealt = common.materialize(found.select("fingerprint").mapInArrow(deal, "shard int, fingerprint long, home boolean"), "simhash-shards")
    own, shard = F.col("fingerprint"), F.col("shard")
    sizes = dealt.groupBy("shard").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"), F.greatest(F.ceil(F.count_if("home") / BLOCK), F.lit(1)).cast("int").alias("blocks"))
    sizes = F.broadcast(spark.createDataFrame(sizes.collect(), sizes.schema))  # at most 2 ** MAX_DEPTH rows
    rows = dealt.join(sizes, "shard").withColumn("block", F.pmod(F.xxhash64(own), F.col("blocks")).cast("int"))
    # a member is a target in its own block, for every chunk of queries there; it asks its own and the later blocks, a visitor all
    first = F.when(F.col("home"), F.col("block")).otherwise(0)
    chunk = F.pmod(F.xxhash64(own, F.lit(1)), F.col("chunks")).cast("int")
    ask = rows.select(shard, F.explode(F.sequence(first, F.col("blocks") - 1)).alias("block"), chunk.alias("chunk"), own, F.lit(False).alias("member"))
    targets = rows.where("home").select(shard, "block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), own, F.lit(True).alias("member"))

    def link(found: pa.Table) -> pa.Table:
        return _unit_links(radius, found)

    return ask.unionByName(targets).groupBy("shard", "block", "chunk").applyInArrow(link, "a long, b long")


def _unit_links(radius: int, rows: pa.Table) -> pa.Table:
    """A forest of the links between the queries and the members of a unit."""
    values, at = np.unique(rows.column("fingerprint").combine_chunks().to_numpy().view(np.uint64), return_inverse=True)
    member = rows.column("member").combine_chunks().to_numpy(zero_copy_only=False)
    links = Links(len(values))
    search(values, at[member], at[~member], radius, links, np.random.default_rng(11))
    root = links.roots()
    child = np.flatnonzero(root != np.arange(len(values)))
    return pa.table({"a": pa.array(values[child].view(np.int64)), "b": pa.array(values[root[child]].view(np.int64))})


def near_duplicates(docs: DataFrame, radius: int = 3, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (long), component_id: the smallest doc_id reachable over fingerprints within ``radius`` bits.

    One row per row of ``docs``. Texts that are null, empty or blank share fingerprint 0, which links like any
    other. Rows with a null doc_id have a fingerprint and belong to a component, whose id is the smallest
    doc_id that is not null (null if there is none); repeated rows and ids are kept. Other columns are ignored.
    """
    return _grouped(docs, radius, shingle, seed, id_col, text_col).drop("root")


def _grouped(docs: DataFrame, radius: int = 3, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """near_duplicates with root, the smallest fingerprint of the component, which no other component has, and the
    columns ``keep`` of docs."""
    prints = common.materialize(fingerprints(docs, shingle, seed, id_col, text_col, keep), "simhash-prints")
    n = prints.count()
    classes = common.materialize(common.gathered(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("low")), n), "simhash-classes")
    roots = components(near_links(classes.select("fingerprint"), radius)).withColumnRenamed("node", "fingerprint")
    linked = common.materialize(common.gathered(roots.join(classes, "fingerprint"), n), "simhash-roots")
    lows = linked.groupBy("root").agg(F.min("low").alias("lowest"))
    best = linked.join(lows, "root").select("fingerprint", "root", "lowest")
    ids = classes.join(best, "fingerprint", "left").select("fingerprint", F.coalesce("root", "fingerprint").alias("root"), F.when(F.col("root").isNull(), F.col("low")).otherwise(F.col("lowest")).alias("component_id"))
    return prints.join(ids, "fingerprint").select("doc_id", "fingerprint", "root", "component_id", *keep)


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay: one of each component, all columns as they were, whatever their names and types.

    The row with the component's smallest doc_id stays (a null one only where all are null); of rows
    that share that id, the one with the smallest fingerprint, and of equal ones the first. Rows are told
    apart by their place in a written copy of ``docs``. An empty table gives no rows.
    """
    copy = common.materialize(docs.select(common.row_of(docs).alias("row"), F.monotonically_increasing_id().alias("at")), "simhash-rows")
    narrow = copy.select(F.col("row").getField(id_col).alias("doc_id"), F.col("row").getField(text_col).alias("text"), "at")
    found = _grouped(narrow, keep=("at",), **options)
    first = F.min_by("at", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fingerprint", "at"))
    kept = found.groupBy("root").agg(first.alias("at")).select("at")
    return _marked(copy, kept).select("row.*")


def _marked(copy: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``copy`` whose place, at, is in ``kept``. The places go to the rows as bitmaps of 32,768 rows each, so that
    rows with their texts aren't shuffled while the bitmaps fit BITMAPS; beyond they are joined by shuffle."""
    at = F.col("at")
    maps = kept.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    maps = common.materialize(common.gathered(maps, copy.count() // 16), "simhash-kept")
    if maps.count() <= BITMAPS:
        maps = F.broadcast(maps)
    bit = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring("bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = copy.withColumn("bucket", F.bitmap_bucket_number(at)).join(maps, "bucket")
    return held.where(F.getbit(byte, (bit % 8).cast("int")) == 1)
