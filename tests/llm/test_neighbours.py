"""Exact top-k, SimHash, embedding near-duplicates, components."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from quire.llm import embed_dedup, queries, simhash, topk
from quire.llm.components import components, forest


def brute_components(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 19), st.integers(0, 19)), max_size=30))
def test_forest(pairs):
    a, b = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
    assert forest(a, b, 20).tolist() == brute_components(20, pairs)


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    rows = [*chain, (7, 7), (3, 9), (9, 3), (9, 5), (None, 4), (50, 51), (51, 60), (60, 50)]
    got = {r.node: r.root for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 7: 7, 3: 3, 9: 3, 5: 3, 50: 50, 51: 50, 60: 50}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", lowered) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aB é\n\t\x0b\u00a0İ.")), max_size=80))
def test_fingerprint(text):
    assert (simhash.fingerprint(text, 3, 42) if text else 0) == plain_fingerprint(text)


def brute_simhash(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    roots = brute_components(len(rows), pairs)
    low = {}
    for (i, _), r in zip(rows, roots, strict=True):
        if i is not None:
            low[r] = min(low.get(r, i), i)
    return sorted((i is None, i or 0, f"{p:016x}", low.get(r)) for (i, _), p, r in zip(rows, prints, roots, strict=True))


@pytest.mark.parametrize("sizes", [(65536, 131072, 32768), (20, 25, 30), (4, 3, 5)])
def test_simhash_against_brute_force(spark, data, monkeypatch, sizes):
    for k, v in zip(("SHARD", "BLOCK", "CHUNK"), sizes, strict=True):
        monkeypatch.setattr(simhash, k, v)
    monkeypatch.setattr(simhash, "LEAF", 4)
    monkeypatch.setattr(simhash, "HELD", 20)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    base = "the quick brown fox jumps over the lazy dog and runs far away from here into the deep dark wood at night " * 8
    docs += [(1000 + i, base + f"w{i % 40}") for i in range(120)] + [(None, "alone with no id"), (2000, None), (2001, ""), (2002, " \n"), (2003, "one"), (2003, "one"), (2004, base * 300)]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, fingerprint int")
    got = sorted((r.doc_id is None, r.doc_id or 0, f"{r.fingerprint & (2**64 - 1):016x}", r.component_id) for r in simhash.near_duplicates(frame).collect())
    assert got == brute_simhash(docs)


def test_representatives(spark):
    rows = [(1, "a b c d", 0), (2, "a b c d", 1), (2, "a b c d", 1), (3, "x y z", 2), (3, "x y z", 2), (None, "q r s t", 3), (None, "q r s t", 3), (None, "a b c d", 4), (5, None, 5), (6, "", 6)]
    kept = simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string, component_id int")).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted([("1", "a b c d"), ("3", "x y z"), ("None", "q r s t"), ("5", None)], key=lambda r: r)
    assert simhash.representatives(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_representatives_of_groups_that_share_an_id(spark):
    b = "the quick brown fox jumps over the lazy dog and runs far away " * 30
    rows = [(3, "a b c d"), (3, b), (7, b + "x"), (None, "q r s t"), (None, "q r s t"), (None, "one two three four"), (None, "u v w x y z")]
    kept = simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted([("3", "a b c d"), ("3", b), ("None", "q r s t"), ("None", "one two three four"), ("None", "u v w x y z")])


@pytest.mark.parametrize("maps", [16384, 0])
def test_representatives_keep_all_columns(spark, monkeypatch, maps):
    monkeypatch.setattr(simhash, "BITMAPS", maps)
    rows = [(1, "a b c d", "x", {"k": 1}, 7), (2, "a b c d", "y", {}, 8), (2, "a b c d", "y", None, 8), (2, "other text here", "z", {"m": 2}, 9), (2, "other text here", "z", {"m": 3}, 9)]
    schema = "doc_id long, text string, _id string, `a.b` map<string,int>, at int"
    kept = simhash.representatives(spark.createDataFrame(rows, schema))
    assert kept.columns == ["doc_id", "text", "_id", "a.b", "at"]
    got = sorted(map(tuple, kept.collect()), key=lambda r: r[1])
    assert got[0] == rows[0] and len(got) == 2 and got[1] in rows[3:]


def test_simhash_query(spark, data):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id) for r in queries.op6_simhash(spark, data).collect())
    assert got == brute_simhash(docs)


def brute_top(rows, k, every):
    x = {i: np.floor(np.array(v, np.float64) * 1024).astype(np.int64) for i, v in rows}
    out = []
    for q in x:
        if q % every == 0:
            best = sorted((-int(x[q] @ x[v]), v) for v in x if v != q)[:k]
            out += [(q, r + 1, v, -s) for r, (s, v) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("n, shard, block", [(900, 8192, 4096), (900, 100, 3), (7, 8192, 4096), (2500, 8192, 20)])
def test_top_k_against_brute_force(spark, n, shard, block):
    rng = np.random.default_rng(n)
    v = np.round(rng.standard_normal((n, 8)) * 0.3, 1)
    rows = [(int(i), [float(c) for c in x]) for i, x in enumerate(v)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int")
    got = topk.top_k(frame, F.col("id") % 10 == 0, shard_cells=shard * 8, query_block=block)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, 10, 10)


def test_top_k_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (4, [0.5, 0.5]), (None, [1.0, 1.0]), (5, []), (6, [0.0, 0.0]), (100, [-1.0, 2.0]), (7, [float("inf"), 0.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 100 == 0)
    sound = [(i, v) for i, v in rows if i in (0, 4, 6, 100)]
    assert sorted(map(tuple, got.collect())) == brute_top(sound, 10, 100)
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("id") % 100 == 0).count() == 0
    large = [(0, [3e6, -1.0]), (1, [2e6, 5.0]), (2, [-1e6, 1e3])]
    got = topk.top_k(spark.createDataFrame(large, "vec_id long, embedding array<double>"), F.col("id") % 100 == 0)
    assert sorted(map(tuple, got.collect())) == brute_top(large, 10, 100)


def test_top_k_of_repeated_ids(spark):
    rng = np.random.default_rng(3)
    v = np.round(rng.standard_normal((300, 6)), 2)
    rows = [(int(i % 120), [float(c) for c in x]) for i, x in enumerate(v)] + [(40, [float(c) for c in v[40]])] * 2
    x = [(i, np.floor(np.array(w) * 1024).astype(np.int64)) for i, w in rows]
    want = []
    for q in {i for i, _ in rows if i % 20 == 0}:
        asked = {tuple(w) for i, w in x if i == q}
        best = sorted((-int(np.array(a) @ w), i) for a in asked for i, w in x if i != q)[:10]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    for cells in (60, 4096):
        got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 20 == 0, shard_cells=cells)
        assert sorted(map(tuple, got.collect())) == sorted(want)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 60), st.integers(1, 12), st.integers(0, 10**6), st.sampled_from([1, 40, 10**15]))
def test_shard_search(n, k, seed, size):
    rng = np.random.default_rng(seed)
    x = rng.integers(-40, 40, (n, 5)) * size
    index = topk.ShardIndex.build(np.arange(n), x, levels=4)
    index = topk.ShardIndex.of(index.row(5, 0))
    skip = rng.permutation(n)[: int(rng.integers(0, 3))]
    for q in (rng.integers(-40, 40, 5), x[0] // size, np.zeros(5, np.int64)):
        rest, scores = index.search(q, k, skip)
        want = [i for i in np.lexsort((np.arange(n), -(x @ q))) if i not in skip][:k]
        assert set(want) <= set(rest.tolist()) and (scores == x[rest] @ q).all() and not set(skip) & set(rest.tolist())


def test_one_shard_stops_early(spark):
    """5,000 clustered vectors in one shard: all searches end on proof, with few rows scored exactly."""
    rng = np.random.default_rng(8)
    v = rng.standard_normal((250, 64))[np.arange(5000) % 250] + rng.standard_normal((5000, 64)) * 0.35
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    x = np.floor(v * 1024).astype(np.int64)
    index, stops = topk.ShardIndex.build(np.arange(5000), x), topk.Stops()
    for q in range(0, 5000, 100):
        rest, scores = index.search(x[q], 10, np.array([q]), stops)
        assert rest[np.lexsort((rest, -scores))[:10]].tolist() == [i for i in np.lexsort((np.arange(5000), -(x @ x[q]))) if i != q][:10]
    assert stops.searches == stops.early == 50
    assert stops.met < 0.97 * stops.postings and stops.rescored < 50 * 5000 * 0.1
    rows = [(int(i), [float(c) for c in w]) for i, w in enumerate(v)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(frame, F.col("id") % 100 == 0)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, 10, 100)


def brute_links(rows, threshold=0.93):
    ok = [i is not None and k is not None and bool(v) and all(c is not None and np.isfinite(c) for c in v) and any(v) for i, v, k in rows]
    pairs = []
    for a in range(len(rows)):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[i][1], np.float64) for i in (a, b))
                if x @ y / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum())) >= threshold:
                    pairs.append((a, b))
    links = np.zeros(len(rows), int)
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    same = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            pairs.append((same.setdefault(r[0], i), i))
    roots = brute_components(len(rows), pairs)
    low = {}
    for r, root in zip(rows, roots, strict=True):
        if r[0] is not None:
            low[root] = min(low.get(root, r[0]), r[0])
    return sorted((str(r[0]), int(n), low.get(root) if r[0] is not None else None, r[0] is not None and r[0] == low[root]) for r, n, root in zip(rows, links, roots, strict=True))


@pytest.mark.parametrize("leaf, block, kind", [(400, 2048, "double"), (20, 2048, "float"), (60, 7, "double"), (2, 2048, "double")])
def test_embedding_links_against_brute_force(spark, leaf, block, kind):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((60, 16))
    rows = [(int(i), np.float32(centres[i % 60] + rng.standard_normal(16) * 0.12).astype(float).tolist(), int(i % 60 % 2)) for i in range(400)]
    rows += [(1000 + i, rows[0][1], rows[0][2]) for i in range(30)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], f"vec_id long, embedding array<{kind}>, label int, kept int")
    got = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(frame, leaf=leaf, block=block).collect())
    want = brute_links(rows)
    found, all_ = sum(g[1] for g in got), sum(w[1] for w in want)
    assert 0.9 * all_ <= found <= all_
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    if leaf == 400:
        assert got == want


@pytest.mark.parametrize("depth, fitted", [(3, 12), (7, 12), (9, 4)])
def test_forest_recall_and_rows(monkeypatch, depth, fitted):
    """Pairs at cosines from 0.93 on share a leaf, a pair's first common leaf is one that both are in, rows stay few."""
    monkeypatch.setattr(embed_dedup, "FITTED", fitted)
    rng = np.random.default_rng(depth)
    x = rng.standard_normal((4000, 32))
    x[2000:] = x[:2000] + rng.standard_normal((2000, 32)) * rng.uniform(0.05, 0.38, 2000)[:, None]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    trees = embed_dedup.Trees(x[rng.permutation(4000)], depth, embed_dedup.TREES, embed_dedup.MARGIN)
    a = np.arange(2000)
    a = a[(x[a] * x[a + 2000]).sum(axis=1) >= 0.93]
    together, rows = np.zeros(len(a), bool), 0
    for t in range(trees.trees):
        at, node = trees.leaves(t, x, np.full(4000, depth))
        rows += len(at)
        p = trees.project(t, x)
        first = trees.first_common(t, p[a], p[a + 2000], depth)
        held = {}
        for i, k in zip(at.tolist(), node.tolist(), strict=True):
            held.setdefault(i, set()).add(k)
        assert first.tolist() == [min(held[i] & held[i + 2000], default=-1) for i in a.tolist()]
        together |= first >= 0
    assert len(a) > 800 and together.mean() >= 0.95
    assert rows / 4000 < embed_dedup.TREES * 1.12**depth


def test_embedding_edges(spark):
    v = [1.0, 2.0]
    rows = [(1, v, 0), (2, v, 0), (2, v, 0), (3, v, 1), (4, None, 0), (5, [0.0, 0.0], 0), (6, [None, 1.0], 0), (7, [float("nan"), 1.0], 0), (8, v, None), (None, v, 0), (9, [2.0, 4.0], 0), (10, [1.0], 0), (11, [], 0), (12, [-0.0, 1.0], 0), (13, [0.0, 1.0], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(frame).collect())
    assert got == brute_links(rows)
    assert embed_dedup.near_duplicates(frame.limit(0)).count() == 0


def test_recall_on_the_table(spark, data):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    got = queries.op7_embedding_dedup(spark, data).collect()
    found, all_ = sum(r.n_links for r in got), sum(w[1] for w in brute_links(rows))
    assert len(got) == len(rows) and 0.9 * all_ <= found <= all_


def test_top_k_query(spark, data):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    assert sorted(map(tuple, queries.op3_exact_topk(spark, data).collect())) == brute_top(rows, 10, 100)
