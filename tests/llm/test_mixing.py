"""Mixing to target weights, and the pipeline."""

from __future__ import annotations

import collections
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quire.llm import langid, mixing, packing, queries, secrets, tokens

DOCS = "doc_id long, text string, source string, size int"


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, out, open_ = share * sum(sizes.values()), {}, set(order)
    while open_:
        level = (total - sum(out.values())) / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > cap * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in open_}
        out |= {s: float(cap * sizes[s]) for s in over}
        open_ -= over
    return out


def run(mix):
    return [r.asDict() for r in mix.decisions().collect()]


@pytest.mark.parametrize("weighted", [False, True])
def test_mix_meets_targets(spark, weighted):
    rng = np.random.default_rng(2)
    rows = [(i, "w " * int(rng.integers(0, 40)), [None, "b", "a", "Z", "é", "b"][int(rng.integers(0, 6))], 1) for i in range(2500)]
    docs = spark.createDataFrame(rows, DOCS)
    mix = mixing.Mix(docs, weight=(F.col("doc_id") % 3 + 1) if weighted else None)
    got = run(mix)
    assert len(got) == len(rows)
    by = {r[0]: r for r in rows}
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = brute_targets(sizes)
    taken = {}
    for r in got:
        s = by[r["doc_id"]][2]
        assert r["size"] == len(by[r["doc_id"]][1].split()) and r["source_size"] == sizes[s]
        assert abs(r["target"] - want[s]) < 1e-6 and r["taken"] == r["copies"] * r["size"] and r["copies"] <= 2
        taken[s] = taken.get(s, 0) + r["taken"]
    assert all(abs(taken[s] - want[s]) <= 20 for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, run(mixing.Mix(docs.repartition(7), weight=(F.col("doc_id") % 3 + 1) if weighted else None))))
    if weighted:
        extra = {k: np.mean([r["copies"] for r in got if r["doc_id"] % 3 == k and 0.2 < r["target"] / r["source_size"] % 1 < 0.7]) for k in (0, 2)}
        assert extra[2] > extra[0]
    repeated = mix.documents().groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in repeated} == {r["doc_id"]: r["copies"] for r in got if r["copies"]}
    assert mix.documents().columns == docs.columns


def test_mix_edges(spark):
    rows = [(1, None, "a", 0), (1, None, "a", 0), (None, "x y", None, 0), (3, "", None, 0), (4, "x " * 50000, "b", 0), (5, "p q", "b", 0), (5, "p q", "b", 0), (6, "p", "b", 0)]
    got = run(mixing.Mix(spark.createDataFrame(rows, DOCS)))
    assert len(got) == len(rows) and sum(r["size"] for r in got) == 50007
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.Mix(spark.createDataFrame([], DOCS)).decisions().count() == 0
    assert mixing.Mix(spark.createDataFrame([], DOCS)).documents().count() == 0
    same = run(mixing.Mix(spark.createDataFrame([(7, "a b c d", "s", 0)] * 400, DOCS)))
    assert sum(r["taken"] for r in same) == 2400
    assert len({r["copies"] for r in same}) == 2


def test_repeated_ids_have_numbers_of_their_own(spark):
    rows = [(None, f"w{i % 50} x", "a", 0) for i in range(600)] + [(8, "q r s", "a", 0)] * 300 + [(i, "one", "b", 0) for i in range(100, 200)]
    docs = spark.createDataFrame(rows, DOCS)
    mix, again = mixing.Mix(docs), mixing.Mix(docs.repartition(5))
    assert mix.rows.select("_u").distinct().count() == len(rows)
    assert sorted(r._u for r in mix.rows.collect()) == sorted(r._u for r in again.rows.collect())
    assert sum(r["taken"] for r in run(mix)) == pytest.approx(1.5 * (1200 + 900 + 100), abs=5)


def test_inclusions_over_many_seeds(spark):
    rng = np.random.default_rng(6)
    rows = [(i, "w " * int(rng.choice([1, 3, 7, 15, 40])), "ab"[i % 2], 1) for i in range(1200)]
    docs = spark.createDataFrame(rows, DOCS)
    total, members = collections.Counter(), collections.Counter()
    n = 6
    for k in range(n):
        for r in run(mixing.Mix(docs, seed=f"s{k}", weight=mixing.length_weight(F.col("text")), whole=False)):
            assert r["copies"] in (int(r["expected"]), int(r["expected"]) + 1) and r["taken"] <= 2 * r["size"]
            total[r["expected"]] += r["copies"]
            members[r["expected"]] += 1
    assert len(total) >= 5
    for e, copies in total.items():
        part = e - int(e)
        assert abs(copies / members[e] - e) < 0.02 + 4 * (part * (1 - part) / members[e]) ** 0.5


def test_certain_copies_are_handed_on(spark):
    rows = [(i, "w " * 10, "a", 1) for i in range(30)] + [(100 + i, "w " * 100, "b", 1) for i in range(30)]
    docs = spark.createDataFrame(rows, DOCS)
    got = run(mixing.Mix(docs, weights=(1, 3), share=1.0, weight=F.when(F.col("doc_id") % 10 == 0, 50).otherwise(1)))
    b = [r for r in got if r["doc_id"] >= 100]
    target = b[0]["target"]
    assert sum(r["expected"] * r["size"] for r in b) == pytest.approx(target)
    assert all(r["copies"] == 2 for r in b if r["doc_id"] % 10 == 0) and len({r["expected"] for r in b}) == 2


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    want = con.sql(queries.ORACLES[name])
    found = queries.QUERIES[name](spark, data)
    assert sorted(found.columns) == sorted(want.columns)
    assert sorted(map(repr, map(tuple, found.select(*want.columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_pipeline_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").withColumn("score", F.concat(F.lit("s"), F.col("doc_id").cast("string")))
    extra = spark.createDataFrame([(-1, "12 34", "en", "src0", 5, "x"), (-2, None, None, None, None, "x"), (-3, "und the password=b7db7aa4a5fcc78305 here of", None, None, 43, "x"), (-4, "", "en", "src0", 0, "x")], docs.schema)
    frame = docs.unionByName(extra)
    before = {r.doc_id: r for r in frame.collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_dedup", "secret_scan", "source_mix", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, data)
        if name != "packing":
            assert out.columns == docs.columns
            frame = spark.createDataFrame(out.collect(), docs.schema)
        rows = out.collect()
        if name == "language_id":
            keep = {i for i, r in before.items() if r.text and re.search(r"[^\W\d_]", r.text)}
            assert {r.doc_id for r in rows} == keep and all(r["lang"] for r in rows)
            assert all(r.text == before[r.doc_id].text and r.score == before[r.doc_id].score for r in rows)
        if name == "simhash_dedup":
            assert len({r.doc_id for r in rows}) == len(rows) < len(keep)
        if name == "secret_scan":
            scanned = rows
            hidden = [r for r in rows if r.text != before[r.doc_id].text]
            assert hidden and all(secrets.MARK in r.text and r.n_chars == len(r.text) for r in hidden)
            assert not any(re.search(r"AKIA[0-9A-Z]{16}|password=[0-9a-f]{18}", r.text) for r in rows)
        if name == "source_mix":
            sizes = {}
            for r in scanned:
                sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").split())
            taken, copies = dict.fromkeys(sizes, 0), collections.Counter(r.doc_id for r in rows)
            for r in rows:
                taken[r.source] += len((r.text or "").split())
            longest = max(len((r.text or "").split()) for r in scanned)
            assert all(abs(taken[s] - t) <= longest for s, t in brute_targets(sizes).items()) and max(copies.values()) == 2
            assert {(r.doc_id, r.text, r.score) for r in rows} <= {(r.doc_id, r.text, r.score) for r in scanned}
            mixed = rows
        if name == "packing":
            library = Tokenizer.from_file(tokens.vocabulary("byte_bpe_50k.json"))
            whole = collections.Counter((r.doc_id, tuple([*library.encode(r.text or "", add_special_tokens=False).ids, 0])) for r in mixed)
            assert sum(r.length for r in rows) == sum(len(k[1]) * n for k, n in whole.items())
            held = collections.defaultdict(collections.Counter)
            for r in rows:
                held[r.doc_id].update(range(r.start, r.start + r.length))
            ids = {d: i for d, i in whole}
            for (d, i), n in whole.items():
                assert held[d] == collections.Counter(dict.fromkeys(range(len(i)), n))
            assert all(tuple(np.frombuffer(r.ids, "<u4")) == ids[r.doc_id][r.start : r.start + r.length] for r in rows)
            lengths = collections.Counter()
            for r in rows:
                lengths[r.sequence_id] += r.length
            assert all(n == 1024 or n & (n - 1) == 0 for n in lengths.values())
    assert packing.PIECES.fieldNames() == corpus_pipeline.run(spark, data).columns
    assert langid.UNDETERMINED == "und"


def test_language_stage_without_labels(spark):
    rows = [(1, "abc", None), (2, "12", None), (3, None, None), (4, "é", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in corpus_pipeline.language_id(spark, docs, "").collect()) == [1, 4]
