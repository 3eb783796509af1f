"""Token files and packing."""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm import common, packing, queries, token_files, tokens

DOCS = "doc_id long, text string, tokens string, shard int"
ROWS = [(3, "b c\n\nd  e"), (1, None), (2, ""), (2, "same id"), (None, "no id"), (5, "a b c " * 4000), (5, "a b c " * 4000), (9, "tab\tsep\u3000x \n y")]


def plain(kind, texts):
    name = {"bytes": "byte_bpe_50k.json", "words": "word_bpe_49k.json"}[kind]
    return [e.ids for e in library(name).encode_batch([x or "" for x in texts], add_special_tokens=False)]


@functools.cache
def library(name):
    """The library as it comes, no switch set."""
    return Tokenizer.from_file(tokens.vocabulary(name))


ENCODERS = {}


def test_added_tokens_in_a_text():
    texts = ["hello <|endoftext|> world", "a<|endoftext|>b", "<|endoftext|>", "<|startoftext|> x", "<|ENDOFTEXT|> <|endof text|>", "<|endoftext|>\u0338", "plain words"]
    for kind, name in (("bytes", "byte_bpe_50k.json"), ("words", "word_bpe_49k.json")):
        flat, at = tokens.Encoder(tokens.vocabulary(name), kind).encode(pa.array(texts))
        assert [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == plain(kind, texts)
    assert plain("words", texts[:1]) == [[3306, 49407, 1002]] and plain("bytes", texts[:1]) == [[31373, 220, 50256, 995]]


def test_queries_with_added_tokens(spark, tmp_path):
    texts = {1: "hello <|endoftext|> world", 2: "a<|endoftext|>", 3: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1).write.parquet(f"file://{tmp_path}/documents.parquet")
    ids = {k: np.array(v + [1], "<u4") for k, v in zip(texts, plain("words", list(texts.values())), strict=True)}
    assert {r.doc_id: r.ids_crc32 for r in queries.op2_token_files(spark, f"file://{tmp_path}").collect()} == {k: zlib.crc32(v.tobytes()) for k, v in ids.items()}
    sums = {k: len(v) + 1 for k, v in zip(texts, plain("bytes", list(texts.values())), strict=True)}
    assert {r.doc_id: r.doc_tokens for r in queries.op5_packing(spark, f"file://{tmp_path}").collect()} == sums


PART = st.sampled_from([*"ab .,'\n\t\x1c é9ΣA\u0301\u3000\u00a0-<|", "<|endoftext|>"]) | st.characters(codec="utf-8")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(PART, max_size=40).map("".join), max_size=6), st.sampled_from(["bytes", "words"]))
def test_encoder_equals_the_library(texts, kind):
    name = {"bytes": "byte_bpe_50k.json", "words": "word_bpe_49k.json"}[kind]
    e = ENCODERS.setdefault(kind, tokens.Encoder(tokens.vocabulary(name), kind))
    flat, at = e.encode(pa.array(texts, pa.string()))
    want = plain(kind, texts) if texts else []
    assert [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want


def test_punctuation_at_a_words_end():
    """Cut off a word where the rules do, so that it makes no piece of its own; İ and क़ come apart, and their mark joins the run."""
    texts = ["İ. İ!! x", "\u0958, a\u0958!!", "it's!! its'!! a'. b.' c.'s", "É!!? ß... 3%% ½;: a)]}~` e\u0301!! Σ!?", "x=1; y[0]!\nz:", "a!!<|endof", "½. Ⅷ, 中."]
    for kind, name in (("bytes", "byte_bpe_50k.json"), ("words", "word_bpe_49k.json")):
        e = tokens.Encoder(tokens.vocabulary(name), kind)
        flat, at = e.encode(pa.array(texts))
        assert [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == plain(kind, texts)
        e.encode(pa.array(["some &&& some&&& some### some%% some"]))
        assert "some&&&" not in e.known and "some" in e.known


def test_memo_is_not_read_through(monkeypatch):
    """A slice asks the memo for its own pieces alone: Arrow's index_in would hash all the known ones each time."""
    monkeypatch.setattr(tokens.pc, "index_in", None)
    e = tokens.Encoder(tokens.vocabulary("byte_bpe_50k.json"), "bytes")
    for text in ("some words", "some other words"):
        assert e.encode(pa.array([text]))[0].tolist() == plain("bytes", [text])[0]


def test_memo_generations(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_PIECES", 5)
    e = tokens.Encoder(tokens.vocabulary("byte_bpe_50k.json"), "bytes")
    for i in range(30):
        text = f"word{i % 7} other.{i} " + "x" * 100
        flat, _ = e.encode(pa.array([text.strip()]))
        assert flat.tolist() == library("byte_bpe_50k.json").encode(text.strip(), add_special_tokens=False).ids
        assert len(e.known) < 30


def test_token_files_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(*r, "clash", 1) for r in ROWS], DOCS)
    path = common.shared_path(spark, "t")
    token_files.write(docs, path, tokens.vocabulary("word_bpe_49k.json"), row_group_bytes=1 << 16, page_rows=2)
    rows = sorted(token_files.with_starts(token_files.read(spark, path), spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 2, 2, 3, 5, 5, 9]
    want = sorted((str(i), ids + [1]) for (i, _), ids in zip(ROWS, plain("words", [t for _, t in ROWS]), strict=True))
    assert sorted((str(r.doc_id), list(r.tokens)) for r in rows) == want
    assert [r.start for r in rows] == list(np.cumsum([0] + [r.n_tokens for r in rows])[:-1])
    crc = {(c.doc_id, c.start): c.ids_crc32 for c in token_files.checksums(token_files.with_starts(token_files.read(spark, path), spark, path)).collect()}
    assert crc == {(r.doc_id, r.start): zlib.crc32(np.array(r.tokens, "<u4").tobytes()) for r in rows}
    token_files.write(docs.limit(0), f"{path}-none", tokens.vocabulary("word_bpe_49k.json"))
    assert token_files.checksums(token_files.with_starts(token_files.read(spark, f"{path}-none"), spark, f"{path}-none")).count() == 0


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_file_layout(spark, data, encoding):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    path = common.shared_path(spark, "t")
    token_files.write(docs, path, tokens.vocabulary("word_bpe_49k.json"), row_group_bytes=1 << 16, page_bytes=1 << 12, page_rows=10, token_encoding=encoding)
    names = [f for f in spark.read.parquet(path).inputFiles()]
    metas = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in names]
    assert any(m.num_row_groups > 1 for m in metas)
    column = {m.row_group(0).column(i).path_in_schema: m.row_group(0).column(i) for m in metas for i in range(m.num_columns)}
    assert column["tokens.list.element"].has_column_index and column["doc_id"].has_offset_index
    assert ("RLE_DICTIONARY" in column["tokens.list.element"].encodings) == (encoding == "dictionary")
    assert "DELTA_BINARY_PACKED" in column["doc_id"].encodings
    some = token_files.read(spark, path, where=F.col("doc_id").isin(3, 5), columns=["doc_id", "n_tokens"])
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(doc_id" in plan and "tokens:array" not in plan.split("ReadSchema")[1]
    assert {r.doc_id for r in some.collect()} == {3, 5}


def check_pieces(rows, want, size):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for pieces in by.values():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == list(np.cumsum([0] + [p.length for p in pieces])[:-1])
        n = sum(p.length for p in pieces)
        assert n == size or (n < size and n & (n - 1) == 0)
    docs = {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
    for doc_id, ids in want.items():
        pieces = sorted(docs.pop(doc_id), key=lambda r: r.start)
        assert np.concatenate([np.frombuffer(p.ids, "<u4") for p in pieces]).tolist() == ids
        assert all(p.doc_tokens == len(ids) and p.length * 4 == len(p.ids) for p in pieces)
    assert not docs


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 70), max_size=60), st.integers(1, 5))
def test_packer(lengths, windows):
    p = packing.Packer(16, windows)
    want = {}
    for i, n in enumerate(lengths):
        want[i] = list(range(n))
        p.add(i, np.arange(n, dtype="<u4").tobytes())
        assert len(p.open) <= windows
    p.close()
    rows = [type("R", (), dict(zip(("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"), r, strict=True))) for r in p.out]
    check_pieces(rows, want, 16)


def test_pack_edges_and_table(spark, data):
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, (_, t) in enumerate(ROWS)], DOCS)
    rows = packing.pack(docs, tokens.vocabulary("byte_bpe_50k.json"), size=64, windows=2).collect()
    check_pieces(rows, {i: ids + [0] for i, ids in enumerate(plain("bytes", [t for _, t in ROWS]))}, 64)
    assert packing.pack(docs.limit(0), tokens.vocabulary("byte_bpe_50k.json")).count() == 0
    found = queries.op5_packing(spark, data).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    ids = dict(zip(texts, plain("bytes", list(texts.values())), strict=True))
    for r in found:
        piece = np.array((ids[r.doc_id] + [0])[r.start : r.start + r.length], "<u4")
        assert len(piece) == r.length and zlib.crc32(piece.tobytes()) == r.ids_crc32
    assert sum(r.length for r in found) == sum(len(v) + 1 for v in ids.values())


def test_token_query(spark, data):
    got = {r.doc_id: r for r in queries.op2_token_files(spark, data).collect()}
    texts = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect())
    start = 0
    for (doc_id, _), ids in zip(texts, plain("words", [t for _, t in texts]), strict=True):
        r = got[doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids) + 1, zlib.crc32(np.array(ids + [1], "<u4").tobytes()))
        start += len(ids) + 1
