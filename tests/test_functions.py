"""Hand-worked cases of column functions and operators."""

from __future__ import annotations

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import charts, pretok, spans, stats, text, tokens, vectors
from quire.operators import bpe, gates, selection, sequences


def one(spark, column, **values):
    names = list(values)
    row = spark.range(1).select(*[F.lit(values[n]).alias(n) for n in names]) if names else spark.range(1)
    return row.select(column.alias("x")).first().x


def values(spark, column, items, kind):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", column.alias("x")).orderBy("i").collect()]


def test_spans(spark):
    pair = "<|ref|>image<|/ref|><|det|>[[1, 2.9, -3.5, 4], [5]]<|/det|>"
    cases = [pair, "<|ref|>a<|/ref|> <|det|>x [1]<|/det|>", "<|det|> títle-1 [1,2,3,4,5]\n<|/det|><|det|>e []<|/det|>", None, ""]
    got = values(spark, spans.spans(F.col("v")), cases, "string")
    assert [(s.label, s.boxes) for s in got[0]] == [("image", [[1, 2, -3, 4]])]
    assert [s.label for s in got[1]] == ["x"] and got[1][0].boxes == []
    assert [(s.label, s.boxes) for s in got[2]] == [("títle-1", [[1, 2, 3, 4]])]  # an empty bracket is no span
    assert values(spark, spans.spans(F.col("v")), ["<|det|> étitle [1,2,3,4]<|/det|>"], "string")[0] == []  # a label begins with an ASCII letter


def test_long_span_bodies(spark):
    body = "x" * 60000
    got = values(spark, spans.spans(F.col("v")), [f"<|ref|>{body}<|/ref|><|det|>[[1,2,3,4]]<|/det|>"], "string")[0]
    assert got[0].label == body


@pytest.mark.parametrize("c, extent, want", [(0, 640, 0), (316, 1024, 323), (999, 1024, 1024), (316, 640, int(316 / 999 * 640)), (-5, 640, -3)])
def test_rescale(spark, c, extent, want):
    assert one(spark, spans.rescale(F.lit(c), F.lit(extent))) == want


def test_pages(spark):
    cases = ["no marker", "junk<PAGE> a \n<PAGE>　b", "<PAGE>a<PAGE>"]
    assert values(spark, spans.pages(F.col("v")), cases, "string") == [[], ["a", "b"], ["a", ""]]
    assert values(spark, spans.join_pages(F.col("v")), [[], ["a", "b"]], "array<string>") == ["<PAGE>\n", "<PAGE>\na\n<PAGE>\nb"]


def test_assemble_collapses_equal_spans(spark):
    image = "<|ref|>image<|/ref|><|det|>[[0,0,9,9]]<|/det|>"
    got = one(spark, spans.assemble(F.lit(f"a{image}b{image}c<|det|>t [1]<|/det|>\\eqqcolon"), F.lit("p_")))
    assert got == "a![](images/p_0.jpg)\nb![](images/p_0.jpg)\nc=:"


def test_strip_and_normalise(spark):
    assert one(spark, text.strip_end(F.lit(f" 　a b\n {text.END_MARK}"))) == "a b"
    assert values(spark, text.normalise(F.col("v")), ["HEADER LINE\nSome hyphen-\nated “text”\n 12 \n", "ONLY LINE", "a\n\nb—c"], "string") == ['some hyphenated "text"', "only line", "a b-c"]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=6), st.lists(st.sampled_from("abcd"), max_size=6))
def test_word_errors(spark, a, b):
    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, p in enumerate(x, 1):
            row = _next(row, i, p, y)
        return row[-1]

    def _next(row, i, p, y):
        new = [i]
        for j, q in enumerate(y, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != q)))
        return new

    words = {"a": "le", "b": "été", "c": "the", "d": "x"}
    left, right = (" ".join(words[c] for c in s) for s in (a, b))
    assert one(spark, text.word_errors(F.lit(left), F.lit(right))) == distance(a, b)


def plain_lag(t, most):
    best = (1, 0, max(len(t) - 1, 1))
    for p in range(1, most + 1):
        c = len(t) - p
        m = sum(t[i] == t[i + p] for i in range(max(c, 0)))
        if c > 0 and (p == 1 or m * best[2] > best[1] * c):
            best = (p, m, c)
    return best


@settings(max_examples=25, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=14))
def test_repetition(spark, t):
    frame = spark.createDataFrame([(t,)], "t array<string>")
    c = F.col("t")
    r = frame.select(tokens.best_lag(c, 6).alias("b"), tokens.novelty_ppm(c).alias("n"), tokens.banned(c, 3, 8).alias("ban"), tokens.draft(c, 2, 3).alias("d")).first()
    lag = plain_lag(t, 6)
    assert (r.b.matches, r.b.comparisons) == lag[1:] and (not lag[1] or r.b.lag == lag[0])
    grams = [tuple(t[i : i + 4]) for i in range(len(t) - 3)]
    assert r.n == (len(set(grams)) * 1000000 // len(grams) if grams else 1000000)
    h = t[-8:]
    assert r.ban == (sorted({h[i + 2] for i in range(len(h) - 2) if h[i : i + 2] == t[-2:]}) if len(t) >= 3 else [])
    at = [i for i in range(len(t) - 2) if t[i : i + 2] == t[-2:]] if len(t) > 2 else []
    assert r.d == (t[at[-1] + 2 : at[-1] + 5] if at else [])


def test_charts(spark):
    cases = ['{"a": "b', '{"a": "\\"{', "{}", '{"a": {"b": 1', "{}}", '{"a": [1, 2']
    want = ['{"a": "b"}', '{"a": "\\"{"}', "{}", '{"a": {"b": 1}}', "{}}", '{"a": [1, 2}']
    assert values(spark, charts.complete_json(F.col("v")), cases, "string") == want
    assert values(spark, charts.min_max(F.col("v")), [[], [0.12345], [1.0, 3.0], [2.0, 2.0]], "array<double>") == [[], [0.1234], [0.0, 1.0], [0.0, 0.0]]
    assert values(spark, charts.number(F.col("v")), ["$1,234.5 (12)", "[3]-7%", "x"], "string") == [1234.5, -7.0, None]
    assert one(spark, charts.mean_l1(F.array(F.lit(1.0)), F.array().cast("array<double>"))) == math.inf


def test_pretok(spark):
    got = values(spark, pretok.three_stage(F.col("v")), ["ab 12345 漢字x, y"], "string")[0]
    assert "".join(got) == "ab 12345 漢字x, y" and "123" in got and "45" in got and "漢字" in got
    assert values(spark, pretok.gpt2(F.col("v")), ["it's  a test"], "string")[0] == ["it", "'s", " ", " a", " test"]


def test_int8(spark):
    got = values(spark, vectors.int8_rows(F.col("v")), [[0.0, 0.0], [127.0, -127.0, 0.5, 1.5, 2.5]], "array<float>")
    assert got[0].q == [0, 0] and got[0].scale == 1.0
    assert got[1].q == [127, -127, 0, 2, 2]
    u8 = values(spark, vectors.u8_rows(F.col("v")), [[0.0, 255.0], [-1.0, 1.0], [0.0, 0.0]], "array<float>")
    assert [u.zero for u in u8] == [0, 128, 0] and u8[0].q == [0, 255]
    packed = values(spark, vectors.int4_groups(F.col("v"), 2), [[7.0, -7.0, 0.0, 3.5]], "array<double>")[0]
    assert values(spark, vectors.int4_unpack(F.col("v")), [packed.packed], "array<int>")[0] == [7, -7, 0, 7]


def test_vector_functions(spark):
    assert values(spark, vectors.argmax(F.col("v")), [[1.0, 3.0, 3.0], [1.0, math.nan, 2.0]], "array<double>") == [1, 1]
    top = values(spark, vectors.top_k(F.col("v"), 2), [[1.0, 2.0, 2.0, 0.0]], "array<double>")[0]
    assert [(t.idx, t.score) for t in top] == [(1, 2.0), (2, 2.0)]
    with pytest.raises(Exception, match="non-finite"):
        values(spark, vectors.top_k(F.col("v"), 2), [[math.inf]], "array<double>")
    erf = one(spark, vectors.erf(F.lit(0.7)))
    assert abs(erf - math.erf(0.7)) < 2e-7
    assert abs(sum(values(spark, vectors.softmax(F.col("v")), [[1000.0, 1001.0]], "array<double>")[0]) - 1) < 1e-12
    turned = values(spark, vectors.rope(F.col("v"), F.lit(3)), [[1.0, 0.0]], "array<double>")[0]
    assert abs(turned[0] - math.cos(3)) < 1e-12 and abs(turned[1] - math.sin(3)) < 1e-12
    norm = values(spark, vectors.layer_norm(F.col("v"), 0.0), [[1.0, 3.0]], "array<double>")[0]
    assert norm == [-1.0, 1.0]


@pytest.mark.parametrize("spec, want", [("3", [2]), ("3-7", [2, 3, 4, 5, 6]), ("1,5-9,2,5", [0, 1, 4, 5, 6, 7, 8])])
def test_page_spec(spark, spec, want):
    assert sorted(r.page for r in selection.page_spec(spark, spec, 10).collect()) == want


@pytest.mark.parametrize("spec", ["0", "9-3", "1,,2", "11", "a", "1-2-3"])
def test_page_spec_errors(spark, spec):
    with pytest.raises(ValueError):
        selection.page_spec(spark, spec, 10)


def test_lookups(spark):
    a = spark.createDataFrame([(1, 2)], "k int, x int")
    b = spark.createDataFrame([(2, 3)], "k int, y int")
    with pytest.raises(Exception, match="no entry"):
        selection.gather(a, b, "k", "y").collect()
    with pytest.raises(Exception, match="only one side"):
        selection.equal_keys_join(a, b, "k").collect()


def test_statistics(spark):
    rows = spark.createDataFrame([("a", float(x)) for x in range(1, 11)] + [("b", 5.0)], "g string, x double")
    got = {r.g: r.cvar for r in stats.cvar(rows, ["g"], "x", 0.25).collect()}
    assert abs(got["a"] - (10 + 9 + 0.5 * 8) / 2.5) < 1e-12 and abs(got["b"] - 5.0 * 0.25 / 0.25) < 1e-12
    assert abs(stats.beta_quantile(0.5, 2, 2) - 0.5) < 1e-9
    assert abs(stats.beta_quantile(0.05, 19.5, 1.5) - 0.8262) < 2e-2
    bound = spark.createDataFrame([(0, 0), (19, 19), (20, 20)], "p int, n int").select(stats.hoeffding_lower(F.col("p"), F.col("n"), 0.05).alias("b")).collect()
    assert bound[0].b == 0.0 and bound[1].b == 1.0 and abs(bound[2].b - (1 - math.sqrt(math.log(20) / 40))) < 1e-6
    votes = spark.createDataFrame([("g", "x"), ("g", "y"), ("g", None)], "g string, k string")
    assert stats.majority(votes, ["g"], "k").first().majority == "y"


def test_sequences(spark):
    hits = [True, True, False, True, True, True, False]
    rows = spark.createDataFrame([("g", i, h) for i, h in enumerate(hits)], "g string, i int, h boolean")
    got = sequences.consecutive_hits(rows, ["g"], ["i"], F.col("h")).orderBy("i").collect()
    assert [r.streak for r in got] == [1, 2, 0, 1, 2, 3, 0]
    assert [r.tripped for r in got] == [False] * 5 + [True, True]
    ring = sequences.ring(rows, ["g"], ["i"], "i", 2, F.col("i") < 2).orderBy("i").collect()
    assert ring[4].held == [0, 1, 3, 4]
    points = [(0.0, 5.0), (1.0, 2.0), (2.0, 3.0), (3.0, 1.0), (4.0, 1.0)]
    hull = values(spark, sequences.lower_hull(F.col("v")), [points], "array<struct<x:double,y:double>>")[0]
    assert [(p.x, p.y) for p in hull] == [(0.0, 5.0), (1.0, 2.0), (3.0, 1.0), (4.0, 1.0)]


def test_gates(spark):
    base = spark.createDataFrame([("a", 0.5), ("b", 0.5), ("c", 0.1234567)], "category string, bound double")
    cand = spark.createDataFrame([("b", 0.4), ("c", 0.1234562), ("d", 0.1)], "category string, bound double")
    got = gates.ratchet(base, cand)
    assert {r.category: r.verdict for r in got.collect()} == {"a": "DROPPED", "b": "LOWERED", "c": "RAISED", "d": "NEW"}
    decision = gates.ratchet_decision(got).first()
    assert not decision.accepted and decision.raised
    ranges = spark.createDataFrame([(1, 0, 10, "x"), (1, 2, 3, "y"), (1, 5, 6, "z"), (1, 6, 6, "e"), (2, 5, 7, "w")], "g int, b int, e int, n string")
    assert sorted(r.n for r in gates.overlaps(ranges, ["g"], "b", "e", ["n"]).collect()) == ["y", "z"]
    rows = spark.createDataFrame([(i * 37 % 100,) for i in range(100)], "k int")
    assert all(r.k == r.at for r in gates.ordinal(rows, ["k"], "at").collect())


def test_merges():
    ranks = {("a", "b"): 0, ("ab", "c"): 1, ("b", "c"): 2}
    assert bpe.merge(list("abcab"), ranks) == ["abc", "ab"]
    assert bpe.merge([], ranks) == []
