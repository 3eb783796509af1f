"""Token sequence functions: repetition, n-gram bans, drafting, decoding."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def ngrams(tokens: Column, n: int) -> Column:
    count = F.greatest(F.size(tokens) - n + 1, F.lit(0))
    return F.when(count == 0, F.array().cast("array<array<string>>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.slice(tokens, i, n)))


def novelty_ppm(tokens: Column, n: int = 4) -> Column:
    """Distinct over all n-grams in integer millionths; a million for a text without any."""
    grams = ngrams(tokens, n)
    return F.when(F.size(grams) == 0, F.lit(1_000_000).cast("long")).otherwise(F.floor(F.size(F.array_distinct(grams)).cast("long") * 1_000_000 / F.size(grams)).cast("long"))


def lag_matches(tokens: Column, lag: Column) -> Column:
    """Positions that equal the one ``lag`` before."""
    n = F.size(tokens)
    ahead = F.slice(tokens, lag + 1, F.greatest(n - lag, F.lit(0)))
    behind = F.slice(tokens, F.lit(1), F.greatest(n - lag, F.lit(0)))
    return F.aggregate(F.zip_with(ahead, behind, lambda a, b: F.when(a == b, 1).otherwise(0)), F.lit(0), lambda t, x: t + x)


def best_lag(tokens: Column, most: int) -> Column:
    """struct(lag, matches, comparisons): the highest ratio, compared by cross multiplication; equal ratios go to the
    smaller lag, no match at all to lag 1."""
    start = F.struct(F.lit(1).alias("lag"), F.lit(0).cast("long").alias("matches"), F.greatest(F.size(tokens) - 1, F.lit(1)).cast("long").alias("comparisons"))

    def step(best: Column, p: Column) -> Column:
        comparisons = (F.size(tokens) - p).cast("long")
        matches = lag_matches(tokens, p).cast("long")
        better = (comparisons > 0) & (matches * best["comparisons"] > best["matches"] * comparisons)
        return F.when(better | ((p == 1) & (comparisons > 0)), F.struct(p.alias("lag"), matches.alias("matches"), comparisons.alias("comparisons"))).otherwise(best)

    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step)


def measure(window: np.ndarray, lags: int, order: int = 4, cycles: int = 8) -> tuple[int, int, int, int, int]:
    """lag, matches, comparisons, unique, total of a window of codes: the lag with the highest share of matches, the smaller on
    ties, among those of which the window holds ``cycles``; distinct and all n-grams."""
    n, best = len(window), (1, 0, len(window) - 1)
    for lag in range(1, min(lags, n // cycles) + 1):
        m = int(np.count_nonzero(window[lag:] == window[:-lag]))
        if m * best[2] > best[1] * (n - lag):
            best = (lag, m, n - lag)
    grams = np.lib.stride_tricks.sliding_window_view(window, order)
    return *best, len(np.unique(grams, axis=0)), len(grams)


def suffix_profile(window: int = 2048, lags: int = 256) -> Callable[[Column], Column]:
    """Of an array of words, struct(lag, matches, comparisons, unique, total) over its last ``window``; null for a shorter one.
    Words are compared by 64-bit hashes, made before the batches go to numpy."""

    @pandas_udf("lag int, matches long, comparisons long, unique long, total long")
    def profile(hashes: pd.Series) -> pd.DataFrame:
        rows = [measure(np.asarray(h), lags) if h is not None else (None,) * 5 for h in hashes]
        return pd.DataFrame(rows, columns=["lag", "matches", "comparisons", "unique", "total"])

    return lambda words: profile(F.when(F.size(words) >= window, F.transform(F.slice(words, F.greatest(F.size(words) - window + 1, F.lit(1)), window), lambda w: F.xxhash64(w))))


def suspicious(matches: Column, comparisons: Column, unique: Column, total: Column) -> Column:
    return (16 * matches >= 15 * comparisons) & (4 * unique <= total)


def banned(tokens: Column, n: int, window: int) -> Column:
    """Last tokens of the n-grams in the last ``window`` tokens (0: all) whose head equals the current last n - 1 tokens. Sorted and distinct."""
    history = F.when(F.lit(window > 0) & (F.size(tokens) > window), F.slice(tokens, F.size(tokens) - window + 1, F.lit(max(window, 1)))).otherwise(tokens)
    head = F.slice(tokens, F.greatest(F.size(tokens) - n + 2, F.lit(1)), n - 1) if n > 1 else F.array().cast("array<string>")
    hits = F.filter(ngrams(history, n), lambda g: F.slice(g, 1, n - 1) == head) if n > 1 else ngrams(history, 1)
    none = F.array().cast("array<string>")
    return F.when(F.size(tokens) < n, none).otherwise(F.array_sort(F.array_distinct(F.transform(hits, lambda g: F.element_at(g, n)))))


def draft(history: Column, n: int, most: int) -> Column:
    """Up to ``most`` tokens after the latest earlier copy of the last n; empty if there is none."""
    size = F.size(history)
    tail = F.slice(history, F.greatest(size - n + 1, F.lit(1)), n)
    places = F.filter(F.sequence(F.lit(1), F.greatest(size - n, F.lit(1))), lambda i: (i <= size - n) & (F.slice(history, i, n) == tail))
    at = F.array_max(places)
    return F.when((size <= n) | at.isNull(), F.array().cast("array<string>")).otherwise(F.slice(history, at + n, F.least(F.lit(most), F.greatest(size - at - n + 1, F.lit(0)))))


def accepted(drafted: Column, truth: Column) -> Column:
    """Length of the common prefix."""
    same = F.zip_with(drafted, truth, lambda a, b: a.eqNullSafe(b) & a.isNotNull())
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def decode_lossy(data: Column) -> Column:
    return F.make_valid_utf8(data.cast("string"))


def decode_strict(data: Column) -> Column:
    return F.validate_utf8(data.cast("string"))


def greedy(scores: Column, history: Column, n: int, end: int, window: int = 0) -> Column:
    """struct(token, is_end): the place of the highest score among the tokens that ``banned`` allows (the lowest on ties).
    history is an array of texts of places; where all are banned, the choice is null."""
    out = F.transform(banned(history, n, window), lambda t: t.cast("int"))
    kept = F.filter(F.transform(scores, lambda x, i: F.struct((-x).alias("less"), i.alias("i"))), lambda s: ~F.array_contains(out, s["i"]))
    token = F.array_min(kept)["i"]
    return F.struct(token.cast("int").alias("token"), (token == end).alias("is_end"))
