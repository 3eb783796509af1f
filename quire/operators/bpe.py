"""Byte-pair merges: learning a small table, encoding in Arrow batches, decoding by lookup."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def merge(parts: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Merges the adjacent pair of lowest rank, the leftmost on ties, until none has a rank."""
    parts = list(parts)
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: (ranks.get((parts[i], parts[i + 1]), 1 << 60), i))
        if (parts[best], parts[best + 1]) not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts


def learn_pairs(words: DataFrame, word: str, n: int) -> list[tuple[str, str]]:
    """The ``n`` commonest adjacent character pairs, ties by the pair; a bounded table."""
    chars = F.split(F.col(word), "")
    pairs = words.select(F.explode(F.filter(F.transform(chars, lambda c, i: F.struct(c.alias("a"), F.get(chars, i + 1).alias("b"))), lambda p: p["b"].isNotNull() & (p["b"] != ""))).alias("p"))
    top = pairs.groupBy("p.a", "p.b").count().orderBy(F.col("count").desc(), "a", "b").limit(n)
    return [(r.a, r.b) for r in top.collect()]


def encoder(ranks: dict[tuple[str, str], int], vocab: dict[str, int], whole_first: bool = False, added: dict[str, int] | None = None) -> Column:
    """A column function: text piece to array of ids. ``whole_first``: a piece that is a token is one token. ``added``: pieces
    that are ids of their own, whatever the merges say."""
    known = added or {}

    @pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo: dict[str, list[int]] = {}
        for batch in batches:
            out = []
            for piece in batch:
                if piece in known:
                    memo[piece] = [known[piece]]
                if piece not in memo:
                    parts = [piece] if whole_first and piece in vocab else merge(list(piece), ranks)
                    missing = [p for p in parts if p not in vocab]
                    if missing:
                        raise KeyError(f"not in the vocabulary: {missing[0]!r}")
                    memo[piece] = [vocab[p] for p in parts]
                out.append(memo[piece])
            yield pd.Series(out)

    return encode


def decode(ids: DataFrame, vocab: DataFrame, group: str, position: str, token: str) -> DataFrame:
    """group, text from one row per id, by a join with (id, token). Unknown ids are an error. Adaptive execution broadcasts a
    vocabulary that is small enough."""
    found = ids.join(vocab, "id", "left").withColumn(token, F.when(F.col(token).isNull(), F.raise_error(F.concat(F.lit("no token "), F.col("id").cast("string")))).otherwise(F.col(token)))
    line = F.array_sort(F.collect_list(F.struct(position, token)))
    return found.groupBy(group).agg(F.array_join(F.transform(line, lambda x: x[token]), "").alias("text"))
