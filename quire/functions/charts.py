"""Chart dictionaries: repairing cut JSON, cleaning values, scaling, distances."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def complete_json(text: Column) -> Column:
    """Closes an open string, then every open brace; braces inside strings and escapes don't count, brackets aren't closed."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("open"), F.lit(False).alias("escaped"))

    def step(s: Column, c: Column) -> Column:
        escape = s["open"] & ~s["escaped"] & (c == "\\")
        quote = (c == '"') & ~s["escaped"]
        outside = ~s["open"]
        depth = s["depth"] + F.when(outside & (c == "{"), 1).when(outside & (c == "}") & (s["depth"] > 0), -1).otherwise(0)
        return F.struct(depth.alias("depth"), F.when(quote, ~s["open"]).otherwise(s["open"]).alias("open"), escape.alias("escaped"))

    end = F.aggregate(F.split(text, ""), start, step)
    return F.concat(text, F.when(end["open"], '"').otherwise(""), F.repeat(F.lit("}"), end["depth"]))


def number(text: Column) -> Column:
    """Parenthesised and bracketed digits go, then all but digits, dot and minus; null if that's no number."""
    plain = F.regexp_replace(F.regexp_replace(text, r"\([0-9]+\)|\[[0-9]+\]", ""), "[^0-9.\\-]", "")
    return plain.try_cast("double")


def round4(x: Column) -> Column:
    """Half to even at four places."""
    return F.rint(x * 1e4) / 1e4


def min_max(v: Column) -> Column:
    """Scaled to 0..1 with a guard of 1e-9 in the divisor, four places; a single value is only rounded."""
    low, high = F.array_min(v), F.array_max(v)
    return F.when(F.size(v) < 2, F.transform(v, round4)).otherwise(F.transform(v, lambda x: round4((x - low) / (high - low + 1e-9))))


def mean_l1(a: Column, truth: Column) -> Column:
    """Over the shorter length; no truth is infinitely far."""
    n = F.least(F.size(a), F.size(truth))
    gap = F.aggregate(F.zip_with(F.slice(a, F.lit(1), F.greatest(n, F.lit(0))), F.slice(truth, F.lit(1), F.greatest(n, F.lit(0))), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda t, x: t + x)
    return F.when(F.size(truth) == 0, float("inf")).otherwise(gap / F.greatest(n, F.lit(1)))


def _walk(value: object, out: list[float]) -> bool:
    """Depth first, keys in order; False once an array is met."""
    if isinstance(value, dict):
        return all(_walk(value[k], out) for k in sorted(value))
    if isinstance(value, list):
        return False
    if isinstance(value, bool) or value is None:
        return True
    if isinstance(value, str):
        value = re.sub(r"[^0-9.\-]", "", re.sub(r"\([0-9]+\)|\[[0-9]+\]", "", value))
    try:
        out.append(float(value))
    except ValueError:
        pass  # a string without a number is skipped
    return True


@pandas_udf(T.ArrayType(T.DoubleType()))
def leaves(documents: pd.Series) -> pd.Series:
    """Numbers under ``values`` (or ``data``) of a JSON document; null where there is neither, an array, or no JSON."""

    def one(text: str | None) -> list[float] | None:
        try:
            found = json.loads(text) if text else None
        except json.JSONDecodeError:
            return None
        held = found.get("values", found.get("data")) if isinstance(found, dict) else None
        out: list[float] = []
        return out if held is not None and _walk(held, out) else None

    return documents.map(one)


def reliable(predicted: Column, truth: Column, within: float = 0.1) -> Column:
    """Whether decoded values, scaled, are near those of a second reading."""
    return mean_l1(min_max(predicted), min_max(truth)) < within
