"""Pre-tokenisation: splitting text into pieces before merges, in stages that keep the gaps between matches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import longest_first

#: The patterns of the stages.
DIGITS = r"\p{N}{1,3}"
CJK = r"[一-龥぀-ゟ゠-ヿ]+"
WORDS = r"[!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~][A-Za-z]+|[^\r\n\p{L}\p{P}\p{S}]?[\p{L}\p{M}]+| ?[\p{P}\p{S}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"
GPT2 = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SINGLE_DIGIT = r"\p{N}"


def isolate(pieces: Column, pattern: str) -> Column:
    """Each piece cut into the pattern's matches and what lies between them, in order."""
    cut = lambda p: F.filter(F.split(F.regexp_replace(p, f"({pattern})", "\u0001$1\u0001"), "\u0001"), lambda x: x != "")
    return F.flatten(F.transform(pieces, cut))


def three_stage(text: Column) -> Column:
    """Groups of up to three digits, then CJK and kana runs, then words."""
    return isolate(isolate(isolate(F.array(text), DIGITS), CJK), WORDS)


def gpt2(text: Column) -> Column:
    return isolate(F.array(text), GPT2)


def digits_apart(text: Column) -> Column:
    """Every digit on its own, then the byte-level pattern."""
    return isolate(isolate(F.array(text), SINGLE_DIGIT), GPT2)


def around_added(text: Column, added: list[str], split: Callable[[Column], Column] = gpt2) -> Column:
    """Added tokens as pieces of their own, the longest first at each place; what lies between is split."""
    if not added:
        return split(text)
    pieces = isolate(F.array(text), longest_first(added))
    return F.flatten(F.transform(pieces, lambda p: F.when(p.isin(added), F.array(p)).otherwise(split(p))))
