"""Text functions: trimming, normalising, counting, error rates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the end marker of a decoded text (full-width bars, lower one eighth block).
END_MARK = "<｜end▁of▁sentence｜>"


def trim_unicode(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def strip_end(x: Column, mark: str = END_MARK) -> Column:
    """One trailing end marker, then white space on both sides."""
    return trim_unicode(F.when(F.endswith(x, F.lit(mark)), F.substring(x, F.lit(1), F.length(x) - len(mark))).otherwise(x))


def collapse(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def drop_spans(x: Column) -> Column:
    """Reference transform: det spans go; what still holds a tag afterwards is an error."""
    out = F.regexp_replace(x, r"(?s)<\|ref\|>.*?<\|/ref\|>|<\|det\|>.*?<\|/det\|>", "")
    return F.when(out.rlike(r"<\|/?(ref|det)\|>"), F.raise_error(F.lit("leftover tag"))).otherwise(out)


def receipt(x: Column) -> Column:
    """Byte and code point counts and SHA-256 of the raw and of the collapsed text."""
    c = collapse(x)
    return F.struct(F.octet_length(x).alias("bytes"), F.length(x).alias("chars"), F.sha2(x.cast("binary"), 256).alias("sha_raw"), F.octet_length(c).alias("norm_bytes"), F.length(c).alias("norm_chars"), F.sha2(c.cast("binary"), 256).alias("sha_norm"))


#: Quotes and dashes and their plain forms.
PLAIN_FROM, PLAIN_TO = "‘’‚‛“”„‐‑‒–—−", "''''\"\"\"------"


def normalise(x: Column) -> Column:
    """Plain quotes and dashes; a first line in capitals goes if more follows; a last line that is a page number
    goes; words cut by a hyphen at a line's end are joined; lower case; white space collapsed. In this order."""
    plain = F.translate(x, PLAIN_FROM, PLAIN_TO)
    lines = F.split(plain, "\n")
    first, rest = F.get(lines, 0), F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1)))
    header = (F.size(lines) > 1) & (F.trim(first) != "") & (F.upper(first) == first) & first.rlike("[A-Z]") & (F.trim(F.array_join(rest, "")) != "")
    body = F.array_join(F.when(header, rest).otherwise(lines), "\n")
    unnumbered = F.regexp_replace(body, r"\n[ \t]*[0-9]+[ \t]*\n*$", "")
    joined = F.regexp_replace(unnumbered, r"([A-Za-z])-\n([a-z])", "$1$2")
    return collapse(F.lower(joined))


def char_errors(reference: Column, hypothesis: Column) -> Column:
    """Edit distance in code points; a missing hypothesis costs the reference's length."""
    return F.coalesce(F.levenshtein(reference, hypothesis), F.length(reference))


def rate(distance: Column, length: Column) -> Column:
    return distance / F.greatest(F.lit(1), length)


def ascii_only(x: Column) -> Column:
    return F.regexp_replace(x, "[^ -~]", "")


def word_errors(reference: Column, hypothesis: Column) -> Column:
    """Edit distance over words: each distinct word of the pair becomes one private character, then Levenshtein."""
    a, b = F.split(collapse(reference), " "), F.split(collapse(hypothesis), " ")
    words = F.array_distinct(F.concat(a, b))

    def coded(ws: Column) -> Column:
        drop_empty = F.filter(ws, lambda w: w != "")
        return F.array_join(F.transform(drop_empty, lambda w: F.decode(F.unhex(F.lpad(F.hex(0x100000 + F.array_position(words, w)), 8, "0")), "utf-32")), "")

    return F.levenshtein(coded(a), coded(b))


def plain_pattern(text: str) -> str:
    return re.escape(text)


def longest_first(pieces: list[str]) -> str:
    """A pattern that finds the longest of some pieces at each place, as the first alternative that fits."""
    return "|".join(re.escape(p) for p in sorted(set(pieces), key=lambda p: (-len(p), p)))


def safe_name(x: Column) -> Column:
    """A file name of letters, digits, dot, dash and underscore that doesn't begin with a dot and holds no parent step."""
    return x.rlike(r"^[A-Za-z0-9_\-][A-Za-z0-9._\-]*$") & ~x.contains("..")


def hex64(x: Column) -> Column:
    return x.rlike("^[0-9a-f]{64}$")


#: Names that a file must not have on some systems, with or without an extension.
RESERVED = "(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\\.|$)"


def portable_name(x: Column) -> Column:
    """One file name that any system takes: safe, not reserved, no full stop at its end, 255 bytes at most."""
    return safe_name(x) & ~x.rlike(RESERVED) & ~x.endswith(".") & (F.octet_length(x) <= 255)


def https_url(x: Column, most: int = 2048) -> Column:
    """An https address with an authority, without white space or control characters, of bounded length."""
    return x.rlike("^https://[^/?#]") & ~x.rlike("[\\x00-\\x20\\x7f]") & (F.octet_length(x) <= most)
