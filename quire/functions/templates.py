"""Prompt templates with repeated placeholders, and detokenised word streams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def with_slots(before: str, slot: str, count: Column, after: str) -> Column:
    """``before``, ``count`` slots, ``after``."""
    return F.concat(F.lit(before), F.repeat(F.lit(slot), count.cast("int")), F.lit(after))


def tiled(rows: Column, columns: Column, slot: str, per_tile: int, mark: str = "<row_{r}_col_{c}>", whole: str = "<global-img>") -> Column:
    """Slots of each tile behind its place, row by row, then those of the whole image."""
    head, middle, tail = mark.replace("{r}", "{c}").split("{c}")
    cell = lambda r, c: F.concat(F.lit(head), r.cast("string"), F.lit(middle), c.cast("string"), F.lit(tail), F.repeat(F.lit(slot), F.lit(per_tile)))
    line = lambda r: F.array_join(F.transform(F.sequence(F.lit(1), columns.cast("int")), lambda c: cell(r, c)), "")
    grid = F.array_join(F.transform(F.sequence(F.lit(1), rows.cast("int")), line), "\n")
    return F.concat(F.when(rows * columns > 1, F.concat(grid, F.lit("\n\n"))).otherwise(""), F.lit(whole), F.repeat(F.lit(slot), F.lit(per_tile)))


def detokenise(tokens: Column, space: str = "▁", control: tuple[str, ...] = ("[BOS]", "[EOS]", "[PAD]")) -> Column:
    """Words without control tokens, the marker as a space, trimmed; a null token (an id out of range) is kept as an empty string."""
    kept = F.filter(F.transform(tokens, lambda t: F.coalesce(t, F.lit(""))), lambda t: ~t.isin(*control))
    return F.transform(kept, lambda t: F.regexp_replace(F.replace(t, F.lit(space), F.lit(" ")), r"(?U)^\s+|\s+$", ""))


def byte_alphabet(data: Column) -> Column:
    """Bytes as the characters of byte-level vocabularies: visible Latin-1 as themselves, the others from 256 on in order."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    source, target = "".join(map(chr, hidden)), "".join(chr(256 + i) for i in range(len(hidden)))
    return F.translate(F.decode(data, "ISO-8859-1"), source, target)
