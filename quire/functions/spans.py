"""Tagged spans of decoded text: scanning, boxes, page assembly, figures, pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tags and the page marker.
REF, REF_END, DET, DET_END, PAGE = "<|ref|>", "<|/ref|>", "<|det|>", "<|/det|>", "<PAGE>"
_PAIR = r"(?s)<\|ref\|>((?:(?!<\|/ref\|>).)*+)<\|/ref\|><\|det\|>((?:(?!<\|/det\|>).)*+)<\|/det\|>"
_BARE = r"(?sU)<\|det\|>\s*([A-Za-z_][\w-]*)\s*(\[[^\]]+\])\s*<\|/det\|>"
_NUMBER = r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)"


def boxes(quads: Column) -> Column:
    """All numbers in a row, four to a box, the remainder dropped; fractions are cut."""
    numbers = F.transform(F.regexp_extract_all(quads, F.lit(_NUMBER), F.lit(0)), lambda x: F.when(x.cast("double") < 0, F.ceil(x.cast("double"))).otherwise(F.floor(x.cast("double"))).cast("long"))
    whole = F.floor(F.size(numbers) / 4).cast("int")
    none = F.array().cast("array<array<bigint>>")
    return F.when(whole == 0, none).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(whole, F.lit(1)) - 1), lambda i: F.slice(numbers, i * 4 + 1, 4)))


def _scan(text: Column, pattern: str) -> Column:
    found = lambda k: F.regexp_extract_all(text, F.lit(pattern), F.lit(k))
    return F.transform(F.arrays_zip(found(0).alias("full"), found(1).alias("label"), found(2).alias("quads")), lambda x: F.struct(x["full"].alias("full"), x["label"].alias("label"), boxes(x["quads"]).alias("boxes")))


def spans(text: Column) -> Column:
    """Array of struct(full, label, boxes): ref and det pairs in text order, then bare det spans over the whole text."""
    return F.concat(_scan(text, _PAIR), _scan(text, _BARE))


def is_image(full: Column, label: Column) -> Column:
    return (F.regexp_replace(label, r"(?U)^\s+|\s+$", "") == "image") | full.contains("<|ref|>image<|/ref|>")


def rescale(c: Column, extent: Column) -> Column:
    """A coordinate on 0..999 in pixels, cut towards zero; division first."""
    scaled = (c / F.lit(999.0)) * extent
    return F.when(scaled < 0, F.ceil(scaled)).otherwise(F.floor(scaled)).cast("long")


def colon_equals(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\coloneqq"), F.lit(":=")), F.lit("\\eqqcolon"), F.lit("=:"))


def assemble(text: Column, base: Column) -> Column:
    """Image spans become links numbered over the images, other spans go; every occurrence of an equal span is
    replaced at its first turn, images before the others."""
    found = spans(text)
    image = lambda x: is_image(x["full"], x["label"])
    ordered = F.concat(F.filter(found, image), F.filter(found, lambda x: ~image(x)))
    state = F.struct(text.alias("t"), F.lit(0).alias("i"))

    def step(s: Column, x: Column) -> Column:
        link = F.concat(F.lit("![](images/"), base, s["i"].cast("string"), F.lit(".jpg)\n"))
        return F.struct(F.replace(s["t"], x["full"], F.when(image(x), link).otherwise("")).alias("t"), (s["i"] + F.when(image(x), 1).otherwise(0)).alias("i"))

    return colon_equals(F.aggregate(ordered, state, step)["t"])


def figures(text: Column, width: Column, height: Column) -> Column:
    """Array of struct(ordinal, x1, y1, x2, y2) over image spans, boxes in pixels and clamped; a degenerate
    crop is left out and leaves a gap in the ordinals."""
    images = F.filter(spans(text), lambda s: is_image(s["full"], s["label"]))

    def crop(s: Column, i: Column) -> Column:
        b = F.get(s["boxes"], 0)
        clamp = lambda k, extent: F.least(F.greatest(rescale(F.get(b, k), extent), F.lit(0)), extent.cast("long"))
        return F.struct(i.alias("ordinal"), clamp(0, width).alias("x1"), clamp(1, height).alias("y1"), clamp(2, width).alias("x2"), clamp(3, height).alias("y2"))

    return F.filter(F.transform(images, crop), lambda c: F.coalesce((c["x2"] > c["x1"]) & (c["y2"] > c["y1"]), F.lit(False)))


def pages(text: Column) -> Column:
    """Texts between page markers, trimmed; what stands before the first marker goes."""
    parts = F.split(text, PAGE)
    return F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", ""))


def join_pages(parts: Column) -> Column:
    """Marker, line feed and text of each page; a lone marker if there is none."""
    return F.when(F.size(parts) == 0, PAGE + "\n").otherwise(F.array_join(F.transform(parts, lambda p: F.concat(F.lit(PAGE + "\n"), p)), "\n"))
