"""PDF pages as a Spark data source: page order, rotation, and embedded images that need only inflate.

``pages(spark, path)`` yields a row per page and image. Files come through Spark's
``binaryFile``, so any store that Spark reads will do. Encrypted files, object streams and DCT or CCITT
images are reported in ``error`` instead of being decoded.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "path string, page int, rotate int, width double, height double, image_no int, image_width int, image_height int, mode string, pixels binary, error string"
#: Channels of the colour spaces that are read.
CHANNELS = {"DeviceGray": 1, "DeviceRGB": 3, "DeviceCMYK": 4}


class PdfError(ValueError):
    """The file isn't a PDF or can't be walked."""


def is_pdf(data: bytes) -> bool:
    return b"%PDF-" in data[:1024]


def inflate(data: bytes, limit: int) -> bytes:
    """Inflates at most ``limit`` bytes; more is an error, so a small stream can't fill the memory."""
    d = zlib.decompressobj()
    out = d.decompress(data, limit + 1)
    if len(out) > limit or d.unconsumed_tail:
        raise PdfError(f"stream inflates beyond {limit} bytes")
    return out


_TOKEN = re.compile(rb"%[^\r\n]*|<<|>>|\[|\]|/[^\s<>\[\]()/%]*|\((?:\\.|[^\\()]|\([^()]*\))*\)|<[0-9A-Fa-f\s]*>|[^\s<>\[\]()/%]+")


@dataclass(frozen=True)
class Ref:
    number: int


@dataclass
class Node:
    """A dictionary, with its stream if it has one."""

    entries: dict = field(default_factory=dict)
    stream: bytes | None = None


def _parse(tokens: list[bytes], at: int):
    t = tokens[at]
    if t == b"<<":
        node, at = Node(), at + 1
        while tokens[at] != b">>":
            key = tokens[at][1:].decode("latin-1")
            node.entries[key], at = _parse(tokens, at + 1)
        return node, at + 1
    if t == b"[":
        items, at = [], at + 1
        while tokens[at] != b"]":
            item, at = _parse(tokens, at)
            items.append(item)
        return items, at + 1
    if t.startswith(b"/"):
        return t[1:].decode("latin-1"), at + 1
    if at + 2 < len(tokens) and tokens[at + 2] == b"R" and t.isdigit() and tokens[at + 1].isdigit():
        return Ref(int(t)), at + 3
    try:
        return float(t) if b"." in t else int(t), at + 1
    except ValueError:
        return {b"true": True, b"false": False, b"null": None}.get(t, t), at + 1


class Document:
    """The objects of a file, found by scanning for their headers; the last of a number counts."""

    def __init__(self, data: bytes) -> None:
        if not is_pdf(data):
            raise PdfError("no PDF header")
        self.objects: dict[int, Node | object] = {}
        for m in re.finditer(rb"(?<!\d)(\d+)\s+\d+\s+obj\b", data):
            end = data.find(b"endobj", m.end())
            body = data[m.end() : end if end >= 0 else len(data)]
            cut = re.search(rb">>\s*stream\r?\n", body)
            head = body[: cut.start() + 2] if cut else body
            tokens = [t for t in _TOKEN.findall(head) if not t.startswith(b"%")]
            if not tokens:
                continue
            value, _ = _parse(tokens, 0)
            if cut and isinstance(value, Node):
                raw, length = data[m.end() + cut.end() :], value.entries.get("Length")
                stop = raw.find(b"endstream")
                value.stream = raw[:length] if isinstance(length, int) else raw[:stop].rstrip(b"\r\n")
            self.objects[int(m[1])] = value
        if any(isinstance(o, Node) and o.entries.get("Type") == "ObjStm" for o in self.objects.values()):
            raise PdfError("object streams aren't read")
        if re.search(rb"trailer\s*<<[^>]*/Encrypt", data):
            raise PdfError("encrypted")

    def get(self, value):
        return self.objects.get(value.number) if isinstance(value, Ref) else value

    def pages(self) -> Iterator[tuple[Node, dict]]:
        """Page nodes in order, each with what it inherits."""
        roots = [o for o in self.objects.values() if isinstance(o, Node) and o.entries.get("Type") == "Catalog"]
        if not roots:
            raise PdfError("no catalog")
        stack: list[tuple[object, dict, frozenset]] = [(roots[-1].entries.get("Pages"), {}, frozenset())]
        while stack:
            ref, above, seen = stack.pop()
            node = self.get(ref)
            if not isinstance(node, Node) or ref in seen:
                continue
            held = above | {k: node.entries[k] for k in ("Rotate", "MediaBox", "Resources") if k in node.entries}
            if "Kids" in node.entries:
                for kid in reversed(self.get(node.entries["Kids"]) or []):
                    stack.append((kid, held, seen | {ref}))
            else:
                yield node, held

    def images(self, held: dict) -> Iterator[Node]:
        resources = self.get(held.get("Resources"))
        objects = self.get(resources.entries.get("XObject")) if isinstance(resources, Node) else None
        for _, ref in sorted(objects.entries.items()) if isinstance(objects, Node) else []:
            node = self.get(ref)
            if isinstance(node, Node) and node.entries.get("Subtype") == "Image":
                yield node

    def decode(self, image: Node) -> tuple[int, int, str, bytes]:
        """(width, height, mode, pixels); one byte a channel, bits widened, CMYK as RGB."""
        e = {k: self.get(v) for k, v in image.entries.items()}
        w, h, bits = int(e["Width"]), int(e["Height"]), 1 if e.get("ImageMask") else int(e.get("BitsPerComponent", 8))
        space = "DeviceGray" if e.get("ImageMask") else e.get("ColorSpace", "DeviceGray")
        if space not in CHANNELS or bits not in (1, 8):
            raise PdfError(f"colour space {space!r} at {bits} bits isn't read")
        row = (w * CHANNELS[space] * bits + 7) // 8
        filters = e.get("Filter") or []
        raw = image.stream or b""
        for name in [filters] if isinstance(filters, str) else filters:
            if name != "FlateDecode":
                raise PdfError(f"filter {name} isn't read")
            raw = inflate(raw, row * h)
        if len(raw) < row * h:
            raise PdfError("image data is too short")
        flip = (e.get("Decode") or [0])[0] == 1
        if bits == 1:
            out = bytearray()
            for y in range(h):
                line = int.from_bytes(raw[y * row : (y + 1) * row], "big") >> (row * 8 - w)
                out += bytes(255 if ((line >> (w - 1 - x)) & 1) != flip else 0 for x in range(w))
            return w, h, "L", bytes(out)
        raw = bytes(255 - b for b in raw[: row * h]) if flip else raw[: row * h]
        if space == "DeviceCMYK":
            raw = bytes((255 - ink) * (255 - raw[i + 3]) // 255 for i in range(0, len(raw), 4) for ink in raw[i : i + 3])
        return w, h, "L" if space == "DeviceGray" else "RGB", raw


def rows(path: str, data: bytes) -> Iterator[tuple]:
    """Rows of SCHEMA; a page without images has one row with a null image_no, an unreadable file one row with its error."""
    try:
        found = list((doc := Document(data)).pages())
    except (PdfError, IndexError, RecursionError) as error:
        yield (path, None, None, None, None, None, None, None, None, None, str(error) or "damaged")
        return
    for n, (_, held) in enumerate(found):
        box = [float(doc.get(x)) for x in (doc.get(held.get("MediaBox")) or [0, 0, 612, 792])]
        page = (path, n, int(doc.get(held.get("Rotate")) or 0) % 360, abs(box[2] - box[0]), abs(box[3] - box[1]))
        images = list(doc.images(held))
        if not images:
            yield (*page, None, None, None, None, None, None)
        for i, image in enumerate(images):
            try:
                w, h, mode, pixels = doc.decode(image)
                yield (*page, i, w, h, mode, pixels, None)
            except (PdfError, KeyError, zlib.error) as error:
                yield (*page, i, None, None, None, None, str(error))


def pages(spark: SparkSession, path: str) -> DataFrame:
    """SCHEMA for all files under ``path``; a damaged file is a row with its error, the others go on."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                frame = pd.DataFrame(list(rows(file, bytes(content))), columns=names)
                for c in ("page", "rotate", "image_no", "image_width", "image_height"):
                    frame[c] = frame[c].astype("Int32")
                yield frame

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SCHEMA)


def logical_rotation(page_rotate: int, placement: tuple[float, float, float, float]) -> int:
    """Degrees of a page and of an axis-aligned placement matrix (a, b, c, d) together; a skewed matrix turns nothing."""
    a, b, c, d = placement
    if b == c == 0:
        own = 180 if a < 0 and d < 0 else 0
    elif a == d == 0:
        own = 90 if b > 0 > c else 270 if b < 0 < c else 0
    else:
        own = 0
    return (page_rotate + own) % 360
