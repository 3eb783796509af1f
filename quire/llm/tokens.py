"""Token ids of whole texts, by the ``tokenizers`` library, with a memo of the pieces between white space.

Both supported vocabularies split a text at white space before they merge, so the ids of a text are
the ids of its pieces in order. Arrow cuts a batch of texts into pieces, finds the distinct ones and looks
them up among those that the worker has met; only new ones are encoded, and numpy lays the ids out. Texts
with white space that this split doesn't cover, or with the string of an added token such as ``<|endoftext|>``,
are encoded whole. The library's switches are as they come from the file: an added token's string is its id.
"""

from __future__ import annotations

import os
import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that a worker remembers; beyond them it starts anew with those of the batch at hand.
MEMO_PIECES = 1_000_000
#: Bytes of text in a slice that is encoded at once.
SLICE = 4 << 20
#: Longest piece that goes to the merges at once.
MEMO_LENGTH = 64

def _byte_chars() -> dict[int, int]:
    """How byte-level vocabularies write bytes: visible Latin-1 characters stand for themselves, the others
    for the characters from 256 on, in order."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: 256 + i for i, b in enumerate(hidden)}


BYTE_CHARS = _byte_chars()
#: Stands before a text's first word, and before punctuation that was cut off.
FIRST, MARK = "\x01", "\x02"
#: Punctuation at a word's end, after a Latin letter or a digit: the split rules cut there too. Not with an apostrophe, which may
#: begin a contraction, nor after a letter that lower case or normalisation takes apart, such as U+0130: its mark joins the run.
STOP = "([0-9A-Za-z\\x{c0}-\\x{d6}\\x{d8}-\\x{f6}\\x{f8}-\\x{12f}\\x{131}-\\x{24f}])([!-&(-/:-@\\[-`{-~]+)( |\\z)"
#: White space other than a single space or line feed between two words.
ODD = "[\\x01\\x02\\t\\r\\x0b\\x0c\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]|\\A[ \\n]|[ \\n]\\z|[ \\n][ \\n]"
SPACE = chr(BYTE_CHARS[0x20])
FORMATS = [f"<{n}i" for n in range(4 * MEMO_LENGTH)]

_open: dict[tuple[str, str], "Encoder"] = {}


def encoder(path: str, kind: str) -> "Encoder":
    """The worker's encoder for a vocabulary file; loaded once in a process."""
    if (path, kind) not in _open:
        _open[path, kind] = Encoder(path, kind)
    return _open[path, kind]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """kind "bytes": byte-level vocabulary; a piece is a word, standing for itself with the space before it, a
    line feed with the word behind it, or FIRST with a text's first word. kind "words": the vocabulary drops
    white space; a piece is a word. In both a piece may also be MARK with the punctuation cut off a word."""

    def __init__(self, path: str, kind: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = (t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.odd = "|".join([ODD, *(f"(?i:{re.escape(t)})" for t in added if t)])  # any case: words are lower-cased before they are split
        self.spaced = kind == "bytes"
        self.feed = self._whole(["\n"])[0]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.starts, self.lengths = np.zeros(0, "<i4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(ids := e.ids)}i", *ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces. One that is a single Latin word goes to the vocabulary's merges at once: no rule
        splits or changes it before, save for the writing of its bytes as characters."""
        out: list[bytes] = []
        rest: list[int] = []
        tokenize, spaced, pack, feed = self.tokenizer.model.tokenize, self.spaced, struct.pack, self.feed
        lead = SPACE if spaced else ""
        for i, p in enumerate(pieces):
            head, word, space = b"", p, lead
            if not p.isalpha():
                if p == "":  # of an empty text
                    out.append(b"")
                    continue
                if p[0] == "\n" and spaced:
                    head, word, space = feed, p[1:], ""
                elif p[0] == FIRST:
                    word, space = p[1:], ""
                if word is p or not word.isalpha():
                    rest.append(i)
                    out.append(b"")
                    continue
            found = None
            if len(word) <= MEMO_LENGTH and (spaced or word.islower()):
                if word.isascii():
                    found = tokenize(space + word)
                elif max(word) < "\u0250":
                    found = tokenize(space + word.encode().decode("latin-1").translate(BYTE_CHARS))
            if found is None:
                rest.append(i)
                out.append(b"")
            else:
                out.append(head + pack(FORMATS[len(found)], *[t.id for t in found]))
        whole = [p[1:] if p[0] in (FIRST, MARK) else p if not spaced or p[0] == "\n" else " " + p for p in (pieces[i] for i in rest)]
        for i, ids in zip(rest, self._whole(whole), strict=True):
            out[i] = ids
        return out

    def _find(self, pieces: pa.Array) -> np.ndarray:
        """Places of distinct pieces among the known ones; new ones are added. A dict is asked for the pieces at hand
        alone, where Arrow's index_in would hash all the known ones for every slice."""
        if len(self.known) > MEMO_PIECES:
            self._forget()
        listed, get = pieces.to_numpy(zero_copy_only=False).tolist(), self.known.get
        places = np.fromiter((get(p, -1) for p in listed), np.int64, len(listed))
        at = np.flatnonzero(places < 0)
        new = [listed[i] for i in at.tolist()]
        places[at] = np.arange(len(self.known), len(self.known) + len(new))
        self.known.update(zip(new, places[at].tolist(), strict=True))
        found = self._words(new)
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(found), "<i4")])
        return places

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row (int32), and where each text's begin, with the end; a null is an empty text."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        if not odd.any():
            return self._split(texts)
        flat, at = self._split(texts.filter(pa.array(~odd)))
        plain = iter([flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)])
        whole = iter([np.frombuffer(x, "<i4") for x in self._whole(texts.filter(pa.array(odd)).to_pylist())])
        parts = [next(whole) if o else next(plain) for o in odd]
        return np.concatenate([np.zeros(0, "<i4"), *parts]), np.cumsum([0, *map(len, parts)])

    def _split(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.replace_substring(texts, "\n", " \n" if self.spaced else " ")
        texts = pc.replace_substring_regex(texts, STOP, f"\\1 {MARK}\\2\\3")
        texts = pc.binary_join_element_wise("", texts, FIRST) if self.spaced else pc.ascii_lower(texts)
        lists = pc.split_pattern(texts, " ")
        coded = lists.flatten().dictionary_encode()
        codes = self._find(coded.dictionary)[coded.indices.to_numpy()]
        n = self.lengths[codes].astype(np.int32)
        ends = np.cumsum(n, dtype=np.int32)
        flat = self.ids[np.repeat(self.starts[codes].astype(np.int32) - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)]
        return flat, np.concatenate([[0], ends])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
