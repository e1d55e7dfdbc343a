"""Byte-level BPE token ids of many texts at once.

The tokenizer's own pre-tokenization splits a text before any merge, so equal pre-tokens have equal ids. numpy finds the
pre-tokens of a slice of texts (runs of letters, numbers, other signs and white space, by the published pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``), and the tokenizer encodes each
distinct one once, into a bounded cache. Texts with characters whose class differs between Unicode versions, or beyond
the basic plane, are encoded whole by the tokenizer. The strings of special tokens are ordinary text.
"""

from __future__ import annotations

import struct
import unicodedata

import numpy as np

from .common import distinct_spans

LETTER, NUMBER, SPACE, OTHER, ODD = 1, 2, 3, 0, 4
#: Pre-tokens of a generation of the cache, unless another number is given; there are two.
CACHE_ENTRIES = 200_000
_SPACES = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_classes: np.ndarray | None = None
#: Byte-level vocabularies write each byte as a printable character: itself where it is one, else the next from U+0100.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARACTERS = {b: chr(b) for b in _PRINTABLE} | {b: chr(0x100 + i) for i, b in enumerate(sorted(set(range(256)) - set(_PRINTABLE)))}


def classes() -> np.ndarray:
    """Class of each character of the basic plane; beyond it, and where versions of Unicode differ, ODD."""
    global _classes
    if _classes is None:
        out = np.full(0x10001, ODD, np.uint8)
        old = unicodedata.ucd_3_2_0
        for c in range(0x10000):
            now = unicodedata.category(chr(c))
            if now == old.category(chr(c)) and now not in ("Cn", "Cs"):
                out[c] = {"L": LETTER, "N": NUMBER}.get(now[0], OTHER)
        out[_SPACES] = SPACE
        _classes = out
    return _classes


def pretoken_starts(points: np.ndarray, doc_of_first: np.ndarray) -> np.ndarray:
    """Where pre-tokens start. points: code points of all texts; doc_of_first: each text's first place, and the end."""
    n = len(points)
    kind = classes()[np.minimum(points, 0x10000)]
    edge = np.zeros(n + 1, bool)
    edge[doc_of_first] = True
    start = np.empty(n + 1, bool)
    start[0], start[n] = True, True
    start[1:n] = kind[1:] != kind[:-1]
    start |= edge
    runs = np.flatnonzero(start)
    a, b = runs[:-1], runs[1:]
    size, ends_text = b - a, edge[b]
    # White space before a word: its last sign stands alone, or goes with the word if it is a plain space.
    inner = (kind[a] == SPACE) & ~ends_text
    plain = inner & (points[b - 1] == 32)
    start[b[inner] - 1] = True
    start[b[plain]] = False
    # Contractions, where the apostrophe stands alone and starts a pre-token.
    mark = np.flatnonzero((size == 1) & (points[a] == 39) & ~ends_text)
    mark = mark[start[a[mark]] & (kind[np.minimum(b[mark], n - 1)] == LETTER)]
    if len(mark):
        first = b[mark]
        stop = b[mark + 1]
        one = points[first]
        two = points[np.minimum(first + 1, n - 1)]
        long = (first + 1 < stop) & (((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108))
        short = np.isin(one, [115, 116, 109, 100])
        take = np.where(long, 2, np.where(short, 1, 0))
        some = take > 0
        start[first[some]] = False
        start[first[some] + take[some]] = True
    return np.flatnonzero(start[:n])


class Encoder:
    """Ids for slices of texts, with a cache of pre-tokens."""

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        from tokenizers import Tokenizer

        self.entries = entries
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _merged(self, tokens: list[bytes]) -> list[bytes]:
        """The ids of pre-tokens. A full cache becomes the older one: what is in use moves back, the rest goes with the next."""
        cache, older, merge = self.cache, self.older, self.tokenizer.model.tokenize
        parts = list(map(cache.get, tokens))
        for i in [i for i, p in enumerate(parts) if p is None]:
            token = tokens[i]
            found = older.get(token)
            if found is None:
                ids = [x.id for x in merge(token.decode("latin-1").translate(BYTE_CHARACTERS))]
                found = struct.pack(f"<{len(ids)}I", *ids)
            if len(cache) >= self.entries:
                self.older = older = cache
                self.cache = cache = {}
            cache[token] = parts[i] = found
        return parts

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in data, and each text's first id (n + 1 offsets)."""
        raw = data.tobytes()
        points = np.frombuffer(raw.decode().encode("utf-32-le"), "<u4")
        at_byte = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        first = np.searchsorted(at_byte, offsets)
        kind = classes()[np.minimum(points, 0x10000)]
        odd = np.zeros(len(offsets) - 1, bool)
        if (strange := np.flatnonzero(kind == ODD)).size:
            odd[np.searchsorted(first, strange, "right") - 1] = True
        starts = pretoken_starts(points, first) if len(points) else np.zeros(0, np.int64)
        lo = at_byte[starts]
        hi = np.append(lo[1:], len(data))
        where, which = distinct_spans(data, lo, hi)
        tokens = [raw[a:b] for a, b in zip(lo[where].tolist(), hi[where].tolist())]
        parts = self._merged(tokens)
        sizes = np.array([len(p) // 4 for p in parts], np.int64)
        flat = np.frombuffer(b"".join(parts), "<u4")
        begin = np.cumsum(sizes) - sizes
        count = sizes[which] if len(sizes) else np.zeros(0, np.int64)
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        ids = flat[np.repeat(begin[which] - (ends - count), count) + np.arange(total)] if total else np.zeros(0, "<u4")
        id_at = np.append(0, ends)[np.searchsorted(starts, first)]
        if odd.any():  # whole texts, by the tokenizer itself
            pieces = [ids[a:b] for a, b in zip(id_at[:-1], id_at[1:])]
            rows = np.flatnonzero(odd)
            for row, got in zip(rows, self._encode([raw[offsets[r] : offsets[r + 1]].decode() for r in rows])):
                pieces[row] = np.frombuffer(got, "<u4")
            id_at = np.cumsum([0, *map(len, pieces)])
            ids = np.concatenate(pieces)
        return ids, id_at
