"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A benchmark item of at least WINDOW words gives every run of WINDOW consecutive words as a pattern, a shorter one its
whole word sequence. Patterns of one length are searched together. The scan looks at the block of BLOCK words that ends
where a pattern may end: a shift table, hashed by block, says how many words on the next pattern can end at the
earliest; where it says 0, the block's hash bucket names the patterns to test, word by word and then byte by byte.
Many stretches of text ("lanes") are scanned in step, each with its own position, so that numpy does the skipping.

Patterns are a stated set: they are sent to all tasks in blocks of at most PATTERN_BYTES of benchmark text, one block at a
time. Documents pass a block without a shuffle, carrying what the earlier blocks found; where there are several blocks, what a
pass found is written to the shared scratch folder before the next block is made.

Words: A-Z lower-cased, then maximal runs of [0-9a-z] and of anything beyond ASCII. Defined results: null and empty
texts have no words and are never contaminated; items without words match nothing; repeated items count once by id; a
null item id reads as the empty string; an empty benchmark hits nothing; rows keep their multiplicity.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from .common import Scratch, mix, slices, span_hash, utf8, word_spans

WINDOW, BLOCK = 13, 3
#: Contaminated: at least one word in SHARE is hit.
SHARE = 20
PATTERN_BYTES = 8 << 20
LANE = 256

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True
_MIXERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


class Words:
    """The words of a slice of documents: hashes, canonical bytes (single spaces) and places."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        data = LOWER[data]
        is_word = IS_WORD[data]
        self.starts, self.ends, self.first = word_spans(is_word, offsets)
        self.hash = span_hash(data, self.starts, self.ends)
        self.data = data

    def text(self, i: int, n: int) -> bytes:
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.starts[i : i + n], self.ends[i : i + n]))


class Group:
    """Patterns of one length with their tables."""

    def __init__(self, length: int, patterns: dict[bytes, set[str]], hashes: dict[bytes, np.ndarray]):
        self.length, self.block = length, min(BLOCK, length)
        keys = list(patterns)
        words = np.array([hashes[p] for p in keys], np.uint64).reshape(len(keys), length)
        tail = self.blocks(words[:, length - self.block :])
        by = np.argsort(tail, kind="stable")
        self.tails, self.words = tail[by], words[by]
        self.texts = [keys[i] for i in by]
        self.items = [patterns[keys[i]] for i in by]
        self.bits = max(12, int(4 * len(keys) * (length - self.block + 1)).bit_length())
        self.bits = min(self.bits, 22)
        self.shift = np.full(1 << self.bits, length - self.block + 1, np.int64)
        for end in range(self.block, length + 1):
            at = self.blocks(words[:, end - self.block : end]) >> np.uint64(64 - self.bits)
            np.minimum.at(self.shift, at.astype(np.int64), length - end)

    @staticmethod
    def blocks(words: np.ndarray) -> np.ndarray:
        return mix((words * _MIXERS[: words.shape[1]]).sum(1, dtype=np.uint64))

    def candidates(self, hashes: np.ndarray) -> np.ndarray:
        """Places of last words where a pattern's tail may stand."""
        n, b = len(hashes), self.block
        if n < self.length:
            return np.zeros(0, np.int64)
        at = np.arange(self.length - 1, n, LANE, dtype=np.int64)
        stop = np.minimum(at + LANE, n)
        found = []
        while len(at):
            block = np.stack([hashes[at - b + 1 + k] for k in range(b)], 1)
            shift = self.shift[(self.blocks(block) >> np.uint64(64 - self.bits)).astype(np.int64)]
            hit = shift == 0
            if hit.any():
                found.append(at[hit])
            at = at + np.maximum(shift, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def search(self, words: Words) -> list[tuple[int, int]]:
        """(first word, pattern) of every occurrence, documents ignored."""
        ends = self.candidates(words.hash)
        if not len(ends):
            return []
        b = self.block
        tail = self.blocks(np.stack([words.hash[ends - b + 1 + k] for k in range(b)], 1))
        lo, hi = np.searchsorted(self.tails, tail, "left"), np.searchsorted(self.tails, tail, "right")
        out = []
        while (more := lo < hi).any():  # one pattern of each bucket at a time
            ends, lo, hi = ends[more], lo[more], hi[more]
            same = np.ones(len(ends), bool)
            for k in range(self.length):
                same &= words.hash[ends - self.length + 1 + k] == self.words[lo, k]
            for end, p in zip(ends[same].tolist(), lo[same].tolist()):
                start = end - self.length + 1
                if words.text(start, self.length) == self.texts[p]:
                    out.append((start, p))
            lo = lo + 1
        return out


def compile_patterns(items: list[tuple[str, str]]) -> list[Group]:
    """Groups by length from (item id, text)."""
    by: dict[int, dict[bytes, set[str]]] = defaultdict(lambda: defaultdict(set))
    hashes: dict[bytes, np.ndarray] = {}
    for item, text in items:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        words = Words(raw, np.array([0, len(raw)]))
        n = len(words.starts)
        size = min(WINDOW, n)
        for i in range(n - size + 1 if n else 0):
            key = words.text(i, size)
            by[size][key].add(item)
            hashes[key] = words.hash[i : i + size]
    return [Group(n, patterns, hashes) for n, patterns in sorted(by.items())]


def scan(groups: list[Group], data: np.ndarray, offsets: np.ndarray):
    """For each document: number of words, occurrences as (first word, number of words), items."""
    words = Words(data, offsets)
    n = len(offsets) - 1
    spans: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    items: list[set[str]] = [set() for _ in range(n)]
    for g in groups:
        hits = g.search(words)
        docs = np.searchsorted(words.first, [s for s, _ in hits], "right") - 1
        for (start, p), doc in zip(hits, docs.tolist()):
            if start + g.length <= words.first[doc + 1]:
                spans[doc].append((start - int(words.first[doc]), g.length))
                items[doc] |= g.items[p]
    return np.diff(words.first), spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal (start, end) runs of covered words."""
    out: list[list[int]] = []
    for start, size in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], start + size)
        else:
            out.append([start, start + size])
    return [(a, b) for a, b in out]


FOUND = "struct<n_words:bigint,spans:array<struct<start:bigint,end:bigint>>,item_ids:array<string>>"


def _pass(groups: list[Group]):
    """A function of texts, and of the spans and items that earlier blocks of patterns found."""

    @arrow_udf(FOUND)
    def run(texts: pa.Array, old_spans: pa.Array, old_items: pa.Array) -> pa.Array:
        n_words, new_spans, new_items = np.zeros(len(texts), np.int64), [], []
        data, offsets = utf8(texts)
        for lo, hi in slices(offsets):
            n_words[lo:hi], spans, items = scan(groups, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            for row, s, i in zip(range(lo, hi), spans, items):
                s = s + [(a["start"], a["end"] - a["start"]) for a in old_spans[row].as_py() or []]
                new_spans.append([{"start": a, "end": b} for a, b in merged(s)])
                new_items.append(sorted(i | set(old_items[row].as_py() or [])))
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        return pa.StructArray.from_arrays([pa.array(n_words), pa.array(new_spans, pa.list_(span)), pa.array(new_items, pa.list_(pa.string()))], ["n_words", "spans", "item_ids"])

    return run.asNondeterministic()


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs' columns under ``doc`` (a struct, so that no name can clash), and n_words, n_hit, n_items, item_ids, spans, contaminated.

    spans: runs of hit words, from 0, end exclusive; item_ids: as strings, sorted.
    """
    items = benchmark.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(f"`{item_text}`"), F.lit("")).alias("t")).distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("t") + F.octet_length("i")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // PATTERN_BYTES))
    nothing = F.lit(None)
    state = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), nothing.cast(FOUND).alias("found"))
    passes = Scratch(docs.sparkSession) if blocks > 1 else None
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b)
        groups = compile_patterns([(r["i"], r["t"]) for r in part.collect()])
        # Only texts and what was found go to Python; rows wait for the results on the JVM.
        state = state.select("doc", _pass(groups)(F.col("doc").getField(text), F.col("found.spans"), F.col("found.item_ids")).alias("found"))
        if b + 1 < blocks:
            state = passes.keep(state, "pass")
            passes.drop(0, "pass")  # the one before has been read
    state = state.select("doc", "found.*")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return state.select(
        "doc", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), "item_ids", "spans"
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * SHARE >= F.col("n_words")))


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents that aren't contaminated, as they are."""
    found = find(docs, benchmark, text).where(~F.col("contaminated"))
    return found.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
