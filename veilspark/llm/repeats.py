"""Exact removal of repeated byte strings by blockwise suffix sorting with a difference cover.

A string of WIDTH bytes that starts at two places is found as follows. The cover COVER modulo PERIOD contains, for any two
places, an offset below PERIOD that lands both on *sample* positions (those whose place in their text, modulo PERIOD, is
in the cover). So two equal strings hold equal sample strings of WIDTH - PERIOD + 1 bytes at the same offset.

1. Ranks of the cover sample: fingerprints of the sample strings go to buckets, a bucket is sorted alone, and a sample
   whose string stands nowhere else is out. Suffixes without a ranked sample have no repeat and are never sorted.
2. Long ties: a ranked sample is compared with its whole reach (PERIOD - 1 bytes to the left, WIDTH to the right). Equal
   reaches settle all strings through those samples at once, however long the common passage and however many its copies.
3. What is left are suffixes near places where passages begin to differ, one for each distinct reach. They are sorted by
   their WIDTH bytes (as fingerprints of 80 bits beside the bucket's) in buckets, one bucket at a time.

Texts travel as compressed chunks, once into the shared scratch folder and once through a shuffle; what a bucket finds
goes back to a chunk as bitmaps. A task holds one chunk or one bucket. Copies within a chunk are merged before they are
sent, so a hot passage costs a bucket at most one entry a chunk. More input makes more buckets, not larger ones.

Defined results: a null text is empty; texts shorter than WIDTH keep all; repeated rows are repeats of each other; rows
keep their multiplicity and null ids; an empty table gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, mix, released, runs, slices, utf8, wide
from .decontaminate import _arrow

WIDTH = 200
#: A perfect difference set: each non-zero remainder is the difference of exactly one pair (fixed values; a test checks it).
PERIOD = 133
COVER = (1, 10, 11, 13, 27, 31, 68, 75, 83, 110, 115, 121)
SAMPLE = WIDTH - PERIOD + 1
CHUNK_BYTES, BUCKET_BYTES = 2 << 20, 6 << 20
SENT = "chunk long, kind int, bucket int, payload binary"
RANK, REACH, SUFFIX, STATE = 0, 1, 2, 9


def covers(cover=COVER, period=PERIOD) -> bool:
    return {(a - b) % period for a in cover for b in cover} == set(range(period))


#: Two odd multipliers: the bases of the strings' polynomial hashes.
BASES = [int(x) | 5 for x in np.random.default_rng(20_240_607).integers(2**62, 2**63, 2, dtype=np.uint64)]
GRAM = 8
_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(n: int, which: int = 0, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, or of its inverse."""
    have = _powers.get((which, inverse))
    if have is None or len(have) < n:
        base = BASES[which] if not inverse else pow(BASES[which], -1, 2**64)
        have = np.array([1], np.uint64)
        while len(have) < n:  # doubling
            step = np.uint64(pow(base, len(have), 2**64))
            have = np.concatenate([have, have * step])
        _powers[which, inverse] = have
    return have[:n]


def grams(data: np.ndarray) -> np.ndarray:
    """The GRAM bytes from each place on, mixed: values without the structure of the text, for the polynomials."""
    out = wide(data)[:-1] * np.uint64(0x9FB21C651E98DF25)
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out


def prefix_hash(mixed: np.ndarray, which: int = 0) -> np.ndarray:
    """Sums of grams times base**i; see string_hash."""
    out = np.zeros(len(mixed) + 1, np.uint64)
    np.cumsum(mixed * powers(len(mixed), which), out=out[1:])
    return out


def string_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of data[start:end] of at least GRAM bytes, by the grams inside: equal for equal strings wherever they stand."""
    return mix((prefix[end - GRAM + 1] - prefix[start]) * powers(len(prefix), which, True)[start])


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def flags(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def high(keys: np.ndarray, width: int = 5) -> bytes:
    """The upper bytes of each key."""
    return np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, 8 - width :].tobytes()


class Chunk:
    """A chunk of texts with its sample positions; every stage derives the same arrays from it."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, buckets: int):
        self.data, self.offsets, self.buckets = data, offsets, buckets
        sizes = np.diff(offsets)
        period = np.zeros(PERIOD, bool)
        period[list(COVER)] = True
        longest = int(sizes.max(initial=0))
        in_cover = np.flatnonzero(np.resize(period, longest)) if longest else np.zeros(0, np.int64)
        some = np.flatnonzero(sizes >= WIDTH)
        counts = np.searchsorted(in_cover, sizes[some] - SAMPLE, "right")
        self.doc = np.repeat(some, counts)
        local = np.arange(len(self.doc)) - np.repeat(np.cumsum(counts) - counts, counts)
        self.at = offsets[self.doc] + in_cover[local] if len(local) else np.zeros(0, np.int64)
        self.mixed = grams(data)
        self.prefix = prefix_hash(self.mixed)
        h = string_hash(self.prefix, self.at, self.at + SAMPLE)
        self.key = ((h & np.uint64(0xFFFFFF)) % np.uint64(buckets)) << np.uint64(40) | h >> np.uint64(24)
        self.distinct, self.which, self.count = np.unique(self.key, return_inverse=True, return_counts=True)

    def parts(self, sorted_keys: np.ndarray) -> list[tuple[int, int, int]]:
        """(bucket, from, to) of the buckets that sorted keys have."""
        return runs(sorted_keys >> np.uint64(40))

    def rank_rows(self):
        low = self.distinct.view(np.uint8).reshape(-1, 8)[:, 1:5]  # a few false partners cost less than the fifth byte
        for b, a, z in self.parts(self.distinct):
            yield RANK, b, bits(self.count[a:z] > 1) + low[a:z].tobytes()

    def ranked(self, shared: np.ndarray) -> None:
        """Keeps the samples whose key is shared, grouped by key and reach."""
        keep = shared[self.which]
        at, key, doc = self.at[keep], self.key[keep], self.doc[keep]
        left = np.maximum(self.offsets[doc], at - (PERIOD - 1))
        right = np.minimum(self.offsets[doc + 1], at + WIDTH)
        self.second = prefix_hash(self.mixed, 1)
        del self.mixed
        reach = mix(string_hash(self.second, left, right, 1) + ((at - left) * 1024 + (right - at)).astype(np.uint64))
        by = np.lexsort((reach, key))
        at, key, doc, reach = at[by], key[by], doc[by], reach[by]
        new = np.ones(len(at), bool)
        new[1:] = (key[1:] != key[:-1]) | (reach[1:] != reach[:-1])
        self.first = np.flatnonzero(new)
        self.r_at, self.r_doc, self.group = at, doc, np.cumsum(new) - 1
        self.r_key, self.r_reach = key[self.first], reach[self.first]
        self.r_count = np.diff(np.append(self.first, len(at)))

    def reach_rows(self):
        low = np.ascontiguousarray(self.r_key).view(np.uint8).reshape(-1, 8)[:, :5]
        for b, a, z in self.parts(self.r_key):
            yield REACH, b, bits(self.r_count[a:z] > 1) + low[a:z].tobytes() + high(self.r_reach[a:z], 6)

    def starts(self, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """True for the starts of all strings through these samples."""
        lo, hi = np.maximum(self.offsets[doc], at - (PERIOD - 1)), np.minimum(at, self.offsets[doc + 1] - WIDTH) + 1
        some = lo < hi
        step = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(step, lo[some], 1)
        np.add.at(step, hi[some], -1)
        return np.cumsum(step[:-1]) > 0

    def suffixes(self, wanted: np.ndarray) -> None:
        """The suffixes through the first sample of each wanted group: keys with their bucket on top, and a second key."""
        one = self.first[wanted]
        self.s_at = np.flatnonzero(self.starts(self.r_at[one], self.r_doc[one]))
        f0, f1 = string_hash(self.prefix, self.s_at, self.s_at + WIDTH), string_hash(self.second, self.s_at, self.s_at + WIDTH, 1)
        bucket = f0 % np.uint64(self.buckets)
        by = np.lexsort((f1, f0, bucket))
        self.s_at, f0, f1, bucket = self.s_at[by], f0[by], f1[by], bucket[by]
        new = np.ones(len(by), bool)
        new[1:] = (f0[1:] != f0[:-1]) | (f1[1:] != f1[:-1])
        first = np.flatnonzero(new)
        self.s_group, self.s_count = np.cumsum(new) - 1, np.diff(np.append(first, len(by)))
        self.f0, self.f1, self.s_bucket = f0[first], f1[first], bucket[first]

    def suffix_rows(self):
        for b, a, z in self.parts(self.s_bucket << np.uint64(40)):
            yield SUFFIX, b, bits(self.s_count[a:z] > 1) + high(self.f0[a:z]) + high(self.f1[a:z])


def _split(raw: bytes, width: int) -> tuple[np.ndarray, bytes, int]:
    """Flags and records of a payload of n records of so many bytes."""
    n = (len(raw) * 8) // (8 * width + 1)
    while (n + 7) // 8 + n * width > len(raw):
        n -= 1
    head = (n + 7) // 8
    return flags(raw[:head], n), raw[head:], n


def _wide(raw: bytes, width: int) -> np.ndarray:
    """Records of so many bytes as integers."""
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view("<u8")[:, 0]


def _sort_bucket(kind: int, payloads: list[bytes]) -> list[bytes]:
    """For each payload of one bucket, the bitmap(s) that answer it."""
    first, second = {RANK: (4, 0), REACH: (5, 6), SUFFIX: (5, 5)}[kind]
    many, ones, twos, sizes = [], [], [], []
    for raw in payloads:
        flag, rest, n = _split(raw, first + second)
        many.append(flag)
        sizes.append(n)
        ones.append(_wide(rest[: first * n], first))
        if second:
            twos.append(_wide(rest[first * n :], second))
    many, one = np.concatenate(many), np.concatenate(ones)
    two = np.concatenate(twos) if twos else np.zeros(len(one), np.uint64)
    by = np.lexsort((two, one)) if twos else np.argsort(one, kind="stable")
    a, b = one[by], two[by]
    new_key = np.ones(len(by), bool)
    new_key[1:] = a[1:] != a[:-1]
    new = new_key.copy()
    new[1:] |= b[1:] != b[:-1]
    group = np.cumsum(new) - 1
    size = np.bincount(group)
    repeated = np.empty(len(by), bool)
    repeated[by] = (size[group] > 1)
    repeated |= many
    cuts = np.cumsum(sizes)[:-1]
    if kind != REACH:
        return [bits(x) for x in np.split(repeated, cuts)]
    key = np.cumsum(new_key) - 1
    reaches = np.bincount(key[new])
    wanted = np.empty(len(by), bool)
    wanted[by] = new & (reaches[key] > 1)  # the first of each reach, where a key has several
    return [bits(x) + bits(y) for x, y in zip(np.split(repeated, cuts), np.split(wanted, cuts))]


def _bucket_function(key, table):
    """Answers all chunks of a bucket; rows of kind STATE pass."""
    table = table.sort_by([("chunk", "ascending")]).combine_chunks()
    kinds, payloads = table.column("kind").to_pylist(), table.column("payload").to_pylist()
    sent = [i for i, k in enumerate(kinds) if k != STATE]
    if sent:
        for i, answer in zip(sent, _sort_bucket(kinds[sent[0]], [payloads[i] for i in sent])):
            payloads[i] = answer
    return pa.table({"chunk": table.column("chunk"), "kind": table.column("kind"), "bucket": table.column("bucket"), "payload": pa.array(payloads, pa.binary())})


def _sent(chunk: int, rows, schema: pa.Schema) -> pa.Table:
    rows = list(rows)
    return pa.table([pa.array([chunk] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], schema=schema)


def strip(docs: DataFrame, text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """docs' columns but the text under ``doc``, n_bytes, spans (removed runs, array of start and end), kept (binary)."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    names = [c for c in docs.columns if c != text]
    state = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), F.col(f"`{text}`").alias("t"))
    doc_field = state.schema["doc"]
    chunk_schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("docs", T.ArrayType(doc_field.dataType)), *T._parse_datatype_string("size long, offsets binary, data binary").fields])
    chunk_arrow, sent_arrow = _arrow(chunk_schema), _arrow(T._parse_datatype_string(SENT))

    def cut(batches):
        number = TaskContext.get().partitionId() << 32
        squeeze = zstandard.ZstdCompressor(level=9).compress
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for lo, hi in slices(offsets, CHUNK_BYTES):
                own = batch.column(0).slice(lo, hi - lo)
                listed = pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), pa.concat_arrays([own]))
                at = offsets[lo : hi + 1] - offsets[lo]
                columns = [pa.array([number], pa.int64()), listed, pa.array([int(at[-1])], pa.int64()), pa.array([squeeze(at.tobytes())], pa.binary()), pa.array([squeeze(data[offsets[lo] : offsets[hi]].tobytes())], pa.binary())]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, chunk_arrow)], schema=chunk_arrow)
                number += 1

    chunks = scratch.keep(state.mapInArrow(released(cut), chunk_schema), "chunks")
    total = chunks.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(1 << 23, max(4 * partitions, -(-total * len(COVER) * 5 // (PERIOD * BUCKET_BYTES))))

    def opened(offsets: bytes, data: bytes) -> Chunk:
        open_ = zstandard.ZstdDecompressor().decompress
        return Chunk(np.frombuffer(open_(data), np.uint8), np.frombuffer(open_(offsets), np.int64), buckets)

    def send_ranks(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                chunk = opened(batch.column(1)[i].as_py(), batch.column(2)[i].as_py())
                yield from _sent(batch.column(0)[i].as_py(), chunk.rank_rows(), sent_arrow).combine_chunks().to_batches()

    def answered(chunk: Chunk, table: pa.Table) -> int:
        """Brings a chunk to where the answers so far take it; returns the last kind answered."""
        got: dict[int, dict[int, bytes]] = {}
        for kind, bucket, payload in zip(table.column("kind").to_pylist(), table.column("bucket").to_pylist(), table.column("payload").to_pylist()):
            if kind == STATE:
                done = np.frombuffer(payload[:8], "<i8")[0]
                got.setdefault(RANK, {})[-1] = payload[8 : 8 + done]
                if len(payload) > 8 + done:
                    got.setdefault(REACH, {})[-1] = payload[8 + done :]
            else:
                got.setdefault(kind, {})[bucket] = payload
        n = len(chunk.distinct)
        if -1 in (rank := got.get(RANK, {})):
            shared = flags(rank[-1], n)
        else:
            shared = np.zeros(n, bool)
            for b, a, z in chunk.parts(chunk.distinct):
                shared[a:z] = flags(rank[b], z - a)
        chunk.shared = shared
        chunk.ranked(shared)
        if REACH not in got and SUFFIX not in got and -1 not in rank:
            return RANK
        m = len(chunk.r_key)
        repeated, wanted = np.zeros(m, bool), np.zeros(m, bool)
        reach = got.get(REACH, {})
        if -1 in reach:
            both = flags(reach[-1], 2 * m)
            repeated, wanted = both[:m], both[m:]
        else:
            for b, a, z in chunk.parts(chunk.r_key):
                head = (z - a + 7) // 8
                repeated[a:z], wanted[a:z] = flags(reach[b][:head], z - a), flags(reach[b][head:], z - a)
        chunk.repeated, chunk.wanted = repeated, wanted
        chunk.suffixes(wanted)
        chunk.s_repeated = np.zeros(len(chunk.f0), bool)
        for b, a, z in chunk.parts(chunk.s_bucket << np.uint64(40)):
            if b in got.get(SUFFIX, {}):
                chunk.s_repeated[a:z] = flags(got[SUFFIX][b], z - a)
        return SUFFIX if SUFFIX in got else REACH

    def send_reaches(key, left, right):
        chunk = opened(left.column("offsets")[0].as_py(), left.column("data")[0].as_py())
        answered(chunk, right)
        shared = bits(chunk.shared)
        own = (STATE, key[0].as_py() % buckets, np.array([len(shared)], "<i8").tobytes() + shared)
        return _sent(key[0].as_py(), [*chunk.reach_rows(), own], sent_arrow)

    def send_suffixes(key, left, right):
        chunk = opened(left.column("offsets")[0].as_py(), left.column("data")[0].as_py())
        answered(chunk, right)
        shared = bits(chunk.shared)
        own = (STATE, key[0].as_py() % buckets, np.array([len(shared)], "<i8").tobytes() + shared + bits(np.concatenate([chunk.repeated, chunk.wanted])))
        return _sent(key[0].as_py(), [*chunk.suffix_rows(), own], sent_arrow)

    out_schema = T.StructType([doc_field, *T._parse_datatype_string("n_bytes long, spans array<struct<start:long,end:long>>, kept binary").fields])
    out_arrow = _arrow(out_schema)

    def finish(key, left, right):
        chunk = opened(left.column("offsets")[0].as_py(), left.column("data")[0].as_py())
        answered(chunk, right)
        hit = chunk.repeated[chunk.group] if len(chunk.group) else np.zeros(0, bool)
        start = chunk.starts(chunk.r_at[hit], chunk.r_doc[hit])
        start[chunk.s_at[chunk.s_repeated[chunk.s_group]]] = True
        step = np.zeros(len(start) + 1, np.int32)
        at = np.flatnonzero(start)
        step[at] += 1
        step[np.minimum(at + WIDTH, len(start))] -= 1
        gone = np.cumsum(step[:-1]) > 0
        spans, kept, raw = [], [], chunk.data
        for a, z in zip(chunk.offsets[:-1].tolist(), chunk.offsets[1:].tolist()):
            own = gone[a:z]
            edge = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
            spans.append([{"start": s, "end": e} for s, e in zip(edge[::2].tolist(), edge[1::2].tolist())])
            kept.append(raw[a:z][~own].tobytes() if len(edge) else raw[a:z].tobytes())
        listed = left.column("docs").combine_chunks()
        columns = [pa.chunked_array([listed.flatten()]) if isinstance(listed, pa.ListArray) else listed, pa.array(np.diff(chunk.offsets)), pa.array(spans, out_arrow.field("spans").type), pa.array(kept, pa.binary())]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, out_arrow)], schema=out_arrow)

    texts = chunks.groupBy("chunk")
    step1 = chunks.select("chunk", "offsets", "data").mapInArrow(released(send_ranks), SENT).groupBy("bucket").applyInArrow(_bucket_function, SENT)
    step2 = texts.cogroup(step1.groupBy("chunk")).applyInArrow(send_reaches, SENT).groupBy("bucket").applyInArrow(_bucket_function, SENT)
    step3 = texts.cogroup(step2.groupBy("chunk")).applyInArrow(send_suffixes, SENT).groupBy("bucket").applyInArrow(_bucket_function, SENT)
    return texts.cogroup(step3.groupBy("chunk")).applyInArrow(finish, out_schema)
