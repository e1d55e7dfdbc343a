"""What several operators share: the scratch folder, Arrow text slices, byte hashes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes and rows that one numpy step works on; they bound a worker's memory.
SLICE_BYTES, SLICE_ROWS = 1 << 20, 4096
#: Rows of a batch that goes to Python while a table is written to the scratch folder.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000


class Scratch:
    """Tables written below the cluster's shared ``spark.checkpoint.dir``, so that a lost executor costs no recomputation.

    Only where a local session names no such folder (tests, a laptop) a temporary one is set; on a cluster that is an error.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.made = spark, {}, 0
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not root:
            root = spark.sparkContext.getCheckpointDir()
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = tempfile.mkdtemp(prefix="veilspark-")
            spark.sparkContext.setCheckpointDir(root)
        self.root = f"{root.rstrip('/')}/veilspark-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and reads it back: the lineage ends here.

        Rows go to Python and back in smaller batches meanwhile, as texts may be long. Snappy, as most of these tables are hashes
        and the native buffers of stronger codecs stay with each thread that has written.
        """
        self.made += 1
        path = f"{self.root}/{name}-{self.made}"
        self.paths[path] = self.made
        before = self.spark.conf.get(BATCH)
        try:
            self.spark.conf.set(BATCH, min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS)
            df.write.option("compression", "snappy").parquet(path)
        finally:
            self.spark.conf.set(BATCH, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, since: int, *kept: str) -> None:
        """Deletes the tables made after so many, but for the last ones of these names: nothing reads them any more."""
        jvm = self.spark._jvm
        stay = {max((p for p in self.paths if p.startswith(f"{self.root}/{name}-")), key=self.paths.get, default=None) for name in kept}
        for gone in [p for p, made in self.paths.items() if made > since and p not in stay]:
            del self.paths[gone]
            path = jvm.org.apache.hadoop.fs.Path(gone)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def held_out(key: str = "doc_id") -> Column:
    """True for the quarter of rows that no model learns from; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def thinned(df: DataFrame, mark: Column, most: int, total: int | Column) -> DataFrame:
    """About ``most`` of ``total`` rows (all, if there are fewer), chosen by the hash of a column expression: no row is ranked or moved."""
    steps = 1 << 30
    share = F.lit(most).cast("double") / (F.lit(max(1, total)) if isinstance(total, int) else total)
    return df.where(F.pmod(F.xxhash64(F.lit("sample"), mark), F.lit(steps)) < share * steps)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets, from 0; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES, rows: int = SLICE_ROWS):
    """Row ranges of at most so many bytes and rows; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = min(lo + rows, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1))
        yield lo, hi
        lo = hi


#: Masks for the first 0 to 8 bytes of a block.
_HEAD = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_PLACE = np.uint64(0x9E3779B97F4A7C15)


def wide(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as one integer (zeros beyond the end): a view that is not aligned, of len(data) + 1."""
    return np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))


def span_blocks(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The blocks of 8 bytes of non-empty spans as integers, each block's place in its span, and each span's first block."""
    count = (end - start + 7) >> 3
    last = np.cumsum(count)
    turn = np.arange(last[-1]) - np.repeat(last - count, count)
    at = np.repeat(start, count) + 8 * turn
    return wide(data)[at] & _HEAD[np.minimum(np.repeat(end, count) - at, 8)], turn, last - count


def block_hash(block: np.ndarray, turn: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans by their blocks.

    Each block of 8 bytes is mixed with its place before blocks are added up. (A polynomial in a fixed base modulo 2**64 would
    give equal values to different texts of a simple structure, as to a Thue-Morse word and its complement.)
    """
    return mix(np.add.reduceat(mix(block + turn.astype(np.uint64) * _PLACE), first) + size.astype(np.uint64))


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of non-empty spans data[start:end]."""
    if not len(start):
        return np.zeros(0, np.uint64)
    return block_hash(*span_blocks(data, start, end), end - start)


def distinct_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One span of each content (its index), and for every span the number of its content; compared byte by byte."""
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = end - start
    block, turn, first = span_blocks(data, start, end)
    _, where, which = np.unique(block_hash(block, turn, first, size), return_index=True, return_inverse=True)
    one = where[which]
    # Blocks of a longer partner may lie beyond its own; then the sizes differ already.
    partner = np.repeat(first[one], np.diff(np.append(first, len(block)))) + turn
    if not ((size[one] == size).all() and (block[np.minimum(partner, len(block) - 1)] == block).all()):  # two contents with one hash
        known: dict[bytes, int] = {}
        raw = data.tobytes()
        which = np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip(start.tolist(), end.tolist())])
        where = np.unique(which, return_index=True)[1]
    return where, which


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values whose every output bit depends on every input bit (xorshift-multiply rounds)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_spans(is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of word bytes that cross no document, and each document's first word (n + 1)."""
    n = len(is_word)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, is_word[:-1]
    starts = np.flatnonzero(is_word & (~before | first[:n]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, is_word[1:]
    ends = np.flatnonzero(is_word & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def strings(values) -> pa.Array:
    return pa.array(values, pa.string())


def runs(sorted_keys: np.ndarray) -> list[tuple[int, int, int]]:
    """(key, from, to) of the runs of equal keys."""
    if not len(sorted_keys):
        return []
    cut = np.concatenate([[0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1, [len(sorted_keys)]])
    return list(zip(sorted_keys[cut[:-1]].tolist(), cut[:-1].tolist(), cut[1:].tolist()))


def released(run):
    """A mapInArrow function that gives the memory of its task back to the system when it ends: workers live on."""

    def out(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return out
