"""Bounded-space online packing of documents into token sequences.

A document's ids, closed by END, are cut into full sequences and a rest. A partition keeps at most OPEN open windows; a
rest goes to the window that it fits best. When none fits, the fullest window is emitted: topped up with the head of the
rest if its gap is at least MIN_CUT (cuts are free), else padded. Memory is that of the open windows.

What a partition leaves open is merged at last: the leftovers of MERGED partitions go to one task, which joins them
end to end into full sequences and cuts the final rest into powers of two, so that merging adds no padding. Everything
that was packed is written to the shared scratch folder before, so no text is tokenized twice and a lost executor costs
only its own task.

Defined results: a null or empty text is the id END alone; repeated rows are packed each; an empty table gives no row; a
text longer than a sequence spans several.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, released, slices, utf8
from .decontaminate import _arrow
from .tokens import CACHE_ENTRIES

LENGTH, OPEN, MIN_CUT, MERGED, END = 2048, 64, 16, 16, 1
#: Bytes of text that are tokenized at once.
STEP = 1 << 20
FIELDS = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Packer:
    """The open windows of a partition. A piece is (row, start, ids, doc_tokens)."""

    def __init__(self, base: int, length: int = LENGTH, most: int = OPEN):
        self.next, self.length, self.most = base, length, most
        self.gaps: list[tuple[int, int]] = []  # (free, window), sorted
        self.windows: dict[int, list] = {}
        self.out: list[tuple] = []

    def emit(self, pieces: list) -> None:
        at = 0
        for row, start, ids, total in pieces:
            self.out.append((row, start, ids, total, self.next, at))
            at += len(ids)
        self.next += 1

    def add(self, row, ids: np.ndarray) -> None:
        total, at = len(ids), 0
        while total - at >= self.length:
            self.emit([(row, at, ids[at : at + self.length], total)])
            at += self.length
        if at < total:
            self.place(row, at, ids[at:], total)

    def place(self, row, start: int, ids: np.ndarray, total: int) -> None:
        i = bisect.bisect_left(self.gaps, (len(ids), -1))
        if i == len(self.gaps) and len(self.gaps) == self.most:
            gap, w = self.gaps.pop(0)  # the fullest
            pieces = self.windows.pop(w)
            if gap >= MIN_CUT:
                pieces.append((row, start, ids[:gap], total))
                start, ids = start + gap, ids[gap:]
            self.emit(pieces)
            i = bisect.bisect_left(self.gaps, (len(ids), -1))
        if i < len(self.gaps):
            gap, w = self.gaps.pop(i)
        else:
            gap, w = self.length, self.next + (1 << 32) + len(self.windows)
            while w in self.windows:
                w += 1
            self.windows[w] = []
        self.windows[w].append((row, start, ids, total))
        if gap == len(ids):
            self.emit(self.windows.pop(w))
        else:
            bisect.insort(self.gaps, (gap - len(ids), w))


def merge(pieces: list[tuple], base: int, length: int = LENGTH) -> list[tuple]:
    """Joins pieces end to end; the last sequence is cut into powers of two, the largest first."""
    out, seq = [], base
    left = sum(len(p[2]) for p in pieces)
    room = size = 0
    for row, start, ids, total in pieces:
        while len(ids):
            if not room:
                seq, size = seq + bool(size), length if left >= length else 1 << (left.bit_length() - 1)
                room = size
            take = min(room, len(ids))
            out.append((row, start, ids[:take], total, seq, size - room))
            start, ids, room, left = start + take, ids[take:], room - take, left - take
    return out


def pack(docs: DataFrame, tokenizer_path: str, text: str = "text", length: int = LENGTH, open_windows: int = OPEN, scratch: Scratch | None = None, entries: int = CACHE_ENTRIES, step: int = STEP) -> DataFrame:
    """One row a piece: docs' columns but the text under ``doc``, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset.

    entries and step bound a worker's memory at the price of CPU seconds (pre-tokens in its cache, bytes that are tokenized at once); the rows don't depend on them.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    keep = [c for c in docs.columns if c != text]
    state = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc"), F.col(f"`{text}`").alias("t"))
    schema = T.StructType([state.schema["doc"], *T._parse_datatype_string(FIELDS + ", open boolean, part long").fields])
    arrow = _arrow(schema)

    def rows(doc: pa.Array, pieces: list[tuple], is_open: bool, part: int) -> pa.RecordBatch:
        n = len(pieces)
        columns = [
            doc, pa.array([p[1] for p in pieces], pa.int64()), pa.array([len(p[2]) for p in pieces], pa.int64()), pa.array([p[2].tobytes() for p in pieces], pa.binary()),
            pa.array([p[3] for p in pieces], pa.int64()), pa.array([p[4] for p in pieces], pa.int64()), pa.array([p[5] for p in pieces], pa.int64()), pa.array([is_open] * n, pa.bool_()), pa.array([part] * n, pa.int64()),
        ]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    def pack_partition(batches):
        from .tokens import Encoder

        encoder = Encoder(tokenizer_path, entries)  # goes with the task, before released() trims
        part = TaskContext.get().partitionId()
        packer = Packer(part << 33, length, open_windows)
        end = np.array([END], "<u4")

        def flush():
            if packer.out:
                done, packer.out = packer.out, []
                yield rows(pa.concat_arrays([p[0] for p in done]), done, False, part)

        for batch in batches:
            doc = batch.column(0)
            data, offsets = utf8(batch.column(1))
            for lo, hi in slices(offsets, step):
                ids, at = encoder.encode(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                for row in range(lo, hi):
                    packer.add(doc.slice(row, 1), np.concatenate([ids[at[row - lo] : at[row - lo + 1]], end]))
                yield from flush()
        yield from flush()
        for pieces in packer.windows.values():
            packer.emit(pieces)
        if packer.out:
            done = packer.out
            yield rows(pa.concat_arrays([p[0] for p in done]), done, True, part)

    packed = scratch.keep(state.mapInArrow(released(pack_partition), schema), "packed")
    final = T.StructType(schema.fields[:-2])
    final_arrow = _arrow(final)

    def merge_leftovers(key, table):
        table = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")]).combine_chunks()
        ids = table.column("ids").to_pylist()
        pieces = [(i, s, np.frombuffer(b, "<u4"), n) for i, (s, b, n) in enumerate(zip(table.column("start").to_pylist(), ids, table.column("doc_tokens").to_pylist()))]
        done = merge(pieces, ((1 << 29) + key[0].as_py()) << 33, length)
        doc = table.column("doc").take(pa.array([p[0] for p in done], pa.int64()))
        columns = [
            doc, pa.chunked_array([pa.array([p[1] for p in done], pa.int64())]), pa.array([len(p[2]) for p in done], pa.int64()), pa.array([p[2].tobytes() for p in done], pa.binary()),
            pa.array([p[3] for p in done], pa.int64()), pa.array([p[4] for p in done], pa.int64()), pa.array([p[5] for p in done], pa.int64()),
        ]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, final_arrow)], schema=final_arrow)

    closed = packed.where(~F.col("open")).drop("open", "part")
    left = packed.where("open").drop("open").withColumn("g", F.floor(F.col("part") / MERGED)).drop("part")
    return closed.unionAll(left.groupBy("g").applyInArrow(merge_leftovers, final))
