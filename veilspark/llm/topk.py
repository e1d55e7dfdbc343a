"""Exact top-k search by inner product, by aggregation without random access (the NRA form of the threshold algorithm).

Every component is a sorted list of the candidates. For a query, a component's list is read from its high end where the
query's value is positive and from its low end where it is negative: that is the order of what the component adds to the
score. Lists are read sequentially, all to the same depth, in rounds of growing depth. After each round what was read gives
every candidate a lower and an upper bound of its score: an unread component lies between the place where reading stands and
the list's far end. A query stops reading as soon as no more than RESOLVED * k candidates can still reach the k-th best lower
bound; their scores are then resolved. A query whose bounds never exclude enough is read to the end of its lists, which gives
the scores themselves.

Candidates are dealt to groups of bounded size, whatever their ids or vectors, and each group meets every query in packed
blocks: the queries are a table that travels once for each group, never through the driver, and candidates travel once. A
task holds one group and one block of queries; a group's lists are sorted once, and it sends on at most k rows a query.
A query's k-th best score so far bounds its reading of the group's further blocks of lists.

Defined results: rows with a null id or a vector that is null or has null, NaN or infinite components take no part;
a query meets candidates of its own dimension only; a candidate is "the query's own" if it has its id; repeated
candidate rows count once each; query rows under one id give one answer, that of the least vector; ties go to the smaller id; a score beyond 64 bits
counts as the nearest within; empty table, empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, released

#: Queries of a block, candidates of a block of lists, and bytes of components (as doubles) of a group of candidates.
QUERY_BLOCK, LIST_BLOCK, GROUP_BYTES = 256, 4096, 16 << 20
#: The first depth is this share of the lists; depths double up to half of the lists, and then grow by this share.
STEP = 0.125
#: A query stops when its candidates are at most so many times k.
RESOLVED = 8
EXACT, LONG = 2.0**53, 2**63 - 1


def fixed_point(values: np.ndarray) -> np.ndarray:
    """floor(256 x) with x as double."""
    return np.floor(256.0 * values.astype(np.float64))


def is_exact(x: np.ndarray, q: np.ndarray) -> bool:
    """Whether doubles hold all partial sums of the inner products."""
    return np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * max(1, x.shape[-1]) < EXACT


class Lists:
    """Candidates as sorted lists. reads: entries that queries have read, and all of theirs; resolved: scores computed apart."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        n = len(x)
        order = np.argsort(-x, axis=0, kind="stable")
        self.rank = np.empty(x.shape, np.int32)
        np.put_along_axis(self.rank, order, np.arange(n, dtype=np.int32)[:, None], 0)
        self.sorted = np.take_along_axis(x, order, 0)
        self.read = self.total = self.resolved = 0

    def best(self, query_ids: np.ndarray, q: np.ndarray, k: int, have: list) -> None:
        """Merges this block's answers into have, a list of (scores, ids) for each query."""
        n, d = self.x.shape
        if not is_exact(self.x, q):  # sums that doubles don't hold: Python's integers, for all pairs
            for c in range(len(q)):
                own = np.flatnonzero(self.ids != query_ids[c])
                scores = [max(-LONG - 1, min(LONG, sum(int(a) * int(b) for a, b in zip(row, q[c])))) for row in self.x[own]]
                have[c] = merged(have[c], np.array(scores, np.int64), self.ids[own], k)
            return
        plus, minus = np.maximum(q, 0), np.minimum(q, 0)
        floor = np.array([s[k - 1] if len(s) >= k else -np.inf for s, _ in have], np.float64)
        on = np.arange(len(q))  # the queries that read on: the rows of known and alive
        alive = query_ids[:, None] != self.ids[None, :]
        known = np.zeros(alive.shape)
        before = 0
        self.total += n * d * len(q)
        while len(on):
            depth = next_depth(before, n, k) if d else n
            self.read += (depth - before) * d * len(on)
            p, m = plus[on], minus[on]
            high, low = self.rank < depth, self.rank >= n - depth
            known += p @ (self.x * (high & (self.rank >= before))).T
            known += m @ (self.x * (low & (self.rank < n - before))).T
            before = depth
            if depth == n:
                for r, i in enumerate(on):
                    some = np.flatnonzero(alive[r] & (known[r] >= floor[i]))
                    have[i] = merged(have[i], known[r, some], self.ids[some], k)
                return
            not_high, not_low = (~high).astype(np.float64), (~low).astype(np.float64)
            upper = (p * self.sorted[depth - 1]) @ not_high.T
            upper += (m * self.sorted[n - depth]) @ not_low.T
            upper += known
            upper[~alive] = -np.inf
            # Any k candidates give a valid bound; those with the greatest upper bounds give a high one.
            few = min(n, 4 * k)
            top = np.argpartition(upper, n - few, axis=1)[:, n - few :]
            for r, i in enumerate(on):
                t = top[r][alive[r, top[r]]]
                if len(t) >= k:
                    lower = known[r, t] + not_high[t] @ (p[r] * self.sorted[-1]) + not_low[t] @ (m[r] * self.sorted[0])
                    floor[i] = max(floor[i], np.partition(lower, len(t) - k)[len(t) - k])
            alive = upper >= floor[on][:, None]
            left = alive.sum(1)
            for r in np.flatnonzero(left <= RESOLVED * k):
                some = np.flatnonzero(alive[r])
                self.resolved += len(some)
                have[on[r]] = merged(have[on[r]], self.x[some] @ q[on[r]], self.ids[some], k)
            go = left > RESOLVED * k
            if not go.all():
                on, known, alive = on[go], known[go], alive[go]


def next_depth(before: int, n: int, k: int) -> int:
    step = max(1, int(n * STEP))
    return min(n, max(4 * k, step if not before else 2 * before if before < n // 2 else before + step + 1))


def merged(have: tuple[np.ndarray, np.ndarray], scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of both: greater scores first, then smaller ids."""
    s, v = np.concatenate([have[0], scores.astype(np.int64)]), np.concatenate([have[1], ids])
    if len(s) > 4 * k:
        keep = s >= np.partition(s, len(s) - k)[len(s) - k]
        s, v = s[keep], v[keep]
    top = np.lexsort((v, -s))[:k]
    return s[top], v[top]


def _packed():
    """A mapInArrow function that packs rows (vec_id, v) into blocks of one dimension: d, ids, values (doubles)."""

    def run(batches):
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            at = lists.offsets.to_numpy()
            values = fixed_point(lists.values.to_numpy(zero_copy_only=False))
            sizes = np.diff(at)
            out = []
            for d in map(int, np.unique(sizes)):
                rows = np.flatnonzero(sizes == d)
                for lo in range(0, len(rows), QUERY_BLOCK):
                    some = rows[lo : lo + QUERY_BLOCK]
                    out.append((d, ids[some].astype("<i8").tobytes(), values[at[some][:, None] + np.arange(d)].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary()))], names=["d", "ids", "data"])

    return run


def _unpacked(d: int, ids: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, "<i8")
    return ids, np.frombuffer(data, np.float64).reshape(len(ids), d)


def _search(k: int):
    """A mapInArrow function over rows (g, d, kind, ids, data) in this order: a group's candidates (kind 0), then blocks of queries."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches):
        group, lists, waiting = None, [], []
        for batch in batches:
            out = []
            for g, d, kind, ids, data in zip(*(c.to_pylist() for c in batch.columns)):
                if (g, d) != group:
                    group, lists, waiting = (g, d), [], []
                if kind == 0:
                    waiting.append(_unpacked(d, ids, data))
                    continue
                if waiting:
                    all_ids, x = (np.concatenate(c) for c in zip(*waiting))
                    waiting = []
                    lists = [Lists(all_ids[lo : lo + LIST_BLOCK], x[lo : lo + LIST_BLOCK]) for lo in range(0, len(x), LIST_BLOCK)]
                query_ids, q = _unpacked(d, ids, data)
                have = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(q)
                for block in lists:
                    block.best(query_ids, q, k, have)
                out += [(np.full(len(v), i), v, s) for i, (s, v) in zip(query_ids, have) if len(v)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], schema=schema)

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scratch: Scratch | None = None) -> DataFrame:
    """query_id, rank (int, from 1), vec_id, score (long): for each row of queries its k best rows of vectors."""
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark)

    def usable(df: DataFrame) -> DataFrame:
        v = F.col(f"`{vector_col}`")
        fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        return df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine)

    block = "d int, ids binary, data binary"
    rows = scratch.keep(usable(vectors).mapInArrow(_packed(), block), "candidates")
    asked = scratch.keep(usable(queries).groupBy("vec_id").agg(F.min("v").alias("v")).mapInArrow(_packed(), block), "queries")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0))).first()[0]
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, -(-size // GROUP_BYTES), min(partitions, -(-size // (GROUP_BYTES >> 4))))
    # Packed blocks are dealt by their running number: no id or vector can make a group large.
    dealt = rows.select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int").alias("g"), "d", F.lit(0).alias("kind"), "ids", "data")
    met = asked.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), "d", F.lit(1).alias("kind"), "ids", "data")
    both = dealt.unionAll(met).repartition(4 * groups, "g", "d").sortWithinPartitions("g", "d", "kind")
    out = both.mapInArrow(released(_search(k)), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
