"""Near-duplicate groups by MinHash bands, odd sketches and exact verification.

1. Each text becomes its set of distinct SHINGLE-word shingles (64-bit hashes). Texts with equal sets are one node: copies
   are pre-aggregated before anything else is shuffled, and need no pairs. A node's id is 64 bits of its set's digest; the
   other bits are compared, and should two sets ever share an id, the ids are drawn anew with another salt.
2. MinHash samples of a set (PERMUTATIONS) make BANDS bands of ROWS samples; nodes that share a band are candidates. At the
   threshold a pair shares none with probability (1 - 0.75**ROWS)**BANDS, 7 in a million.
3. Shingles that no other text has bound what two sets can share, and so do their sizes: pairs (and nodes) that these exact
   bounds rule out are never tested. The samples are folded into an odd sketch: each flips one of SKETCH bits. The bits in
   which two sketches differ estimate a high Jaccard similarity well; candidates below FLOOR (more than four standard
   deviations under the threshold) are dropped before sets are fetched.
4. The others are confirmed on the full sets. Components of the confirmed links are the groups.

No band is gathered. Two rounds by aggregations and joins bring the bulk of a band together, with as many tests as it has
members: first each member meets the band's least node; then members outside the band's largest component meet two nodes of
that. Members that came into one component need no further test. What is left are the members outside the largest component
("rest") of bands that still hold several. The rest meets all others in blocks of BLOCK members: a block of the largest
component with a block of the rest, or two blocks of the rest, never two of the largest. A task holds two blocks with their
sketches, and lists the pairs that the sketches can't exclude, each in its first shared band only. The full sets of the nodes
listed go to their blocks, which send on the links. So no link is lost to skew, no cap is set, and no pair is ever a row:
the rows that travel are the members, times the blocks that they meet.

Full sets are made only for nodes in a candidate pair, from the texts again: their keys go to all tasks while there are at
most BROADCAST_KEYS, else they are joined.

Defined results: a null text and a text without words have the empty set and link with nothing; texts of fewer than
SHINGLE words have one shingle, the whole sequence; a group's id is its least non-null key (null if all are null);
repeated rows are linked with each other; an empty table gives no row.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, mix, released, runs, slices, span_hash, utf8, word_spans
from .components import components
from .decontaminate import LOWER, _arrow

SHINGLE, THRESHOLD = 5, 75
BANDS, ROWS = 44, 5
#: The bands take the first samples; the sketches take all.
PERMUTATIONS = 720
SKETCH, FLOOR = 2048, 0.66
BLOCK, BLOCK_BYTES, BROADCAST_KEYS = 512, 32 << 20, 1_000_000
WORDS = SKETCH // 64
#: Rows that one step works on where it holds samples or sketches of each.
STEP = 1024

IS_WORD = np.ones(256, bool)
IS_WORD[[32, 9, 10, 11, 12, 13]] = False
_rng = np.random.default_rng(77)
_odd = lambda n: _rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE, _MULT, _SALT, _BAND = _odd(SHINGLE), _odd(PERMUTATIONS), _odd(PERMUTATIONS), _odd(ROWS)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and n + 1 offsets."""
    data = LOWER[data]
    starts, ends, first = word_spans(IS_WORD[data], offsets)
    words = span_hash(data, starts, ends)
    n_words = np.diff(first)
    sets = [np.zeros(0, np.uint64)] * len(n_words)
    rolled = np.zeros(max(0, len(words) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        rolled += words[k : len(words) - SHINGLE + 1 + k] * _PLACE[k] if len(rolled) else np.uint64(0)
    rolled = mix(rolled)
    for i, n in enumerate(n_words.tolist()):
        if n >= SHINGLE:
            sets[i] = np.unique(rolled[first[i] : first[i + 1] - SHINGLE + 1])
        elif n:
            sets[i] = mix(np.array([(words[first[i] : first[i + 1]] * _PLACE[:n]).sum(dtype=np.uint64) + np.uint64(n)], np.uint64))
    at = np.cumsum([0, *map(len, sets)])
    return (np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)), at


def samples(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """MinHash samples, a row for each non-empty set."""
    full = at[:-1][np.diff(at) > 0]
    out = np.empty((len(full), PERMUTATIONS), np.uint64)
    if len(full):
        for j in range(PERMUTATIONS):
            out[:, j] = np.minimum.reduceat((hashes ^ _SALT[j]) * _MULT[j], full)
    return out


def odd_sketches(sampled: np.ndarray) -> np.ndarray:
    """Parity bitmaps, as rows of 64-bit words."""
    bit = (mix(sampled + np.arange(PERMUTATIONS, dtype=np.uint64)) >> np.uint64(64 - (SKETCH - 1).bit_length())).astype(np.int64)
    flips = np.zeros((len(sampled), SKETCH), np.uint8)
    np.add.at(flips, (np.arange(len(sampled))[:, None], bit), 1)
    return np.packbits(flips & 1, axis=1, bitorder="little").view("<u8")


def most_bits(floor: float = FLOOR) -> int:
    """The number of differing sketch bits that stands for a similarity of floor: J = 1 + SKETCH / (4 k) * ln(1 - 2 bits / SKETCH)."""
    return int(SKETCH / 2 * (1 - np.exp(-4 * PERMUTATIONS * (1 - floor) / SKETCH)))


def _text_keys(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("second"), text).alias("t2")]


def can_link(n: Column, s: Column, m: Column, t: Column) -> Column:
    """Whether sets of n and m shingles, of which s and t are not theirs alone, can reach the threshold."""
    both = F.least(s, t)
    return 100 * both >= THRESHOLD * (n + m - both)


def listed(rows: np.ndarray) -> pa.Array:
    """Rows of one width as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.reshape(-1)))


def _node_ids(hashes: np.ndarray, at: np.ndarray, salt: int) -> np.ndarray:
    """128 bits of each non-empty set's digest, in two columns."""
    first = at[:-1][np.diff(at) > 0]
    seeds = (0x9E3779B97F4A7C15 + salt, 0x5851F42D4C957F2D)
    out = [mix(np.add.reduceat(mix(hashes ^ np.uint64(x)), first)) if len(first) else np.zeros(0, np.uint64) for x in seeds]
    return np.stack(out, 1).view(np.int64)


KEYS, NODES = 0, 1
CHUNK_BYTES, CHUNK_ROWS, BUCKET_BYTES = 1 << 20, 60_000, 6 << 20
SENT = "chunk long, kind int, bucket int, payload binary"


def shared_counts(docs: DataFrame, text: str, salt: int, shingles: int) -> DataFrame:
    """(node, s): how many of a node's shingles another text has too (or seems to have: 40 bits and the bucket are compared).

    Shingles travel as packed blocks, one for each bucket and chunk of texts; a bucket answers with a count for each text.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(1 << 23, max(4 * partitions, -(-7 * shingles // BUCKET_BYTES)))

    def send(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for a, z in slices(offsets, CHUNK_BYTES, CHUNK_ROWS):
                hashes, at = shingle_sets(data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a])
                ids = _node_ids(hashes, at, salt)[:, 0]
                nodes, one = np.unique(ids, return_index=True)  # copies within a chunk count once
                full = np.flatnonzero(np.diff(at))[one]
                sizes = np.diff(at)[full]
                index = np.repeat(np.arange(len(full)), sizes)
                keys = hashes[np.repeat(at[full] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(index))]
                bucket = ((keys & np.uint64(0xFFFFFF)) % np.uint64(buckets)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                parts = runs(bucket[by])
                index, high = index[by].astype("<u2"), np.ascontiguousarray(keys[by]).view(np.uint8).reshape(-1, 8)[:, 3:]
                rows = [(number, KEYS, b, index[c:d].tobytes() + high[c:d].tobytes()) for b, c, d in parts]
                rows.append((number, NODES, number % buckets, nodes.astype("<i8").tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["chunk", "kind", "bucket", "payload"])
                number += 1

    def answer(key, table):
        kinds, payloads = table.column("kind").to_pylist(), table.column("payload").to_pylist()
        sent = [i for i, k in enumerate(kinds) if k == KEYS]
        if sent:
            sizes = [len(payloads[i]) // 7 for i in sent]
            wide = np.zeros((sum(sizes), 8), np.uint8)
            at = 0
            for i, n in zip(sent, sizes):
                wide[at : at + n, :5] = np.frombuffer(payloads[i], np.uint8)[2 * n :].reshape(-1, 5)
                at += n
            keys = wide.view("<u8")[:, 0]
            by = np.argsort(keys, kind="stable")
            same = np.zeros(len(by) + 1, bool)
            same[1:-1] = keys[by][1:] == keys[by][:-1]
            shared = np.empty(len(by), bool)
            shared[by] = same[:-1] | same[1:]
            for i, part in zip(sent, np.split(shared, np.cumsum(sizes)[:-1])):
                index = np.frombuffer(payloads[i], "<u2")[: len(part)] if len(payloads[i]) % 2 == 0 else np.frombuffer(payloads[i][: 2 * len(part)], "<u2")
                payloads[i] = zlib.compress(np.bincount(index[part]).astype("<u4").tobytes(), 1)
        return pa.table({"chunk": table.column("chunk"), "kind": table.column("kind"), "bucket": table.column("bucket"), "payload": pa.array(payloads, pa.binary())})

    def add(key, table):
        kinds, payloads = table.column("kind").to_pylist(), table.column("payload").to_pylist()
        nodes = np.frombuffer(payloads[kinds.index(NODES)], "<i8")
        total = np.zeros(len(nodes), np.int64)
        for k, raw in zip(kinds, payloads):
            if k == KEYS:
                counts = np.frombuffer(zlib.decompress(raw), "<u4")
                total[: len(counts)] += counts
        return pa.table({"node": pa.array(nodes, pa.int64()), "s": pa.array(total, pa.int64())})

    sent = docs.select(F.col(f"`{text}`").alias("t")).mapInArrow(released(send), SENT)
    answered = sent.groupBy("bucket").applyInArrow(answer, SENT)
    return answered.groupBy("chunk").applyInArrow(add, "node long, s long").groupBy("node").agg(F.max("s").alias("s"))


def signatures(docs: DataFrame, key: str, text: str, salt: int = 0) -> DataFrame:
    """key, t1, t2 (of the text), n, node (null for the empty set), rest (of the digest), bands, sketch (WORDS of 64 bits)."""
    t = F.col(f"`{text}`")
    state = docs.select(F.col(f"`{key}`").alias("key"), *_text_keys(t), t.alias("t"))
    extra = T._parse_datatype_string("n long, node long, rest long, bands array<long>, sketch array<long>")
    schema = T.StructType([*state.schema.fields[:3], *extra.fields])
    arrow = _arrow(schema)

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(3))
            for lo, hi in slices(offsets, rows=STEP):
                hashes, at = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                n = np.diff(at)
                full = np.flatnonzero(n)
                sampled = samples(hashes, at)
                bands = mix((sampled[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS) * _BAND).sum(2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
                digest = _node_ids(hashes, at, salt)
                place = np.full(hi - lo, -1)
                place[full] = np.arange(len(full))
                nulls = pa.array(place, pa.int64(), mask=place < 0)
                values = [*(pa.array(d) for d in np.ascontiguousarray(digest.T)), listed(bands.view(np.int64)), listed(odd_sketches(sampled).view("<i8"))]
                columns = [*(c.slice(lo, hi - lo) for c in batch.columns[:3]), pa.array(n), *(v.take(nulls) for v in values)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return state.mapInArrow(released(run), schema)


def full_sets(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """(node, set): shingle hashes of the wanted (node, t1, t2), made from the texts."""
    t = F.col(f"`{text}`")
    if wanted.count() <= BROADCAST_KEYS:
        wanted = F.broadcast(wanted)
    rows = docs.select(*_text_keys(t), t.alias("t")).join(wanted, ["t1", "t2"]).select("node", "t").dropDuplicates(["node"])
    schema = "node long, set binary"

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for lo, hi in slices(offsets):
                hashes, at = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                sets = pa.array([hashes[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), sets], names=["node", "set"])

    return rows.mapInArrow(released(run), schema)


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose full sets reach the threshold."""
    left = sets.select(F.col("node").alias("u"), F.col("set").alias("a"))
    right = sets.select(F.col("node").alias("v"), F.col("set").alias("b"))
    # The pivot's side comes last: its keys are the hot ones, and that join can be split.
    rows = pairs.join(right, "v").join(left, "u").select("u", "v", "a", "b")

    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3)):
                keep.append(similar(a.as_buffer(), b.as_buffer()))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["u", "v"])

    return rows.mapInArrow(released(run), "u long, v long")


def nearest(links: DataFrame) -> DataFrame:
    """(node, comp): the least node that a link or two lead to. Nodes of one comp are in one component; a component may have several."""
    both = links.select(F.col("v").alias("node"), F.col("u").alias("comp")).unionAll(links.select(F.col("u").alias("node"), F.col("v").alias("comp")))
    least = both.groupBy("node").agg(F.least(F.min("comp"), F.col("node")).alias("comp"))
    via = least.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
    return least.join(via, "comp").select("node", F.col("further").alias("comp"))


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after further links between their components."""
    for c in ("u", "v"):
        links = links.join(labels.select(F.col("node").alias(c), F.col("comp").alias(f"{c}c")), c, "left").withColumn(f"{c}c", F.coalesce(f"{c}c", c))
    moved = nearest(links.where("uc <> vc").select(F.col("uc").alias("u"), F.col("vc").alias("v"))).select(F.col("node").alias("old"), F.col("comp").alias("new"))
    kept = labels.join(moved, labels.comp == moved.old, "left").select("node", F.coalesce("new", "comp").alias("comp"))
    fresh = moved.join(labels, labels.node == moved.old, "left_anti").select(F.col("old").alias("node"), F.col("new").alias("comp"))
    return kept.unionAll(fresh).distinct()


def in_blocks(state: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows (band, node, comp, ...) of bands with several components, for each pair of blocks (x, y) that a row is in: see rest_pairs."""
    sizes = state.groupBy("band", "comp").agg(F.count("*").alias("c"), F.sum(8 * F.col("n").cast("long")).alias("b"))
    bands = sizes.groupBy("band").agg(F.count("*").alias("comps"), F.sum("c").alias("c"), F.sum("b").alias("b"), F.max(F.struct("c", "comp", "b")).alias("top")).where("comps > 1")
    blocks = lambda c, b: F.greatest(F.ceil(c / BLOCK), F.ceil(b / BLOCK_BYTES)).cast("int")
    few = (F.col("c") <= BLOCK) & (F.col("b") <= BLOCK_BYTES)
    nl, nr = blocks(F.col("top.c"), F.col("top.b")), blocks(F.col("c") - F.col("top.c"), F.col("b") - F.col("top.b"))
    bands = bands.select("band", F.col("top.comp").alias("largest"), F.when(few, 1).otherwise(nl).alias("nl"), F.when(few, 1).otherwise(nr).alias("nr"))
    rows = state.join(scratch.keep(bands, "bands"), "band").withColumn("large", F.col("comp") == F.col("largest"))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("large"), F.col("nl")).otherwise(F.col("nr"))).cast("int")
    rows = rows.withColumn("own", own)
    pair = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own = F.col("own")
    large = F.transform(to("nr"), lambda y: pair(own, y))
    rest = F.concat(F.transform(to("nl"), lambda x: pair(x, own)), F.transform(F.filter(to("nr"), lambda y: y != own), lambda y: pair(-1 - F.greatest(y, own), F.least(y, own))))
    return rows.withColumn("at", F.explode(F.when(F.col("large"), large).otherwise(rest))).select(*state.columns, "large", "own", "at.x", "at.y")


def rest_pairs(group, x, large, own, comp, n, s, band, bands, sketch) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within groups (of equal band, x, y) that bounds and sketches can't exclude, each in the pair's first shared band only.

    x >= 0: block x of the largest component meets block y of the rest; there, x = 0 stands for the rest's own pairs in block y.
    x < 0: blocks -1 - x and y of the rest meet.
    """
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    i = np.arange(len(n))
    for d in range(1, len(n)):
        i = i[: np.searchsorted(i, len(n) - d)]
        i = i[group[i] == group[i + d]]
        if not len(i):
            break
        j = i + d
        meet = np.where(x[i] < 0, own[i] != own[j], large[i] | large[j] | (x[i] == 0))
        most = np.minimum(s[i], s[j])
        ok = meet & (comp[i] != comp[j]) & (100 * most >= THRESHOLD * (n[i] + n[j] - most))
        a, b = i[ok], j[ok]
        near = np.bitwise_count(sketch[a] ^ sketch[b]).sum(1, dtype=np.int64) <= most_bits()
        a, b = a[near], b[near]
        first = bands[a, (bands[a] == bands[b]).argmax(1)] == band[a]
        left.append(a[first])
        right.append(b[first])
    return np.concatenate(left), np.concatenate(right)


def by_group(batches):
    """Tables that end where a group (band, x, y) ends, from batches in this order."""
    wait = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if wait is None else pa.concat_tables([wait, table])
        keys = [table.column(c).to_numpy() for c in ("band", "x", "y")]
        last = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0))
        cut = int(last[-1]) + 1 if len(last) else 0  # the last group may go on in the next batch
        if cut:
            yield table.slice(0, cut).combine_chunks()
        wait = table.slice(cut).combine_chunks()
    if wait is not None and wait.num_rows:
        yield wait


CANDIDATES = "band long, x int, y int, node long, pairs binary"


def candidates(state: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """For each group (band, x, y) with pairs of different components that no bound or sketch excludes: a row for each of their nodes, and one with all those pairs."""
    rows = in_blocks(state, scratch).join(nodes.select("node", "bands", "sketch"), "node")
    rows = rows.select("band", "x", "y", "large", "own", "node", "comp", "n", "s", "bands", "sketch")
    rows = rows.repartition("band", "x", "y").sortWithinPartitions("band", "x", "y")

    def run(batches):
        for table in by_group(batches):
            get = lambda name: table.column(name).to_numpy()
            band, x, y, node = (get(c) for c in ("band", "x", "y", "node"))
            new = np.zeros(len(node), bool)
            for k in (band, x, y):
                new[1:] |= k[1:] != k[:-1]
            group = np.cumsum(new)
            bands, bits = (table.column(c).chunk(0).flatten().to_numpy().reshape(-1, w) for c, w in (("bands", BANDS), ("sketch", WORDS)))
            a, b = rest_pairs(group, x, get("large"), get("own"), get("comp"), get("n"), get("s"), band, bands, bits.view(np.uint64))
            by = np.argsort(group[a], kind="stable")
            a, b = a[by], b[by]
            out = []
            for _, lo, hi in runs(group[a]):
                pairs = np.stack([node[a[lo:hi]], node[b[lo:hi]]], 1)
                at = (int(band[a[lo]]), int(x[a[lo]]), int(y[a[lo]]))
                out += [(*at, i, None) for i in np.unique(pairs).tolist()]
                out.append((*at, None, pairs.astype("<i8").tobytes()))
            if out:
                types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["band", "x", "y", "node", "pairs"])

    return rows.mapInArrow(released(run), CANDIDATES)


def similar(a: bytes, b: bytes) -> bool:
    """Whether two sets (of sorted 64-bit hashes) reach the threshold."""
    union = np.frombuffer(b"".join((a, b)), np.uint64).copy()
    union.sort()
    both = np.count_nonzero(union[1:] == union[:-1])
    return 100 * both >= THRESHOLD * (len(union) - both)


def confirmed_in_groups(listed: DataFrame, sets: DataFrame) -> DataFrame:
    """The links (u, v) that tie together what the candidates' pairs tie: a pair that its group's links already join needs no test."""
    nothing = F.lit(None).cast("binary")
    rows = listed.where("node is not null").join(sets, "node").select("band", "x", "y", "node", "set", nothing.alias("pairs"))
    rows = rows.unionAll(listed.where("node is null").select("band", "x", "y", "node", nothing.alias("set"), "pairs"))
    rows = rows.repartition("band", "x", "y").sortWithinPartitions("band", "x", "y", F.col("node").asc_nulls_last())

    def run(batches):
        group, own, root = None, {}, {}

        def find(i):
            while root.get(i, i) != i:
                i = root[i]
            return i

        for batch in batches:
            out = []
            for band, x, y, node, found, pairs in zip(*batch.columns):
                at = (band.as_py(), x.as_py(), y.as_py())
                if at != group:
                    group, own, root = at, {}, {}
                if pairs.as_py() is None:
                    own[node.as_py()] = found.as_py()
                    continue
                for u, v in np.frombuffer(pairs.as_py(), "<i8").reshape(-1, 2).tolist():
                    a, b = find(u), find(v)
                    if a != b and similar(own[u], own[v]):
                        root[max(a, b)] = min(a, b)
                        out.append((min(u, v), max(u, v)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["u", "v"])

    return rows.mapInArrow(released(run), "u long, v long")


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """(key, t1, t2, n, node, comp, group) of every row: group is the least key of the row's component comp (null for the empty set).

    Of the tables that it writes to scratch only the result stays.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    before = scratch.made
    salt = 0
    while True:
        sig = scratch.keep(signatures(docs, key, text, salt), "signatures")
        nodes = sig.where("n > 0").groupBy("node").agg(*[F.first(c).alias(c) for c in ("t1", "t2", "n", "bands", "sketch")], (F.min("rest") < F.max("rest")).alias("clash"))
        nodes = scratch.keep(nodes, "nodes")
        if nodes.where("clash").isEmpty():
            break
        salt += 1
    shingles = nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bounds = scratch.keep(shared_counts(docs, text, salt, shingles), "bounds")
    size = ["n", "s"]
    # A node with too many shingles of its own can have no link, and isn't banded.
    members = nodes.select("node", "n", "bands").join(bounds, "node").where(100 * F.col("s") >= THRESHOLD * F.col("n"))
    members = members.select("node", *[F.col(c).cast("int") for c in size], F.explode("bands").alias("band"))
    members = scratch.keep(members, "members")
    hubs = members.groupBy("band").agg(F.count("*").alias("c"), F.min(F.struct("node", *size)).alias("p")).where("c > 1")
    # What is known of each band is a table of its own, so that a join with it can split a hot band.
    hubs = scratch.keep(hubs.select("band", F.col("p.node").alias("p"), F.col("p.n").alias("pn"), F.col("p.s").alias("ps")), "hubs")
    # The hub of a band meets all its members here, and needs no further place in it.
    active = scratch.keep(members.join(hubs, "band").where("node <> p"), "active")
    small = nodes.select("node", "sketch")
    links = sets = labels = None

    def with_sets(asked: DataFrame) -> None:
        """Makes the sets of the nodes asked for, where there are none yet."""
        nonlocal sets
        if sets is not None:
            asked = asked.join(sets, "node", "left_anti")
        made = scratch.keep(full_sets(docs, text, scratch.keep(asked.join(nodes.select("node", "t1", "t2"), "node"), "asked")), "sets")
        sets = made if sets is None else sets.unionAll(made)

    def linked(found: DataFrame) -> None:
        nonlocal links, labels
        found = scratch.keep(found, "links")
        links = found if links is None else links.unionAll(found)
        labels = scratch.keep(nearest(found) if labels is None else merged(labels, found), "labels")

    def tested(pairs: DataFrame) -> None:
        pairs = scratch.keep(pairs, "pairs")
        if not pairs.isEmpty():
            with_sets(pairs.select(F.col("u").alias("node")).distinct().unionAll(pairs.select("v").distinct()).distinct())
            linked(confirmed(pairs, sets))

    def sketched(pairs: DataFrame) -> DataFrame:
        differ = F.aggregate(F.zip_with("a.sketch", "b.sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
        near = differ <= most_bits()
        return pairs.join(small.alias("b"), F.col("v") == F.col("b.node")).join(small.alias("a"), F.col("u") == F.col("a.node")).where(near).select("u", "v")

    def labelled() -> DataFrame:
        """The active rows with their component."""
        if labels is None:
            return active.withColumn("comp", F.col("node"))
        return active.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))

    def rounds() -> None:
        """Both rounds and the blocks; nothing more is done once no band holds several components."""
        nonlocal active
        if active.isEmpty():
            return
        linkable = can_link(F.col("n"), F.col("s"), F.col("pn"), F.col("ps"))
        tested(sketched(active.where(linkable).select(F.col("p").alias("u"), F.col("node").alias("v")).distinct()))
        active = active.select("band", "node", *size)
        # Members outside a band's largest component meet two of its nodes, which differ from band to band: a group of near
        # copies of which some missed the least node comes together here.
        state = scratch.keep(labelled(), "labelled")
        sizes = state.groupBy("band", "comp").agg(F.count("*").alias("c"))
        several = sizes.groupBy("band").agg(F.count("*").alias("comps"), F.max_by("comp", F.struct("c", "comp")).alias("pc")).where("comps > 1").select("band", "pc")
        several = scratch.keep(several, "several")
        if several.isEmpty():
            return
        state = scratch.keep(state.join(several, "band"), "state")
        active = state.select("band", "node", *size)
        spread = F.struct(F.xxhash64("node", "band").alias("h"), "node", *size)
        both = scratch.keep(state.where("comp = pc").groupBy("band").agg(F.array(F.min(spread), F.max(spread)).alias("r")), "pairs_of")
        tests = state.where("comp <> pc").join(both, "band").select("node", *size, F.explode("r").alias("r")).where(can_link(F.col("n"), F.col("s"), F.col("r.n"), F.col("r.s")))
        tested(sketched(tests.select(F.least("node", "r.node").alias("u"), F.greatest("node", "r.node").alias("v")).distinct()))
        listed = scratch.keep(candidates(scratch.keep(labelled(), "rest"), nodes, scratch), "candidates")
        if not listed.isEmpty():
            with_sets(listed.where("node is not null").select("node").distinct())
            linked(confirmed_in_groups(listed, sets))

    rounds()
    if links is not None:
        labels = components(links, scratch)
    least = sig.where("n > 0").groupBy("node").agg(F.min("key").alias("least"))
    if labels is not None:
        least = scratch.keep(least.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "least")
        by = scratch.keep(least.groupBy("comp").agg(F.min("least").alias("g")), "by")
        least = least.join(by, "comp").select("node", "comp", F.col("g").alias("least"))
    else:
        least = least.withColumn("comp", F.col("node"))
    out = sig.select("key", "t1", "t2", "n", "node").join(least, "node", "left")
    out = scratch.keep(out.select("key", "t1", "t2", "n", "node", "comp", F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("key")).alias("group")), "groups")
    scratch.drop(before, "groups")
    return out


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group, as it is: one of the group's id; among texts under that id the one of the least digest. Rows with the empty set are groups of their own."""
    scratch = Scratch(docs.sparkSession)
    found = groups(docs, key, text, scratch).where("n > 0").select("key", "t1", "t2", "comp", "group")
    is_id = F.col("key").eqNullSafe(F.col("group"))
    ids = found.where(is_id).groupBy("comp", "key", "t1", "t2").agg(F.count("*").alias("c"))
    best = ids.groupBy("comp").agg(F.min(F.struct("t1", "t2")).alias("w"))
    ids = scratch.keep(ids.join(best, "comp").withColumn("kept", F.struct("t1", "t2") == F.col("w")), "ids")
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    t = F.col(names[text])
    rows = rows.withColumn("x1", _text_keys(t)[0]).withColumn("x2", _text_keys(t)[1])

    def matched(some: DataFrame, how: str) -> DataFrame:
        some = some.select(F.col("key").alias("k"), F.col("t1").alias("y1"), F.col("t2").alias("y2")).distinct()
        small = some.count() <= BROADCAST_KEYS
        on = F.col(names[key]).eqNullSafe(F.col("k")) & (F.col("x1") == F.col("y1")) & (F.col("x2") == F.col("y2"))
        return rows.join(F.broadcast(some) if small else some, on, how)

    columns = ("key", "t1", "t2")
    again = ids.where("kept and c > 1").select(*columns)
    go = found.where(~is_id).select(*columns).unionAll(ids.where("not kept").select(*columns))
    once = matched(go.unionAll(again), "left_anti")
    if not again.isEmpty():  # repeated rows of the kept one: only these are moved
        once = once.unionAll(matched(again, "left_semi").dropDuplicates([names[key], "x1", "x2"]))
    return once.select(*[F.col(n).alias(c) for c, n in names.items()])
