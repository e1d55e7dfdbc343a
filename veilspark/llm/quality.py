"""Quality score by a byte-level convolutional network, in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. FILTERS learned filters of KERNEL bytes slide
over a chunk; each filter's greatest response in the chunk is kept (max-pooling, ReLU). Chunk vectors are combined by their
mean and their maximum over the document, and a linear layer with a logistic function gives one probability.

A filter's response is a sum of one weight for each of its bytes, so scoring reads tables of byte pairs. The network is
trained on the driver with Adam on a bounded sample: SAMPLE labelled texts of at most SAMPLE_CHARS characters, chosen by the
hash of their id; all texts are scored whole.

Defined results: null and empty texts are one chunk of padding and get that chunk's score; without usable labels the score
is 0.5; labels other than 0 and 1 are left out; a key that is labelled more than once takes its greatest label.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import slices, thinned, utf8

FILTERS, KERNEL, CHUNK, OVERLAP = 16, 6, 1024, 128
SAMPLE, SAMPLE_CHARS, EPOCHS, BATCH, RATE = 1500, 20_000, 12, 64, 0.02


def chunked(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunk rows of CHUNK + KERNEL - 1 bytes (0 is padding), and each document's first chunk (n + 1)."""
    sizes, step = np.diff(offsets), CHUNK - OVERLAP
    counts = np.maximum(1, -(-np.maximum(sizes - OVERLAP, 0) // step))
    first = np.concatenate([[0], np.cumsum(counts)])
    doc = np.repeat(np.arange(len(sizes)), counts)
    start = (np.arange(first[-1]) - first[doc]) * step
    place = start[:, None] + np.arange(CHUNK + KERNEL - 1)
    inside = (place < sizes[doc, None]) & (np.arange(CHUNK + KERNEL - 1) < CHUNK)
    if not len(data):
        return np.zeros(place.shape, np.uint8), first
    return np.where(inside, data[np.minimum(offsets[doc, None] + place, len(data) - 1)], 0).astype(np.uint8), first


class Network:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.filters = rng.normal(0, 0.2, (KERNEL, 256, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.shift = np.zeros(1, np.float32)

    def tables(self) -> list[np.ndarray]:
        """Responses to byte pairs, for each pair of places in a filter."""
        return [(self.filters[k][:, None, :] + self.filters[k + 1][None, :, :]).reshape(65536, FILTERS) for k in range(0, KERNEL, 2)]

    def pooled(self, chunks: np.ndarray, tables: list[np.ndarray], places: bool = False):
        """Max-pooled responses of each chunk, and where they stand."""
        pairs = chunks[:, :-1].astype(np.int32) * 256 + chunks[:, 1:]
        best = np.empty((len(chunks), FILTERS), np.float32)
        where = np.empty((len(chunks), FILTERS), np.int64)
        for lo in range(0, len(chunks), 32):
            p = pairs[lo : lo + 32]
            r = tables[0][p[:, :CHUNK]]
            for k, t in enumerate(tables[1:], 1):
                r += t[p[:, 2 * k : 2 * k + CHUNK]]
            if places:
                where[lo : lo + 32] = r.argmax(1)
            best[lo : lo + 32] = r.max(1)
        return best + self.bias, where

    def combined(self, hidden: np.ndarray, first: np.ndarray) -> np.ndarray:
        counts = np.diff(first)[:, None]
        return np.concatenate([np.add.reduceat(hidden, first[:-1]) / counts, np.maximum.reduceat(hidden, first[:-1])], 1)

    def score(self, chunks: np.ndarray, first: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        hidden = np.maximum(self.pooled(chunks, tables)[0], 0)
        z = self.combined(hidden, first) @ self.out + self.shift
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))

    def gradients(self, chunks: np.ndarray, first: np.ndarray, y: np.ndarray):
        """Of the mean logistic loss, in the order of parameters()."""
        raw, where = self.pooled(chunks, self.tables(), True)
        hidden = np.maximum(raw, 0)
        features = self.combined(hidden, first)
        p = 1 / (1 + np.exp(-np.clip(features @ self.out + self.shift, -30, 30)))
        g = (p - y) / len(y)
        counts = np.diff(first)
        doc = np.repeat(np.arange(len(y)), counts)
        back = g[:, None] * self.out
        top = hidden == features[doc, FILTERS:]
        share = top / np.add.reduceat(top.astype(np.float32), first[:-1])[doc]
        d_hidden = (back[doc, :FILTERS] / counts[doc, None] + back[doc, FILTERS:] * share) * (raw > 0)
        d_filters = np.zeros_like(self.filters)
        rows = np.arange(len(chunks))[:, None]
        for k in range(KERNEL):
            np.add.at(d_filters[k], (chunks[rows, where + k], np.arange(FILTERS)[None, :]), d_hidden)
        return [d_filters, d_hidden.sum(0), features.T @ g, np.array([g.sum()])]

    def parameters(self) -> list[np.ndarray]:
        return [self.filters, self.bias, self.out, self.shift]


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS) -> Network:
    net, rng = Network(), np.random.default_rng(11)
    if len(texts) < 2 or len(set(labels.tolist())) < 2:
        net.out[:] = 0
        return net
    docs = [chunked(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(docs))
        rate = RATE * (1 - epoch / epochs)
        for lo in range(0, len(order), BATCH):
            rows = order[lo : lo + BATCH]
            chunks = np.concatenate([docs[i] for i in rows])
            first = np.concatenate([[0], np.cumsum([len(docs[i]) for i in rows])])
            step += 1
            for p, (m, v), g in zip(net.parameters(), state, net.gradients(chunks, first, labels[rows])):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Network:
    """The network for P(label = 1), from the bounded sample of labelled docs."""
    usable = labels.select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").alias("y")).where(F.col("k").isNotNull() & F.col("y").isin(0, 1))
    usable = usable.groupBy("k").agg(F.max("y").alias("y"))
    # Ids are chosen by hash before any text is touched; twice the sample, as some texts are long or null.
    chosen = thinned(usable, F.col("k"), 2 * SAMPLE, usable.count())
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).where(F.length("t") <= SAMPLE_CHARS)
    rows = rows.join(F.broadcast(chosen), "k").groupBy("k").agg(F.first("y").alias("y"), F.min("t").alias("t")).collect()
    rows = sorted(rows, key=lambda r: zlib.crc32(str(r["k"]).encode()))[:SAMPLE]
    return fit([r["t"].encode() for r in rows], np.array([r["y"] for r in rows], np.float32))


def score(docs: DataFrame, network: Network, text: str = "text") -> DataFrame:
    """docs' columns but the text under ``doc``, and score."""
    frozen = docs.sparkSession.sparkContext.broadcast(network)  # of fixed size
    names = [c for c in docs.columns if c != text]

    @arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        net = frozen.value
        tables = net.tables()
        data, offsets = utf8(texts)
        out = np.empty(len(texts))
        for lo, hi in slices(offsets):
            out[lo:hi] = net.score(*chunked(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]), tables)
        return pa.array(out)

    return docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), run.asNondeterministic()(F.col(f"`{text}`")).alias("score"))
