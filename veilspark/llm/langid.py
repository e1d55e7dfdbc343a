"""Language identification by prediction by partial matching (PPM) over bytes.

For each language a context tree of variable order, up to ORDER bytes, is counted on labelled texts and then frozen. The
probability of a byte is that of the longest known context; a byte the context hasn't seen costs an escape (method C:
distinct successors against all) and goes on in the context one byte shorter, with the bytes already ruled out excluded,
so that every context's distribution sums to 1. Below the empty context all 256 bytes are equally likely. A text's score
under a language is its exact code length in bits; the shortest wins, and ``score`` is that language's posterior under
equal priors.

As the statistics are frozen, the code length of a byte that some language's context has seen is a table entry with a column
for each language, and the escape from a context is another; both tables are sorted and hold only what occurs, so they are
never larger than the sample. A text is scored by lookups, longest contexts first; what a context hasn't seen goes on below it.

The model learns from a bounded sample: of each language PER_LANGUAGE different texts of at most SAMPLE_CHARS characters (all,
if it has fewer), chosen by their hash. A language that has only longer texts is learned from those, whole, up to
PER_LANGUAGE * SAMPLE_CHARS characters or one text. All texts are scored whole.

Defined results: null texts and texts without a letter are ``und`` with score 0; ties go to the language first in
order; without any labelled text every row is ``und``; rows keep their multiplicity.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import slices, thinned, utf8

ORDER = 3
#: Bytes of text that are scored at once.
STEP = 1 << 18
PER_LANGUAGE, SAMPLE_CHARS = 400, 20_000
LETTER = regex.compile(r"\p{L}")
ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[65:91] = ASCII_LETTER[97:123] = True


class Places:
    """Where keys stand in an array of distinct ones: open addressing, half full at most."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(4, (2 * len(keys)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        waiting, at = np.arange(len(keys)), self._first(keys)
        while len(waiting):
            free = self.slots[at] < 0
            self.slots[at[free]] = waiting[free]  # where several want a slot, the last one has it
            lost = self.slots[at] != waiting
            waiting, at = waiting[lost], (at[lost] + 1) & (len(self.slots) - 1)

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places, -1 for what isn't there."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.keys):
            return out
        at = self._first(keys)
        found = self.slots[at].astype(np.int64)
        waiting = np.flatnonzero(found >= 0)
        at, found = at[waiting], found[waiting]
        while len(waiting):
            hit = self.keys[found] == keys[waiting]
            out[waiting[hit]] = found[hit]
            waiting, at = waiting[~hit], (at[~hit] + 1) & (len(self.slots) - 1)
            found = self.slots[at].astype(np.int64)
            on = found >= 0
            waiting, at, found = waiting[on], at[on], found[on]
        return out


class Order:
    """Contexts of one length. A gram is a context's code times the number of symbols, plus a symbol."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, size: int, shorter: "Order | None", order: int):
        """counts: a column for each language."""
        self.grams = grams
        self.contexts, of = np.unique(grams // size, return_inverse=True)
        if shorter is None:
            below = np.full(counts.shape, 1 / 256)
        else:  # the context without its first byte, with the same symbol: it occurs wherever the longer one does
            below = shorter.p[np.searchsorted(shorter.grams, grams % size**order)]
        start = np.flatnonzero(np.diff(of, prepend=-1)) if len(of) else np.zeros(0, np.int64)

        def per_context(values: np.ndarray) -> np.ndarray:
            return np.add.reduceat(values, start, axis=0) if len(start) else np.zeros((0, counts.shape[1]))

        seen = counts > 0
        total, distinct = per_context(counts.astype(np.float64)), per_context(seen.astype(np.float64))
        left = 1 - per_context(below * seen)  # what the shorter context gives to the symbols that this one hasn't seen
        left[left < 1e-12] = 0
        with np.errstate(divide="ignore", invalid="ignore"):
            factor = np.where(total > 0, np.where(left > 0, distinct / (total + distinct) / left, 0), 1)
            known = counts / (total + np.where(left > 0, distinct, 0))[of]
            self.p = np.where(total[of] > 0, np.where(seen, known, factor[of] * below), below)
            self.cost, self.escape = (-np.log2(np.maximum(x, 1e-300)).astype(np.float32) for x in (self.p, factor))


class Model:
    """Frozen code lengths. symbols: byte -> symbol (the last one stands for every byte never seen)."""

    def __init__(self, samples: dict[str, list[bytes]]):
        self.languages = sorted(samples)
        joined = {lang: [np.frombuffer(t, np.uint8) for t in texts if t] for lang, texts in samples.items()}
        seen = np.zeros(256, bool)
        for t in (t for texts in joined.values() for t in texts):
            seen[t] = True
        self.size = int(seen.sum()) + 1
        self.symbols = np.full(256, self.size - 1, np.int64)
        self.symbols[seen] = np.arange(self.size - 1)
        self.orders: list[Order] = []
        for order in range(ORDER + 1):
            found = [self._grams(joined[lang], order) for lang in self.languages]
            if not found:
                break
            grams = np.unique(np.concatenate([g for g, _ in found]))
            counts = np.zeros((len(grams), len(found)), np.int64)
            for j, (g, n) in enumerate(found):
                counts[np.searchsorted(grams, g), j] = n
            self.orders.append(Order(grams, counts, self.size, self.orders[-1] if order else None, order))
        for o in self.orders:
            o.grams_at, o.contexts_at = Places(o.grams), Places(o.contexts)
            del o.p, o.grams, o.contexts

    def _grams(self, texts: list[np.ndarray], order: int) -> tuple[np.ndarray, np.ndarray]:
        codes = [np.zeros(0, np.int64)]
        for t in texts:
            x = self.symbols[t]
            if len(x) > order:
                codes.append(sum(x[k : len(x) - order + k] * self.size ** (order - k) for k in range(order + 1)))
        return np.unique(np.concatenate(codes), return_counts=True)

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each document under each language. A document's first bytes stand in contexts as short as what precedes them."""
        n, langs = len(offsets) - 1, len(self.languages)
        if not len(data) or not langs:
            return np.zeros((n, langs))
        x = self.symbols[data]
        before = np.arange(len(x)) - np.repeat(offsets[:-1], np.diff(offsets))
        bits = np.zeros((len(x), langs), np.float32)
        waiting = np.arange(len(x))
        for o in range(ORDER, -1, -1):
            table = self.orders[o]
            long = before[waiting] >= o
            at = waiting[long]
            context = np.zeros(len(at), np.int64)
            for k in range(1, o + 1):
                context += x[at - k] * self.size ** (k - 1)
            found = table.grams_at.find(context * self.size + x[at])
            hit = found >= 0
            bits[at[hit]] += table.cost[found[hit]]
            missed = at[~hit]
            inside = table.contexts_at.find(context[~hit])
            known = inside >= 0
            bits[missed[known]] += table.escape[inside[known]]
            waiting = np.sort(np.concatenate([waiting[~long], missed]))
        bits[waiting] += 8  # bytes that no language has
        full = np.flatnonzero(np.diff(offsets))
        out = np.zeros((n, langs))
        out[full] = np.add.reduceat(bits, offsets[full], axis=0, dtype=np.float64)
        return out

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the best language and its posterior."""
        bits = self.code_lengths(data, offsets)
        best = bits.argmin(1)
        gap = bits - bits.min(1, keepdims=True)
        return best, 1 / np.exp2(-np.minimum(gap, 1000)).sum(1)


def train(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Counts the context trees on the bounded sample."""
    rows = labelled.select(F.col(f"`{text}`").alias("t"), F.col(f"`{lang}`").alias("l")).where("t is not null and l is not null")
    rows = rows.where("t <> ''").select("l", "t", F.sha2("t", 256).alias("d"), F.length("t").alias("n"))
    each = rows.groupBy("l", "d").agg(F.first("n").alias("n"))  # a text counts once a language, however often it is repeated
    short = F.col("n") <= SAMPLE_CHARS
    counts = {r["l"]: (r["short"], r["all"]) for r in each.groupBy("l").agg(F.count_if(short).alias("short"), F.count("*").alias("all")).collect()}
    if not counts:
        return Model({})
    usable = short | F.col("l").isin([name for name, (n, _) in counts.items() if not n])
    left = {name: n or all_ for name, (n, all_) in counts.items()}
    # Chosen by hash, so that no task ranks a language's texts; some more than asked for, then exactly that many.
    picked, most = [], PER_LANGUAGE + PER_LANGUAGE // 2
    while left:
        total = F.element_at(F.create_map(*[F.lit(x) for pair in left.items() for x in pair]), F.col("l"))
        drawn: dict[str, list[tuple]] = {}
        for r in thinned(each.where(usable & F.col("l").isin(list(left))), F.col("d"), most, total).collect():
            drawn.setdefault(r["l"], []).append((r["d"], r["n"]))
        for name, texts in drawn.items():
            if len(texts) >= min(PER_LANGUAGE, left[name]):
                del left[name]
                room = PER_LANGUAGE * SAMPLE_CHARS
                for i, (digest, n) in enumerate(sorted(texts)[:PER_LANGUAGE]):
                    room -= n
                    if room >= 0 or not i:  # only texts over SAMPLE_CHARS can fill it
                        picked.append((name, digest))
        most *= 4  # redrawn at a higher rate
    wanted = F.broadcast(labelled.sparkSession.createDataFrame(picked, "l string, d string"))
    samples: dict[str, list[bytes]] = {}
    for r in sorted(rows.join(wanted, ["l", "d"]).groupBy("l", "d").agg(F.first("t").alias("t")).collect(), key=lambda r: (r["l"], r["d"])):
        samples.setdefault(r["l"], []).append(r["t"].encode())
    return Model(samples)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs' columns under ``doc`` (a struct), and lang_pred, score. Only texts go to Python, and only results come back."""
    frozen = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample that it was counted on

    @arrow_udf("struct<lang_pred:string,score:double>")
    def run(texts: pa.Array) -> pa.Array:
        model = frozen.value
        names = np.array(model.languages, object)
        pred, score = np.full(len(texts), "und", object), np.zeros(len(texts))
        if len(names):
            data, offsets = utf8(texts)
            for lo, hi in slices(offsets, STEP):
                own, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                best, p = model.predict(own, at)
                pred[lo:hi], score[lo:hi] = names[best], p
                letters = np.concatenate([[0], np.cumsum(ASCII_LETTER[own])])
                for i in lo + np.flatnonzero(letters[at[1:]] == letters[at[:-1]]):
                    if not LETTER.search(texts[int(i)].as_py() or ""):
                        pred[i], score[i] = "und", 0
        return pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["lang_pred", "score"])

    found = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), run.asNondeterministic()(F.col(f"`{text}`")).alias("r"))
    return found.select("doc", "r.lang_pred", "r.score")


def keep_identified(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents that are in some learned language, as they are."""
    found = identify(docs, model, text).where(F.col("lang_pred") != "und")
    return found.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
