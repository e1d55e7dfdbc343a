"""Vocabularies, codes and training windows as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHORT, LONG = 120, 20_000


def characters(text: Column) -> Column:
    """The code points of a text."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def vocabulary(df: DataFrame, text: str) -> DataFrame:
    """(char, idx): the distinct characters of all texts in code point order. Characters are made distinct by text before the
    shuffle; the list is bounded by the character set, so numbering it in one task is."""
    chars = df.select(F.explode(F.array_distinct(characters(F.col(text)))).alias("char")).distinct()
    listed = chars.agg(F.array_sort(F.collect_list("char")).alias("all"))
    return listed.select(F.posexplode("all").alias("idx", "char")).select("char", F.col("idx").cast("int"))


def text_vocabulary(text: Column) -> Column:
    """The sorted distinct characters of one text."""
    return F.array_sort(F.array_distinct(characters(text)))


def encode(text: Column, vocab: Column) -> Column:
    """Indices in a vocabulary array; unknown characters are dropped."""
    at = F.transform(characters(text), lambda c: F.array_position(vocab, c).cast("int") - 1)
    return F.filter(at, lambda i: i >= 0)


def decode(ids: Column, vocab: Column) -> Column:
    return F.array_join(F.transform(ids, lambda i: F.element_at(vocab, i + 1)), "")


def windows(df: DataFrame, ids: str, context: int, keys: list[str]) -> DataFrame:
    """(keys, i, x, y): every run of context codes with the run one step on. Narrow: windows of a text stay in its task."""
    if context < 1:
        raise ValueError("the context needs at least one character")
    starts = F.when(F.size(ids) > context, F.sequence(F.lit(0), F.size(ids) - context - 1)).otherwise(F.array().cast("array<int>"))
    each = df.select(*keys, ids, F.explode(starts).alias("i"))
    return each.select(*keys, F.col("i").cast("long"), F.slice(ids, F.col("i") + 1, context).alias("x"), F.slice(ids, F.col("i") + 2, context).alias("y"))


def split_held_out(df: DataFrame, n: Column, share: float = 0.1, least: int = 20) -> DataFrame:
    """Adds held_out: the last windows of texts with at least so many. Neighbouring windows overlap, so the split shares context - 1 characters."""
    return df.withColumn("held_out", (n >= least) & (F.col("i") >= F.floor(n * (1 - share))))


def parameters(vocab: Column, context: Column, dim: Column) -> Column:
    """Number of weights of the model."""
    hidden = 2 * dim
    return vocab * dim + context * dim + 4 * dim * dim + dim * hidden + hidden + hidden * dim + dim + dim * vocab + vocab


def stats(text: Column, context: int = 8) -> Column:
    """Struct: characters, distinct, windows, loss of guessing at random, and a warning for very short or long texts."""
    n = F.length(text)
    distinct = F.size(F.array_distinct(characters(text)))
    warning = F.when((n > 0) & (n < SHORT), "very short").when(n > LONG, "long")
    return F.struct(n.cast("long").alias("n_chars"), distinct.cast("long").alias("n_distinct"), F.greatest(F.lit(0), n - context).cast("long").alias("n_windows"), F.when(distinct > 0, F.ln(distinct)).alias("guess_loss"), warning.alias("warning"))


def clamp(value: Column, low: float, high: float, default: float) -> Column:
    """A setting within its bounds; what is no number is the default."""
    return F.least(F.greatest(F.coalesce(F.nanvl(value, F.lit(None)), F.lit(default)), F.lit(low)), F.lit(high))
