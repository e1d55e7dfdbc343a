"""Consistent pseudonyms for table columns, and the risk that the rest still singles people out."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checks import SPACE
from ..functions.digests import hmac_sha256

LENGTHS = (8, 16, 32, 64)
ROUNDS = 100_000


def slug(header: str | None, index: int) -> str:
    """Prefix of a column's tokens; columns without letters or digits are COLn."""
    s = re.sub("[^A-Z0-9]+", "-", (header or f"col{index + 1}").upper())
    s = s[1:] if s.startswith("-") else s
    return (s[:-1] if s.endswith("-") else s) or f"COL{index + 1}"


def slugs(headers: list[str]) -> list[str]:
    """One prefix a column; a prefix that is taken gets the column's number."""
    out: list[str] = []
    for i, h in enumerate(headers):
        s = slug(h, i)
        out.append(s if s not in out else f"{s}-{i + 1}")
    return out


def normalize(value: Column, fold: bool = True) -> Column:
    """Null is empty; folded: trimmed, white space in one space, lower case."""
    v = F.coalesce(value.cast("string"), F.lit(""))
    if not fold:
        return v
    inner = F.regexp_replace(v, f"{SPACE}+", " ")
    return F.lower(F.regexp_replace(inner, "^ | $", ""))


def derive_key(passphrase: str, salt: bytes = b"veilspark-pseudonyms-1", rounds: int = ROUNDS) -> bytes:
    """A 256-bit key by PBKDF2-HMAC-SHA256, once on the driver. The same passphrase and salt give the same pseudonyms."""
    if not passphrase:
        raise ValueError("a keyed hash needs a passphrase")
    return hashlib.pbkdf2_hmac("sha256", passphrase.encode(), salt, rounds, 32)


def keyed(df: DataFrame, columns: list[str], key: bytes, length: int = 16, fold: bool = True) -> DataFrame:
    """The columns replaced by keyed hashes of (column name, value): a projection, no shuffle, fit for streams. Empty values stay empty.

    The plan holds the key's padded forms as literals: keep its text (explain, event logs) private.
    """
    if length not in LENGTHS:
        raise ValueError(f"length is one of {LENGTHS}")
    if not columns:
        raise ValueError("no column to replace")
    out = {}
    for c in columns:
        norm = normalize(F.col(f"`{c}`"), fold)
        mac = hmac_sha256(key, F.concat(F.lit(c), F.lit("\0"), norm))
        out[c] = F.when(norm != "", F.substring(mac, 1, length)).otherwise(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")))
    return df.withColumns(out)


def dictionary(df: DataFrame, columns: list[str], order: str, fold: bool = True) -> DataFrame:
    """(column, norm, token, original): tokens numbered by first appearance in the order column.

    Values are made distinct with partial aggregation before anything is ranked, so only the dictionary is sorted, and it is
    numbered in two steps: ranges of the order column (a number or a time) by their counts, then rows within a range, by order
    and then by value. No task sees a whole column. Nothing runs before the result is asked for: the ranges' bounds are a table
    of one row.
    """
    if not columns:
        raise ValueError("no column to replace")
    names = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("raw")) for c in columns])
    cells = df.select(F.col(f"`{order}`").alias("o"), F.explode(names).alias("x")).select("o", "x.column", "x.raw", normalize(F.col("x.raw"), fold).alias("norm"))
    first = cells.where("norm <> ''").groupBy("column", "norm").agg(F.min(F.struct("o", "raw")).alias("f"))
    first = first.select("column", "norm", F.col("f.o").alias("o"), F.col("f.raw").alias("original"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = first.agg(F.percentile_approx("o", [i / n for i in range(1, n)] or [0.5], 10_000).alias("bounds")).select(F.lit(1).alias("all"), F.coalesce("bounds", F.array()).alias("bounds"))
    range_of = F.size(F.filter(F.array_distinct("bounds"), lambda b: F.col("o") > b))
    parts = first.withColumn("all", F.lit(1)).join(F.broadcast(bounds), "all").select("column", "norm", "o", "original", range_of.alias("p"))
    within = parts.withColumn("r", F.row_number().over(Window.partitionBy("column", "p").orderBy("o", "norm")))
    before = parts.groupBy("column", "p").count().withColumn("base", F.sum("count").over(Window.partitionBy("column").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)))
    prefix = F.create_map(*[F.lit(x) for pair in zip(columns, slugs(columns)) for x in pair])
    out = within.join(before.select("column", "p", F.coalesce("base", F.lit(0)).alias("base")), ["column", "p"])
    token = F.format_string("%s-%04d", F.element_at(prefix, F.col("column")), F.col("r") + F.col("base"))
    return out.select("column", "norm", token.alias("token"), "original")


def _row(df: DataFrame) -> DataFrame:
    """The columns as one struct, so that helper columns can't clash with them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def _columns(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[F.col("row").getField(c).alias(c) for c in names])


def tokens(df: DataFrame, columns: list[str], words: DataFrame, fold: bool = True) -> DataFrame:
    """The columns replaced by their tokens; a join a column (Spark broadcasts small dictionaries by itself)."""
    out = _row(df)
    for c in columns:
        cell = F.col("row").getField(c)
        own = words.where(F.col("column") == c).select(F.col("norm").alias("n"), F.col("token").alias("t"))
        out = out.withColumn("n", normalize(cell, fold)).join(own, "n", "left")
        out = out.select(F.col("row").withField(f"`{c}`", F.coalesce("t", cell.cast("string"), F.lit(""))).alias("row"))
    return _columns(out, df.columns)


def reidentify(df: DataFrame, column: str, words: DataFrame) -> DataFrame:
    """The column's tokens replaced by the originals; what is no token stays."""
    own = words.where(F.col("column") == column).select(F.col("token").alias("t"), F.col("original").alias("o"))
    cell = F.col("row").getField(column)
    out = _row(df).join(own, cell == F.col("t"), "left").select(F.col("row").withField(f"`{column}`", F.coalesce("o", cell)).alias("row"))
    return _columns(out, df.columns)


def class_sizes(df: DataFrame, quasi: list[str]) -> DataFrame:
    """Equivalence classes on the folded quasi-identifiers with their sizes."""
    return df.groupBy(*[normalize(F.col(f"`{c}`")).alias(c) for c in quasi]).agg(F.count("*").alias("n"))


def uniqueness(df: DataFrame, quasi: list[str]) -> DataFrame:
    """One row: rows, unique rows, their per cent (half up), and what is to be said of it. Two aggregations, the rows never meet."""
    sizes = class_sizes(df, quasi)
    out = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum((F.col("n") == 1).cast("long")), F.lit(0)).alias("n_unique"))
    percent = F.when(F.col("n_rows") > 0, F.floor(F.col("n_unique") * 100.0 / F.col("n_rows") + 0.5)).otherwise(0).cast("long")
    names = " + ".join(quasi)
    said = F.when(F.col("n_unique") > 0, F.concat_ws("", F.col("n_unique"), F.lit(" of "), F.col("n_rows"), F.lit(" rows ("), F.col("percent"), F.lit(f"%) are unique on {names}."))).otherwise(f"No row is unique on {names}.")
    return out.withColumn("percent", percent).withColumn("verdict", said)


def with_class_size(df: DataFrame, quasi: list[str], name: str = "class_size") -> DataFrame:
    """Each row with its class's size, by a join on counts (a window would bring a hot class into one task)."""
    class_of = F.struct(*[normalize(F.col(f"`{c}`")).alias(f"q{i}") for i, c in enumerate(quasi)])
    sizes = df.select(class_of.alias("class")).groupBy("class").agg(F.count("*").alias("n"))
    out = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), class_of.alias("class")).join(sizes, "class", "left")
    return out.select(*[F.col("row").getField(c).alias(c) for c in df.columns], F.col("n").alias(name))


def replaced(df: DataFrame, columns: list[str], fold: bool = True) -> DataFrame:
    """One row: distinct values replaced over all columns, columns, rows."""
    norm = [normalize(F.col(f"`{c}`"), fold) for c in columns]
    distinct = sum(F.count_distinct(F.when(n != "", n)) for n in norm)
    return df.agg(distinct.alias("n_replaced"), F.lit(len(columns)).cast("long").alias("n_columns"), F.count("*").alias("n_rows"))


def collisions(words: DataFrame) -> DataFrame:
    """Pseudonyms that stand for more than one value of a column; truncated hashes collide at scale."""
    return words.groupBy("column", "token").agg(F.count_distinct("norm").alias("n")).where("n > 1")
