"""What is handed out: names of files, tables as one file of lines, archives of clean copies."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.layouts import csv_line, quoted_line
from . import scrub, zipfmt
from .report import Options

#: What takes the place of a name's extension (fixed values).
PSEUDONYMIZED, KEY, MAPPING = "-pseudonymized.csv", "-key.csv", "-mapping.csv"


def named(name: Column, ending: str) -> Column:
    """The name with its extension replaced by an ending."""
    return F.concat(F.regexp_replace(name, r"\.[A-Za-z0-9_]+\z", ""), F.lit(ending))


def receipt_name(stamp: Column, kind: str = "txt") -> Column:
    return F.concat(F.lit("digest-receipt-"), stamp, F.lit(f".{kind}"))


def key_lines(words: DataFrame) -> DataFrame:
    """The key file of numbered tokens as (order, line), the header first: column, token, original."""
    head = words.sparkSession.range(1).select(F.struct(F.lit("").alias("column"), F.lit(0).alias("n"), F.lit("").alias("token")).alias("order"), F.lit("column,token,original").alias("line"))
    order = F.struct(F.col("column"), F.length("token").alias("n"), F.col("token"))
    return head.unionAll(words.select(order.alias("order"), csv_line([F.col(c) for c in ("column", "token", "original")]).alias("line")))


def mapping_lines(rows: DataFrame, order: str) -> DataFrame:
    """The mapping of a redaction as (order, line), the header first, every field quoted: type, token, original."""
    head = rows.sparkSession.range(1).select(F.lit(None).cast(rows.schema[order].dataType).alias("order"), F.lit("type,token,original").alias("line"))
    return head.unionAll(rows.select(F.col(order).alias("order"), quoted_line([F.col(c) for c in ("type", "token", "original")]).alias("line")))


def write_lines(lines: DataFrame, path: str, end: str = "\r\n") -> None:
    """One file of all lines by their order (null first), each closed by ``end``.

    Executors write ranges of the order beside the file; the driver's file system then streams them behind each other, so
    that no task and no memory holds the whole.
    """
    spark = lines.sparkSession
    parts = f"{path}.{uuid.uuid4().hex}.parts"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = lines.repartitionByRange(n, "order").sortWithinPartitions("order").select("line")
    sorted_.write.option("lineSep", end).text(parts)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(parts)
    fs = folder.getFileSystem(conf)
    try:
        out = fs.create(jvm.org.apache.hadoop.fs.Path(path), True)
        try:
            for status in sorted(fs.listStatus(folder), key=lambda s: s.getPath().getName()):
                if status.getPath().getName().startswith("part-"):
                    source = fs.open(status.getPath())
                    try:
                        jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
                    finally:
                        source.close()
        finally:
            out.close()
    finally:
        fs.delete(folder, True)


def write_mounted(files: DataFrame, folder: str, name: str = "name", content: str = "bytes") -> DataFrame:
    """(name, size, error): each content as a file of its name in a folder that all executors mount. A name with a folder in it is an error."""

    def run(batches):
        for pdf in batches:
            rows = []
            for n, c in zip(pdf["name"], pdf["content"]):
                try:
                    if c is None or not n or "/" in n or n in (".", ".."):
                        raise ValueError("no content, or no plain name")
                    with open(f"{folder}/{n}", "wb") as f:
                        rows.append((n, f.write(bytes(c)), None))
                except (OSError, ValueError) as e:
                    rows.append((n, None, str(e)))
            yield pd.DataFrame(rows, columns=["name", "size", "error"]).astype({"size": "Int64"})

    return files.select(F.col(name).alias("name"), F.col(content).cast("binary").alias("content")).mapInPandas(run, "name string, size long, error string")


def clean_archives(files: DataFrame, by: str, options: Options = Options()) -> DataFrame:
    """(by, content): an archive of the clean copies of each group of files (path, content), without those that can't be cleaned. A group must fit a task."""
    name = scrub.clean_name(F.element_at(F.split("path", "/"), -1))
    copies = files.select(by, name.alias("name"), scrub.clean(F.col("content"), options).alias("c")).where("c.error is null")
    return zipfmt.bundle(copies.select(by, "name", "c.bytes"), "name", "bytes", by)
