"""Files as rows: contents, kinds by their first bytes, digests of files of any size."""

from __future__ import annotations

import hashlib
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.digests import ALGORITHMS, digest, digests

CHUNK = 8 << 20
CROSS_CHECK_BYTES = 64 << 20


def read(spark: SparkSession, path: str, pattern: str | None = None, recursive: bool = False) -> DataFrame:
    """path, modificationTime, length, content of every file; Spark's reader skips empty files (hash_streams does not)."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): each file whole."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def kind(content: Column) -> Column:
    """jpeg, png, webp, pdf, zip, heic or unknown, by the first bytes."""
    at = lambda start, raw: F.substring(content, start, len(raw)) == F.lit(raw)
    return (
        F.when(at(1, b"\xff\xd8"), "jpeg").when(at(1, b"\x89PNG"), "png").when(at(1, b"RIFF") & at(9, b"WEBP"), "webp").when(at(1, b"%PDF"), "pdf")
        .when(at(1, b"PK"), "zip").when((F.length(content) > 12) & at(5, b"ftyp"), "heic").otherwise("unknown")
    )


def office_kind(names: Column) -> Column:
    """docx, xlsx or pptx by the names of an archive's entries, else zip."""
    has = lambda prefix: F.exists(names, lambda n: F.startswith(n, F.lit(prefix)))
    return F.when(has("word/"), "docx").when(has("xl/"), "xlsx").when(has("ppt/"), "pptx").otherwise("zip")


def hash_files(files: DataFrame, algorithms=ALGORITHMS) -> DataFrame:
    """path, length, modificationTime, hashes (map), all digests from one scan of the content."""
    return files.select("path", "length", "modificationTime", digests(F.col("content"), algorithms).alias("hashes"))


def fold_blocks(blocks, algorithms=ALGORITHMS) -> dict[str, str]:
    """Digests of a stream of blocks: constant memory."""
    states = {a: hashlib.new(a) for a in algorithms}
    for block in blocks:
        for s in states.values():
            s.update(block)
    return {a: s.hexdigest() for a, s in states.items()}


def open_stream(path: str):
    """A file as a stream of bytes: a plain path or a file: URI from a mount, other URIs (hdfs, s3, gs ..) from their own file system."""
    if "://" not in path and not path.startswith("file:"):
        return open(path, "rb")
    from pyarrow import fs

    system, inside = fs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)
    return system.open_input_stream(inside)


def hash_streams(paths: DataFrame, path: str = "path", algorithms=ALGORITHMS) -> DataFrame:
    """(path, hashes, error) of files beyond the 2 GB that a value holds, read in blocks from where they are, never whole."""
    chosen = tuple(algorithms)

    def run(batches):
        for pdf in batches:
            rows = []
            for p in pdf["path"]:
                try:
                    with open_stream(p) as f:
                        rows.append((p, fold_blocks(iter(lambda: f.read(CHUNK), b""), chosen), None))
                except (OSError, ValueError) as e:
                    rows.append((p, {}, str(e)))
            yield pd.DataFrame(rows, columns=["path", "hashes", "error"])

    return paths.select(F.col(path).alias("path")).mapInPandas(run, "path string, hashes map<string,string>, error string")


def cross_check(content: Column) -> Column:
    """matched, MISMATCH or not run (beyond CROSS_CHECK_BYTES): the engine's SHA-256 against a second implementation."""

    @pandas_udf("string")
    def second(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: hashlib.sha256(c).hexdigest() if c is not None else None)

    small = F.when(F.octet_length(content) <= CROSS_CHECK_BYTES, content)
    again = second(small)
    return F.when(again.isNull(), "not run").when(again == digest(content, "sha256"), "matched").otherwise("MISMATCH")


def adler32(content: Column) -> Column:
    """Adler-32 of contents of any length."""

    @pandas_udf("long")
    def run(contents: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else zlib.adler32(c) for c in contents], dtype="Int64")

    return run(content.cast("binary"))
