"""Streams: stateless redaction and keyed pseudonyms run unchanged on streaming DataFrames; files can be hashed as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.digests import ALGORITHMS, digests
from ..operators import pseudonym, redact


def read_files(spark: SparkSession, path: str, per_batch: int = 1000) -> DataFrame:
    """New files below a path, as rows with their content."""
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])
    return spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", per_batch).load(path)


def hashed(files: DataFrame, algorithms=ALGORITHMS) -> DataFrame:
    return files.select("path", "length", digests(F.col("content"), algorithms).alias("hashes"))


def redacted(texts: DataFrame, text: str, mode: str = "label", types=None, terms=()) -> DataFrame:
    """The text column redacted; no state, so late and repeated rows need no care."""
    spans = redact.detect(F.col(text), types, terms)
    return texts.withColumn("_spans", spans).withColumn(text, redact.apply(F.col(text), F.col("_spans"), mode)["text"]).drop("_spans")


def pseudonymized(rows: DataFrame, columns: list[str], key: bytes, length: int = 16) -> DataFrame:
    """Keyed hashes only: numbered tokens need all rows, and so no stream."""
    return pseudonym.keyed(rows, columns, key, length)


def counted(texts: DataFrame, text: str, time: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Finds by type and window; windows close when the watermark passes them."""
    each = texts.withWatermark(time, late).select(time, F.explode(redact.detect(F.col(text))).alias("s"))
    return each.groupBy(F.window(time, window), F.col("s.type").alias("type")).count()


def write(df: DataFrame, path: str, checkpoint: str, kind: str = "parquet"):
    """A file sink that loses and repeats nothing across restarts; runs over what is there, then stops."""
    return df.writeStream.format(kind).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
