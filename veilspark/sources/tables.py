"""Table functions for SQL: the entries of archives, and the segments or chunks of images."""

from __future__ import annotations

import struct

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from . import scrub, zipfmt


@udtf(returnType=zipfmt.ENTRY)
class ZipEntries:
    """A row an entry; what is no archive has none."""

    def eval(self, content: bytes):
        try:
            listed = zipfmt.entries(bytes(content)) if content is not None else []
        except (zipfmt.ZipError, struct.error):
            return
        for e in listed:
            yield e.row()


@udtf(returnType="kind string, start long, end long")
class ImageParts:
    """A row a segment (JPEG) or chunk (PNG, WebP); what is no such image has none."""

    def eval(self, content: bytes):
        for p in scrub.parts_of(content) or []:
            yield p.kind, p.start, p.end


def register(spark: SparkSession) -> None:
    """Makes zip_entries and image_parts known to a session's SQL."""
    spark.udtf.register("zip_entries", ZipEntries)
    spark.udtf.register("image_parts", ImageParts)
