"""Inspecting and cleaning files of all kinds, on a column of their contents."""

from __future__ import annotations

import re
import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.layouts import clean_name, document_text
from . import images, office, pdf
from .report import CLEANED, REPORT, FormatError, Options, Report
from .zipfmt import ZipError

_UNSUPPORTED = {
    "heic": "HEIC and HEIF images can't be read; a JPEG export can.",
    "unknown": "None of JPEG, PNG, WebP, PDF, DOCX, XLSX and PPTX.",
}
_INSPECT = {"jpeg": images.jpeg_inspect, "png": images.png_inspect, "webp": images.webp_inspect, "pdf": pdf.inspect, "zip": office.inspect}
_ERRORS = (FormatError, ZipError, struct.error, IndexError, ValueError)


def kind_of(b: bytes) -> str:
    """files.kind on one value."""
    for head, kind in ((b"\xff\xd8", "jpeg"), (b"\x89PNG", "png"), (b"%PDF", "pdf"), (b"PK", "zip")):
        if b.startswith(head):
            return kind
    if b[:4] == b"RIFF" and b[8:12] == b"WEBP":
        return "webp"
    return "heic" if len(b) > 12 and b[4:8] == b"ftyp" else "unknown"


def inspect_one(b: bytes) -> Report:
    kind = kind_of(b)
    if kind in _UNSUPPORTED:
        return Report(kind, notes=[_UNSUPPORTED[kind]], unsupported=True)
    try:
        return _INSPECT[kind](b)
    except _ERRORS as e:
        return Report(kind, notes=[f"Unreadable: {e}"], unsupported=True)


def cleaned(b: bytes, report: Report, options: Options) -> dict:
    """A copy without what was reported."""
    try:
        if report.kind == "jpeg":
            out, changes = images.jpeg_clean(b, report, options)
        elif report.kind == "png":
            out, changes = images.png_clean(b)
        elif report.kind == "webp":
            out, changes = images.webp_clean(b)
        elif report.kind == "pdf":
            out, changes = pdf.clean(b, report)
        elif report.kind in office.KINDS.values():
            out, changes = office.clean(b, options)
        else:
            raise FormatError("unsupported")
    except _ERRORS as e:
        return {"bytes": None, "changes": [], "error": str(e)}
    return {"bytes": out, "changes": changes, "error": None}


def clean_one(b: bytes, options: Options) -> dict:
    return cleaned(b, inspect_one(b), options)


def examine(content: Column, options: Options = Options()) -> Column:
    """Struct of report (REPORT) and cleaned (CLEANED): contents go to Python once for both. Null contents give null."""

    @pandas_udf(f"report struct<{_typed(REPORT)}>, cleaned struct<{_typed(CLEANED)}>")
    def run(contents: pd.Series) -> pd.DataFrame:
        rows = []
        for c in contents:
            report = inspect_one(bytes(c)) if c is not None else Report("unknown")
            rows.append((report.row(), cleaned(bytes(c), report, options) if c is not None else {"bytes": None, "changes": [], "error": "null"}))
        return pd.DataFrame(rows, columns=["report", "cleaned"])

    return F.when(content.isNotNull(), run(content))


def _typed(fields: str) -> str:
    """"a int, b long" as the inside of a struct type."""
    return re.sub(r"(^|, )(\w+) ", r"\1\2:", fields)


def inspect(content: Column) -> Column:
    """Struct of the fields of REPORT; null contents give null."""

    @pandas_udf(REPORT)
    def run(contents: pd.Series) -> pd.DataFrame:
        rows = [inspect_one(bytes(c)).row() if c is not None else Report("unknown").row() for c in contents]
        return pd.DataFrame(rows, columns=list(Report("").row()))

    return F.when(content.isNotNull(), run(content))


def clean(content: Column, options: Options = Options()) -> Column:
    """Struct of bytes, changes and error."""

    @pandas_udf(CLEANED)
    def run(contents: pd.Series) -> pd.DataFrame:
        empty = {"bytes": None, "changes": [], "error": "null"}
        return pd.DataFrame([clean_one(bytes(c), options) if c is not None else empty for c in contents], columns=["bytes", "changes", "error"])

    return run(content)


_PARTS = {"jpeg": images.jpeg_segments, "png": images.png_chunks, "webp": images.webp_chunks}


def parts_of(content: bytes | None) -> list[images.Part] | None:
    """The segments or chunks of an image; None if it can't be read."""
    try:
        return _PARTS[kind_of(bytes(content))](bytes(content))
    except (KeyError, TypeError, *_ERRORS):
        return None


def segments(content: Column) -> Column:
    """Array of the segments or chunks of an image: kind, start, end; null if it can't be read."""

    @pandas_udf("array<struct<kind:string,start:long,end:long>>")
    def run(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: None if (parts := parts_of(c)) is None else [{"kind": p.kind, "start": p.start, "end": p.end} for p in parts])

    return run(content)


def part_text(content: Column, name: str) -> Column:
    """A part of an archive as text; null if it isn't there."""

    @pandas_udf("string")
    def run(contents: pd.Series) -> pd.Series:
        def one(c):
            try:
                return office.part_of(bytes(c), name)
            except (TypeError, *_ERRORS):
                return None

        return contents.map(one)

    return run(content)


def docx_text(content: Column) -> Column:
    """Plain text of word-processing documents: unzipped in Python, made text on the JVM; null if there is no main part."""
    return document_text(part_text(content, "word/document.xml"))


def summary(report: Column, size: Column, cleaned: Column) -> Column:
    """Struct: removable items (sections but Kept), whether a location was found, bytes saved."""
    items = F.size(F.filter(report["findings"], lambda f: f["section"] != "Kept"))
    located = F.exists(report["findings"], lambda f: f["risky"])
    return F.struct(items.alias("items"), located.alias("located"), (size - F.octet_length(cleaned["bytes"])).alias("saved"))


def findings(df: DataFrame, path: str, report: str) -> DataFrame:
    """(path, idx, heading, section, name, value, risky): the heading is blank where it repeats the finding before."""
    all_ = F.col(f"{report}.findings")
    same = lambda f, i: F.when(i > 0, F.get(all_, i - 1)["section"]).eqNullSafe(f["section"])
    headed = F.transform(all_, lambda f, i: F.struct(F.when(same(f, i), "").otherwise(f["section"]).alias("heading"), f.alias("f")))
    each = df.select(path, F.posexplode(headed).alias("idx", "x"))
    return each.select(path, "idx", "x.heading", "x.f.*")


def clean_copies(files: DataFrame, options: Options = Options()) -> DataFrame:
    """(path, name, bytes, changes, error) for files with path and content."""
    name = clean_name(F.element_at(F.split("path", "/"), -1))
    return files.select("path", name.alias("name"), clean(F.col("content"), options).alias("c")).select("path", "name", "c.*")
