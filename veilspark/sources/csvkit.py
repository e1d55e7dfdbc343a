"""Delimited text as it comes: sniffed delimiter, quoting rules of spreadsheets, ragged rows.

``read_clean`` uses Spark's CSV reader and splits large files; ``parse`` applies the exact rules to texts in a column, for
files that don't follow them: a quote opens only an empty field, doubled quotes are one, every bare carriage return outside
quotes is dropped, a blank line is a row of one empty field, an unterminated quote runs to the end.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.layouts import DELIMITERS, csv_line


def sniff(text: str) -> str:
    """layouts.sniff_delimiter on one string."""
    lines = [x for x in re.split(r"\r?\n", text[:20_000])[:10] if x]
    if not lines:
        return ","

    def score(d: str) -> int:
        counts = [x.count(d) for x in lines]
        return min(counts) * (10 if min(counts) == max(counts) else 1)

    return max(DELIMITERS, key=score)


_CELL: dict[str, re.Pattern] = {}


def _cell(delimiter: str) -> re.Pattern:
    """A field's quoted opening (after any carriage returns), or a run of plain text, or what ends the field."""
    if delimiter not in _CELL:
        d = re.escape(delimiter)
        _CELL[delimiter] = re.compile(rf'(?P<quoted>"(?P<inner>(?:[^"]|"")*)(?:"|\Z))|(?P<plain>[^{d}\r\n"]+|")|(?P<end>{d}|\n)|\r')
    return _CELL[delimiter]


def rows_of(text: str | None, delimiter: str | None = None) -> list[list[str]]:
    """All rows of a text. The delimiter is sniffed, with any byte order mark still there, unless given."""
    if not text:
        return []
    d = delimiter or sniff(text)
    text = text.removeprefix("﻿")
    pattern, rows, row, field, at = _cell(d), [], [], "", 0
    while at < len(text):
        m = pattern.match(text, at)
        if m["quoted"] is not None and field == "":
            field += m["inner"].replace('""', '"')
            at = m.end()
        elif m["quoted"] is not None:  # a quote inside a field is a plain character
            field += '"'
            at += 1
        else:
            at = m.end()
            if m["plain"] is not None:
                field += m["plain"]
            elif m["end"] is not None:
                row.append(field)
                field = ""
                if m["end"] == "\n":
                    rows.append(row)
                    row = []
    if field or row:
        rows.append([*row, field])
    return rows


def parse(text: Column, delimiter: str | None = None) -> Column:
    """Array of rows, each an array of fields."""

    @pandas_udf("array<array<string>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: rows_of(t, delimiter))

    return run(text)


def read_texts(files: DataFrame, path: str = "path", text: str = "value", delimiter: str | None = None) -> DataFrame:
    """One row a record: path, _row (from 0, header excluded), header, fields (padded or cut to the header's width)."""
    all_rows = files.select(F.col(path).alias("path"), parse(F.col(text), delimiter).alias("rows")).where(F.size("rows") > 0)
    header = F.element_at("rows", 1)
    each = all_rows.select("path", header.alias("header"), F.posexplode(F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(1)))).alias("_row", "f"))
    width = F.sequence(F.lit(0), F.size("header") - 1)
    return each.select("path", F.col("_row").cast("long"), "header", F.transform(width, lambda i: F.coalesce(F.get("f", i), F.lit(""))).alias("fields"))


def read_clean(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """Well-formed files with a header line, all columns strings, null as the empty string; Spark splits and prunes."""
    df = spark.read.csv(path, sep=delimiter, header=True, inferSchema=False, multiLine=False, quote='"', escape='"')
    return df.fillna("")


def to_lines(df: DataFrame, delimiter: str = ",", order: str | None = None) -> DataFrame:
    """One column ``line``; with an order column its rows come sorted and that column isn't written."""
    columns = [c for c in df.columns if c != order]
    out = df.orderBy(order) if order else df
    return out.select(csv_line([F.col(f"`{c}`") for c in columns], delimiter).alias("line"))


def write(df: DataFrame, path: str, delimiter: str = ",", order: str | None = None) -> None:
    """Text files with CRLF line ends, each with the header line."""
    columns = [c for c in df.columns if c != order]
    lines = to_lines(df, delimiter, order)
    header = df.sparkSession.range(1).select(csv_line([F.lit(c) for c in columns], delimiter).alias("line"))
    header.coalesce(1).unionByName(lines).write.text(path, lineSep="\r\n")
