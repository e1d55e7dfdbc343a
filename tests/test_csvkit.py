import pytest
from pyspark.sql import functions as F

from veilspark.functions.layouts import csv_line, sniff_delimiter
from veilspark.sources import csvkit

CASES = [
    ("a,b\n1,2\n", [["a", "b"], ["1", "2"]]),
    ("﻿a;b\r\n1;2", [["a", "b"], ["1", "2"]]),
    ('a\tb\n"x ""y"" z"\t2\n', [["a", "b"], ['x "y" z', "2"]]),
    ('a|b\n"l1\nl2"|2\n', [["a|b"], ["l1\nl2|2"]]),  # the line break hides the delimiter from the sniffer
    ('a,b\nx"y,z\n', [["a", "b"], ['x"y', "z"]]),
    ("a,b\n1\r,2\r\n", [["a", "b"], ["1", "2"]]),
    ("a,b\n\n1,2\n", [["a", "b"], [""], ["1", "2"]]),
    ('a,b\n"open,2\n', [["a", "b"], ["open,2\n"]]),
    ('a,b\n"q"tail,2\n', [["a", "b"], ["qtail", "2"]]),
    ("a,b\n1,2,3\n4\n", [["a", "b"], ["1", "2", "3"], ["4"]]),
    ("a,b\n1,", [["a", "b"], ["1", ""]]),
    ("", []),
    ('a,b\n"",""\n', [["a", "b"], ["", ""]]),
    ('a,b\n"""",x\n', [["a", "b"], ['"', "x"]]),
]


@pytest.mark.parametrize("text,want", CASES)
def test_rows(text, want):
    assert csvkit.rows_of(text) == want


def test_sniff_agrees(spark):
    texts = [t for t, _ in CASES if t] + ["a,b;c\n1,2;3\n", "plain", "a;b,c\n;\n", "\n\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", sniff_delimiter(F.col("t")).alias("d"))
    assert [r.d for r in df.collect()] == [csvkit.sniff(t) for t in texts]


def test_ragged_rows_take_the_header_width(spark):
    df = spark.createDataFrame([("f", "a,b\n1,2,3\n4\n")], "path string, value string")
    assert [r.fields for r in csvkit.read_texts(df).orderBy("_row").collect()] == [["1", "2"], ["4", ""]]


def test_quote(spark):
    values = ["plain", 'q"', "a,b", " lead", "trail ", "x\ny", "", None, " x"]
    got = spark.createDataFrame([(v,) for v in values], "v string").select(csv_line([F.col("v")])).collect()
    assert [r[0] for r in got] == ["plain", '"q"""', '"a,b"', '" lead"', '"trail "', '"x\ny"', "", "", '" x"']


def test_write_and_read(spark, tmp_path):
    df = spark.createDataFrame([(1, "x,y"), (2, "z")], "k int, v string")
    csvkit.write(df.coalesce(1), str(tmp_path / "out"))
    back = csvkit.read_clean(spark, str(tmp_path / "out"))
    assert sorted(tuple(r) for r in back.collect() if r["k"] != "k") == [("1", "x,y"), ("2", "z")]
