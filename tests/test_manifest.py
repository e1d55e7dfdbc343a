import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from veilspark.functions import digests
from veilspark.operators import manifest
from veilspark.sources import files, outputs, scrub, tables, zipfmt


def sri(content):
    return "sha384-" + base64.b64encode(hashlib.sha384(content).digest()).decode()


def test_integrity_is_written(spark):
    found = [("tool/a.js", b"one"), ("tool/b.css", b"two"), ("shell/s.css", b"three")]
    held = spark.createDataFrame([(p, bytearray(c)) for p, c in found], "path string, content binary")
    html = '<head><link rel="stylesheet" integrity="old" href="../shell/./s.css" media="x"><link href="b.css"/><script defer src="a.js" integrity="old"></script></head><a href="a.js">no</a>'
    pages = spark.createDataFrame([("tool/index.html", html), ("plain.html", "<p>none</p>"), ("null.html", None)], "path string, html string")
    out = {r.path: r for r in manifest.with_integrity(pages, held).collect()}
    assert out["plain.html"].html == "<p>none</p>" and out["null.html"].html is None and out["tool/index.html"].problems == []
    assert out["tool/index.html"].html == html.replace(' integrity="old"', "").replace('media="x"', f'media="x" integrity="{sri(b"three")}"').replace('href="b.css"', f'href="b.css" integrity="{sri(b"two")}"').replace('src="a.js"', f'src="a.js" integrity="{sri(b"one")}"')
    assert spark.range(1).select(digests.integrity(F.lit("one"))).first()[0] == sri(b"one")


@pytest.mark.parametrize("ref,said", [("https://x.y/z.js", "refers to another host"), ("//x.y/z.js", "refers to another host"), ("gone.js", "refers to no file")])
def test_releases_refuse_what_they_do_not_hold(spark, ref, said):
    held = spark.createDataFrame([("a.js", bytearray(b"one"))], "path string, content binary")
    pages = spark.createDataFrame([("i.html", f'<script src="{ref}"></script><script src="a.js"></script>')], "path string, html string")
    with pytest.raises(Exception, match=said):
        manifest.with_integrity(pages, held).collect()
    got = manifest.with_integrity(pages, held, strict=False).first()
    assert len(got.problems) == 1 and said in got.problems[0] and sri(b"one") in got.html and ref in got.html


def test_release_lists_each_file_once(spark, tmp_path):
    rows = [("t/index.html", 0), ("t/b.js", 1), ("t/a.js", 1), ("t/index.html", 1), ("t/a.js", 2), ("shell/z", 3), ("shell/b", 3)]
    listed = manifest.listing(spark.createDataFrame(rows, "path string, rank int"))
    assert [r.path for r in listed.orderBy("place").collect()] == ["t/index.html", "t/a.js", "t/b.js", "shell/b", "shell/z"]
    lines = manifest.release("t", "1.2", "today", listed.withColumn("sha256", F.sha2("path", 256)))
    outputs.write_lines(lines, str(tmp_path / "release.txt"), "\n")
    want = ["t 1.2", "Built today", "", "SHA-256 of the files of this release:", ""] + [f"{hashlib.sha256(p.encode()).hexdigest()}  {p}" for p in ("t/index.html", "t/a.js", "t/b.js", "shell/b", "shell/z")]
    assert (tmp_path / "release.txt").read_text() == "\n".join(want) + "\n"
    assert {p.name for p in tmp_path.iterdir()} <= {"release.txt", ".release.txt.crc"}
    again = manifest.parse(spark.read.text(str(tmp_path / "release.txt")))
    assert again.count() == 5


def test_key_and_mapping_files(spark, tmp_path):
    words = spark.createDataFrame([("b", "x", "B-10000", "X"), ("b", "y", "B-9999", 'Y "q"'), ("a", "z", "A-0001", "z, z")], "column string, norm string, token string, original string")
    outputs.write_lines(outputs.key_lines(words), str(tmp_path / "k.csv"))
    assert (tmp_path / "k.csv").read_bytes().decode() == 'column,token,original\r\na,A-0001,"z, z"\r\nb,B-9999,"Y ""q"""\r\nb,B-10000,X\r\n'
    rows = spark.createDataFrame([(2, "email", "EMAIL-2", 'b"'), (1, "email", "EMAIL-1", "a")], "i int, type string, token string, original string")
    outputs.write_lines(outputs.mapping_lines(rows, "i"), str(tmp_path / "m.csv"))
    assert (tmp_path / "m.csv").read_bytes().decode() == 'type,token,original\r\n"email","EMAIL-1","a"\r\n"email","EMAIL-2","b"""\r\n'
    names = spark.createDataFrame([("a.csv",), ("a.b.tar",), ("plain",), (".csv",)], "n string").select(outputs.named(F.col("n"), outputs.KEY)).collect()
    assert [r[0] for r in names] == ["a-key.csv", "a.b-key.csv", "plain-key.csv", "-key.csv"]


def test_files_and_archives(spark, tmp_path):
    jpeg = b"\xff\xd8\xff\xfe\0\5abc\xff\xda\0\2scan\xff\xd9"
    df = spark.createDataFrame([("/x/a.jpg", bytearray(jpeg), 1), ("/x/b.jpg", bytearray(b"junk"), 1), ("/y/c.jpeg", bytearray(jpeg), 2)], "path string, content binary, g int")
    copies = scrub.clean_copies(df)
    done = {r.name: (r.size, r.error) for r in outputs.write_mounted(copies, str(tmp_path)).collect()}
    assert done["a-clean.jpg"] == (12, None) and done["b-clean.jpg"][1] and (tmp_path / "c-clean.jpeg").read_bytes() == jpeg[:2] + jpeg[9:]
    archives = {r.g: zipfmt.entries(bytes(r.content)) for r in outputs.clean_archives(df, "g").collect()}
    assert {g: [e.name for e in x] for g, x in archives.items()} == {1: ["a-clean.jpg"], 2: ["c-clean.jpeg"]}
    assert outputs.write_mounted(spark.createDataFrame([("../x", bytearray(b""))], "name string, bytes binary"), str(tmp_path)).first().error


def test_table_functions(spark):
    tables.register(spark)
    archive = zipfmt.write([zipfmt.Item("a", b"1"), zipfmt.Item("b", b"22")])
    df = spark.createDataFrame([(1, bytearray(archive)), (2, bytearray(b"no")), (3, None)], "i int, c binary")
    rows = spark.sql("SELECT i, e.name, e.usize FROM {df}, LATERAL zip_entries(c) e", df=df).collect()
    assert sorted(map(tuple, rows)) == [(1, "a", 1), (1, "b", 2)]
    assert spark.sql("SELECT * FROM {df}, LATERAL image_parts(c) e", df=df).count() == 0


def test_receipts_and_violations(spark):
    rows = [("a", True, None), ("b", False, None), ("c", True, "bad"), ("d", None, None)]
    assert [r.name for r in manifest.finished(spark.createDataFrame(rows, "name string, done boolean, error string")).collect()] == ["a"]
    seen = spark.createDataFrame([("x", "u"), ("x", "u"), (None, "u"), ("?", "u"), ("x", None)], "directive string, blocked string")
    assert sorted(map(tuple, manifest.violations(seen).collect())) == [("?", "u"), ("x", ""), ("x", "u")]


def test_adler_of_long_contents(spark):
    import zlib

    df = spark.createDataFrame([("a" * 1_000_000,), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(files.adler32(F.col("t"))).collect()] == [zlib.adler32(b"a" * 1_000_000), 1, None]
