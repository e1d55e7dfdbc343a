import struct
import zlib

import pytest
from pyspark.sql import functions as F

from veilspark.sources import exif, files, images, pdf, scrub, zipfmt
from veilspark.sources.report import Options, Report


def segment(marker, data):
    return bytes([0xFF, marker]) + struct.pack(">H", len(data) + 2) + data


def chunk(kind, data):
    return struct.pack(">L", len(data)) + kind + data + struct.pack(">L", zlib.crc32(kind + data))


def tiff():
    """Big-endian: Make = Apple, Orientation = 6, and a GPS directory in the south west, below sea level."""
    ifd = struct.pack(">H", 3) + struct.pack(">HHLL", 0x010F, 2, 6, 50) + struct.pack(">HHLHH", 0x0112, 3, 1, 6, 0) + struct.pack(">HHLL", 0x8825, 4, 1, 56) + struct.pack(">L", 0)
    assert 8 + len(ifd) == 50
    gps = struct.pack(">H", 6) + struct.pack(">HHL4s", 1, 2, 2, b"S\0\0\0") + struct.pack(">HHLL", 2, 5, 3, 134) + struct.pack(">HHL4s", 3, 2, 2, b"W\0\0\0") + struct.pack(">HHLL", 4, 5, 3, 158)
    gps += struct.pack(">HHL4s", 5, 1, 1, b"\1\0\0\0") + struct.pack(">HHLL", 6, 5, 1, 182) + struct.pack(">L", 0)
    assert 56 + len(gps) == 134
    return b"MM\0*" + struct.pack(">L", 8) + ifd + b"Apple\0" + gps + struct.pack(">6L", 10, 1, 30, 1, 0, 1) + struct.pack(">6L", 20, 1, 0, 1, 36, 1) + struct.pack(">2L", 25, 2)


JPEG = b"\xff\xd8" + segment(0xE1, b"Exif\0\0" + tiff()) + segment(0xFE, b"hello") + segment(0xDB, b"quant") + segment(0xDA, b"") + b"scan\xff\xd9" + b"TRAIL"
PNG = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"x" * 13) + chunk(b"tEXt", b"Author\0Jane") + chunk(b"tIME", struct.pack(">H5B", 2026, 1, 2, 3, 4, 5)) + chunk(b"eXIf", tiff()) + chunk(b"IDAT", b"d" * 13) + chunk(b"IEND", b"")
XMP = b'<x:xmpmeta><rdf:Description xmp:CreatorTool="Tool"/><dc:creator><rdf:li>A</rdf:li><rdf:li>B</rdf:li></dc:creator></x:xmpmeta>'


def found(report):
    return {f["name"]: f["value"] for f in report.findings}


def test_jpeg():
    r = scrub.inspect_one(JPEG)
    f = found(r)
    assert f["Camera make"] == "Apple" and f["Comment"] == "hello" and "Data after end of image" in f and r.orientation == 6
    assert f["Location"] == "-10.500000, -20.010000 (latitude, longitude)" and f["Altitude"] == "12.5 m below sea level"
    c = scrub.clean_one(JPEG, Options())
    assert c["bytes"].endswith(b"\xff\xd9") and segment(0xDB, b"quant") in c["bytes"] and segment(0xDA, b"") in c["bytes"]
    assert set(found(scrub.inspect_one(c["bytes"]))) == {"Orientation"}
    assert scrub.clean_one(JPEG, Options(drop_trailer=False))["bytes"].endswith(b"TRAIL")


def test_minimal_exif():
    raw = exif.minimal(6)
    r = Report("jpeg")
    exif.inspect(raw[10:], r)
    assert len(raw) == 36 and r.orientation == 6


def test_png():
    r = scrub.inspect_one(PNG)
    assert found(r)["Author"] == "Jane" and found(r)["Last modified"] == "2026-01-02 03:04:05" and found(r)["Camera make"] == "Apple"
    c = scrub.clean_one(PNG, Options())
    assert len(c["bytes"]) == 8 + 25 + 25 + 12 and len(c["changes"]) == 3


def test_png_texts():
    body = chunk(b"zTXt", b"Key\0\0" + zlib.compress(b"packed")) + chunk(b"iTXt", b"XML:com.adobe.xmp\0\0\0\0\0" + XMP) + chunk(b"iTXt", b"Note\0\1\0en\0\0" + zlib.compress("é".encode())) + chunk(b"zTXt", b"Bad\0\0junk")
    f = found(scrub.inspect_one(PNG[:33] + body + PNG[33:]))
    assert f["Key (compressed)"] == "packed" and f["Creator tool"] == "Tool" and f["Creator"] == "A, B" and f["Note"] == "é" and f["Bad (compressed)"] == "(could not decompress)"


def test_webp():
    part = lambda kind, data: kind + struct.pack("<L", len(data)) + data + b"\0" * (len(data) % 2)
    body = part(b"VP8X", bytes([0x2C]) + b"\0" * 9) + part(b"ICCP", b"icc") + part(b"EXIF", tiff()) + part(b"XMP ", XMP)
    b = b"RIFF" + struct.pack("<L", len(body) + 4) + b"WEBP" + body
    f = found(scrub.inspect_one(b))
    assert f["Camera make"] == "Apple" and f["Creator tool"] == "Tool" and "ICC color profile" in f
    c = scrub.clean_one(b, Options())["bytes"]
    assert struct.unpack_from("<L", c, 4)[0] == len(c) - 8 and c[20] == 0x20 and b"EXIF" not in c and b"icc" in c


def a_pdf(filter_=b"", data=XMP, length=None):
    length = str(len(data)).encode() if length is None else length
    return b"%PDF-1.4\n1 0 obj << /Title (Secret) /Author (Jane \\(J\\) Doe) /CreationDate (D:20260101120000) >> endobj\n2 0 obj << /Type /Metadata " + filter_ + b"/Length " + length + b" >> stream\n" + data + b"\nendstream endobj"


def test_pdf():
    b = a_pdf()
    f = found(scrub.inspect_one(b))
    assert f["Author"] == "Jane (J) Doe" and f["Creation Date"] == "2026-01-01 12:00" and f["Creator tool"] == "Tool"
    c = scrub.clean_one(b, Options())["bytes"]
    assert len(c) == len(b) and b"/Author (" + b" " * 14 + b")" in c and XMP not in c
    packed = zlib.compress(XMP)
    b = a_pdf(b"/Filter /FlateDecode ", packed)
    assert found(scrub.inspect_one(b))["Creator tool"] == "Tool"
    c = scrub.clean_one(b, Options())["bytes"]
    at = c.index(b"stream\n") + 7
    assert len(c) == len(b) and zlib.decompress(c[at : at + len(packed)]).strip() == b""
    assert pdf.streams(a_pdf(length=b"12 0 R"))[0].length == len(XMP)
    assert scrub.clean_one(b + b" /Encrypt ", Options())["error"] == "encrypted PDF"
    assert pdf.decode(b"<FEFF00E9>") == "é" and pdf.decode(rb"(\101\n)") == "A\n"


def office_file():
    deflated = zlib.compressobj(wbits=-15)
    document = b'<w:p><w:ins w:author="Ann" w:initials="AN"/>Hi<w:tab/>you &amp;lt; me</w:p>'
    raw = deflated.compress(document) + deflated.flush()
    core = b"<cp:coreProperties><dc:creator>Ann &amp; Bob</dc:creator><cp:revision>7</cp:revision><dcterms:created x='y'>2026</dcterms:created></cp:coreProperties>"
    items = [
        zipfmt.Item("[Content_Types].xml", b'<Types><Override PartName="/docProps/custom.xml" ContentType="c"/><Default/></Types>'),
        zipfmt.Item("_rels/.rels", b'<Relationships><Relationship Type="http://x/custom-properties" Target="docProps/custom.xml"/><Relationship Type="doc"/></Relationships>'),
        zipfmt.Item("docProps/core.xml", core), zipfmt.Item("docProps/app.xml", b"<Properties><Company>ACME</Company><TotalTime>12</TotalTime><Application>W</Application></Properties>"),
        zipfmt.Item("docProps/custom.xml", b'<Properties><property fmtid="x" name="Case"><vt:lpwstr>42</vt:lpwstr></property></Properties>'),
        zipfmt.Item("word/document.xml", raw, method=8, crc=zlib.crc32(document), usize=len(document)), zipfmt.Item("word/media/é.png", b"pic", time=1, date=2),
    ]
    return zipfmt.write(items)


def test_office(spark):
    b = office_file()
    r = scrub.inspect_one(b)
    f = found(r)
    assert r.kind == "docx" and f["Author"] == "Ann (1 mention)" and f["Company"] == "ACME" and f["Case"] == "42" and f["Revision"] == "7" and r.authors == {"Ann": 1}
    assert {"section": "Properties", "name": "Author", "value": "Ann & Bob", "risky": False} in r.findings
    c = scrub.clean_one(b, Options(clear_dates=True))
    parts = {e.name: e.data() for e in zipfmt.entries(c["bytes"])}
    assert "docProps/custom.xml" not in parts and b"Ann" not in b"".join(parts.values()) and b"created" not in parts["docProps/core.xml"] and b"<cp:revision>1<" in parts["docProps/core.xml"]
    assert b"custom" not in parts["[Content_Types].xml"] + parts["_rels/.rels"] and parts["word/media/é.png"] == b"pic"
    df = spark.createDataFrame([(bytearray(b),), (bytearray(b"PK"),), (None,)], "c binary")
    assert [x[0] for x in df.select(scrub.docx_text(F.col("c"))).collect()] == ["Hi\tyou < me\n", None, None]


def test_office_rules():
    from veilspark.sources import office

    xml = """<?xml version="1.0"?><!-- <dc:title>no</dc:title> --><a:x dc:y='>'><dc:title>One <b>two</b></dc:title><dc:title/><cp:lastPrinted z="1">x</cp:lastPrinted>&amp;lt;</a:x>"""
    assert "".join(t.source for t in office.tags(xml)) == xml
    core = office.rules_for(office.CORE_PART, Options())
    assert office.rewritten(xml, core) == (xml.replace("One <b>two</b>", "").replace('<cp:lastPrinted z="1">x</cp:lastPrinted>', ""), 0)
    comments = '<authors><author>Ann</author><author> Bo </author></authors><comment authorId="0"/>'
    assert office.authors(comments) == ["Ann", "Bo"]
    assert office.rewritten(comments, office.rules_for("xl/comments1.xml", Options())) == (comments.replace("Ann", "Author").replace(" Bo ", "Author"), 2)
    slides = '<p:cmAuthor id="1" name="Ann" initials="AN" lastIdx="2"/>'
    assert office.rewritten(slides, office.rules_for("ppt/commentAuthors.xml", Options())) == ('<p:cmAuthor id="1" name="Author" initials="A" lastIdx="2"/>', 1)
    people = '<w15:person w15:author="Ann"><w15:presenceInfo w15:userId="S::a@b"/></w15:person>'
    assert office.rewritten(people, office.rules_for("word/people.xml", Options())) == (people.replace("Ann", "Author").replace("S::a@b", ""), 1)
    assert office.rules_for("word/document.xml", Options(anonymize_authors=False)) is None and office.rules_for("word/styles.xml", Options()) is None
    report = Report("docx")
    office._properties(report, "<P><Company>A&amp;B</Company><Company>C</Company><TotalTime>0</TotalTime><AppVersion>16</AppVersion></P>", office.APP, office.PROGRAM)
    assert [(f["section"], f["name"], f["value"]) for f in report.findings] == [("Properties", "Company", "A&B"), ("Kept", "App version", "16")]


def test_jpeg_stream_and_iptc():
    stuffed = b"\xff\xd8" + b"\xff\xff" + segment(0xFE, b"a") + b"\xff\xd0" + b"\xff" + segment(0xDA, b"") + b"scan"
    assert [(p.kind, stuffed[p.data : p.stop]) for p in images.jpeg_segments(stuffed)] == [("FFFE", b"a"), ("FFDA", b"")]
    assert images.jpeg_segments(b"\xff\xd8\xff\xff\xff") == []
    for bad in (b"\xff\xd8junk", b"\xff\xd8\xff\xe1", b"\x89PNG"):
        with pytest.raises(ValueError):
            images.jpeg_segments(bad)
    report = Report("jpeg")
    dataset = lambda n, value: b"\x1c\x02" + bytes([n]) + struct.pack(">H", len(value)) + value
    images.iptc(report, b"8BIM\x1c" + dataset(105, b"Head") + b"\0" + dataset(200, b"?") + dataset(90, "Köln".encode()) + b"\x1c\x02\x05")
    assert [(f["name"], f["value"]) for f in report.findings] == [("Headline", "Head"), ("City", "Köln")]


def test_examining_reads_once(spark):
    df = spark.createDataFrame([(1, bytearray(JPEG)), (2, bytearray(office_file())), (3, bytearray(b"GIF")), (4, None)], "i int, c binary")
    both = df.select("i", scrub.examine(F.col("c")).alias("x"), scrub.inspect(F.col("c")).alias("r"), scrub.clean(F.col("c")).alias("k")).orderBy("i").collect()
    assert all(r.x.report == r.r and r.x.cleaned == r.k for r in both[:3]) and both[3].x is None
    rows = scrub.findings(df.select("i", scrub.inspect(F.col("c")).alias("r")), "i", "r").where("i = 1").orderBy("idx").collect()
    assert [r.heading for r in rows] == [r.section if not k or rows[k - 1].section != r.section else "" for k, r in enumerate(rows)]


def test_unreadable(spark):
    cases = [b"", b"GIF89a", b"\xff\xd8\x00", b"PK\3\4", b"\0\0\0\x18ftypheic\0", b"%PDF", PNG[:20], JPEG[:25], None]
    df = spark.createDataFrame([(i, None if c is None else bytearray(c)) for i, c in enumerate(cases)], "i int, c binary")
    rows = df.select("i", scrub.inspect(F.col("c")).alias("r"), scrub.clean(F.col("c")).alias("k"), files.kind(F.col("c")).alias("kind")).orderBy("i").collect()
    assert [r.kind for r in rows[:8]] == ["unknown", "unknown", "jpeg", "zip", "heic", "pdf", "png", "jpeg"]
    assert rows[4].r.unsupported and rows[2].k.error and rows[8].r is None


def test_zip(spark):
    archive = zipfmt.write([zipfmt.Item("a.txt", b"one"), zipfmt.Item("dir/b.xml", b"<two/>")])
    got = zipfmt.entries(archive)
    assert [(e.name, e.data(), e.crc) for e in got] == [("a.txt", b"one", zlib.crc32(b"one")), ("dir/b.xml", b"<two/>", zlib.crc32(b"<two/>"))]
    rows = zipfmt.list_entries(spark.createDataFrame([("p", bytearray(archive)), ("q", bytearray(b"no"))], "path string, content binary")).collect()
    assert [(r.path, r.name, r.error) for r in rows] == [("p", "a.txt", None), ("p", "dir/b.xml", None), ("q", None, "not a ZIP file")]


@pytest.mark.parametrize("n", [11, 12, 100, 65_546, 70_000, 200_000])
def test_blank_zlib(n):
    raw = zipfmt.blank_zlib(n)
    assert len(raw) == n and zlib.decompress(raw) == b" " * (n - 6 - 5 * -(-(n - 6) // 65_540))


def test_blank_zlib_too_short():
    assert zipfmt.blank_zlib(10) is None


def test_checksums(spark):
    from veilspark.functions.digests import VECTORS, adler32, digest

    row = spark.range(1).select(F.crc32(F.lit("123456789").cast("binary")), adler32(F.lit("Wikipedia")), *[digest(F.lit(x), a) for a, x, _ in VECTORS]).first()
    assert (row[0], row[1]) == (0xCBF43926, 0x11E60398) and list(row[2:]) == [d for *_, d in VECTORS]
    with pytest.raises(ValueError):
        digest(F.lit("x"), "sha0")


def test_files(spark, tmp_path):
    for name, content in (("a.bin", b"x" * 1000), ("b.bin", b"")):
        (tmp_path / name).write_bytes(content)
    df = files.read(spark, str(tmp_path), "*.bin")
    built_in = {r.path.rsplit("/", 1)[1]: r.hashes for r in files.hash_files(df).collect()}
    paths = spark.createDataFrame([(u,) for n in ("a.bin", "b.bin", "none") for u in (str(tmp_path / n), f"file:{tmp_path}/{n}", f"file://{tmp_path}/{n}")], "path string")
    blocks = {r.path.rsplit("/", 1)[1]: r for r in files.hash_streams(paths).collect()}
    assert blocks["a.bin"].hashes == built_in["a.bin"] and blocks["none"].error and "b.bin" not in built_in  # the reader skips empty files
    assert blocks["b.bin"].hashes["md5"] == "d41d8cd98f00b204e9800998ecf8427e"
    assert files.fold_blocks([b"ab", b"c"], ["md5"]) == {"md5": "900150983cd24fb0d6963f7d28e17f72"}


def test_segments(spark):
    df = spark.createDataFrame([(bytearray(JPEG),), (bytearray(b"zz"),)], "c binary")
    got = [r[0] for r in df.select(scrub.segments(F.col("c"))).collect()]
    assert [s.kind for s in got[0]] == ["FFE1", "FFFE", "FFDB", "FFDA"] and got[1] is None
    assert images.end_of_image(JPEG, images.jpeg_segments(JPEG)) == JPEG.index(b"\xff\xd9")
