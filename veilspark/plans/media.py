"""Files made of documents: images, PDF and Office files with metadata in known places, inspected and cleaned."""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources import outputs, scrub, tables, zipfmt
from .registry import load, query


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">L", len(data)) + kind + data + struct.pack(">L", zlib.crc32(kind + data))


_PNG_HEAD = b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">LLBBBBB", 1, 1, 8, 0, 0, 0, 0))
_PNG_TAIL = _chunk(b"IDAT", zlib.compress(b"\0\0")) + _chunk(b"IEND", b"")


def _be(n: Column, width: int) -> Column:
    """A number as big-endian bytes."""
    return F.unhex(F.lpad(F.hex(n), 2 * width, "0"))


def _png(value: Column) -> Column:
    data = F.concat(F.lit(b"Comment\0\0\0\0\0"), value.cast("binary"))
    body = F.concat(F.lit(b"iTXt"), data)
    return F.concat(F.lit(_PNG_HEAD), _be(F.octet_length(data), 4), body, _be(F.crc32(body), 4), F.lit(_PNG_TAIL))


#: Characters of one comment; four bytes each fit a segment.
_COMMENT = 15_000


def _jpeg(value: Column) -> Column:
    """The whole value, in as many comments as it takes."""
    last = F.greatest(F.ceil(F.length(value) / _COMMENT).cast("int") - 1, F.lit(0))
    parts = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(value, i * _COMMENT + 1, F.lit(_COMMENT)).cast("binary"))
    notes = F.aggregate(parts, F.lit(b""), lambda out, x: F.concat(out, F.lit(b"\xff\xfe"), _be(F.octet_length(x) + 2, 2), x))
    return F.concat(F.lit(b"\xff\xd8"), notes, F.lit(b"\xff\xda\0\2scan\xff\xd9"), F.lit(b"TRAIL"))


def _pdf(value: Column) -> Column:
    name = F.hex(F.encode(value, "UTF-16BE"))
    return F.concat(F.lit(b"%PDF-1.4\n1 0 obj << /Author <FEFF"), name.cast("binary"), F.lit(b"> /CreationDate (D:20260101120000) >> endobj\n%%EOF"))


def _items(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("value"))


@query(f"SELECT doc_id, 'png' AS kind, 1 AS n_findings, substr(text, 1, 300) AS found, (24 + strlen(text))::BIGINT AS removable, {len(_PNG_HEAD) + len(_PNG_TAIL)} AS clean_size FROM documents")
def media_png(spark, sf_dir):
    return _report(_items(spark, sf_dir).select("doc_id", _png(F.col("value")).alias("content")))


_COMMENTS = f"greatest(ceil(length(text) / {_COMMENT}.0), 1)::BIGINT"


@query(f"SELECT doc_id, 'jpeg' AS kind, ({_COMMENTS} + 1)::INT AS n_findings, substr(text, 1, 300) AS found, (4 * {_COMMENTS} + 5 + strlen(text))::BIGINT AS removable, 12 AS clean_size FROM documents")
def media_jpeg(spark, sf_dir):
    return _report(_items(spark, sf_dir).select("doc_id", _jpeg(F.col("value")).alias("content")))


_BLANK = r"regexp_matches(text, '^\s*$')"


@query(f"SELECT doc_id, 'pdf' AS kind, CASE WHEN {_BLANK} THEN 1 ELSE 2 END AS n_findings, CASE WHEN {_BLANK} THEN '2026-01-01 12:00' ELSE substr(text, 1, 200) END AS found, (4 * length(text) + 6 + 18)::BIGINT AS removable, (83 + 4 * length(text))::INT AS clean_size FROM documents")
def media_pdf(spark, sf_dir):
    return _report(_items(spark, sf_dir).select("doc_id", _pdf(F.col("value")).alias("content")))


def _examined(files):
    """report and cleaned of each content."""
    return files.withColumn("x", scrub.examine(F.col("content"))).select("*", "x.report", "x.cleaned").drop("x")


def _report(files):
    found = F.element_at("report.findings", 1)["value"]
    both = _examined(files).select("doc_id", "report.kind", F.size("report.findings").alias("n_findings"), found.alias("found"), "report.removable", F.octet_length("cleaned.bytes").alias("clean_size"))
    return both


@query(
    f"""WITH c AS (SELECT doc_id, text, {_COMMENTS} AS n FROM documents),
f AS (SELECT doc_id, i::INT AS idx, 'Comment' AS section, 'Comment' AS name, substr(substr(text, {_COMMENT} * i + 1, {_COMMENT}), 1, 300) AS value, n FROM (SELECT doc_id, text, n, unnest(range(n)) AS i FROM c)
UNION ALL SELECT doc_id, n::INT, 'Other', 'Data after end of image', '5 B beyond the image', n FROM c)
SELECT doc_id AS path, idx, CASE WHEN idx = 0 OR idx = n THEN section ELSE '' END AS heading, section, name, value, false AS risky FROM f"""
)
def media_findings(spark, sf_dir):
    files = _items(spark, sf_dir).select(F.col("doc_id").alias("path"), _jpeg(F.col("value")).alias("content"))
    return scrub.findings(files.select("path", scrub.inspect(F.col("content")).alias("report")), "path", "report")


@query("SELECT doc_id, 1 AS items, false AS located, (24 + strlen(text))::INT AS saved FROM documents")
def media_summary(spark, sf_dir):
    files = _examined(_items(spark, sf_dir).select("doc_id", _png(F.col("value")).alias("content")))
    return files.select("doc_id", scrub.summary(F.col("report"), F.octet_length("content"), F.col("cleaned")).alias("s")).select("doc_id", "s.*")


_EXIF_HEAD = b"II*\0" + struct.pack("<LH", 8, 3)


def _le(n: Column, width: int) -> Column:
    """A number as little-endian bytes."""
    return F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright(n.cast("long"), 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(width)]))


def _tiff(make: Column, orientation: Column) -> Column:
    """A directory of Make, Orientation and Software; the texts stand behind it."""
    size = F.octet_length(make) + 1
    entry = lambda tag, kind: F.lit(struct.pack("<HH", tag, kind))
    return F.concat(
        F.lit(_EXIF_HEAD), entry(0x010F, 2), _le(size, 4), F.lit(struct.pack("<L", 50)), entry(0x0112, 3), F.lit(struct.pack("<L", 1)), _le(orientation, 4),
        entry(0x0131, 2), F.lit(struct.pack("<L4s", 4, b"vs1\0")), F.lit(b"\0" * 4), make.cast("binary"), F.lit(b"\0"),
    )


def _maker() -> Column:
    return F.concat(F.lit("Maker of part "), F.col("p_partkey").cast("string"))


@query("SELECT p_partkey, 'Maker of part ' || p_partkey AS make, (p_partkey % 8 + 1)::INT AS orientation, (p_partkey % 8 > 0) AS rewritten FROM part")
def media_exif(spark, sf_dir):
    """EXIF directories in JPEG files: what is read, and whether the copy holds a new one for its orientation."""
    tiff = _tiff(_maker(), F.col("p_partkey") % 8 + 1)
    block = F.concat(F.lit(b"Exif\0\0"), tiff)
    content = F.concat(F.lit(b"\xff\xd8\xff\xe1"), _be(F.octet_length(block) + 2, 2), block, F.lit(b"\xff\xda\0\2scan\xff\xd9"))
    files = _examined(load(spark, sf_dir, "part").select("p_partkey", content.alias("content")))
    make = F.element_at(F.filter("report.findings", lambda f: f["name"] == "Camera make"), 1)["value"]
    again = F.size(F.filter("cleaned.changes", lambda c: F.contains(c, F.lit("orientation")))) > 0
    return files.select("p_partkey", make.alias("make"), "report.orientation", again.alias("rewritten"))


@query("SELECT p_partkey, 'webp' AS kind, 'Maker of part ' || p_partkey AS make, (58 + length('Maker of part ' || p_partkey) + 1 + (length('Maker of part ' || p_partkey) + 1) % 2)::BIGINT AS removable, 12 + 18 + 12 AS clean_size FROM part")
def media_webp(spark, sf_dir):
    """WebP files with an extended header, a picture and an EXIF chunk."""
    tiff = _tiff(_maker(), F.lit(1))
    pad = F.when(F.octet_length(tiff) % 2 == 1, F.lit(b"\0")).otherwise(F.lit(b""))
    body = F.concat(F.lit(b"WEBPVP8X\x0a\0\0\0\x08" + b"\0" * 9 + b"VP8 \4\0\0\0pics"), F.lit(b"EXIF"), _le(F.octet_length(tiff), 4), tiff, pad)
    files = _examined(load(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit(b"RIFF"), _le(F.octet_length(body), 4), body).alias("content")))
    make = F.element_at(F.filter("report.findings", lambda f: f["name"] == "Camera make"), 1)["value"]
    return files.select("p_partkey", "report.kind", make.alias("make"), "report.removable", F.octet_length("cleaned.bytes").alias("clean_size"))


@query("SELECT n_nationkey, n_name AS headline, 'City of ' || n_nationkey AS city, 2::BIGINT AS n_blocks FROM nation")
def media_iptc(spark, sf_dir):
    """IPTC datasets in a JPEG file's APP13 block."""
    city = F.concat(F.lit("City of "), F.col("n_nationkey").cast("string"))
    dataset = lambda n, v: F.concat(F.lit(b"\x1c\x02" + bytes([n])), _be(F.octet_length(v), 2), v.cast("binary"))
    block = F.concat(F.lit(b"Photoshop 3.0\08BIM"), dataset(105, F.col("n_name")), dataset(90, city))
    content = F.concat(F.lit(b"\xff\xd8\xff\xed"), _be(F.octet_length(block) + 2, 2), block, F.lit(b"\xff\xda\0\2scan\xff\xd9"))
    files = load(spark, sf_dir, "nation").select("n_nationkey", scrub.inspect(content).alias("report"), scrub.segments(content).alias("parts"))
    value = lambda name: F.element_at(F.filter("report.findings", lambda f: f["name"] == name), 1)["value"]
    return files.select("n_nationkey", value("Headline").alias("headline"), value("City").alias("city"), F.size("parts").cast("long").alias("n_blocks"))


def _docx(docs):
    """A word-processing file for each document: its source is its author, and the author of one to three changes."""
    who = F.concat(F.lit("Editor "), F.col("source"))
    change = F.concat(F.lit('<w:ins w:author="'), who, F.lit('">x</w:ins>'))
    main = F.concat(F.lit("<w:document><w:p>"), F.repeat(change, (F.col("doc_id") % 3 + 1).cast("int")), F.lit("</w:p></w:document>"))
    core = F.concat(F.lit("<cp:coreProperties><dc:creator>"), who, F.lit("</dc:creator><cp:revision>"), F.col("doc_id").cast("string"), F.lit("</cp:revision></cp:coreProperties>"))
    parts = F.array(*[F.struct(F.lit(n).alias("name"), x.cast("binary").alias("content")) for n, x in (("docProps/core.xml", core), ("word/document.xml", main))])
    return zipfmt.bundle(docs.select("doc_id", F.explode(parts).alias("p")).select("doc_id", "p.*"), "name", "content", "doc_id")


@query("SELECT 'Editor ' || source AS author, sum(doc_id % 3 + 1)::BIGINT AS mentions FROM documents GROUP BY 1")
def author_counts(spark, sf_dir):
    reports = _docx(load(spark, sf_dir, "documents")).select(scrub.inspect(F.col("content")).alias("r"))
    return reports.select(F.explode("r.authors").alias("author", "n")).groupBy("author").agg(F.sum("n").cast("long").alias("mentions"))


@query(
    """SELECT doc_id, 'docx' AS kind, 'Editor ' || source AS author, doc_id::VARCHAR AS revision, (doc_id % 3 + 1)::INT AS mentions,
'<cp:coreProperties><dc:creator></dc:creator><cp:revision>1</cp:revision></cp:coreProperties>' AS core, '<w:document><w:p>' || repeat('<w:ins w:author="Author">x</w:ins>', doc_id % 3 + 1) || '</w:p></w:document>' AS document FROM documents"""
)
def media_office(spark, sf_dir):
    """Office files inspected and cleaned; the parts of the copies as text."""
    files = _examined(_docx(load(spark, sf_dir, "documents")))
    value = lambda name: F.element_at(F.filter("report.findings", lambda f: (f["section"] == "Properties") & (f["name"] == name)), 1)["value"]
    part = lambda name: scrub.part_text(F.col("cleaned.bytes"), name)
    mentions = F.aggregate(F.map_values("report.authors"), F.lit(0), lambda a, n: a + n)
    return files.select("doc_id", "report.kind", value("Author").alias("author"), value("Revision").alias("revision"), mentions.alias("mentions"), part("docProps/core.xml").alias("core"), part("word/document.xml").alias("document"))


#: Documents of one archive; archives grow in number, not in size.
_SHARD = 64


@query(f"SELECT path, (row_number() OVER (PARTITION BY path ORDER BY name) - 1)::INT AS entry_idx, name, size AS usize FROM (SELECT source || '-' || doc_id // {_SHARD} AS path, 'd' || doc_id || '.txt' AS name, strlen(text)::BIGINT AS size FROM documents)")
def zip_directory(spark, sf_dir):
    shard = F.concat(F.col("source"), F.lit("-"), F.floor(F.col("doc_id") / _SHARD).cast("string"))
    docs = load(spark, sf_dir, "documents").select(shard.alias("path"), F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.col("text").cast("binary").alias("content"))
    return zipfmt.list_entries(zipfmt.bundle(docs, "name", "content", "path")).select("path", "entry_idx", "name", "usize")


@query(f"SELECT 'clean-copies-' || doc_id // {_SHARD} || '.zip' AS path, (row_number() OVER (PARTITION BY doc_id // {_SHARD} ORDER BY 'd' || doc_id || '-clean.png') - 1)::INT AS entry_idx, 'd' || doc_id || '-clean.png' AS name, {len(_PNG_HEAD) + len(_PNG_TAIL)}::BIGINT AS usize FROM documents WHERE doc_id % 5 <> 0")
def clean_archives(spark, sf_dir):
    """Archives of all clean copies; files that can't be cleaned (every fifth is cut off) are left out."""
    content = F.when(F.col("doc_id") % 5 == 0, F.lit(b"\xff\xd8junk")).otherwise(_png(F.col("value")))
    files = _items(spark, sf_dir).select(F.concat(F.lit("/in/d"), F.col("doc_id").cast("string"), F.lit(".png")).alias("path"), content.alias("content"), F.floor(F.col("doc_id") / _SHARD).cast("string").alias("shard"))
    archives = outputs.clean_archives(files, "shard").select(F.concat(F.lit("clean-copies-"), F.col("shard"), F.lit(".zip")).alias("path"), "content")
    return zipfmt.list_entries(archives).select("path", "entry_idx", "name", "usize")


@query(f"SELECT source || '-' || doc_id // {_SHARD} AS path, 'd' || doc_id || '.txt' AS name, 0 AS method, strlen(text)::BIGINT AS usize FROM documents")
def zip_table_function(spark, sf_dir):
    """The same archives through the table function, in SQL."""
    tables.register(spark)
    shard = F.concat(F.col("source"), F.lit("-"), F.floor(F.col("doc_id") / _SHARD).cast("string"))
    docs = load(spark, sf_dir, "documents").select(shard.alias("path"), F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.col("text").cast("binary").alias("content"))
    return spark.sql("SELECT f.path, e.name, e.method, e.usize FROM {files} f, LATERAL zip_entries(f.content) e", files=zipfmt.bundle(docs, "name", "content", "path"))


@query("SELECT doc_id, unnest(['IHDR', 'iTXt', 'IDAT', 'IEND']) AS kind FROM documents")
def image_table_function(spark, sf_dir):
    tables.register(spark)
    return spark.sql("SELECT f.doc_id, e.kind FROM {files} f, LATERAL image_parts(f.content) e", files=_items(spark, sf_dir).select("doc_id", _png(F.col("value")).alias("content")))
