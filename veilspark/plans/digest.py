"""Digests, verdicts, receipts and manifests over the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import digests as G
from ..operators import manifest
from ..sources import files, outputs
from .registry import load, query


@query("SELECT doc_id, sha256(text) AS sha256, sha1(text) AS sha1, md5(text) AS md5 FROM documents")
def digest_all(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", G.digests(F.col("text"), G.ALGORITHMS).alias("h"))
    return docs.select("doc_id", *[F.element_at("h", a).alias(a) for a in G.ALGORITHMS])


_EXPECTED = "CASE doc_id % 4 WHEN 0 THEN upper(sha256(text)) WHEN 1 THEN md5(text) WHEN 2 THEN repeat('0', 64) ELSE 'abc' END"


@query(
    f"""WITH x AS (SELECT doc_id, sha256(text) AS a, sha1(text) AS b, lower(regexp_replace({_EXPECTED}, '[^0-9a-fA-F]', '', 'g')) AS e FROM documents)
SELECT doc_id, CASE WHEN e = '' THEN NULL WHEN e IN (a, b) THEN 'match' WHEN length(e) IN (64, 40) THEN 'mismatch' ELSE 'length-none' END AS verdict FROM x"""
)
def digest_verdict(spark, sf_dir):
    text, i = F.col("text"), F.col("doc_id") % 4
    want = F.when(i == 0, F.concat(F.lit(" "), F.upper(F.sha2(text, 256)))).when(i == 1, F.md5("text")).when(i == 2, F.repeat(F.lit("0"), 64)).otherwise("abc")
    return load(spark, sf_dir, "documents").select("doc_id", G.verdict(G.digests(text, ("sha256", "sha1")), want).alias("verdict"))


@query(
    """SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n / 1024.0 < 10 THEN printf('%.2f KB', floor(n * 100 / 1024.0 + 0.5) / 100) WHEN n < 1048576 THEN printf('%.1f KB', floor(n * 10 / 1024.0 + 0.5) / 10) ELSE printf('%.2f MB', floor(n * 100 / 1048576.0 + 0.5) / 100) END AS size_text,
CASE WHEN n < 1024 THEN n || ' B' ELSE printf('%.1f KB', floor(n * 10 / 1024.0 + 0.5) / 10) END AS short_text FROM (SELECT doc_id, strlen(text) AS n FROM documents)"""
)
def digest_sizes(spark, sf_dir):
    n = F.octet_length("text")
    return load(spark, sf_dir, "documents").select("doc_id", G.size_text(n).alias("size_text"), G.short_size_text(n).alias("short_text"))


_ADLER = """WITH b AS (SELECT {0} AS id, encode(text) AS c, octet_length(encode(text)) AS n FROM {1}),
x AS (SELECT id, n, i, CASE WHEN i < n THEN ('0x' || substr(hex(c), 2 * i + 1, 2))::BIGINT ELSE 0 END AS v FROM (SELECT id, n, c, unnest(range(greatest(n, 1))) AS i FROM b))
SELECT id AS {0}, (((n + sum((n - i) * v)) % 65521) * 65536 + (1 + sum(v)) % 65521)::BIGINT AS adler32 FROM x GROUP BY id, n"""


@query(_ADLER.format("item_id", "benchmark"))
def digest_adler32(spark, sf_dir):
    return load(spark, sf_dir, "benchmark").select("item_id", G.adler32(F.col("text")).cast("long").alias("adler32"))


@query(_ADLER.format("doc_id", "documents"))
def digest_adler32_files(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", files.adler32(F.col("text")).alias("adler32"))


_STEP = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384::BIGINT) ELSE {0} >> 1 END"
_TABLE = "range(256)"
for _ in range(8):
    _TABLE = f"list_transform({_TABLE}, lambda x: {_STEP.format('x')})"


@query(
    f"""WITH t AS (SELECT {_TABLE} AS t), d AS (SELECT doc_id, hex(encode(text)) AS h, strlen(text) AS n FROM documents)
SELECT doc_id, xor(list_reduce(list_transform(range(n), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS crc32 FROM d, t"""
)
def digest_crc32(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.crc32(F.col("text").cast("binary")).alias("crc32"))


@query("SELECT doc_id, 'sha256-' || base64(unhex(sha256(text))) AS integrity FROM documents")
def digest_integrity(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", G.integrity(F.col("text"), "sha256").alias("integrity"))


@query("SELECT 'matched' AS cross_check, count(*) AS count FROM documents HAVING count(*) > 0")
def digest_cross_check(spark, sf_dir):
    return load(spark, sf_dir, "documents").groupBy(files.cross_check(F.col("text").cast("binary")).alias("cross_check")).count()


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' UTC+00:00' AS local_stamp, strftime(ts, '%Y%m%d-%H%M') AS file_stamp FROM events")
def digest_stamps(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", G.local_stamp(F.col("ts")).alias("local_stamp"), G.file_stamp(F.col("ts")).alias("file_stamp"))


@query("SELECT sha256(text) || '  ' || 'docs/' || doc_id || '.txt' AS line FROM documents")
def manifest_lines(spark, sf_dir):
    return load(spark, sf_dir, "documents").select(G.manifest_line(F.col("text"), F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt"))).alias("line"))


@query(
    """WITH p AS (SELECT 'd' || doc_id AS path, sha256(text) AS a FROM documents WHERE doc_id % 10 <> 3),
f AS (SELECT 'd' || doc_id AS path, CASE WHEN doc_id % 7 = 0 THEN md5(text) ELSE sha256(text) END AS b FROM documents WHERE doc_id % 10 <> 4)
SELECT path, CASE WHEN b IS NULL THEN 'missing' WHEN a IS NULL THEN 'extra' WHEN a = b THEN 'match' ELSE 'mismatch' END AS status FROM p FULL JOIN f USING (path)"""
)
def manifest_compare(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").withColumn("path", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    published = docs.where("doc_id % 10 <> 3").select("path", G.digest(F.col("text"), "sha256").alias("sha256"))
    found = docs.where("doc_id % 10 <> 4").select("path", F.when(F.col("doc_id") % 7 == 0, F.md5("text")).otherwise(F.sha2("text", 256)).alias("sha256"))
    return manifest.compare(published, found)


@query(
    """SELECT item_id, '1. item-' || item_id || chr(10) || '   Size: ' || strlen(text) || ' bytes' || chr(10) || '   Last modified: -' || chr(10) || '   SHA-256: ' || sha256(text) || chr(10)
|| '   MD5    : ' || md5(text) || chr(10) || '   Cross-check: not run' || chr(10) AS receipt FROM benchmark"""
)
def receipt_text(spark, sf_dir):
    items = load(spark, sf_dir, "benchmark")
    return items.select("item_id", G.receipt_text(F.array(_file())).alias("receipt"))


@query(
    """SELECT item_id, '{' || chr(10) || '  "tool" : "veilspark digests",' || chr(10) || '  "version" : "1",' || chr(10) || '  "generated" : "2024-01-01 00:00:00 UTC+00:00",' || chr(10) || '  "files" : [ {' || chr(10)
|| '    "name" : "item-' || item_id || '",' || chr(10) || '    "size_bytes" : ' || strlen(text) || ',' || chr(10) || '    "last_modified" : "-",' || chr(10) || '    "hashes" : {' || chr(10)
|| '      "sha256" : "' || sha256(text) || '",' || chr(10) || '      "md5" : "' || md5(text) || '"' || chr(10) || '    },' || chr(10) || '    "cross_check" : "not run"' || chr(10) || '  } ]' || chr(10) || '}' AS receipt FROM benchmark"""
)
def receipt_json(spark, sf_dir):
    items = load(spark, sf_dir, "benchmark")
    return items.select("item_id", G.receipt_json(F.lit("2024-01-01 00:00:00 UTC+00:00"), F.array(_file())).alias("receipt"))


@query("SELECT 'd' || doc_id AS name, sha256(text) AS sha256 FROM documents WHERE doc_id % 4 <> 1 AND doc_id % 5 <> 2")
def receipt_files(spark, sf_dir):
    """The files that a receipt lists: every fourth isn't done, every fifth failed."""
    i = F.col("doc_id")
    jobs = load(spark, sf_dir, "documents").select(F.concat(F.lit("d"), i.cast("string")).alias("name"), (i % 4 != 1).alias("done"), F.when(i % 5 == 2, "unreadable").alias("error"), G.digest(F.col("text"), "sha256").alias("sha256"))
    return manifest.finished(jobs).select("name", "sha256")


def _file():
    text = F.col("text")
    return F.struct(
        F.concat(F.lit("item-"), F.col("item_id").cast("string")).alias("name"), F.octet_length("text").alias("size_bytes"), F.lit("-").alias("last_modified"),
        G.digests(text, ("sha256", "md5")).alias("hashes"), F.lit("not run").alias("cross_check"),
    )


@query(
    """WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<((?:script|link)\\b[^>]*?\\s(?:src|href)="[^"]+")', 1)) AS t FROM pages)
SELECT page_id, regexp_extract(t, '^(\\w+)', 1) AS tag, regexp_extract(t, '\\s(?:src|href)="([^"]+)"', 1) AS ref, regexp_matches(regexp_extract(t, '\\s(?:src|href)="([^"]+)"', 1), '^(?:https?:|//)') AS external FROM t"""
)
def integrity_references(spark, sf_dir):
    return manifest.references(load(spark, sf_dir, "pages"), "page_id", "html")


_SRI = "'sha256-' || base64(unhex(sha256({0})))"


@query(
    """WITH f AS (SELECT item_id AS i, text FROM benchmark), a AS (SELECT text FROM f WHERE i = (SELECT min(i) FROM f))
SELECT '/tool/p' || page_id || '.html' AS path, '<link href="../shell/s' || page_id % 3 || '.css" rel="stylesheet" integrity="' || {0} || '"><script src="./app.js" integrity="' || {1} || '"></script><p>' || page_id || '</p><link rel="x" href="s0.css" integrity="' || {2} || '" />' AS html
FROM pages, a""".format(_SRI.format("('sheet ' || page_id % 3)"), _SRI.format("a.text"), _SRI.format("'own'"))
)
def integrity_written(spark, sf_dir):
    """Pages that refer to a style sheet beside their folder, a script and a sheet in it."""
    first = load(spark, sf_dir, "benchmark").orderBy("item_id").limit(1).select(F.lit("tool/app.js").alias("path"), F.col("text").alias("content"))
    sheets = spark.range(3).select(F.format_string("shell/s%d.css", "id").alias("path"), F.format_string("sheet %d", "id").alias("content"))
    own = spark.range(1).select(F.lit("tool/s0.css").alias("path"), F.lit("own").alias("content"))
    i = F.col("page_id").cast("string")
    html = F.concat(F.lit('<link href="../shell/s'), (F.col("page_id") % 3).cast("string"), F.lit('.css" integrity="old" rel="stylesheet"><script src="./app.js"></script><p>'), i, F.lit('</p><link rel="x" href="s0.css" />'))
    made = load(spark, sf_dir, "pages").select(F.concat(F.lit("/tool/p"), i, F.lit(".html")).alias("path"), html.alias("html"))
    return manifest.with_integrity(made, first.unionAll(sheets).unionAll(own), algorithm="sha256").select("path", "html")


@query("SELECT DISTINCT first_value(rank) OVER (PARTITION BY path ORDER BY rank) AS rank, path FROM (SELECT 'd' || doc_id % 700 AS path, (doc_id % 4)::INT AS rank FROM documents)")
def release_listing(spark, sf_dir):
    paths = load(spark, sf_dir, "documents").select(F.concat(F.lit("d"), (F.col("doc_id") % 700).cast("string")).alias("path"), (F.col("doc_id") % 4).cast("int").alias("rank"))
    return manifest.listing(paths).select("place.rank", "path")


@query(
    """SELECT line FROM (SELECT unnest(['digests 1.0', 'Built 2024-01-01 00:00 UTC', '', 'SHA-256 of the files of this release:', '']) AS line) UNION ALL SELECT sha256(text) || '  docs/' || doc_id || '.txt' FROM documents"""
)
def release_manifest(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), G.digest(F.col("text"), "sha256").alias("sha256"))
    return manifest.release("digests", "1.0", "2024-01-01 00:00 UTC", docs.withColumn("place", F.col("path"))).orderBy("order").select("line")


@query("SELECT DISTINCT CASE WHEN event_id % 11 = 0 THEN '?' ELSE event_type END AS directive, CASE WHEN event_id % 7 = 0 THEN '' ELSE 'https://h' || event_id % 50 END AS blocked FROM events")
def distinct_violations(spark, sf_dir):
    i = F.col("event_id")
    rows = load(spark, sf_dir, "events").select(F.when(i % 11 != 0, F.col("event_type")).alias("directive"), F.when(i % 7 != 0, F.concat(F.lit("https://h"), (i % 50).cast("string"))).alias("blocked"))
    return manifest.violations(rows)


@query("SELECT page_id, regexp_replace(n, '\\.[A-Za-z0-9_]+$', '') || '-pseudonymized.csv' AS data, regexp_replace(n, '\\.[A-Za-z0-9_]+$', '') || '-key.csv' AS key FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'a.b.csv' WHEN 1 THEN 'plain' ELSE list_last(string_split(url, '//')) END AS n FROM pages)")
def output_names(spark, sf_dir):
    i = F.col("page_id") % 3
    name = F.when(i == 0, "a.b.csv").when(i == 1, "plain").otherwise(F.element_at(F.split("url", "//"), -1))
    return load(spark, sf_dir, "pages").select("page_id", outputs.named(name, outputs.PSEUDONYMIZED).alias("data"), outputs.named(name, outputs.KEY).alias("key"))


@query(
    """SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'png' WHEN 2 THEN 'webp' WHEN 3 THEN 'pdf' WHEN 4 THEN 'zip' WHEN 5 THEN 'heic' ELSE 'unknown' END AS kind FROM documents WHERE octet_length(encode(text)) > 0"""
)
def file_kinds(spark, sf_dir):
    heads = [b"\xff\xd8\xff", b"\x89PNG\r\n", b"RIFF\1\2\3\4WEBP", b"%PDF-1.7", b"PK\3\4", b"\0\0\0\x18ftypheic\0", b"GIF89a", b""]
    head = F.element_at(F.array(*[F.lit(h) for h in heads]), (F.col("doc_id") % 8 + 1).cast("int"))
    docs = load(spark, sf_dir, "documents").where(F.octet_length("text") > 0)
    return docs.select("doc_id", files.kind(F.concat(head, F.col("text").cast("binary"))).alias("kind"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'docx' WHEN 1 THEN 'xlsx' WHEN 2 THEN 'pptx' ELSE 'zip' END AS kind FROM part")
def office_kinds(spark, sf_dir):
    lists = [["a.xml", "word/document.xml", "xl/x.xml"], ["xl/workbook.xml", "ppt/y"], ["[Content_Types].xml", "ppt/presentation.xml"], ["password/x", "z.txt"]]
    names = F.element_at(F.array(*[F.array(*[F.lit(n) for n in x]) for x in lists]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return load(spark, sf_dir, "part").select("p_partkey", files.office_kind(names).alias("kind"))
