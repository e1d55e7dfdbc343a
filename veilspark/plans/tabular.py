"""Delimited text, XML and display forms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import layouts as L
from ..operators import manifest
from ..sources import csvkit
from .registry import load, query

_QUOTE = """CASE WHEN regexp_matches({0}, '["\r\n]') OR contains({0}, ',') OR regexp_matches({0}, '^[\\t\\n\\x0B\\f\\r ]') OR regexp_matches({0}, '[\\t\\n\\x0B\\f\\r ]\\z') THEN '"' || replace({0}, '"', '""') || '"' ELSE {0} END"""


@query(f"SELECT doc_id::VARCHAR || ',' || {_QUOTE.format('text')} || ',' || lang || ',' || n_chars AS line FROM documents")
def csv_lines(spark, sf_dir):
    return csvkit.to_lines(load(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars"))


@query("""SELECT '"' || doc_id || '","' || replace(text, '"', '""') || '"' AS line FROM documents""")
def csv_quoted_lines(spark, sf_dir):
    return load(spark, sf_dir, "documents").select(L.quoted_line([F.col("doc_id"), F.col("text")]).alias("line"))


@query("SELECT l_orderkey, l_linenumber, CASE l_linenumber % 5 WHEN 0 THEN ',' WHEN 1 THEN ';' WHEN 2 THEN chr(9) WHEN 3 THEN '|' ELSE ',' END AS delimiter FROM lineitem")
def csv_sniff(spark, sf_dir):
    d = F.element_at(F.array(*[F.lit(x) for x in (",", ";", "\t", "|", "")]), (F.col("l_linenumber") % 5 + 1).cast("int"))
    text = F.concat(F.lit("a,b"), d, F.lit("c\r\n\r\n"), F.col("l_returnflag"), d, F.lit("e"), d, F.col("l_linestatus"))
    text = F.when(d == "", "plain\nlines").when(d == ",", F.lit("a,b\n1,2\n")).otherwise(text)
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", L.sniff_delimiter(text).alias("delimiter"))


@query("SELECT doc_id::VARCHAR AS id, text, lang FROM documents")
def csv_round_trip(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", "lang")
    lines = docs.select("id", F.concat(F.lit("id,text,lang\r\n"), L.csv_line([F.col("id"), F.col("text"), F.col("lang")]), F.lit("\r\n")).alias("value"))
    rows = csvkit.read_texts(lines, "id", "value", ",")
    return rows.select(*[F.element_at("fields", i + 1).alias(c) for i, c in enumerate(("id", "text", "lang"))])


@query("SELECT c_custkey, string_split('x,' || c_name || ',,' || c_mktsegment, ',') AS fields FROM customer")
def csv_parse_rows(spark, sf_dir):
    text = F.concat(F.lit("﻿x,"), F.col("c_name"), F.lit(",,"), F.col("c_mktsegment"))
    return load(spark, sf_dir, "customer").select("c_custkey", F.element_at(csvkit.parse(text, ","), 1).alias("fields"))


@query("SELECT page_id, CASE WHEN regexp_matches(n, '(?s)^.+\\.[^.]*$') THEN regexp_replace(n, '(?s)^(.+)(\\.[^.]*)$', '\\1-clean\\2') ELSE n || '-clean' END AS name FROM (SELECT page_id, list_last(string_split(url, '/')) AS n FROM pages)")
def clean_names(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", L.clean_name(F.element_at(F.split("url", "/"), -1)).alias("name"))


def _unescaped(x: str) -> str:
    for entity, sign in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''")):
        x = f"replace({x}, '{entity}', '{sign}')"
    return x


@query("SELECT page_id, " + _unescaped("regexp_replace(regexp_replace(replace(html, '<w:tab/>', chr(9)), '<w:br/>|<w:cr/>|</w:p>', chr(10), 'g'), '<[^>]+>', '', 'g')") + " AS text FROM pages")
def xml_document_text(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", L.document_text(F.col("html")).alias("text"))


@query(
    """SELECT page_id, CASE WHEN regexp_matches(html, '(?s)<title(?:\\s[^>]*)?>(.*?)</title>') THEN trim(regexp_replace(regexp_extract(html, '(?s)<title(?:\\s[^>]*)?>(.*?)</title>', 1), '<[^>]+>', '', 'g')) END AS title,
md5(regexp_replace(html, '(?s)(<title(?:\\s[^>]*)?>)(.*?)(</title>)', '\\1gone\\3', 'g')) AS without_title FROM pages"""
)
def xml_element(spark, sf_dir):
    html = F.col("html")
    return load(spark, sf_dir, "pages").select("page_id", L.xml_text(html, "title").alias("title"), F.md5(L.set_xml_text(html, "title", "gone")).alias("without_title"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN o_orderkey % 2 = 0 THEN ' ' || strftime(o_orderdate, '%H:%M') ELSE '' END AS date FROM orders")
def pdf_dates(spark, sf_dir):
    pattern = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "'D:'yyyyMMddHHmmss")).otherwise(F.date_format("o_orderdate", "'D:'yyyyMMdd"))
    return load(spark, sf_dir, "orders").select("o_orderkey", L.pdf_date(pattern).alias("date"))


@query("SELECT c_custkey, round(((c_custkey % 90) + (c_custkey % 60) / 60.0 + (c_custkey % 3600) / 36000.0) * CASE c_custkey % 4 WHEN 0 THEN -1 WHEN 1 THEN -1 ELSE 1 END, 6) AS degrees FROM customer")
def gps_degrees(spark, sf_dir):
    k = F.col("c_custkey")
    ref = F.element_at(F.array(*[F.lit(x) for x in "SWNE"]), (k % 4 + 1).cast("int"))
    return load(spark, sf_dir, "customer").select("c_custkey", F.round(L.gps_decimal((k % 90).cast("double"), (k % 60).cast("double"), (k % 3600) / 10.0, ref), 6).alias("degrees"))


@query("SELECT event_id, event_type || 'Date' AS key, regexp_replace(event_type || 'Date', '([a-z])([A-Z])', '\\1 \\2', 'g') AS words FROM events")
def key_words(spark, sf_dir):
    key = F.concat(F.col("event_type"), F.lit("Date"))
    return load(spark, sf_dir, "events").select("event_id", key.alias("key"), L.key_words(key).alias("words"))


@query("SELECT event_id, CASE WHEN ms / 1000.0 < 10 THEN printf('%.1f s', floor((ms + 50) / 100) / 10.0) WHEN ms / 1000.0 < 90 THEN floor(ms / 1000.0 + 0.5)::BIGINT || ' s' ELSE floor(ms / 60000.0)::BIGINT || ' min ' || floor((ms / 1000.0) % 60 + 0.5)::BIGINT || ' s' END AS duration FROM (SELECT event_id, event_id * 37 % 400000 AS ms FROM events)")
def durations(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", L.duration_text(F.col("event_id") * 37 % 400000).alias("duration"))


@query("SELECT event_id, user_id, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN '' ELSE event_type END AS heading FROM events")
def finding_headings(spark, sf_dir):
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return load(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_type").eqNullSafe(before), "").otherwise(F.col("event_type")).alias("heading"))


@query("SELECT doc_id, source, coalesce(sum(30 + length('d' || doc_id) + strlen(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS entry_offset FROM documents")
def archive_offsets(spark, sf_dir):
    """Prefix sums in two steps: no task holds all entries of a source."""
    size = F.lit(30) + F.length(F.concat(F.lit("d"), F.col("doc_id").cast("string"))) + F.octet_length("text")
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", size.cast("long").alias("size"), F.floor(F.col("doc_id") / 10_000).alias("part"))
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    parts = docs.groupBy("source", "part").agg(F.sum("size").alias("size"))
    parts = parts.select("source", "part", F.coalesce(F.sum("size").over(before("source").orderBy("part")), F.lit(0)).alias("base"))
    inside = docs.withColumn("own", F.coalesce(F.sum("size").over(before("source", "part").orderBy("doc_id")), F.lit(0)))
    return inside.join(parts, ["source", "part"]).select("doc_id", "source", (F.col("base") + F.col("own")).alias("entry_offset"))


@query("SELECT DISTINCT path, section, name, value FROM (SELECT 'p' || (event_id % 100) AS path, event_type AS section, 'n' || (event_id % 7) AS name, (event_id % 13)::VARCHAR AS value FROM events WHERE event_id % 3 <> 0) EXCEPT SELECT 'p' || (event_id % 100), event_type, 'n' || (event_id % 7), (event_id % 13)::VARCHAR FROM events WHERE event_id % 3 = 0")
def findings_gone(spark, sf_dir):
    i = F.col("event_id")
    rows = load(spark, sf_dir, "events").select(i, F.concat(F.lit("p"), (i % 100).cast("string")).alias("path"), F.col("event_type").alias("section"), F.concat(F.lit("n"), (i % 7).cast("string")).alias("name"), (i % 13).cast("string").alias("value"))
    return manifest.new_findings(rows.where("event_id % 3 <> 0").drop("event_id"), rows.where("event_id % 3 = 0")).distinct()


@query("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 8")
def preview(spark, sf_dir):
    return load(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice").orderBy("o_orderdate", "o_orderkey").limit(8)


@query("SELECT bool_and(n_chars >= 0) AS all_sized, bool_or(lang = 'en') AS any_english, count(DISTINCT (lang, source))::BIGINT AS n_pairs FROM documents")
def verdict_flags(spark, sf_dir):
    return load(spark, sf_dir, "documents").agg(F.bool_and(F.col("n_chars") >= 0).alias("all_sized"), F.bool_or(F.col("lang") == "en").alias("any_english"), F.count_distinct("lang", "source").alias("n_pairs"))
