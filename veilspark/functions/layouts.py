"""Text layouts: CSV quoting, file names, XML to text, dates, tables of findings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .checks import SPACE

DELIMITERS = (",", ";", "\t", "|")


def csv_quote(value: Column, delimiter: str = ",") -> Column:
    """Quoted if it has a quote, a line break or the delimiter, or starts or ends with white space; null is empty."""
    v = F.coalesce(value.cast("string"), F.lit(""))
    must = v.rlike('["\r\n]') | F.contains(v, F.lit(delimiter)) | v.rlike(f"^{SPACE}") | v.rlike(f"{SPACE}\\z")
    return F.when(must, F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)


def csv_line(columns: list[Column], delimiter: str = ",") -> Column:
    return F.concat_ws(delimiter, *[csv_quote(c, delimiter) for c in columns])


def quoted_line(columns: list[Column]) -> Column:
    """Every field quoted."""
    return F.concat_ws(",", *[F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in columns])


def _let(value: Column, then) -> Column:
    """then(value), with value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def sniff_delimiter(text: Column) -> Column:
    """The delimiter of the first ten lines: a count that is the same on all lines counts tenfold, ties go to , ; tab | in this order."""
    lines = F.filter(F.slice(F.split(F.substring(text, 1, 20_000), "\r?\n", -1), 1, 10), lambda x: F.length(x) > 0)
    signs = F.array(*[F.lit(d) for d in DELIMITERS])
    counts = lambda ls, d: F.transform(ls, lambda x: F.length(x) - F.length(F.replace(x, d, F.lit(""))))
    score = lambda c: _let(F.struct(F.array_min(c).alias("low"), F.array_max(c).alias("high")), lambda m: F.when((m["low"] > 0) & (m["low"] == m["high"]), m["low"] * 10).otherwise(F.coalesce(m["low"], F.lit(-1))))
    scores = _let(lines, lambda ls: F.transform(signs, lambda d: _let(counts(ls, d), score)))
    return _let(scores, lambda s: F.element_at(signs, F.array_position(s, F.array_max(s)).cast("int")))


def clean_name(name: Column) -> Column:
    """-clean before the extension, if there is a name before it."""
    return F.when(name.rlike(r"(?s)^.+\.[^.]*$"), F.regexp_replace(name, r"(?s)^(.+)(\.[^.]*)$", "$1-clean$2")).otherwise(F.concat(name, F.lit("-clean")))


def unescape(text: Column) -> Column:
    """The five XML entities, &amp; first, so that doubly escaped text is unescaped twice."""
    for entity, sign in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return text


def document_text(xml: Column) -> Column:
    """Plain text of a word-processing document's XML: tabs, breaks and paragraphs as signs, other tags dropped."""
    out = F.replace(xml, F.lit("<w:tab/>"), F.lit("\t"))
    out = F.regexp_replace(out, "<w:br/>|<w:cr/>|</w:p>", "\n")
    return unescape(F.regexp_replace(out, "<[^>]+>", ""))


def xml_text(xml: Column, tag: str) -> Column:
    """Text of the first element of that name, tags inside dropped; null if there is none."""
    name = tag.replace(":", "\\:")
    whole = f"(?s)<{name}(?:\\s[^>]*)?>(.*?)</{name}>"
    return F.when(xml.rlike(whole), F.trim(F.regexp_replace(F.regexp_extract(xml, whole, 1), "<[^>]+>", "")))


def set_xml_text(xml: Column, tag: str, value: str) -> Column:
    name = tag.replace(":", "\\:")
    return F.regexp_replace(xml, f"(?s)(<{name}(?:\\s[^>]*)?>)(.*?)(</{name}>)", "$1" + value.replace("\\", "\\\\").replace("$", "\\$") + "$3")


def pdf_date(value: Column) -> Column:
    """D:YYYYMMDDHHmm as YYYY-MM-DD HH:mm, as far as it goes; other texts as they are."""
    part = lambda i: F.regexp_extract(value, r"^D:(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?", i)
    dash = lambda p: F.when(p != "", F.concat(F.lit("-"), p)).otherwise("")
    clock = F.when(part(4) != "", F.concat(F.lit(" "), part(4), F.lit(":"), F.when(part(5) != "", part(5)).otherwise("00"))).otherwise("")
    return F.when(value.rlike(r"^D:\d{4}"), F.concat(part(1), dash(part(2)), dash(part(3)), clock)).otherwise(value)


def key_words(name: Column) -> Column:
    """CreationDate as Creation Date."""
    return F.regexp_replace(name, "([a-z])([A-Z])", "$1 $2")


def gps_decimal(degrees: Column, minutes: Column, seconds: Column, ref: Column) -> Column:
    """Decimal degrees; south and west are negative."""
    return (degrees + minutes / 60.0 + seconds / 3600.0) * F.when(ref.isin("S", "W"), -1.0).otherwise(1.0)


def duration_text(ms: Column) -> Column:
    s = ms / 1000.0
    whole = lambda x: F.floor(x + 0.5).cast("string")
    long = F.concat(F.floor(s / 60).cast("string"), F.lit(" min "), whole(s % 60), F.lit(" s"))
    return F.when(s < 10, F.concat(F.format_string("%.1f", s), F.lit(" s"))).when(s < 90, F.concat(whole(s), F.lit(" s"))).otherwise(long)
