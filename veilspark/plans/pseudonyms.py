"""Pseudonyms and uniqueness risk on customers and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pseudonym as P
from .registry import load, query

#: A fixed key, so that the results can be compared; real ones come from derive_key.
KEY = bytes(range(32))
_INNER, _OUTER = ("".join(f"{b ^ pad:02x}" for b in KEY.ljust(64, b"\0")) for pad in (0x36, 0x5C))
_WS = "[\\t\\n\\x0B\\f\\r \\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]+"


def _norm(x: str) -> str:
    return f"lower(trim(regexp_replace(coalesce({x}::VARCHAR, ''), '{_WS}', ' ', 'g'), ' '))"


def _mac(column: str, x: str, length: int = 16) -> str:
    return f"substr(sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode('{column}' || chr(0) || {x})))), 1, {length})"


@query(f"SELECT c_custkey, {_mac('c_name', _norm('c_name'))} AS c_name, {_mac('c_mktsegment', _norm('c_mktsegment'))} AS c_mktsegment FROM customer")
def pseudo_keyed(spark, sf_dir):
    return P.keyed(load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), ["c_name", "c_mktsegment"], KEY)


@query(f"SELECT doc_id, CASE WHEN {_norm('text')} <> '' THEN {_mac('text', _norm('text'), 64)} ELSE '' END AS text FROM documents")
def pseudo_keyed_texts(spark, sf_dir):
    return P.keyed(load(spark, sf_dir, "documents").select("doc_id", "text"), ["text"], KEY, 64)


_FIRST = """first AS (SELECT col, norm, min(o) AS o, arg_min(raw, o) AS original FROM cells WHERE norm <> '' GROUP BY col, norm),
dict AS (SELECT col, norm, pre || '-' || CASE WHEN r < 10000 THEN lpad(r::VARCHAR, 4, '0') ELSE r::VARCHAR END AS token, original FROM (SELECT *, row_number() OVER (PARTITION BY col ORDER BY o) AS r, CASE col WHEN 'c_name' THEN 'C-NAME' ELSE 'C-MKTSEGMENT' END AS pre FROM first))"""
_CELLS = f"""WITH cells AS (SELECT 'c_name' AS col, c_custkey AS o, c_name AS raw, {_norm('c_name')} AS norm FROM customer UNION ALL SELECT 'c_mktsegment', c_custkey, c_mktsegment, {_norm('c_mktsegment')} FROM customer),
{_FIRST}"""
_COLUMNS = ["c_name", "c_mktsegment"]


@query(f'{_CELLS} SELECT col AS "column", norm, token, original FROM dict')
def pseudo_dictionary(spark, sf_dir):
    return P.dictionary(load(spark, sf_dir, "customer"), _COLUMNS, "c_custkey")


@query(f"{_CELLS} SELECT c_custkey, a.token AS c_name, b.token AS c_mktsegment FROM customer JOIN dict a ON a.col = 'c_name' AND a.norm = {_norm('c_name')} JOIN dict b ON b.col = 'c_mktsegment' AND b.norm = {_norm('c_mktsegment')}")
def pseudo_tokens(spark, sf_dir):
    customers = load(spark, sf_dir, "customer").select("c_custkey", *_COLUMNS)
    return P.tokens(customers, _COLUMNS, P.dictionary(customers, _COLUMNS, "c_custkey"))


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def pseudo_reidentify(spark, sf_dir):
    customers = load(spark, sf_dir, "customer").select("c_custkey", *_COLUMNS)
    words = P.dictionary(customers, _COLUMNS, "c_custkey")
    return P.reidentify(P.reidentify(P.tokens(customers, _COLUMNS, words), "c_name", words), "c_mktsegment", words)


@query(f"SELECT {_mac('custkey', _norm('c_custkey'))} AS custkey, count(*) AS n_orders FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def pseudo_join(spark, sf_dir):
    left = P.keyed(load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey")), ["custkey"], KEY)
    right = P.keyed(load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey")), ["custkey"], KEY)
    return left.join(right, "custkey").groupBy("custkey").agg(F.count("*").alias("n_orders"))


@query(f"SELECT (SELECT count(DISTINCT {_norm('c_name')}) FROM customer) + (SELECT count(DISTINCT {_norm('c_mktsegment')}) FROM customer) AS n_replaced, 2::BIGINT AS n_columns, (SELECT count(*) FROM customer) AS n_rows")
def pseudo_summary(spark, sf_dir):
    return P.replaced(load(spark, sf_dir, "customer"), _COLUMNS)


_MACS = "(SELECT 'c_name' AS col, {norm} AS norm, {mac} AS token FROM customer)".format(norm=_norm("c_name"), mac=_mac("c_name", _norm("c_name"), 8))


@query(f'SELECT col AS "column", substr(token, 1, 3) AS token, count(DISTINCT norm) AS n FROM {_MACS} GROUP BY 1, 2 HAVING count(DISTINCT norm) > 1')
def pseudo_collisions(spark, sf_dir):
    customers = load(spark, sf_dir, "customer").select("c_name")
    words = P.keyed(customers.withColumn("norm", P.normalize(F.col("c_name"))), ["c_name"], KEY, 8)
    return P.collisions(words.select(F.lit("c_name").alias("column"), F.substring("c_name", 1, 3).alias("token"), "norm"))


_QUASI = "SELECT c_custkey, lower(c_mktsegment) AS a, c_nationkey::VARCHAR AS b, (floor(c_acctbal / 500)::BIGINT)::VARCHAR AS c FROM customer"
_SIZES = f"WITH q AS ({_QUASI}), s AS (SELECT a, b, c, count(*) AS n FROM q GROUP BY a, b, c)"


def _quasi(spark, sf_dir):
    return load(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("a"), F.col("c_nationkey").alias("b"), F.floor(F.col("c_acctbal") / 500).alias("c"))


@query(
    f"""{_SIZES}, t AS (SELECT sum(n)::BIGINT AS n_rows, (count(*) FILTER (n = 1))::BIGINT AS n_unique FROM s)
SELECT n_rows, n_unique, floor(n_unique * 100.0 / n_rows + 0.5)::BIGINT AS percent, CASE WHEN n_unique > 0 THEN n_unique || ' of ' || n_rows || ' rows (' || floor(n_unique * 100.0 / n_rows + 0.5)::BIGINT || '%) are unique on a + b + c.' ELSE 'No row is unique on a + b + c.' END AS verdict FROM t"""
)
def risk_uniqueness(spark, sf_dir):
    return P.uniqueness(_quasi(spark, sf_dir), ["a", "b", "c"])


@query(f"{_SIZES} SELECT a, b, c, n FROM s")
def risk_classes(spark, sf_dir):
    return P.class_sizes(_quasi(spark, sf_dir), ["a", "b", "c"])


@query(f"{_SIZES} SELECT c_custkey, n AS class_size FROM q JOIN s USING (a, b, c)")
def risk_class_of_row(spark, sf_dir):
    return P.with_class_size(_quasi(spark, sf_dir), ["a", "b", "c"]).select("c_custkey", "class_size")
