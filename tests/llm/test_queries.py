"""The contract's queries against plain versions and SQL on the smallest tables, and the pipeline stage by stage."""

import zlib

import duckdb
import pytest

import brute
import corpus_pipeline
from veilspark.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    return {t: duckdb.sql(f"SELECT * FROM '{DATA}/{t}.parquet'").fetchall() for t in ("documents", "benchmark", "embeddings", "pages", "labels")}


@pytest.fixture(scope="module")
def docs(tables):
    return [(r[0], r[1]) for r in tables["documents"]]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "pages"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = c.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(x) for x in columns]
    assert sorted((tuple(r[x] for x in columns) for r in df.collect()), key=str) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)


@pytest.mark.parametrize("name,plain", [("op1_repeats", brute.op1_rows), ("op9_neardup", brute.op9_rows)])
def test_plain(spark, docs, name, plain):
    assert sorted(map(tuple, QUERIES[name](spark, DATA).collect())) == sorted(plain(docs))


def test_pii(spark, docs):
    import hashlib

    texts = dict(docs)
    for r in QUERIES["op3_pii"](spark, DATA).collect():
        base = brute.pii_base(texts[r.doc_id])
        assert hashlib.sha256(base.encode()).hexdigest() == r.base_sha256
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [base.count(k) for k in ("email:", "ip:", "card:", "phone:")]


def test_language_and_quality_on_held_out_rows(spark, tables):
    lang = {r[0]: r[2] for r in tables["documents"]}
    rows = QUERIES["op4_language"](spark, DATA).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)
    assert len(QUERIES["op7_quality"](spark, DATA).collect()) == len(lang)


def test_extraction(spark, tables):
    rows = {r.page_id: r for r in QUERIES["op10_extract"](spark, DATA).collect()}
    assert len(rows) == len(tables["pages"]) and all(r.n_chars == len(r.text) for r in rows.values())
    import html as h
    import re

    for page_id, _, source in tables["pages"]:
        article = re.search(r"<article>(.*?)(?:</article>|<footer>)", source, re.S)[1]
        blocks = (" ".join(h.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)[^>]*>", article))
        assert rows[page_id].text == " ".join(b for b in blocks if b)


def test_pipeline(spark, tables):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    n = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        n.append(docs.count())
    assert n[1] == n[0] and n[2] < n[1] and n[3] < n[2] and n[4] == n[3]
    left = docs.collect()
    texts = dict((r[0], r[1]) for r in tables["documents"])
    groups = {d: g for d, _, g, _ in brute.op9_rows(list(texts.items()))}
    assert all(groups[r.doc_id] == r.doc_id for r in left)
    assert not any(r[5] for r in brute.op2_rows([(r.doc_id, texts[r.doc_id]) for r in left], [(r[0], r[1]) for r in tables["benchmark"]]))
    assert not any(brute.pii_base(r.text) for r in left) and all(r.n_chars == len(r.text) for r in left)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in left}
