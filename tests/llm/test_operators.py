"""Each operator against a plain version, on rows that are awkward: null ids and texts, copies, ties, long texts, names that clash."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from veilspark.llm import common, decontaminate, extract, langid, licenses, neardup, packing, pii, quality, repeats, topk
from veilspark.llm.common import Scratch

random.seed(4)
VOCABULARY = [f"w{i}é" if i % 7 == 0 else f"word{i}" for i in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def documents():
    base = prose(120, 1)
    words = base.split()
    near = [" ".join([*words[:i], "changed", *words[i + 1 :]]) for i in range(0, 60, 5)]
    passage = prose(60, 2)
    texts = [base, base, base + " ", *near, None, "", "  ", "one", "one", "One", "a b c", "é" * 150, "x" * 900, "x" * 450, "ab" * 300, passage, "begin " + passage + " end", prose(30, 3) + " " + passage, prose(4000, 5), prose(4000, 5)[:20_000], "\x00\x01\x02 +1 (409) 555-8387 a@b.co"]
    rows = [(i, t) for i, t in enumerate(texts)]
    return [*rows, (3, near[0]), (3, near[0]), (3, "another text under the same id")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"n{i}", "d", 1, 2) for i, t in documents()]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string, doc string, t int, n int")
    return df.repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id < 0")


def nulls(spark):
    return spark.createDataFrame([(None, None), (None, "x" * 300), (None, "x" * 300), (1, "text")], "doc_id long, text string")


def test_cover():
    assert repeats.covers() and len(repeats.COVER) == 12


def test_repeats(docs, empty, spark):
    def rows(df):
        out = repeats.strip(df.select("doc_id", "text", "node")).select("doc.doc_id", "n_bytes", "spans", "kept").collect()
        return sorted((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in out)

    assert rows(docs) == sorted(brute.op1_rows(documents()))
    assert rows(empty) == []
    assert [r[2] for r in repeats.strip(nulls(spark)).select("doc.doc_id", "n_bytes", F.octet_length("kept")).orderBy("n_bytes").collect()] == [0, 4, 0, 0]


@pytest.mark.parametrize("seed", range(4))
def test_repeats_of_shifted_passages(spark, seed):
    r = random.Random(seed)
    common = [bytes(r.choices(b"abcd", k=r.randint(150, 700))).decode() for _ in range(6)]
    rows = [(i, "".join(r.choice([*common, "".join(r.choices("efgh", k=r.randint(1, 300)))]) for _ in range(5))[r.randint(0, 40) :]) for i in range(25)]
    out = repeats.strip(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    got = sorted((x.doc.doc_id, x.n_bytes, sum(s.end - s.start for s in x.spans), len(x.spans), hashlib.sha256(bytes(x.kept)).hexdigest()) for x in out)
    assert got == sorted(brute.op1_rows(rows))


ITEMS = [(1, prose(60, 2)), (2, "one"), (2, "One!"), (3, None), (4, ""), (None, "a b c"), (5, prose(40, 99)), (6, "x" * 450)]


def test_decontamination(docs, empty, spark, monkeypatch):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    def rows(df):
        out = decontaminate.find(df, bench).select("doc.doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256), "contaminated")
        return sorted(map(tuple, out.collect()))

    want = sorted(brute.op2_rows(documents(), ITEMS))
    assert rows(docs) == want and rows(empty) == []
    assert any(r[5] for r in want)
    monkeypatch.setattr(decontaminate, "PATTERN_BYTES", 300)  # several passes
    assert rows(docs) == want
    assert decontaminate.find(docs, bench.where("false")).where("n_hit > 0").count() == 0
    cleaned = decontaminate.clean(docs, bench)
    assert cleaned.columns == docs.columns and cleaned.count() == sum(not r[5] for r in want)


def test_pii(docs, empty, spark):
    r = random.Random(9)
    parts = ["a.b@c.de%x@y.zz", "x@y", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "12345678901234567890", "+1 (409) 555-8387", "+12", "+1   ", "+49 30 1234567-", "word", "é", "\n", " ", "9" * 16, "@", "+"]
    rows = [(i, "".join(r.choices(parts, k=r.randint(0, 12)))) for i in range(300)] + [(i, t) for i, t in documents()] + [(900, "9" * 30_000), (901, "a" * 30_000 + "@"), (902, "1 " * 9 + "+" * 50), (None, "k@l.mn")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = pii.find(df).select("doc.doc_id", pii.listed(F.col("base"))).collect()
    clean = lambda t: t and t.replace("\x01", "\x03").replace("\x02", "\x03")
    assert sorted(((x[0] is None, x[0] or 0, x[1]) for x in out)) == sorted((i is None, i or 0, brute.pii_base(clean(t))) for i, t in rows)
    assert pii.find(empty.select("doc_id", "text")).count() == 0
    red = pii.redact(docs)
    assert red.columns == docs.columns and red.count() == docs.count()
    last = max(i for i, _ in documents())
    assert red.where(F.col("doc_id") == last).first().text == "\x00\x01\x02 [PHONE] [EMAIL]"


def test_bootstrapping_finds_identifiers_behind_confident_words(spark):
    rows = [(i, f"please phone: +1 409 555 {1000 + i} now {prose(5, i)}") for i in range(60)] + [(100, "please phone: 0409-555-777 now"), (101, "room 2024-555 is free")]
    out = {x[0]: x[1] for x in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).select("doc.doc_id", pii.listed(F.col("spans"))).collect()}
    assert out[100] == "phone:14:26" and out[101] == ""


def test_contexts_and_identifiers_of_any_length_are_found(spark):
    """Neither a long word before an identifier nor a long one glued to it is cut."""
    word, glued = "w" * 300, "x" * 65
    rows = [(i, f"{word} call: +1 409 555 {1000 + i} now {prose(5, i)}") for i in range(30)] + [(100, f"a {word} call: 0409-555-777 now"), (101, f"a {word} call: {glued}0409-555-777 now")]
    rows = [(*r, "clash", 1, 2, "k") for r in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, doc string, uid int, i int, kind string")
    out = {x[0]: x[1] for x in pii.find(df).select("doc.doc_id", pii.listed(F.col("spans"))).collect()}
    start = 2 + len(word) + 7
    assert out[100] == f"phone:{start}:{start + 12}" and out[101] == f"phone:{start}:{start + 12 + len(glued)}"


def test_redaction_of_a_table(spark, empty):
    rows = [(1, "mail a.b@c.org now", "x"), (1, "mail a.b@c.org now", "x"), (2, None, "y"), (3, "", "y"), (None, "nothing here", None), (4, "+49 30 1234567" + " long" * 50_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string").repartition(3)
    got = sorted(map(str, pii.redact(df).collect()))
    want = [(i, t and t.replace("a.b@c.org", "[EMAIL]").replace("+49 30 1234567", "[PHONE]"), d) for i, t, d in rows]
    assert got == sorted(map(str, spark.createDataFrame(want, df.schema).collect()))
    assert pii.redact(empty).count() == 0 and pii.redact(empty).columns == empty.columns


def test_language(spark, docs, empty):
    words = {"aa": "alpha beta gamma delta epsilon", "zz": "zulu yankee xray whiskey victor", "mm": "один два три четыре пять"}
    r = random.Random(1)
    rows = [(i, " ".join(r.choices(words[lang].split(), k=12)), lang) for i, lang in enumerate(list(words) * 40)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    test = [(1, "beta gamma alpha"), (2, "yankee victor"), (3, "три два"), (4, None), (5, ""), (6, "123 !?"), (7, "alpha beta " * 20_000), (None, "пять")]
    got = {x.doc.doc_id: (x.lang_pred, x.score) for x in langid.identify(spark.createDataFrame(test, "doc_id long, text string"), model).collect()}
    assert [got[k][0] for k in (1, 2, 3, 4, 5, 6, 7, None)] == ["aa", "zz", "mm", "und", "und", "und", "aa", "mm"]
    assert all(0 <= s <= 1 for _, s in got.values()) and got[4][1] == 0
    assert langid.identify(empty, model).count() == 0
    none = langid.train(empty.select("doc_id", "text", F.lit("x").alias("lang")))
    assert {x.lang_pred for x in langid.identify(docs, none).collect()} == {"und"}


def test_language_sample_counts_different_texts(spark, monkeypatch):
    monkeypatch.setattr(langid, "PER_LANGUAGE", 20)
    seen = {}
    monkeypatch.setattr(langid, "Model", lambda samples: seen.update(samples))
    rows = [("a copy", "hot")] * 5000 + [(prose(5, i), "hot") for i in range(100)] + [(f"rare {i % 10}", "few") for i in range(2000)] + [("long " * 5000 + str(i), "long") for i in range(3)]
    langid.train(spark.createDataFrame(rows, "text string, lang string").repartition(3))
    assert {name: len(set(texts)) for name, texts in seen.items()} == {"hot": 20, "few": 10, "long": 3}
    assert {name: len(texts) for name, texts in seen.items()} == {"hot": 20, "few": 10, "long": 3}


def test_code_lengths_are_those_of_ppm():
    """The tables against contexts walked one byte at a time, with exclusion."""
    texts = {"a": [b"abracadabra", b"banana"], "b": [b"zebra zzz"]}
    model = langid.Model(texts)

    def bits(lang, text):
        counts = {}
        for t in texts[lang]:
            for i in range(len(t)):
                for o in range(langid.ORDER + 1):
                    if i >= o:
                        c = counts.setdefault(t[i - o : i], {})
                        c[t[i]] = c.get(t[i], 0) + 1
        total = 0.0
        for i, byte in enumerate(text):
            def p(context, b):
                seen = counts.get(context, {})
                below = (lambda x: p(context[1:], x)) if context else (lambda x: 1 / 256)
                n, d = sum(seen.values()), len(seen)
                if not n:
                    return below(b)
                left = 1 - sum(below(x) for x in seen)
                if b in seen:
                    return seen[b] / (n + d)
                return d / (n + d) * below(b) / left

            total -= np.log2(p(text[max(0, i - langid.ORDER) : i], byte))
        return total

    for text in (b"abra", b"zebra banana", b"a", b"\xffabc"):
        got = model.code_lengths(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]
        assert got == pytest.approx([bits("a", text), bits("b", text)], rel=1e-4)


def test_packing(docs, empty, spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    odd = ["it's we'll x's't ''s \n'start  a\n\nb \t c\r\n  \n end  ", "日本語 テキスト 123½", "😀 hi <|endoftext|>", " ", "'re 'v", None]
    rows = [(i, t, 5) for i, (_, t) in enumerate(documents())] + [(100 + i, t, 6) for i, t in enumerate(odd)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start long").repartition(3)
    out = packing.pack(df, path).collect()
    by_doc, by_sequence = {}, {}
    for x in out:
        by_doc.setdefault(x.doc.doc_id, []).append(x)
        by_sequence.setdefault(x.sequence_id, []).append(x)
    for i, t, _ in rows:
        want = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        pieces = sorted(by_doc[i], key=lambda x: x.start)
        assert [v for x in pieces for v in struct.unpack(f"<{x.length}I", x.ids)] == want
        assert {x.doc_tokens for x in pieces} == {len(want)} and [x.start for x in pieces] == list(np.cumsum([0, *[x.length for x in pieces]])[:-1])
    for pieces in by_sequence.values():
        pieces.sort(key=lambda x: x.offset)
        assert [x.offset for x in pieces] == list(np.cumsum([0, *[x.length for x in pieces]])[:-1]) and sum(x.length for x in pieces) <= 2048
    assert packing.pack(empty.select("doc_id", "text"), path).count() == 0


def test_packing_in_bounded_memory(docs):
    """Small caches and steps give the same rows; no generation of the cache outgrows its bound."""
    import public_tokenizers

    from veilspark.llm.tokens import Encoder

    path = public_tokenizers.path("byte_bpe_50k.json")
    one = docs.select("doc_id", "text").coalesce(1)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(packing.pack(one, path, entries=7, step=64)) == rows(packing.pack(one, path))
    few, more = Encoder(path, 7), Encoder(path)
    for seed in range(4):
        data = np.frombuffer(prose(60, seed).encode(), np.uint8)
        at = np.array([0, len(data)])
        assert few.encode(data, at)[0].tolist() == more.encode(data, at)[0].tolist()
        assert len(few.cache) <= 7 and len(few.older) <= 7
    assert len(more.cache) > 7


def test_packing_pads_little():
    r = random.Random(3)
    packer = packing.Packer(0)
    total = 0
    for i in range(4000):
        n = int(r.lognormvariate(6, 1)) + 1
        total += n
        packer.add(i, np.zeros(n, "<u4"))
    for w in packer.windows.values():
        packer.emit(w)
    assert packer.next * 2048 < total * 1.03 + packing.OPEN * 2048 and len(packer.gaps) <= packing.OPEN


def test_merged_leftovers_are_full_or_powers_of_two():
    done = packing.merge([(0, 0, np.arange(1500), 1500), (1, 0, np.arange(1900), 1900)], 7)
    sizes = {}
    for _, _, ids, _, seq, _ in done:
        sizes[seq] = sizes.get(seq, 0) + len(ids)
    assert sum(sizes.values()) == 3400 and all(n & (n - 1) == 0 for n in sizes.values()) and min(sizes) == 7


def test_topk(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.normal(0, 0.3, 16).astype(np.float32)]) for i in range(700)]
    rows += [(1000 + i, rows[i][1]) for i in range(150)] + [(2000, None), (2050, [float("nan")] * 16), (2100, [1.0, None] * 8), (2150, [0.5] * 3), (2151, [0.25] * 3), (3000, [1e12] * 16), (3001, [0.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(map(tuple, topk.top_k(df, df.where("vec_id % 50 = 0")).collect()))
    finite = [(i, v) for i, v in rows if v is not None and None not in v and len(v) == 16 and i != 3000]
    three = [(i, v) for i, v in rows if v is not None and len(v) == 3]
    small = [x for x in sorted(brute.op6_rows(finite) + brute.op6_rows(three)) if x[0] != 3000]
    with_big = sorted(brute.op6_rows([*finite, (3000, [1e12] * 16)]) + brute.op6_rows(three))
    assert got == [x for x in with_big] and small
    assert topk.top_k(df.where("false"), df.where("false")).count() == 0


def plain_best(ids, x, query_id, q, k=5):
    return sorted(((-int(s), int(i)) for s, i in zip(x @ q, ids) if i != query_id))[:k]


@pytest.mark.parametrize("scale", [[30, 1, 1, 1, 1, 1, 1, 1], [1] * 8])
def test_topk_reads_lists_until_bounds_exclude_the_rest(scale):
    r = np.random.default_rng(2)
    x = np.floor(256 * r.normal(0, 1, (3000, 8)) * np.array(scale))
    ids = np.arange(3000)
    have = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * 40
    first, second = topk.Lists(ids[:2000], x[:2000]), topk.Lists(ids[2000:], x[2000:])
    for block in (first, second):
        block.best(ids[:40], x[:40], 5, have)
    for c in range(40):
        assert list(zip((-have[c][0]).tolist(), have[c][1].tolist())) == plain_best(ids, x, c, x[c])
    share = (first.read + second.read) / (first.total + second.total)
    assert share < (0.6 if scale[0] > 1 else 0.99) and first.resolved > 0


def test_topk_on_embeddings_table():
    import duckdb

    rows = duckdb.sql("SELECT vec_id, embedding FROM '/root/testdata/sf0.01/embeddings.parquet' ORDER BY vec_id").fetchall()
    ids, x = np.array([i for i, _ in rows]), topk.fixed_point(np.array([v for _, v in rows]))
    asked = np.flatnonzero(ids % 50 == 0)
    have = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(asked)
    lists = topk.Lists(ids, x)
    lists.best(ids[asked], x[asked], 5, have)
    for c, at in enumerate(asked):
        assert list(zip((-have[c][0]).tolist(), have[c][1].tolist())) == plain_best(ids, x, ids[at], x[at])
    assert 0 < lists.read <= lists.total


def test_topk_on_repeated_rows_many_groups_and_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(topk, "GROUP_BYTES", 600)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "LIST_BLOCK", 7)
    rows = [(i, [0.1 * (i % 4), 0.5]) for i in range(60)] + [(7, [0.3, 0.5])] * 3 + [(50, [0.0, 0.5])]
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "vec_id long, embedding array<float>, v int, d int, kind string").repartition(4)
    got = sorted(map(tuple, topk.top_k(df, df.where("vec_id % 50 = 0")).collect()))
    ids, x = np.array([r[0] for r in rows]), topk.fixed_point(np.array([r[1] for r in rows], np.float32))
    want = []
    for q, v in ((0, [0.0, 0.5]), (50, [0.0, 0.5])):
        want += [(q, n, i, -s) for n, (s, i) in enumerate(plain_best(ids, x, q, topk.fixed_point(np.array(v, np.float32))), 1)]
    assert got == sorted(want)


def test_quality(spark, docs, empty):
    r = random.Random(0)
    good = [(i, prose(r.randint(5, 80), i), 1) for i in range(150)]
    bad = [(1000 + i, " ".join(w + "!!" for w in prose(r.randint(5, 80), i).upper().split()), 0) for i in range(150)]
    df = spark.createDataFrame([(i, t) for i, t, _ in good + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in good + bad if i % 4] + [(5000, 1), (None, 1), (6, 7)], "doc_id long, quality int")
    net = quality.train(df, labels)
    got = {x.doc.doc_id: x.score for x in quality.score(df, net).collect()}
    held = [(got[i] >= 0.7) == (y == 1) for i, _, y in good + bad if i % 4 == 0]
    assert sum(held) / len(held) > 0.95
    assert quality.score(docs, net).where(~F.col("score").between(0, 1) | F.col("score").isNull()).count() == 0 and quality.score(docs, net).count() == docs.count()
    assert quality.score(empty, net).count() == 0
    none = quality.train(df, labels.where("false"))
    assert quality.score(docs, none).select("score").distinct().collect()[0][0] == 0.5


def test_chunks_cover_the_document():
    for n in (0, 1, 1023, 1024, 1025, 5000):
        data = np.arange(n).astype(np.uint8)
        chunks, first = quality.chunked(data, np.array([0, n]))
        seen = set()
        for i, c in enumerate(chunks):
            start = i * (quality.CHUNK - quality.OVERLAP)
            part = data[start : start + quality.CHUNK]
            assert (c[: len(part)] == part).all()
            seen |= set(range(start, start + len(part)))
        assert seen == set(range(n)) and first.tolist() == [0, len(chunks)] and len(chunks) >= 1


def test_quality_gradients():
    net = quality.Network()
    r = np.random.default_rng(0)
    chunks, first = quality.chunked(r.integers(97, 101, 3000).astype(np.uint8), np.array([0, 1200, 1300, 3000]))
    y = np.array([1, 0, 1], np.float32)

    def loss():
        p = net.score(chunks, first, net.tables())
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    exact = net.gradients(chunks, first, y)
    for which, at in ((0, (2, 98, 3)), (1, (3,)), (2, (5,)), (3, (0,))):
        p = net.parameters()[which]
        old = p[at]
        p[at] = old + 1e-2
        up = loss()
        p[at] = old - 1e-2
        down = loss()
        p[at] = old
        assert exact[which][at] == pytest.approx((up - down) / 2e-2, abs=2e-3)


def test_licenses(spark, docs, empty):
    mit = dict(licenses.TEXTS)["MIT"]
    rows = [(1, mit), (2, "Copyright (c) 2020 Someone\n" + mit.upper().replace(",", " ,\n")), (3, "x\nReleased under the MIT Licence\nlicensed under CC BY 4.0"), (4, mit + " more"), (5, None), (6, ""), (7, "The MIT License (MIT)\n\n# Copyright 2001 X\n\n" + mit)]
    rows += [(8, "code\n\n * " + dict(licenses.NOTICES)["MPL-2.0"].replace(". ", ".\n * ") + "\n\nmore code"), (9, "// SPDX-License-Identifier: GPL-3.0-or-later\nint x;"), (10, "All rights reserved.\n" + mit)]
    got = {x.doc.doc_id: (x.license, x.lines, x.licenses) for x in licenses.scan(spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, kind string, license int")).collect()}
    assert got[1] == ("MIT", 1, ["MIT"]) and got[2][0] == got[7][0] == got[10][0] == "MIT" and got[3] == (None, 2, ["CC-BY-4.0", "MIT"])
    assert got[4] == got[5] == got[6] == (None, 0, []) and got[8] == (None, 0, ["MPL-2.0"]) and got[9] == (None, 1, ["GPL-3.0"])
    assert licenses.scan(empty).count() == 0 and licenses.scan(docs).count() == docs.count()


def test_equivalent_spellings_fold_side_by_side(spark):
    texts = [("licence licence terms", "license license terms"), ("sub-licence sub licence", "sublicense sublicense"), ("Copyright owner\n", "copyright holder"), ("x\n © 2020 me\n(c) 2021 you\ny", "x y"), ("copyright notice\n", "copyright notice"), ("# Copyright 2020 A\nz", "z")]
    got = spark.createDataFrame(texts, "t string, want string").select(licenses.canonical(F.col("t")).alias("c"), "want").collect()
    assert [r.c for r in got] == [r.want for r in got]


def test_published_licences_are_known(spark):
    """Against the texts that many systems carry."""
    from pathlib import Path

    folder = Path("/usr/share/common-licenses")
    files = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "BSD": "BSD-3-Clause"}
    rows = [(name, "\ufeff\n" + (folder / f).read_text().replace(" ", "  ")) for f, name in files.items() if (folder / f).exists()]
    if not rows:
        pytest.skip("no licence texts on this system")
    assert all(r.doc.doc_id == r.license for r in licenses.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect())


def test_near_duplicates(docs, empty, spark):
    def rows(df):
        return sorted((r.key, r.n, r.group) for r in neardup.groups(df).collect())

    want = sorted((d, n, g) for d, n, g, _ in brute.op9_rows(documents()))
    assert rows(docs) == want and rows(empty) == []
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} >= {g for _, _, g in want}
    no_ids = nulls(spark)
    assert sorted((r.n, r.group is None) for r in neardup.groups(no_ids).collect()) == [(0, True), (1, False), (1, True), (1, True)]


def test_one_row_of_each_group_is_kept(spark):
    a, b = prose(120, 1), prose(60, 2)
    near = a.replace(a.split()[5], "changed", 1)
    rows = [(1, a)] * 5 + [(1, near), (2, a), (None, a), (3, "alone")] + [(None, b)] * 4 + [(4, None), (4, None)]
    kept = neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    left = [(r.doc_id, r.text) for r in kept]
    assert len(left) == 5 and left.count((None, b)) == 1 and left.count((3, "alone")) == 1 and left.count((4, None)) == 2
    assert sum(left.count((1, t)) for t in (a, near)) == 1


@pytest.mark.parametrize("block", [2, 512])
def test_near_duplicates_in_dissimilar_bands(spark, monkeypatch, block):
    """Many texts share a passage, few of them are near copies: what the first rounds leave must be found in blocks."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    passage = prose(30, 50)
    rows = []
    for i in range(40):
        own = prose(45, 100 + i)
        rows.append((2 * i, passage + " " + own))
        if i % 3 == 0:
            words = own.split()
            words[20] = "other"
            rows.append((2 * i + 1, passage + " " + " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.key, r.n, r.group) for r in neardup.groups(df).collect()) == sorted((d, n, g) for d, n, g, _ in brute.op9_rows(rows))


def test_links_at_the_threshold_are_found(spark):
    """A pair of texts that share 3 of 4 shingles exactly, 300 times: recall where it is least."""
    rows = []
    for i in range(300):
        words = [f"{i}x{k}" for k in range(144)]  # 140 shingles; 20 of each text are its own: 120 of 160 are shared
        rows += [(2 * i, " ".join([*words[:-20], *(f"{i}a{k}" for k in range(20))])), (2 * i + 1, " ".join([*words[:-20], *(f"{i}b{k}" for k in range(20))]))]
    found = neardup.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {(r.key, r.group) for r in found} == {(k, k - k % 2) for k, _ in rows}


def test_blocks_compare_each_pair_once(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 3)
    monkeypatch.setattr(neardup, "most_bits", lambda: neardup.SKETCH)
    comps = [0] * 10 + [1] * 3 + [2] * 2 + [3, 4, 5, 6]  # two bands: the second holds every other node
    nodes = [(i, [7, 9 if i % 2 else 100 + i] + [1000 * b + i for b in range(2, neardup.BANDS)], [0] * neardup.WORDS) for i in range(len(comps))]
    nodes = spark.createDataFrame(nodes, "node long, bands array<long>, sketch array<long>")
    state = [(7, i, 10, 10, c) for i, c in enumerate(comps)] + [(9, i, 10, 10, c) for i, c in enumerate(comps) if i % 2]
    rows = neardup.candidates(spark.createDataFrame(state, "band long, node long, n int, s int, comp long"), nodes, Scratch(spark)).where("node is null").collect()
    got = [p for r in rows for p in struct.iter_unpack("<2q", bytes(r.pairs))]
    assert sorted((min(p), max(p)) for p in got) == [(i, j) for i in range(len(comps)) for j in range(i + 1, len(comps)) if comps[i] != comps[j]]


def thue_morse(n, letters="ab"):
    return "".join(letters[i.bit_count() % 2] for i in range(n))


def test_texts_of_simple_structure_differ(spark):
    """A Thue-Morse word and its complement have equal values under any polynomial hash modulo a power of two."""
    import public_tokenizers
    from tokenizers import Tokenizer

    a, b = thue_morse(8192), thue_morse(8192, "ba")
    assert len({int(x) for x in common.span_hash(np.frombuffer((a + b).encode(), np.uint8), np.array([0, 8192]), np.array([8192, 16384]))}) == 2
    df = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string").coalesce(1)
    assert {(r.key, r.group) for r in neardup.groups(df).collect()} == {(1, 1), (2, 2)}
    bench = spark.createDataFrame([(1, a)], "item_id long, text string")
    assert {(r.doc.doc_id, r.n_hit) for r in decontaminate.find(df, bench).collect()} == {(1, 1), (2, 0)}
    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    for r in spark.createDataFrame(packing.pack(df, path).toPandas()).groupBy("doc.doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "ids"))).alias("p")).collect():
        assert struct.unpack(f"<{len(b''.join(bytes(x.ids) for x in r.p)) // 4}I", b"".join(bytes(x.ids) for x in r.p)) == (*own.encode({1: a, 2: b}[r.doc_id], add_special_tokens=False).ids, 1)
    words = [(i, thue_morse(256, x) * 2 + str(i)) for i, x in enumerate(("ab", "ba", "cd", "dc", "ab"))]
    out = repeats.strip(spark.createDataFrame(words, "doc_id long, text string").repartition(2)).collect()
    assert sorted((x.doc.doc_id, x.n_bytes, sum(s.end - s.start for s in x.spans), len(x.spans), hashlib.sha256(bytes(x.kept)).hexdigest()) for x in out) == sorted(brute.op1_rows(words))


def test_equal_hashes_are_compared_by_bytes(monkeypatch):
    monkeypatch.setattr(common, "block_hash", lambda block, turn, first, size: np.zeros(len(first), np.uint64))
    data = np.frombuffer(b"one two one three tw", np.uint8)
    start, end = np.array([0, 4, 8, 12, 18]), np.array([3, 7, 11, 17, 20])
    where, which = common.distinct_spans(data, start, end)
    assert [bytes(data[start[where[w]] : end[where[w]]]) for w in which] == [b"one", b"two", b"one", b"three", b"tw"]


def test_odd_sketches_estimate():
    r = np.random.default_rng(5)
    for share in (0.6, 0.75, 0.9):
        both = r.integers(0, 2**63, 1000, dtype=np.uint64)
        n = int(1000 * (1 - share) / share / 2) if share < 1 else 0
        a, b = (np.unique(np.concatenate([both, r.integers(0, 2**63, n, dtype=np.uint64)])) for _ in range(2))
        true = 1000 / (len(a) + len(b) - 1000)
        s = neardup.odd_sketches(neardup.samples(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])))
        differ = int(np.bitwise_count(s[0] ^ s[1]).sum())
        k = neardup.SKETCH
        assert 1 + k / (4 * neardup.PERMUTATIONS) * np.log(1 - 2 * differ / k) == pytest.approx(true, abs=0.12)


PAGE = '<html lang="en"><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><header>Site name</header><nav><ul><li><a href="/a">Menu {i}</a></li></ul></nav><div class="ad">Buy {i}</div><div class="cookie-notice">We use cookies</div><article><h1>Head {i}</h1><p><b>First {i} &amp; more.<br><p>Second\n  {i}.</p><form><input>Your mail</form><p class="share-buttons">Share this</p><p>Read our rules</p></article><aside>Side {i}</aside><section id="comments"><p>Reader says {i}</p></section><footer>&copy; end</footer></body></html>'


def test_extraction(spark, empty):
    rows = [(i, f"https://x.example/{i}", PAGE.format(i=i)) for i in range(30)] + [(100, "u", None), (101, None, ""), (102, "https://y.example", "<p>a<p>b&nbsp;c<div>d</div>"), (103, "https://z.example/", "plain &lt;text&gt;"), (5, "https://x.example/5", PAGE.format(i=5))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = extract.extract(df.withColumn("text", F.lit("clash"))).select("doc.page_id", "text").collect()
    by = {r.page_id: r.text for r in got}
    assert len(got) == len(rows)
    assert by[7] == "Head 7 First 7 & more. Second 7."  # the constant "Read our rules" is template
    assert by[100] == by[101] == "" and by[102] == "a b c d" and by[103] == "plain <text>"
    assert extract.extract(df.where("false")).count() == 0


def texts_of(spark, rows, partitions=3):
    """page_id -> text of rows (page_id, url, html)."""
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(partitions)
    return {r.page_id: r.text for r in extract.extract(df).select("doc.page_id", "text").collect()}


def test_extraction_counts_copies_once_over_all_tasks(spark):
    rows = [(i, "https://one.example/", "<p>The only page of its host.</p>") for i in range(40)]
    assert set(texts_of(spark, rows, 20).values()) == {"The only page of its host."}


def test_extraction_compares_whole_texts(spark):
    start = "A standing introduction of many words. " * 8
    rows = [(i, "https://x.example/", f"<div>{start}News {i}.</div>") for i in range(8)]
    assert texts_of(spark, rows) == {i: f"{start}News {i}." for i in range(8)}


def test_extraction_holds_large_templates(spark):
    letters = "bcdfghjklmnpqrtvwxyz"
    entries = "".join(f'<div class="{a}{b}q">Entry {a}{b}</div>' for a in letters for b in letters)
    rows = [(i, "https://x.example/", f"<h2>Top</h2>{entries}<h3>End</h3><p>News {i}.</p>") for i in range(8)]
    assert texts_of(spark, rows) == {i: f"News {i}." for i in range(8)}


def test_extraction_counts_texts_over_all_pages(spark):
    rows = [(10 * h + i, f"https://h{h}.example/", f"<p>News {h} {i}.</p><h2>{'Old' if i == 0 else 'New'} rules apply</h2>") for h in range(40) for i in range(6)]
    assert texts_of(spark, rows) == {10 * h + i: f"News {h} {i}." + " Old rules apply" * (i == 0) for h in range(40) for i in range(6)}


def neutral_page(i, words=40):
    """Nothing but div elements without a name: a menu, a varying box, the article, a varying note and a footer."""
    menu = "".join(f'<div><a href="/{i}{k}">Link {i} {k}</a></div>' for k in range(5))
    body = "".join(f"<div>{prose(words, 10 * i + k)}.</div>" for k in range(4))
    return f"<html><body><div>{menu}</div><div><div>Buy {i}!</div></div><div><h1>Head {i}</h1>{body}</div><div><div>Note {i}</div></div><div>End of page</div></body></html>"


def test_content_in_neutral_elements(spark):
    rows = [(i, "https://x.example/", neutral_page(i)) for i in range(12)]
    got = texts_of(spark, rows)
    assert got == {i: " ".join([f"Head {i}", *(prose(40, 10 * i + k) + "." for k in range(4))]) for i in range(12)}


def test_the_wrapper_alone_finds_articles(monkeypatch):
    """On hosts with enough pages, without word list, ``article``, or tags that say what they hold."""
    import html
    import json
    from collections import defaultdict

    import duckdb

    for name, value in (("NOISE", re.compile("(?!)")), ("MAIN", frozenset()), ("DROP", extract.RAW | {"head"})):
        monkeypatch.setattr(extract, name, value)
    extract.deep()
    hosts = defaultdict(dict)
    for url, source in duckdb.sql("SELECT url, html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall():
        hosts[url.split("/")[2]][source] = None
    right = total = 0
    for pages in (list(x) for x in hosts.values() if len(x) >= extract.MIN_PAGES):
        trees = [extract.folded(extract.parse(x)) for x in pages]
        wrapper = trees[0]
        for tree in trees[1:]:
            wrapper = extract.laid(wrapper, tree)
        raw = json.dumps(wrapper)
        found = defaultdict(list)
        for tree in trees:
            for node, digest, chars in extract.texts_at(tree, extract.numbered(raw)):
                found[node].append((digest, chars))
        counted = []
        for node, seen in found.items():
            most = max((d for d, _ in seen), key=lambda d: sum(x == d for x, _ in seen))
            same = bool(most) and len(seen) >= extract.MIN_PAGES and sum(x == most for x, _ in seen) >= extract.CONSTANT * len(seen)
            counted.append({"node": node, "digest": most if same else None, "chars": 0 if same else sum(c for _, c in seen)})
        done = extract.finished(raw, json.dumps(counted))
        for source in pages:
            article = re.search(r"<article>(.*?)(?:</article>|<footer>)", source, re.S)[1]
            blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)[^>]*>", article))
            total += 1
            right += extract.extract_page(source, done) == " ".join(b for b in blocks if b)
    assert total > 100 and right >= 0.95 * total


def test_two_containers_of_text_are_both_content(spark):
    page = lambda i: f"<body><div><a href='/{i}'>Menu {i}</a></div><div><div><p>{prose(30, i)}</p></div><div><p>{prose(60, 100 + i)}</p></div><div><p>{i}!</p></div></div><div><p>By {i}</p></div></body>"
    rows = [(i, "https://x.example/", page(i)) for i in range(8)]
    assert texts_of(spark, rows) == {i: f"{prose(30, i)} {prose(60, 100 + i)} {i}!" for i in range(8)}


def test_deep_pages(spark):
    """As deep as 10,000 elements, in texts and in breaks like shallow ones."""
    deep = "<div>" * 10_000 + "a<b>b</b>c<div>d</div>e<div class='comments'><i>x</i></div>" + "</div>" * 5_000 + "f" + "</div>" * 5_000 + "<p>gN</p><p>end</p>"
    rows = [(i, "https://x.example/", deep.replace("f", f"f{i}").replace("N", str(i))) for i in range(6)] + [(9, "https://y.example/", "<i>" * 100_000 + "z" + "</i>" * 100_000)]
    got = texts_of(spark, rows)
    assert got == {**{i: f"abc d e f{i} g{i} end" for i in range(6)}, 9: "z"}


def test_wide_pages_align_quickly():
    a = [[f"x{i}", 1, 0, "", [], 0] for i in range(20_000)]
    b = [[f"x{i}", 1, 0, "", [], 0] for i in range(20_000) if i % 7] + [["y", 1, 0, "", [], 0]]
    pairs = extract.match(a, b)
    assert len(pairs) == len(b) - 1 and all(a[i][0] == b[j][0] for i, j in pairs)


def test_matching_is_the_heaviest():
    def plain(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                pair = best[i][j] + 1 + plain(x[4], y[4]) if x[0] == y[0] else 0
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], pair)
        return best[-1][-1]

    r = random.Random(3)
    tree = lambda d: [r.choice("abc"), 1, 0, "", [tree(d - 1) for _ in range(r.randint(0, 4))] if d else [], 0]
    for _ in range(60):
        a, b = tree(3), tree(3)
        pairs = extract.match(a[4], b[4])
        assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:]))
        assert sum(extract.weight(a[4][i], b[4][j]) for i, j in pairs) == plain(a[4], b[4])


def test_wrappers_keep_what_most_pages_have():
    page = lambda i: extract.folded(extract.parse(f"<h2>Top</h2><div class='{'ab'[i > 100]}'>x</div>" + "".join(f"<p class='{chr(97 + i % 26)}{chr(97 + i // 26)}{c}'>y</p>" for c in "klm")))
    wrapper = page(0)
    for i in range(1, 600):
        wrapper = extract.laid(wrapper, page(i))
        if wrapper[extract.PAGES] % extract.WIDTH == 0:
            wrapper = extract.pruned(wrapper)
    kept = {c[extract.LABEL]: c[extract.PAGES] for c in wrapper[extract.CHILDREN]}
    assert kept["h2"] == 600 and kept["div b"] == 499 and len(kept) < 500


def test_tree_matching():
    a, b = (extract.folded(extract.parse(x)) for x in ("<div><p>1</p><ul><li>x</li></ul><span>s</span></div>", "<div><h2>n</h2><p>2</p><ul><li>x</li><li>y</li></ul></div>"))
    assert extract.match(a[extract.CHILDREN], b[extract.CHILDREN]) == [(0, 0)]
    inner = extract.match(a[4][0][4], b[4][0][4])
    assert [(a[4][0][4][i][0], b[4][0][4][j][0]) for i, j in inner] == [("p", "p"), ("ul", "ul")]


def test_scratch_is_in_the_shared_folder(spark):
    s = Scratch(spark)
    kept = s.keep(spark.range(3), "x")
    assert kept.count() == 3 and s.root in kept.inputFiles()[0]
    since = s.made
    y, z = s.keep(spark.range(4), "y"), s.keep(spark.range(5), "z")
    s.drop(since, "z")
    assert kept.count() == 3 and z.count() == 5 and len(s.paths) == 2 and not any("/y-" in p for p in s.paths)
