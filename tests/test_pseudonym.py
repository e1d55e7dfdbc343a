import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from veilspark.operators import pseudonym as P
from veilspark.sources import csvkit

SAMPLE = 'holder,contact,zip,born,plan,visits\nMaría Ruiz,m.ruiz@mail.test,90012,1975-11-30,gold,3\n"Okafor, Chidi",chidi@mail.test,90012,1990-02-14,basic,8\nmaría  RUIZ,M.RUIZ@mail.test,90013,1975-11-30,gold,1\n'
HEADER = "holder contact zip born plan visits".split()


@pytest.fixture
def table(spark):
    rows = csvkit.rows_of(SAMPLE)
    assert rows[0] == HEADER
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows[1:])], "_row long, " + ", ".join(f"{c} string" for c in HEADER))


def test_keyed(table):
    key = P.derive_key("four words of spring", b"a salt of ours", rounds=500)
    assert key == hashlib.pbkdf2_hmac("sha256", b"four words of spring", b"a salt of ours", 500)
    got = P.keyed(table, ["holder", "contact"], key).orderBy("_row").collect()
    want = lambda column, value: hmac.new(key, f"{column}\0{value}".encode(), "sha256").hexdigest()[:16]
    assert [r["holder"] for r in got] == [want("holder", v) for v in ("maría ruiz", "okafor, chidi", "maría ruiz")]
    assert [r["contact"] for r in got] == [want("contact", v) for v in ("m.ruiz@mail.test", "chidi@mail.test", "m.ruiz@mail.test")]


def test_tokens_and_back(table):
    words = P.dictionary(table, ["holder", "contact"], "_row")
    assert {(r["column"], r["token"], r["original"]) for r in words.collect()} == {("holder", "HOLDER-0001", "María Ruiz"), ("holder", "HOLDER-0002", "Okafor, Chidi"), ("contact", "CONTACT-0001", "m.ruiz@mail.test"), ("contact", "CONTACT-0002", "chidi@mail.test")}
    out = P.tokens(table, ["holder", "contact"], words).orderBy("_row")
    assert [r["holder"] for r in out.collect()] == ["HOLDER-0001", "HOLDER-0002", "HOLDER-0001"]
    assert [r["contact"] for r in P.reidentify(out, "contact", words).orderBy("_row").collect()] == ["m.ruiz@mail.test", "chidi@mail.test", "m.ruiz@mail.test"]
    assert tuple(P.replaced(table, ["holder", "contact"]).first()) == (4, 2, 3)


def test_equal_order_values_and_clashing_names(spark):
    rows = [(1, f"v{i % 7}", "n", "t", "row", "p", "o") for i in range(70)]
    df = spark.createDataFrame(rows, "at long, `a.b` string, n string, t string, row string, p string, all string").repartition(5)
    words = P.dictionary(df, ["a.b", "row"], "at")
    assert sorted((r["norm"], r["token"]) for r in words.where("column = 'a.b'").collect()) == [(f"v{i}", f"A-B-000{i + 1}") for i in range(7)]
    out = P.tokens(df, ["a.b", "row"], words)
    assert out.columns == df.columns and {tuple(r)[2:] for r in out.collect()} == {("n", "t", "ROW-0001", "p", "o")}
    back = P.reidentify(P.reidentify(out, "a.b", words), "row", words)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    sized = P.with_class_size(df, ["a.b", "n"])
    assert sized.columns == [*df.columns, "class_size"] and {r.class_size for r in sized.collect()} == {10}
    assert P.dictionary(df.where("false"), ["n"], "at").count() == 0


def test_more_than_9999_tokens(spark):
    df = spark.range(10_050).select("id", F.concat(F.lit("v"), F.col("id")).alias("v"))
    words = P.dictionary(df, ["v"], "id")
    assert words.select("token").distinct().count() == 10_050
    assert words.where("norm = 'v10004'").first()["token"] == "V-10005"


def test_risk(table):
    got = P.uniqueness(table, ["zip", "born", "plan"]).first()
    assert (got.n_rows, got.n_unique, got.percent) == (3, 3, 100) and got.verdict == "3 of 3 rows (100%) are unique on zip + born + plan."
    assert P.uniqueness(table, ["plan"]).first().percent == 33
    assert P.uniqueness(table.where("false"), ["plan"]).first().percent == 0


def test_empty_and_null_stay_empty(spark):
    df = spark.createDataFrame([("",), (None,), ("  ",), ("x",)], "v string")
    got = [r[0] for r in P.keyed(df, ["v"], b"k").collect()]
    assert got[:3] == ["", "", "  "] and len(got[3]) == 16


def test_slugs():
    assert P.slugs(["a b", "a-b", "", "**", None]) == ["A-B", "A-B-2", "COL3", "COL4", "COL5"]
    with pytest.raises(ValueError):
        P.derive_key("")
