import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.operators.charlm import model as M
from veilspark.operators.charlm import text as T
from veilspark.operators.charlm import train as R
from veilspark.operators.charlm.rng import Rng

TEXT = "the cat sat on the mat and the dog sat on the log. " * 6


def test_rng():
    r = Rng(42)
    assert [r.next() for _ in range(3)] == [0.6011037519201636, 0.44829055899754167, 0.8524657934904099]
    assert Rng(0).next() == Rng(1).next() and sorted(Rng(5).order(9)) == list(range(9))


def test_gradients():
    assert M.gradient_check(7) < 1e-4


def fresh(context=8, dim=16, seed=3):
    return M.Model.fresh(sorted(set(TEXT)), context, dim, Rng(seed))


def test_causal():
    m = fresh()
    a, b = np.array([[1, 2, 3, 4, 5, 6, 7, 8]]), np.array([[1, 2, 3, 4, 5, 9, 10, 11]])
    assert np.abs(m.forward(a)["logits"][0, :5] - m.forward(b)["logits"][0, :5]).max() < 1e-12


def test_loss_starts_at_guessing_and_drops():
    m = fresh()
    x, y = R.windows_of(m.encode(TEXT), 8)
    total, n = M.evaluate(m, x, y)
    assert abs(total / n - np.log(len(m.chars))) < 0.1
    rng = Rng(3)
    losses = [M.epoch(m, x, y, 32, 0.05, 1.0, rng) for _ in range(30)]
    assert losses[-1] < 0.9 * total / n


def test_generate():
    m = fresh()
    out = M.generate(m, "the cat", 40, 0.8, Rng(1))
    assert len(out) == 47 and out.startswith("the cat") and set(out) <= set(m.chars)
    assert len(M.generate(m, "~~~", 5, 0.8, Rng(1))) == 6


def test_clip():
    g = {"a": np.full(24, 10.0)}
    assert M.clip(g, 0) == pytest.approx(np.sqrt(2400)) and g["a"][0] == 10
    assert M.clip(g, 1) == pytest.approx(np.sqrt(2400)) and np.linalg.norm(g["a"]) == pytest.approx(1)


def test_json():
    m = fresh()
    again = M.Model.from_json(m.to_json({"epochs": 1}))
    assert again.chars == m.chars and all((again.weights[k] == w).all() for k, w in m.weights.items())
    for bad in ("{}", '{"format": "x"}', m.to_json().replace('"b1": [', '"b1": [0.0, ')):
        with pytest.raises(ValueError):
            M.Model.from_json(bad)


def test_parameters(spark):
    row = spark.range(1).select(T.parameters(F.lit(33), F.lit(8), F.lit(16)), T.parameters(F.lit(33), F.lit(8), F.lit(32))).first()
    assert tuple(row) == (3313, 10689)
    assert M.Model.fresh([chr(40 + i) for i in range(33)], 8, 16, Rng(1)).size == 3313


def test_training_by_group(spark):
    df = spark.createDataFrame([("a", TEXT), ("b", TEXT.upper()), ("c", "xx"), ("d", None)], "k string, t string")
    out = R.train(df, "k", "t", R.Settings(epochs=4, dim=8, rate=0.1, holdout=0.1)).collect()
    assert {r.k: r.error for r in out if r.error} == {"c": "the text needs at least two different characters", "d": "the text needs at least two different characters"}
    out = [r for r in out if not r.error]
    assert {r.k for r in out} == {"a", "b"} and len(out) == 8
    last = next(r for r in out if r.k == "a" and r.epoch == 4)
    assert last.held_out is not None and len(last.sample) == 61
    rows = T.windows(df.where("k = 'a'").withColumn("ids", T.encode(F.col("t"), T.text_vocabulary(F.col("t")))), "ids", 8, ["k"])
    got = R.mean_loss(rows, last.weights).first()
    m = M.Model.from_json(last.weights)
    total, n = M.evaluate(m, *R.windows_of(m.encode(TEXT), 8))
    assert got.n == n and got.loss == pytest.approx(total / n)
    assert R.mean_loss(rows.where("false"), last.weights).first().loss is None
    assert len(spark.range(2).select(R.continued(F.lit("the"), last.weights, 5)).collect()[0][0]) == 8


def test_query_trains_on_all_items(spark, monkeypatch):
    from veilspark.plans import charlm

    seen = []
    monkeypatch.setattr(charlm.R, "train", lambda items, key, text, settings: seen.append(items))
    charlm._trained(spark, "/root/testdata/sf0.01")
    every = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    assert seen[0].select("item_id").exceptAll(every.select("item_id")).isEmpty() and seen[0].count() == every.count() > 8
    assert seen[0].select("part").distinct().count() > 1


def test_blow_up_ends_training():
    rows = R.train_text(TEXT, R.Settings(epochs=50, dim=8, rate=1e6, clip=0))
    assert len(rows) < 50 and not np.isfinite(rows[-1]["loss"])


def test_bad_settings(spark):
    with pytest.raises(ValueError):
        R.Settings(rate=0).checked()
