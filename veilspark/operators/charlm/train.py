"""Training, evaluation and generation on DataFrames.

Stochastic gradient descent depends on its order, so one model is trained by one task; Spark trains many, one a group.
Evaluation and generation are spread over all windows or seeds, with the weights broadcast.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .model import Model, epoch, evaluate, generate
from .rng import Rng

HISTORY = "epoch int, loss double, held_out double, weights string, sample string, error string"


@dataclass(frozen=True)
class Settings:
    context: int = 8
    dim: int = 32
    epochs: int = 500
    rate: float = 0.2
    batch: int = 32
    clip: float = 1.0
    seed: int = 42
    holdout: float = 0.0
    evaluate_every: int = 10
    sample_seed: str = ""

    def checked(self) -> Settings:
        if self.context < 1 or self.dim < 1 or self.epochs < 1 or not self.rate > 0 or self.batch < 1:
            raise ValueError("those settings do not make sense")
        return self


def windows_of(ids: list[int], context: int) -> tuple[np.ndarray, np.ndarray]:
    n = max(0, len(ids) - context)
    at = np.arange(n)[:, None] + np.arange(context)
    codes = np.asarray(ids, int)
    return (codes[at], codes[at + 1]) if n else (np.zeros((0, context), int),) * 2


def train_text(text: str, s: Settings) -> list[dict]:
    """History rows of one model: one an epoch; the last one carries the weights and a sample. A loss that isn't finite ends it."""
    chars = sorted(set(text))
    if len(chars) < 2:
        raise ValueError("the text needs at least two different characters")
    if len(text) <= s.context + 1:
        raise ValueError("the text is shorter than the context window")
    rng = Rng(s.seed)
    m = Model.fresh(chars, s.context, s.dim, rng)
    x, y = windows_of(m.encode(text), s.context)
    cut = int(len(x) * (1 - s.holdout)) if s.holdout > 0 and len(x) >= 20 else len(x)
    rows = []
    for i in range(1, s.epochs + 1):
        value = epoch(m, x[:cut], y[:cut], s.batch, s.rate, s.clip, rng)
        held = None
        if cut < len(x) and (i % s.evaluate_every == 0 or i == s.epochs):
            total, n = evaluate(m, x[cut:], y[cut:])
            held = total / n
        rows.append({"epoch": i, "loss": value, "held_out": held, "weights": None, "sample": None})
        if not np.isfinite(value):
            break
    about = asdict(s) | {"windows": cut, "held_out_windows": len(x) - cut, "epochs_done": len(rows), "final_loss": rows[-1]["loss"]}
    rows[-1] |= {"weights": m.to_json(about), "sample": generate(m, s.sample_seed, 60, 0.8, Rng(1)) if np.isfinite(rows[-1]["loss"]) else None}
    return rows


def train(df: DataFrame, key: str, text: str, settings: Settings = Settings()) -> DataFrame:
    """(key, HISTORY): one model a key, from its texts in order; a group whose text can't train one has a row with the error and nothing else."""
    s = settings.checked()

    def run(k, pdf: pd.DataFrame) -> pd.DataFrame:
        joined = "\n".join(sorted(t for t in pdf[text] if t))
        try:
            rows = [r | {"error": None} for r in train_text(joined, s)]
        except ValueError as e:
            rows = [{"epoch": None, "loss": None, "held_out": None, "weights": None, "sample": None, "error": str(e)}]
        out = pd.DataFrame(rows, columns=["epoch", "loss", "held_out", "weights", "sample", "error"]).astype({"epoch": "Int32"})
        out.insert(0, key, k[0])
        return out

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).groupBy(key).applyInPandas(run, f"{key} {kind}, {HISTORY}")


def mean_loss(windows: DataFrame, weights: str, x: str = "x", y: str = "y") -> DataFrame:
    """One row (loss, n): partial sums by batch, weights broadcast; the mean over no windows is null."""
    frozen = windows.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        m = Model.from_json(frozen.value)
        for pdf in batches:
            if len(pdf):
                total, n = evaluate(m, np.stack(pdf[x].to_list()), np.stack(pdf[y].to_list()))
                yield pd.DataFrame({"total": [total], "n": [n]})

    sums = windows.select(x, y).mapInPandas(run, "total double, n long").agg(F.sum("total").alias("total"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return sums.select((F.col("total") / F.nullif(F.col("n"), F.lit(0))).alias("loss"), "n")


def continued(seed: Column, weights: str, n: int = 60, temperature: float = 0.8, rng_seed: int = 1) -> Column:
    """Each seed with n generated characters; every row draws from a generator of its own."""
    Model.from_json(weights)

    @pandas_udf("string")
    def run(seeds: pd.Series) -> pd.Series:
        m = Model.from_json(weights)
        return seeds.map(lambda s: generate(m, s or "", n, temperature, Rng(rng_seed)))

    return run(seed)
