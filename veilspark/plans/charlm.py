"""Character language models over documents and benchmark items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.charlm import text as T
from ..operators.charlm import train as R
from .registry import load, query

_VOCAB = "(SELECT list(DISTINCT c ORDER BY c) AS v FROM (SELECT unnest(string_split(text, '')) AS c FROM documents))"


@query("SELECT char, (row_number() OVER (ORDER BY char) - 1)::INT AS idx FROM (SELECT DISTINCT unnest(string_split(text, '')) AS char FROM documents) WHERE char <> ''")
def lm_vocabulary(spark, sf_dir):
    return T.vocabulary(load(spark, sf_dir, "documents"), "text")


_ITEMS = "(SELECT item_id, text, list_sort(list_distinct(string_split(text, ''))) AS v FROM benchmark)"


@query(f"SELECT item_id, list_transform(string_split(text, ''), lambda c: (list_position(v, c) - 1)::INT) AS ids, text AS decoded FROM {_ITEMS}")
def lm_encode(spark, sf_dir):
    items = load(spark, sf_dir, "benchmark").withColumn("v", T.text_vocabulary(F.col("text"))).withColumn("ids", T.encode(F.concat(F.col("text"), F.lit("☃")), F.col("v")))
    return items.select("item_id", "ids", T.decode(F.col("ids"), F.col("v")).alias("decoded"))


_IDS = f"(SELECT item_id, list_transform(string_split(text, ''), lambda c: (list_position(v, c) - 1)::INT) AS ids FROM {_ITEMS})"


def _windows(spark, sf_dir, context=8):
    items = load(spark, sf_dir, "benchmark").withColumn("ids", T.encode(F.col("text"), T.text_vocabulary(F.col("text"))))
    return T.windows(items.withColumn("n", F.size("ids")), "ids", context, ["item_id", "n"])


@query(f"SELECT item_id, i, ids[i + 1:i + 8] AS x, ids[i + 2:i + 9] AS y FROM (SELECT item_id, ids, unnest(range(len(ids) - 8)) AS i FROM {_IDS} WHERE len(ids) > 8)")
def lm_windows(spark, sf_dir):
    return _windows(spark, sf_dir).drop("n")


@query(f"SELECT item_id, (n >= 20 AND i >= floor(n * 0.9)) AS held_out, count(*) AS n_windows FROM (SELECT item_id, len(ids) - 8 AS n, unnest(range(len(ids) - 8)) AS i FROM {_IDS} WHERE len(ids) > 8) GROUP BY 1, 2")
def lm_held_out(spark, sf_dir):
    split = T.split_held_out(_windows(spark, sf_dir).withColumn("n", F.col("n") - 8), F.col("n"))
    return split.groupBy("item_id", "held_out").agg(F.count("*").alias("n_windows"))


@query("SELECT v, c, d, v * d + c * d + 4 * d * d + 2 * d * d + 2 * d + 2 * d * d + d + d * v + v AS n_parameters FROM (SELECT DISTINCT l_linenumber::BIGINT * 11 AS v, (l_quantity % 5)::BIGINT + 4 AS c, (l_orderkey % 3) * 8 + 16 AS d FROM lineitem)")
def lm_parameters(spark, sf_dir):
    v, c, d = F.col("v"), F.col("c"), F.col("d")
    rows = load(spark, sf_dir, "lineitem").select((F.col("l_linenumber").cast("long") * 11).alias("v"), ((F.col("l_quantity") % 5).cast("long") + 4).alias("c"), (F.col("l_orderkey") % 3 * 8 + 16).alias("d")).distinct()
    return rows.select("v", "c", "d", T.parameters(v, c, d).alias("n_parameters"))


@query(
    """SELECT doc_id, n AS n_chars, d AS n_distinct, greatest(0, n - 8) AS n_windows, round(CASE WHEN d > 0 THEN ln(d) END, 9) AS guess_loss, CASE WHEN n > 0 AND n < 120 THEN 'very short' WHEN n > 20000 THEN 'long' END AS warning
FROM (SELECT doc_id, length(text) AS n, len(list_distinct(string_split(text, ''))) AS d FROM documents)"""
)
def lm_text_stats(spark, sf_dir):
    s = load(spark, sf_dir, "documents").select("doc_id", T.stats(F.col("text")).alias("s")).select("doc_id", "s.*")
    return s.withColumn("guess_loss", F.round("guess_loss", 9))


@query("SELECT event_id, least(greatest(CASE WHEN event_id % 5 = 0 THEN 8 ELSE value END, 2), 32) AS context FROM events")
def lm_settings(spark, sf_dir):
    value = F.when(F.col("event_id") % 10 == 0, F.lit(None)).when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return load(spark, sf_dir, "events").select("event_id", T.clamp(value, 2.0, 32.0, 8.0).alias("context"))


#: About so many items train one model: the number of models grows with the table, a task's work doesn't.
_GROUP_ITEMS = 10


def _trained(spark, sf_dir):
    settings = R.Settings(context=8, dim=16, epochs=3, rate=0.1, holdout=0.1, evaluate_every=1)
    items = load(spark, sf_dir, "benchmark")
    groups = max(1, -(-items.count() // _GROUP_ITEMS))
    items = items.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(groups)))
    return R.train(items, "part", "text", settings)


@query()
def lm_train(spark, sf_dir):
    return _trained(spark, sf_dir).select("part", "epoch", F.round("loss", 6).alias("loss"), F.round("held_out", 6).alias("held_out"), "sample", "error")
