"""The contract's queries: each reads its whole table, applies its operator and derives the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out
from .oracles import ORACLES  # noqa: F401

#: Rows are their own queries if their id is divisible by this.
EVERY = 50
#: The score from which a text is predicted to be of quality.
PASS_MARK = 0.7


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def language_model(docs: DataFrame):
    """The language model of the labelled documents that aren't held out."""
    from . import langid

    return langid.train(docs.where(~held_out()))


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import repeats

    found = repeats.strip(read(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(F.col("doc.doc_id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontaminate

    found = decontaminate.find(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("doc.doc_id").alias("doc_id"), "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated"
    )


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    found = pii.find(read(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256")
    return found.select(F.col("doc.doc_id").alias("doc_id"), *[count(k) for k in pii.KINDS], base, pii.listed(F.col("spans")).alias("spans"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    docs = read(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), language_model(docs))
    return found.select(F.col("doc.doc_id").alias("doc_id"), held_out("doc.doc_id").alias("held_out"), "lang_pred", "score")


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import packing

    found = packing.pack(read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.select(F.col("doc.doc_id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import topk

    vectors = read(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    docs = read(spark, sf_dir, "documents")
    network = quality.train(docs.select("doc_id", "text"), read(spark, sf_dir, "labels").where(~held_out()))
    found = quality.score(docs.select("doc_id", "text"), network).select(F.col("doc.doc_id").alias("doc_id"), "score")
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= PASS_MARK).cast("int").alias("predicted"))


def op8_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import licenses

    found = licenses.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("doc.doc_id").alias("doc_id"), "license", F.col("lines").alias("n_lines"), F.array_join("licenses", ",").alias("licenses"))


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import neardup

    found = neardup.groups(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("key").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("group").alias("component_id"), F.col("key").eqNullSafe(F.col("group")).alias("kept"))


def op10_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import extract

    found = extract.extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select(F.col("doc.page_id").alias("page_id"), F.col("doc.url").alias("url"), "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {f.__name__: f for f in (op1_repeats, op2_decontaminate, op3_pii, op4_language, op5_pack, op6_topk, op7_quality, op8_license, op9_neardup, op10_extract)}
