"""A training-data pipeline over the documents: each stage calls one operator, and its decisions take effect.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which a driver may write as
Parquet and read again as the next one's docs. All stages but the last return the columns of documents.

1. language: documents in no learned language go, so null and empty texts and those without a letter do.
2. near duplicates: one row of each group stays, of the group's least id (null only if all ids are null); repeated rows are a
   group. Texts without words are no copies of anything and all stay.
3. decontamination: documents that hold much of a benchmark item go; null and empty texts stay.
4. personal data: the spans found are replaced by their kind in brackets, and n_chars follows the new text; a null text stays
   null with its n_chars.
5. packing: the rest becomes token sequences of bounded length, one row a piece; a null or empty text is its end sign alone.

A stage takes a table without rows, and one with further columns of any name, which it hands on (all but the last).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import decontaminate, langid, neardup, packing, pii
from veilspark.llm.common import Scratch
from veilspark.llm.queries import language_model, read

ORACLE_SQL = None
#: Rows of a batch that goes to Python: whole texts travel, and some are long.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
#: Packing's cached pre-tokens and bytes at once: its workers live beside executors that all stages have filled.
CACHED, STEP = 50_000, 1 << 18


def bounded(spark: SparkSession) -> SparkSession:
    """The session, which from now on sends at most BATCH_ROWS rows to Python at once: a stage's plan runs after its function has returned."""
    rows = int(spark.conf.get(BATCH))
    spark.conf.set(BATCH, min(rows, BATCH_ROWS) if rows > 0 else BATCH_ROWS)
    return spark


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    return langid.keep_identified(docs, language_model(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    return neardup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, read(bounded(spark), sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    bounded(spark)
    found = packing.pack(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), entries=CACHED, step=STEP)
    return found.select(F.col("doc.doc_id").alias("doc_id"), "start", "length", "ids", "doc_tokens", "sequence_id", "offset")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each but the last is written to the shared scratch folder and read again."""
    scratch = Scratch(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
