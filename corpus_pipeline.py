"""The corpus pipeline: stages that each apply one operator to all that the stage before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossarion.llm import bpe, neardup, packing, pii, quality, toxicity
from glossarion.llm.queries import tokenizer_path
from glossarion.llm.text import shared_dir, table

#: Documents that score this high are toxic.
TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from labels, doesn't find toxic.

    A null text is scored as one of no words. Without labels of both kinds nothing is toxic, unless all
    labels say so. Repeated rows are judged alike; no documents give none.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select(F.struct("*").alias("_doc")), model, "_doc.text", keep=("_doc",))
    return scored.filter(F.col("score") < TOXIC).select("_doc.*")


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the standard policy rejects; a null text has no words and goes. No documents give none."""
    return quality.keep(docs, quality.STANDARD)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (0.8 or more of their five-word shingles shared): that of the smallest id.

    Texts whose SimHash fingerprints lie within three bits, or that share a MinHash band, are compared whole. Null and blank texts are copies of each other. Of repeated rows one is left. Documents without an id
    stay. No documents give none.
    """
    return neardup.keep_one(docs).select(docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars follows the text. A null text and its n_chars are null."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document, with a separator after it, lies in the training sequences.

    A null or empty text is a separator alone. Repeated rows and ids are packed one by one; no documents
    give no rows.
    """
    lengths = bpe.token_counts(docs, tokenizer_path())
    return packing.best_fit(lengths.withColumn("n_tokens", F.col("n_tokens") + 1), "n_tokens")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_poor),
    ("near duplicates", drop_near_copies),
    ("personal data", mask_personal_data),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each one's result is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_dir(spark)
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/stage{i}")
        docs = spark.read.parquet(f"{folder}/stage{i}")
    return docs
