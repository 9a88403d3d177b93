"""Stages of the corpus pipeline: each applies one operator's decisions to the documents it gets.

A stage takes (spark, docs, sf_dir) and, but for the last, returns the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, jaccard, pii, toxicity
from .common import fresh, table


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text as packed token ids in place of the text (operator 5)."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose toxicity score reaches the threshold (operator 2)."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    score = fresh(docs.columns, "score")
    scored = docs.withColumn(score, toxicity.score_column(model, F.col("text").cast("string")))
    return scored.filter(F.col(score) < toxicity.THRESHOLD).select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of the least id (operator 8).

    Near copies share 80 percent of their five-word shingles, a wider rule than that of the query.
    """
    return jaccard.keep_one(docs, words=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that contain an item of ``benchmark`` (operator 6)."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text with its personal data replaced by marks (operator 10); ``n_chars``, where there
    is one, follows the new text."""
    done = pii.redact(docs)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars"))
                               .otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)
