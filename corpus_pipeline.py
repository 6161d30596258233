"""A training-data pipeline over ``documents``: each stage works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lidarspark.llm import decontaminate, pieces, pii, simhash, toxicity
from lidarspark.llm.common import bounded_batches, cut, table
from lidarspark.llm.queries import TEST_KEY


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic go; clean ones stay as they are, with all their columns.

    A null or empty text is scored like any other; repeated rows go or stay together.
    """
    bounded_batches(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five-word shingles, similarity 0.8): the smallest doc_id.

    Texts without words and rows without a doc_id stay; of rows that repeat a doc_id one stays.
    """
    bounded_batches(spark)
    return simhash.drop_near_copies(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, all rows of their doc_id with them.

    Null and empty texts hold none; rows without a doc_id stay.
    """
    bounded_batches(spark)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms; n_chars follows the new text. Every row stays.

    The key is the session's (``pii.KEY_SETTING``), or the one for tests.
    """
    bounded_batches(spark)
    hidden = pii.pseudonymise_docs(docs, pii.key_of(spark, TEST_KEY))
    return hidden.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_pieces and the decoded text of every row; nulls for a null text."""
    bounded_batches(spark)
    return pieces.encode(docs, pieces.default_model())


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("pii", hide_personal_data),
    ("sentencepiece", encode),
]

#: The stages learn, search and encode; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole table ``documents``; of an empty one an empty result."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
