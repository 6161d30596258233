"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import covertree, decontaminate, licenses, packing, pieces, pii, resharding, search, simhash, spelling, suffix_dedup, toxicity, url_filter
from .common import table


#: For tests and measurements only: a session with real documents sets ``pii.KEY_SETTING``.
TEST_KEY = b"not a secret"


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page."""
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with pseudonyms, and how many of each kind."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = pii.pseudonymise_docs(docs, pii.key_of(spark, TEST_KEY), counts=True)
    return done.select("doc_id", "text", *[F.coalesce(F.col("pii")[k], F.lit(0)).alias(f"n_{k}") for k in pii.KINDS])


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded, and decoded again."""
    coded = pieces.encode(table(spark, sf_dir, "documents"), pieces.default_model())
    return coded.select("doc_id", "n_pieces", "ids", "decoded")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a document and a benchmark item that it holds."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest, licence and notices of every document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return covertree.near_vectors(table(spark, sf_dir, "embeddings"))


def op8_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New shard and slot of every document."""
    planned = resharding.plan(table(spark, sf_dir, "documents"))
    return planned.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text without strings of smaller documents."""
    return suffix_dedup.removed(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word with its near words, its form and its root."""
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents of every benchmark item."""
    return search.search(search.build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a sequence."""
    return packing.pack(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_simhash, op2_url_filter, op3_pii, op4_sentencepiece, op5_decontamination, op6_licenses, op7_embedding_dedup, op8_resharding, op9_suffix_dedup, op10_toxicity, op11_spelling, op12_search, op13_packing)
}

ORACLE_SQL: dict[str, str] = {
    "op2_url_filter": url_filter.judge_sql(),
    "op6_licenses": licenses.scan_sql(),
    "op11_spelling": spelling.variants_sql(),
    "op12_search": search.search_sql(),
}
