"""The queries of the thirteen operators over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .filter_audit import AUDIT_SQL, audit_filters
from .html_text import extract_main_text
from .hyper_minhash import NEAR_SQL, components_sql, near_duplicates
from .jaccard_join import jaccard_components
from .langid import predict_languages
from .merkle import MERKLE_SQL, merkle_manifest
from .mixing import document_rates
from .packing import pack_documents
from .paragraph_dedup import remove_repeated_paragraphs
from .quality import QUALITY_SQL, quality_rules
from .simhash import fingerprint_documents
from .token_counts import token_counts
from .toxicity import score_toxicity

Query = Callable[[SparkSession, str], DataFrame]


def labelled_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, domain: language and quality of the labelled documents."""
    known = labels.filter(F.col("quality").isNotNull()).select("doc_id", "quality")
    return docs.select("doc_id", "lang").join(known, "doc_id").select("doc_id", F.concat_ws("/", F.col("lang"), F.col("quality").cast("string")).alias("domain"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("clean_text")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return document_rates(docs, labelled_domains(docs, table(spark, sf_dir, "labels")))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_paragraphs(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("n_removed", F.size("removed").cast("long"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_languages(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_quality_rules, op2_html_extraction, op3_source_mixing, op4_fingerprints, op5_substring_dedup, op6_packing, op7_language_id, op8_toxicity, op9_jaccard_join, op10_token_counts, op11_merkle_manifest, op12_filter_audit, op13_minhash_dedup)}

ORACLES: dict[str, str] = {"op1_quality_rules": QUALITY_SQL, "op9_jaccard_join": components_sql(4, 85), "op11_merkle_manifest": MERKLE_SQL, "op12_filter_audit": AUDIT_SQL, "op13_minhash_dedup": NEAR_SQL}
