"""The registered queries of this subpackage: every operator over its whole table, and their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxoffice.llm import decontam, langid, licenses, lm, middle, mixing, packing, pii, simhash, tokenfiles, toxicity, trie, vectors
from boxoffice.llm.oracle import ORACLE  # noqa: F401

#: The key of the registered query; real runs pass a secret of their own.
PSEUDONYM_KEY = "registered query"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.document_scores(table(spark, sf_dir, "documents"), order=3, whole=True)


def op2_embedding_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.links_and_groups(table(spark, sf_dir, "embeddings"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents")).withColumn("notices", F.array_join("notices", ","))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.document_tokens(table(spark, sf_dir, "documents"))


def op6_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.document_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_groups(table(spark, sf_dir, "documents"))


def op9_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.document_languages(table(spark, sf_dir, "documents"))


def op10_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY)


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"))


def op12_middles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle.middle_digests(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.shared_prefixes(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_lm_scores": op1_lm_scores,
    "op2_embedding_groups": op2_embedding_groups,
    "op3_source_mix": op3_source_mix,
    "op4_licenses": op4_licenses,
    "op5_token_files": op5_token_files,
    "op6_contamination": op6_contamination,
    "op7_toxicity": op7_toxicity,
    "op8_simhash_groups": op8_simhash_groups,
    "op9_languages": op9_languages,
    "op10_pseudonyms": op10_pseudonyms,
    "op11_packing": op11_packing,
    "op12_middles": op12_middles,
    "op13_prefix_trie": op13_prefix_trie,
}
