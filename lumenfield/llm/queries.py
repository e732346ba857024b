"""The registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import code_books, cotrain, hnsw, host_rules, line_dedup, merge_dropout, mixing, ngram_lm, pii, secret_scan, simhash, spelling, token_counts
from .util import table

#: Folder with the public tokenizers' vocabulary files, where the session doesn't set spark.lumenfield.tokenizers.
TOKENIZERS = "/opt/tokenizers"


def vocabulary(spark: SparkSession, name: str) -> str:
    """The path of a vocabulary file."""
    return f"{spark.conf.get('spark.lumenfield.tokenizers', TOKENIZERS)}/{name}"


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(table(spark, sf_dir, "documents"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.lm_scores(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"), width=4, distance=4)
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.host_rules(table(spark, sf_dir, "documents")).drop("host_rate")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digest(table(spark, sf_dir, "documents"), distance=2, min_chars=20)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_dropout.encode_digest(table(spark, sf_dir, "documents"), vocabulary(spark, "piece_bpe_32k.model"), rate=0.1, seed=1)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary(spark, "byte_bpe_50k.tiktoken"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_books.code_digest(table(spark, sf_dir, "embeddings"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digest(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": mixing.MIX_SQL, "op6_host_rules": host_rules.HOST_RULES_SQL, "op11_vector_codes": code_books.CODE_SQL}
