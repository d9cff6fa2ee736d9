"""The registered queries of the numbered operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm.common import documents
from citeloom.llm.filter_audit import filter_audit
from citeloom.llm.importance import importance_resample
from citeloom.llm.licenses import scan_licenses
from citeloom.llm.mixing import mixed
from citeloom.llm.ngram_join import jaccard_components
from citeloom.llm.oracle import ORACLE  # noqa: F401
from citeloom.llm.packing import packed, pieces
from citeloom.llm.quality_model import quality_scores
from citeloom.llm.quality_rules import quality_rules
from citeloom.llm.sharding import sharded
from citeloom.llm.simhash import simhash_components
from citeloom.llm.substring_dedup import remove_repeats
from citeloom.llm.token_files import read_token_files, token_counts, write_token_files
from citeloom.llm.topk import top_k


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(documents(spark, sf_dir), 40)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return packed(pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(vectors, vectors.filter("vec_id % 20 = 0"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir)).drop("matches")


def token_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each of the first 256 ids of the vocabulary comes in all documents, from the counts in the files."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return token_counts(write_token_files(docs, public_tokenizers.path("word_bpe_49k.json")), tuple(range(256)))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    files = write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(files, docs.schema["doc_id"]).select("doc_id", "start", "n_tokens", "ids_crc32")


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance_resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(documents(spark, sf_dir))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_sharding": op2_sharding,
    "op4_mixing": op4_mixing,
    "op5_ngram_join": op5_ngram_join,
    "op3_exact_top_k": op3_exact_top_k,
    "op6_quality_rules": op6_quality_rules,
    "op7_license_scan": op7_license_scan,
    "op8_token_files": op8_token_files,
    "op9_quality_model": op9_quality_model,
    "op10_packing": op10_packing,
    "op11_importance": op11_importance,
    "op12_simhash": op12_simhash,
    "op13_filter_audit": op13_filter_audit,
    "token_lookup": token_lookup,
}

