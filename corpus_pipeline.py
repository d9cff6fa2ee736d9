"""A corpus pipeline over documents: reject, deduplicate, strip repeats, mix, pack.

Every stage takes the rows that its predecessor kept; all but the last return the columns of documents. A stage
writes its steps to the scratch that it is given, or to one of its own; run() gives each stage one and removes
it when the stage's result is written, so a run owns its tables and nobody else's.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm.common import Scratch, free_name
from citeloom.llm.mixing import mixed_rows
from citeloom.llm.ngram_join import without_copies
from citeloom.llm.packing import packed, pieces
from citeloom.llm.quality_rules import kept_rows
from citeloom.llm.substring_dedup import remove_repeats


def reject(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """Documents that the quality rules keep."""
    return kept_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """One document of each group of near copies: five-word shingles, Jaccard 0.8 or more."""
    return without_copies(docs, scratch=scratch, k=5, percent=80)


def strip_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """Documents without the words of repeated passages; texts that lose nothing stay as they are, a text that loses all is empty."""
    prefix = free_name("__repeats", docs) + "_"
    found = remove_repeats(docs, prefix=prefix, scratch=scratch)
    hit, kept = F.col(f"{prefix}n_removed") > 0, F.col(f"{prefix}kept_text")
    text = F.when(hit, kept).otherwise(F.col("text"))
    size = F.when(hit, F.length(kept).cast("long")).otherwise(F.col("n_chars"))
    return found.withColumns({"text": text, "n_chars": size}).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixed_rows(docs, scratch=scratch)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """The pieces of all documents, each with its sequence and place."""
    return packed(pieces(docs, public_tokenizers.path("word_bpe_49k.json")), scratch=scratch)


STAGES = [("quality rules", reject), ("n-gram Jaccard join", deduplicate), ("substring dedup", strip_repeats), ("mixing", mix), ("packing", pack)]
#: SQL cannot say the learned rules, the sampling and the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each reads what the one before has written to the shared folder.

    Left in the folder are the tables that the returned (lazy) rows read; every other table of the run is removed.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (name, step) in enumerate(STAGES):
        work, last = Scratch(spark, f"pipeline-{i}"), i == len(STAGES) - 1
        docs = step(spark, docs, sf_dir, work)
        if not last:
            kept = Scratch(spark, f"pipeline-{i}-kept")
            docs = kept.stored(docs, name.replace(" ", "-"))
            work.remove()
        if before:
            before.remove()
        before = None if last else kept
    return docs
