"""A stored inverted index for BM25: posting blocks in impact order, searched with block-max skipping.

write_postings() reads the texts once. A term's postings (id, frequency, what a match adds to the score) stand in blocks of
falling impact, each with its largest; a term of very many documents is cut into parts by a hash of the id first,
so no task holds a whole hot term. search() never reads a text: the first blocks of a query's terms give a k-th score
that the best must reach, and a block is read only if its largest impact and the largest of the query's
other terms can reach it together. Results are those of retrieval.bm25().
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.operators.retrieval import best_documents, distinct_queries, for_each_query

RAW = "id long, len int, term string, tf int"
BLOCKS = "term string, part int, block int, n int, most double, least double, ids array<long>, tfs array<int>, impacts array<double>"
#: Postings of one part of a term.
PART = 65_536


def counted_terms(docs: DataFrame) -> DataFrame:
    """RAW: each row's terms with their frequency, counted within the row, and one row without a term for each document. docs: id (distinct), tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                tokens = part.column(1)
                size = np.diff(tokens.offsets.to_numpy()).astype(np.int32)
                size[np.asarray(tokens.is_null())] = 0
                codes = tokens.flatten().dictionary_encode()
                n = max(1, len(codes.dictionary))
                held = np.isin(np.arange(len(codes)), np.flatnonzero(np.asarray(codes.is_valid())))
                row = np.repeat(np.arange(part.num_rows), size)[held]
                size = np.bincount(row, minlength=part.num_rows).astype(np.int32)
                pairs, tf = np.unique(row * n + codes.indices.to_numpy(zero_copy_only=False)[held].astype(np.int64), return_counts=True)
                rows = np.concatenate((pairs // n, np.arange(part.num_rows)))
                terms = pa.concat_arrays([codes.dictionary.cast(pa.string()).take(pa.array(pairs % n)), pa.nulls(part.num_rows, pa.string())])
                tfs = np.concatenate((tf, np.zeros(part.num_rows))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), pa.array(size[rows]), terms, pa.array(tfs)], names=["id", "len", "term", "tf"])

    return docs.select(F.col("id").cast("long"), "tokens").mapInArrow(count, RAW)


def _cut(block_rows: int):
    def run(table: pa.Table) -> pa.Table:
        t = table.sort_by([("term", "ascending"), ("impact", "descending"), ("id", "ascending")]).combine_chunks()
        codes = t["term"].combine_chunks().dictionary_encode().indices.to_numpy()
        first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
        place = np.arange(len(codes)) - np.repeat(first, np.diff(np.append(first, len(codes))))
        at = np.flatnonzero(place % block_rows == 0)
        ends = np.append(at[1:], len(codes))
        impact, offsets = t["impact"].to_numpy(), pa.array(np.append(at, len(codes)).astype(np.int32))
        lists = lambda c: pa.ListArray.from_arrays(offsets, t[c].combine_chunks())
        return pa.table(
            {"bucket": t["bucket"].take(pa.array(at)), "term": t["term"].take(pa.array(at)), "part": t["part"].take(pa.array(at)), "block": pa.array((place[at] // block_rows).astype(np.int32)), "n": pa.array((ends - at).astype(np.int32)),
             "most": pa.array(impact[at]), "least": pa.array(impact[ends - 1]), "ids": lists("id"), "tfs": lists("tf"), "impacts": lists("impact")}
        )

    return run


def write_postings(docs: DataFrame, path: str, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, block_rows: int = 512, part_rows: int = PART) -> None:
    """The index of docs (id: distinct whole numbers, tokens: array of strings) below path: postings, documents, terms, blocks.

    A null array has no tokens, null tokens do not count. A negative idf becomes epsilon times the mean idf.
    """
    spark = docs.sparkSession
    counted_terms(docs).write.parquet(f"{path}/postings")
    raw = spark.read.schema(RAW).parquet(f"{path}/postings")
    stats = raw.filter("term is null").agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean_len"))  # one row
    postings = raw.filter("term is not null")
    terms = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(stats))
    terms = terms.withColumn("raw", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    mean = terms.agg(F.avg("raw").alias("mean_idf"))  # one row
    idf = F.when(F.col("raw") < 0, epsilon * F.col("mean_idf")).otherwise(F.col("raw"))
    terms.crossJoin(F.broadcast(mean)).select("term", "df", "mean_len", idf.alias("idf")).write.parquet(f"{path}/terms")
    terms = spark.read.parquet(f"{path}/terms")
    buckets = max(16, math.ceil(postings.count() / 1_000_000))
    rows = postings.join(terms.hint("merge"), "term")  # a vocabulary takes a tenth of its memory on disk, so it is not for the planner to broadcast
    impact = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean_len")))
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket")
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("df") / part_rows)).cast("int").alias("part")
    cut = rows.select(bucket, part, "term", "id", "tf", impact.alias("impact")).groupBy("bucket", "part").applyInArrow(_cut(block_rows), f"bucket int, {BLOCKS}")
    cut.write.partitionBy("bucket").parquet(f"{path}/blocks")
    spark.createDataFrame([(buckets,)], "buckets int").write.parquet(f"{path}/layout")


def _asked(spark: SparkSession, path: str, queries: DataFrame) -> DataFrame:
    """query_id, term, times and bucket of the queries' tokens."""
    buckets = spark.read.parquet(f"{path}/layout").first()[0]
    asked = queries.select("query_id", F.explode("tokens").alias("term")).filter("term is not null").groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    return asked.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))


def _scores(blocks: DataFrame) -> DataFrame:
    """query_id, id, score from read blocks with times."""
    one = blocks.select("query_id", "times", F.explode(F.arrays_zip("ids", "impacts")).alias("p"))
    return one.select("query_id", F.col("p.ids").alias("id"), (F.col("p.impacts") * F.col("times")).alias("w")).groupBy("query_id", "id").agg(F.sum("w").alias("score"))


def block_visits(spark: SparkSession, path: str, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, bucket, term, times, part, block, n, wanted) of every block of the queries' terms; wanted: it can hold one of the k best.

    A query with a negative impact (terms that nearly all documents have, in a corpus of such terms) wants all its blocks.
    """
    blocks = spark.read.parquet(f"{path}/blocks")
    asked = _asked(spark, path, queries)
    met = asked.join(blocks.select("bucket", "term", "part", "block", "n", "most", "least"), ["bucket", "term"])
    first = asked.join(blocks.filter("block = 0").select("bucket", "term", "ids", "impacts"), ["bucket", "term"])
    reach = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
    bar = _scores(first).withColumn("r", reach).filter(F.col("r") <= k).groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("bar"))
    tops = met.filter("block = 0").groupBy("query_id", "term").agg(F.max(F.col("most") * F.col("times")).alias("top"))
    whole = tops.groupBy("query_id").agg(F.sum("top").alias("all_tops"))
    lows = met.groupBy("query_id").agg(F.min("least").alias("low"))
    rows = met.join(tops, ["query_id", "term"]).join(whole, "query_id").join(lows, "query_id").join(bar, "query_id", "left")
    # sums of doubles in another order may differ in the last digits
    bound = F.col("all_tops") - F.col("top") + F.col("most") * F.col("times")
    wanted = F.col("bar").isNull() | (F.col("low") < 0) | (bound >= F.col("bar") - 1e-6)
    return rows.select("query_id", "bucket", "term", "times", "part", "block", "n", wanted.alias("wanted"))


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """query_id, id, score, rank: the k best documents of each query (query_id, tokens) by BM25 from a stored index; ties by id.

    Documents without a query token score 0 and rank too, by id. Queries of the same tokens are searched once, and a block is
    read once for all queries that want it.
    """
    asked, same = distinct_queries(queries)
    firsts = same.select(F.col("first").alias("query_id")).distinct()
    blocks = spark.read.parquet(f"{path}/blocks").select("bucket", "term", "part", "block", "ids", "impacts")
    visits = block_visits(spark, path, queries.join(firsts, "query_id", "left_semi"), k).filter("wanted").select("bucket", "term", "part", "block").distinct()
    read = blocks.join(visits, ["bucket", "term", "part", "block"], "left_semi").select("term", F.explode(F.arrays_zip("ids", "impacts")).alias("p"))
    ids = spark.read.schema(RAW).parquet(f"{path}/postings").filter("term is null").select("id")
    found = best_documents(read.select(F.col("p.ids").alias("id"), "term", F.col("p.impacts").alias("w")), ids, firsts, asked, k, digits)
    return for_each_query(found, same)
