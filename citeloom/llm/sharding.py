"""Reproducible shuffle into shards by a Feistel permutation with cycle walking; DataFrame functions only.

Rows get global numbers 0..n-1 (hash range of the id first, then the id), a keyed Feistel network
permutes the numbers, and the permuted number gives shard (remainder) and slot (quotient): any
worker can compute where a row goes, and the counts of two shards differ by one at most.

Numbers go to distinct (id, crc32, size) first, each with as many as it has rows, so an id that a third of all
rows share is one row to count and sort; its rows are then written out in pieces.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.llm.common import distinct_names

#: Rounds of the network, and the walks that one expression can make.
ROUNDS, MOST_WALKS = 6, 32


def _sides(n: int) -> tuple[int, int]:
    """Two factors whose product is the least such domain of at least n points."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def permuted(x: Column, n: int, seed: int) -> Column:
    """One pass of the network over the domain a * b >= n."""
    a, b = _sides(n)
    right = F.pmod(x, F.lit(b))
    left = F.floor((x - right) / b)  # exact: a multiple of b below 2**53
    for r in range(ROUNDS):
        if r % 2 == 0:
            left = (left + F.pmod(F.xxhash64(F.lit(seed), F.lit(r), right), F.lit(a))) % a
        else:
            right = (right + F.pmod(F.xxhash64(F.lit(seed), F.lit(r), left), F.lit(b))) % b
    return left * b + right


def walked(x: Column, n: int, seed: int, walks: int) -> Column:
    """The network, applied again while its value is n or more: a permutation of 0..n-1."""
    if walks == 0:
        return permuted(x, n, seed)
    return F.aggregate(F.sequence(F.lit(1), F.lit(walks)), permuted(x, n, seed), lambda acc, _: F.when(acc >= n, permuted(acc, n, seed)).otherwise(acc))


def _walks(spark: SparkSession, n: int, seed: int) -> tuple[int, int]:
    """The seed used and the most walks that any of its numbers needs; there are about 2 * sqrt(n) points to try."""
    a, b = _sides(n)
    if n == 0 or a * b == n:
        return seed, 0
    # an excess point that is still one after MOST_WALKS may be reachable: take another key then
    for attempt in range(seed, seed + 64):
        steps = F.aggregate(
            F.sequence(F.lit(1), F.lit(MOST_WALKS)),
            F.struct(F.col("id").alias("at"), F.lit(0).alias("n")),
            lambda acc, _: F.when(acc["at"] >= n, F.struct(permuted(acc["at"], n, attempt).alias("at"), (acc["n"] + 1).alias("n"))).otherwise(acc),
        )
        most, stuck = spark.range(n, a * b).select(steps.alias("s")).agg(F.max("s.n"), F.max((F.col("s.at") >= n).cast("int"))).first()
        if not stuck:
            return attempt, most
    raise ValueError(f"no key near {seed} lets all {n} rows walk out")


def bucket_of(key: Column, ties: list[Column], buckets: int) -> Column:
    """The hash bucket of a row by all its sort columns, so that unlike rows of one key (or of none) do not share one."""
    return F.pmod(F.xxhash64(key, *ties), F.lit(buckets)).cast("int")


def numbered(df: DataFrame, key: Column, ties: list[Column], buckets: int = 4096, piece: int = 65_536) -> DataFrame:
    """Every row of df with row_number (0..n-1, long): by hash bucket of key and ties, then key, then ties.

    The columns of df must be known from key and ties. Equal rows are counted first (in the tasks that read them);
    buckets of distinct rows get their offsets from a sum, so no task sorts all rows; a row that came often is
    dealt in pieces and multiplied there.
    """
    rows = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__rows"))
    rows = rows.withColumn("__bucket", bucket_of(key, ties, buckets))
    sizes = rows.groupBy("__bucket").agg(F.sum("__rows").alias("__all"))
    before = Window.unboundedPreceding, -1
    offsets = sizes.select("__bucket", F.coalesce(F.sum("__all").over(Window.orderBy("__bucket").rowsBetween(*before)), F.lit(0)).alias("__before"))
    within = F.coalesce(F.sum("__rows").over(Window.partitionBy("__bucket").orderBy(key, *ties).rowsBetween(*before)), F.lit(0))
    # at most `buckets` rows of offsets, whatever the size of df
    first = rows.withColumn("__within", within).join(F.broadcast(offsets), "__bucket").withColumn("__first", F.col("__before") + F.col("__within"))
    whole = first.filter(F.col("__rows") <= piece).select(*df.columns, "__first", "__rows")
    often = first.filter(F.col("__rows") > piece).withColumn("__lo", F.explode(F.sequence(F.lit(0), F.col("__rows") - 1, F.lit(piece))))
    parts = often.select(*df.columns, (F.col("__first") + F.col("__lo")).alias("__first"), F.least(F.lit(piece), F.col("__rows") - F.col("__lo")).alias("__rows"))
    dealt = whole.unionByName(parts.repartition("__first"))
    return dealt.withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("__rows") - 1))).select(*df.columns, (F.col("__first") + F.col("__i")).alias("row_number"))


def sharded(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text: str = "text", seed: int = 17, buckets: int = 4096) -> DataFrame:
    """Per row: the id, size (UTF-8 bytes of the text plus 16), text_crc32, law, shard, slot, grown_shard, row_number and place.

    Law `rows`: the counts of any two shards differ by one at most, whatever the sizes; equal texts are
    placed apart like any other rows. grown_shard is null: only a key-based law defines it. A null text
    counts as empty (size 16, crc32 0); of a text of any length only size and crc32 move. Rows with equal or null
    ids are ordered by crc32 and size; those equal in all three are alike in the result. An empty table gives an
    empty table. Reruns and other partition counts give the same shards. Other columns, whatever their names, are
    not read; an id column named like an output is an error.
    """
    distinct_names({id_col}, ("size", "text_crc32", "law", "shard", "slot", "grown_shard", "row_number", "place"))
    spark = docs.sparkSession
    raw = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col), (F.octet_length(raw).cast("long") + 16).alias("size"), F.crc32(F.encode(raw, "UTF-8")).alias("text_crc32"))
    n = docs.count()
    seed, walks = _walks(spark, n, seed)
    placed = numbered(rows, F.col(id_col), [F.col("text_crc32"), F.col("size")], buckets)
    placed = placed.withColumn("place", walked(F.col("row_number"), n, seed, walks)) if n else placed.withColumn("place", F.col("row_number"))
    return placed.select(
        id_col, "size", "text_crc32", F.lit("rows").alias("law"), (F.col("place") % n_shards).cast("int").alias("shard"),
        F.floor((F.col("place") - F.col("place") % n_shards) / n_shards).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_number", "place",
    )
