"""Target-distribution importance resampling: draw the documents whose hashed n-grams look like the target's.

The texts of a batch are joined into one run of bytes with a sentinel between them; one regular expression finds
all words, searchsorted on the documents' offsets tells whose they are, and a pair of words of two documents is
masked before the buckets are counted. Words and pairs are hashed in numpy, all words at once.

The model is one count a bucket for the documents and for the target, so what the driver and a task hold is bounded
by the number of buckets, never by the corpus. Drawing is a perturbed (Gumbel) top-k: exact ranks come from counts
of the scores and a window within each score, not from one sorted task.
"""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.llm.common import Scratch, distinct_names, scratch_of
from citeloom.llm.tokens import slices

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Between two texts: a byte that no word holds.
SENTINEL = b"\x00"
#: Words that are hashed together; what a task holds does not grow with a text.
RUN = 1 << 16
#: Longer words are hashed one by one.
LONG = 48
#: Rows that one row writes out, where rows are equal.
PIECE = 1 << 16


def _crc_table() -> np.ndarray:
    """The CRC of each byte, from the polynomial of CRC-32 (bits reversed)."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = (out >> np.uint32(1)) ^ (out & np.uint32(1)) * np.uint32(0xEDB88320)
    return out


_CRC = _crc_table()


def crc32_of(data: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """The CRC-32 of each span of bytes; before: that of what stands in front of it."""
    size = end - start
    first = np.zeros(len(start), np.uint32) if before is None else before
    held = ~first
    for j in range(int(min(size.max(initial=0), LONG))):
        live = np.flatnonzero(size > j)
        now = held[live]
        held[live] = _CRC[(now ^ data[start[live] + j]) & np.uint32(255)] ^ (now >> np.uint32(8))
    out = ~held
    for i in np.flatnonzero(size > LONG):
        out[i] = zlib.crc32(data[start[i] : end[i]], int(first[i]))
    return out


def batch_features(texts: pa.Array, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text of each word, text of each feature, bucket of each feature), a run of words at a time; a null text has none."""
    raw = [t or b"" for t in texts.cast(pa.large_binary()).to_pylist()]
    data = SENTINEL.join(raw).lower()
    offsets = np.cumsum([0, *(len(t) + 1 for t in raw)])
    flat = np.frombuffer(data, np.uint8)
    found, last = map(re.Match.span, WORDS.finditer(data)), np.zeros((0, 2), np.int64)
    while spans := list(itertools.islice(found, RUN)):
        words = np.concatenate((last, np.array(spans, np.int64)))
        new, last = len(last), words[-1:]
        start, end = words[:, 0], words[:, 1]
        doc = np.searchsorted(offsets, start, side="right") - 1
        single = crc32_of(flat, start, end)
        # a pair goes on from "first word, space"; a pair across two documents is masked
        pairs = np.flatnonzero(doc[1:] == doc[:-1])
        spaced = ~single[pairs]
        spaced = ~(_CRC[(spaced ^ np.uint32(32)) & np.uint32(255)] ^ (spaced >> np.uint32(8)))
        double = crc32_of(flat, start[pairs + 1], end[pairs + 1], spaced)
        yield doc[new:], np.concatenate((doc[new:], doc[pairs])), np.concatenate((single[new:], double)).astype(np.int64) % buckets


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = 10_000) -> DataFrame:
    """(bucket, n): the features of all texts in each bucket that has any. A task sends one row a bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, 0, 2 << 20):
                for _, _, bucket in batch_features(part.column(0), buckets):
                    total += np.bincount(bucket, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], ["bucket", "n"])

    return texts.select(F.col(text)).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(own: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """floor(1000 * log ratio) of the target's and the documents' smoothed shares of each bucket."""
    s_all, t_all = sum(own.values()), sum(target.values())
    share = lambda b: (float(target.get(b, 0) + 1) * float(s_all + buckets)) / (float(own.get(b, 0) + 1) * float(t_all + buckets))
    return np.array([math.floor(1000 * math.log(share(b))) for b in range(buckets)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, id_col: str, text: str, carried: str) -> DataFrame:
    """The id and the carried column of each row, with n_words, n_features and weight, the floored mean of its features' gains."""
    schema = T.StructType([docs.schema[id_col], docs.schema[carried], *(T.StructField(n, T.LongType()) for n in ("n_words", "n_features", "weight"))])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, 2 << 20):
                n = part.num_rows
                words, features, total = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
                for word_doc, doc, bucket in batch_features(part.column(2), len(gain)):
                    words += np.bincount(word_doc, minlength=n)
                    features += np.bincount(doc, minlength=n)
                    total += np.bincount(doc, gain[bucket], n).astype(np.int64)  # whole numbers below 2**53: exact
                weight = np.where(features > 0, total // np.maximum(features, 1), 0)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *map(pa.array, (words, features, weight))], names=schema.names)

    return docs.select(id_col, carried, F.col(text)).mapInArrow(weigh, schema)


def perturbed(weight: Column, id_col: str, seed: int) -> Column:
    """weight + floor(1000 * Gumbel noise of the id); a null id counts as an empty one."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    return weight + F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def ranked(rows: DataFrame, id_col: str, drawable: Column, percent: int, scratch: Scratch) -> DataFrame:
    """rows with rank: 1, 2, ... for the floor(percent * n / 100) highest scores of the n drawable rows, ties to the smaller id (null last).

    Scores are whole numbers of a bounded range, so their counts are a small table (under 200,000 rows) whatever the
    input; it says how many rows stand before each score. Within a score a window orders the rows, where rows equal
    in all columns are one row with a count, so that copies of one row cannot fill a task.
    """
    scores = scratch.stored(rows.filter(drawable).groupBy("score").agg(F.count(F.lit(1)).alias("n")), "scores")
    quota = (scores.agg(F.sum("n")).first()[0] or 0) * percent // 100
    ahead = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    scores = scores.withColumn("__before", F.coalesce(F.sum("n").over(ahead), F.lit(0))).filter(F.col("__before") < quota).select("score", "__before")
    scores = scratch.stored(scores, "drawn-scores")
    least = scores.agg(F.min("score")).first()[0]
    none = F.lit(None).cast("long").alias("rank")
    if least is None:
        return rows.withColumn("rank", none)
    near = drawable & (F.col("score") >= least)
    times = rows.filter(near).groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("__times")).join(F.broadcast(scores), "score")
    order = [F.col(id_col).asc_nulls_last(), *(F.col(c) for c in rows.columns if c not in (id_col, "score"))]
    within = Window.partitionBy("score").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    times = times.withColumn("__first", F.col("__before") + F.coalesce(F.sum("__times").over(within), F.lit(0)))
    # equal rows are written out in pieces
    times = times.withColumn("__piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("__times") - 1) / PIECE))))
    start = F.col("__piece") * PIECE
    times = times.withColumn("__at", F.explode(F.sequence(start, F.least(F.col("__times"), start + PIECE) - 1)))
    place = F.col("__first") + F.col("__at") + 1
    drawn = times.select(*rows.columns, F.when(place <= quota, place).alias("rank"))
    return drawn.unionByName(rows.filter(~near).withColumn("rank", none))


def importance_resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), buckets: int = 10_000, percent: int = 25, least_words: int = 20, seed: int = 7, scratch: Scratch | None = None
) -> DataFrame:
    """Per row of docs: the id, n_words, n_features, weight, score, rank (null: not drawn) and the columns in `keep`.

    Words are lower-cased (A-Z) runs of digits, letters and characters outside ASCII; features are all words and all
    pairs of neighbours of one text. target: a table of texts (the same text column) that the draw should resemble. A
    null or empty text has no features and weight 0; rows under least_words words are never drawn. An empty target
    counts as one without features; an empty table gives an empty table. Repeated rows share a score and get ranks
    one after the other; a null id is drawn like any other and stands last among ties. A text of any length is read
    whole. Other columns are not read, whatever their names; an id or kept column named like an output is an error,
    as is a kept column that cannot be grouped by. Reruns agree: nothing depends on the order of rows.
    """
    distinct_names({id_col, *keep}, ("n_words", "n_features", "weight", "score", "rank"))
    scratch = scratch_of(docs, scratch, "importance")
    counted = [{r.bucket: r.n for r in scratch.stored(bucket_counts(t, text, buckets), name).collect()} for t, name in ((docs, "own"), (target, "target"))]
    own = docs.select(F.col(id_col), F.struct(F.lit(0).alias("_"), *keep).alias("__kept"), F.col(text).alias("__text"))
    rows = weighed(own, gains(*counted, buckets), id_col, "__text", "__kept").withColumn("score", perturbed(F.col("weight"), id_col, seed))
    rows = ranked(scratch.stored(rows, "rows"), id_col, F.col("n_words") >= least_words, percent, scratch)
    return rows.select(id_col, "n_words", "n_features", "weight", "score", "rank", *(F.col(f"__kept.{c}").alias(c) for c in keep))
