"""Token ids of a corpus in wavelet-matrix files, one for each shard, in ascending order of the ids of documents.

Texts are range-partitioned by id, so each task writes consecutive shards; the sizes of all shards give
each one's first position in the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.llm.common import Scratch, distinct_names, scratch_of
from citeloom.llm.tokens import encoder, slices
from citeloom.llm.wavelet import WaveletMatrix, build

FILES = "part long, seq long, n_texts long, n_tokens long, file binary"


def write_token_files(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", end: int = 1, shard_bytes: int = 4 << 20, partitions: int | None = None, scratch: Scratch | None = None
) -> DataFrame:
    """A stored table with one file a row (FILES); (part, seq) is the order of the corpus.

    A shard holds about shard_bytes of text, and whole texts only: a text of any length is in one shard. Null ids
    come first; rows with the same id come in the order of a hash of their texts, null and empty alike, and may
    span shards and partitions. A null text is its end id alone. An empty table gives no files. Other columns,
    whatever their names, are not read; an id column named like an output of the readers is an error.
    """
    distinct_names({id_col}, ("start", "n_tokens", "ids_crc32", "part", "seq", "token", "offset"))
    scratch = scratch_of(docs, scratch, "token-files")
    keys = docs.schema[id_col]
    rows = docs.select(id_col, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    # the last key parts rows that are equal in the others, so one id with a third of all rows still spreads
    rows = rows.withColumns({"__hash": F.xxhash64("__text"), "__salt": F.pmod(F.monotonically_increasing_id(), F.lit(4096))})
    order = [F.col(id_col).asc_nulls_first(), F.col("__hash"), F.col("__salt")]
    dealt = rows.repartitionByRange(*([partitions] if partitions else []), *order).sortWithinPartitions(*order).select(id_col, "__text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in slices(batch, 1, shard_bytes):
                ids, at = encoder(tokenizer).encode(piece.column(1), end)
                table = pa.table({keys.name: piece.column(0), "n_tokens": pa.array(np.diff(at))})
                yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([seq]), pa.array([piece.num_rows]), pa.array([len(ids)]), pa.array([build(ids, table)], pa.binary())], names=["part", "seq", "n_texts", "n_tokens", "file"])
                seq += 1

    return scratch.stored(dealt.mapInArrow(write, FILES), "files", "uncompressed")


def token_counts(files: DataFrame, tokens: tuple[int, ...]) -> DataFrame:
    """token and n of the given ids over all files, from the files' rank support: no file is unpacked whole. Ids that never come have n 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0):
                matrix = WaveletMatrix(file.as_buffer().to_pybytes())
                yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array([matrix.count(t) for t in tokens], pa.int64())], names=["token", "n"])

    return files.select("file").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def token_places(files: DataFrame, id_field: T.StructField, tokens: tuple[int, ...]) -> DataFrame:
    """Every place of the given ids: the text's id, token and offset in the text, from the files' select support."""
    schema = T.StructType([id_field, T.StructField("token", T.LongType()), T.StructField("offset", T.LongType())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0):
                matrix = WaveletMatrix(file.as_buffer().to_pybytes())
                texts = matrix.texts
                ends = np.cumsum(texts["n_tokens"].to_numpy())
                for token in tokens:
                    at = matrix.places(token)
                    text = np.searchsorted(ends, at, side="right")
                    offset = at - np.concatenate(([0], ends))[text]
                    yield pa.RecordBatch.from_arrays([texts[id_field.name].combine_chunks().take(pa.array(text)), pa.array(np.full(len(at), token), pa.int64()), pa.array(offset, pa.int64())], names=schema.names)

    return files.select("file").mapInArrow(find, schema)


def read_token_files(files: DataFrame, id_field: T.StructField, scratch: Scratch | None = None) -> DataFrame:
    """Per text, from the files: the id, start (ids of all texts before it), n_tokens, ids_crc32, part, seq."""
    scratch = scratch_of(files, scratch, "token-starts")
    name = id_field.name
    schema = T.StructType([id_field, *(T.StructField(c, T.LongType()) for c in ("__within", "n_tokens", "ids_crc32", "part", "seq"))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, file in zip(*(batch[c].to_pylist() for c in ("part", "seq", "file")), strict=True):
                matrix = WaveletMatrix(file)
                texts = matrix.texts
                raw, size = matrix.all().astype("<u4").view(np.uint8), texts["n_tokens"].to_numpy()
                ends = np.cumsum(size)
                crc = [zlib.crc32(raw[4 * (e - s) : 4 * e]) for s, e in zip(size.tolist(), ends.tolist(), strict=True)]
                n = len(size)
                yield pa.RecordBatch.from_arrays([texts[name].combine_chunks(), pa.array(ends - size), pa.array(size), pa.array(crc, pa.int64()), pa.array(np.full(n, part)), pa.array(np.full(n, seq))], names=schema.names)

    texts = files.select("part", "seq", "file").mapInArrow(read, schema)
    # one row a shard; sums by part first, so no task sees all shards
    shards = files.select("part", "seq", "n_tokens")
    before = Window.unboundedPreceding, -1
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("part_start", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(*before)), F.lit(0)))
    inner = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(*before)), F.lit(0))
    starts = scratch.stored(shards.withColumn("seq_start", inner).join(parts, "part").select("part", "seq", (F.col("part_start") + F.col("seq_start")).alias("shard_start")), "starts")
    return texts.join(starts, ["part", "seq"]).select(name, (F.col("shard_start") + F.col("__within")).alias("start"), "n_tokens", "ids_crc32", "part", "seq")
