"""Best-fit packing of token pieces into sequences, by hierarchical residual packing.

Blocks of pieces are packed best-fit (longest first) on their own. Nearly full bins are done; the
underfull ones become items of the next level, where more blocks meet, until few are left or a level
gains nothing. A bin is one long id and a fill, so the tree moves no token and no text.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.llm.common import Scratch, distinct_names, scratch_of
from citeloom.llm.tokens import encoder, slices


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", end: int = 0, capacity: int = 2048) -> DataFrame:
    """Per piece of at most `capacity` ids: the id, piece, start, length, ids_crc32.

    A null or empty text is its end id alone; a text of any length is encoded whole. Other columns, whatever their
    names, are not read; an id column named like an output of this or of packed() is an error.
    """
    distinct_names({id_col}, ("piece", "start", "length", "ids_crc32", "sequence_id", "offset"))
    schema = T.StructType([docs.schema[id_col], T.StructField("piece", T.IntegerType()), *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32"))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                ids, at = encoder(tokenizer).encode(part.column(1), end)
                size = np.diff(at)
                n = -(-size // capacity)
                row = np.repeat(np.arange(len(size)), n)
                piece = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(size[row] - start, capacity)
                first, raw = at[:-1][row] + start, ids.astype("<u4").view(np.uint8)
                crc = [zlib.crc32(raw[a * 4 : b * 4]) for a, b in zip(first.tolist(), (first + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], names=schema.names)

    return docs.select(id_col, text).mapInArrow(cut, schema)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each item's bin and offset, and the bins' fills: longest first, each to the fullest bin that holds it."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_, fills = 0, []  # bit r of open_: a bin has r left
    for i, length in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fit = open_ >> length
        if fit:
            left = length + (fit & -fit).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                open_ &= ~(1 << left)
        else:
            left, b = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += length
        left -= length
        if left:
            room[left].append(b)
            open_ |= 1 << left
    return bins, offsets, np.array(fills, np.int64)


def _packer(level: int, length: str, capacity: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        bins, offsets, fills = best_fit(table[length].to_numpy(), capacity)
        names = (level << 58) + (int(key[0].as_py()) << 26) + bins
        for name, x in (("__bin", names), ("offset", offsets), ("__fill", fills[bins])):
            table = table.append_column(name, pa.array(x, pa.int64()))
        return table

    return run


def _packed(items: DataFrame, n: int, key: str, length: str, level: int, capacity: int, block_rows: int) -> DataFrame:
    """Items dealt to blocks by a hash of their (distinct) key, and packed block by block."""
    blocks = max(1, math.ceil(n / block_rows))
    dealt = items.withColumn("__block", F.pmod(F.xxhash64(F.lit(level), key), F.lit(blocks)))
    schema = T.StructType([*dealt.schema.fields, *(T.StructField(c, T.LongType()) for c in ("__bin", "offset", "__fill"))])
    return dealt.groupBy("__block").applyInArrow(_packer(level, length, capacity), schema).drop("__block")


def packed(cut: DataFrame, capacity: int = 2048, full: int = 2040, block_rows: int = 16384, gain: float = 0.01, scratch: Scratch | None = None) -> DataFrame:
    """Every row of pieces() with sequence_id and offset: the place in a sequence of at most `capacity` tokens.

    Offsets of a sequence are gapless from 0. Bins of `full` tokens or more are done at once. Null ids and
    repeated rows are packed like any others: blocks come from a number that each piece gets when it is
    stored, so no id is hot. An empty table gives an empty table.
    """
    scratch = scratch_of(cut, scratch, "packing")
    stored = scratch.stored(cut.withColumn("__row", F.monotonically_increasing_id()), "pieces")
    placed = scratch.stored(_packed(stored, stored.count(), "__row", "length", 1, capacity, block_rows), "level1")
    # open bins of the first level, and where each has gone since: to which bin, from which offset on
    items = placed.filter(F.col("__fill") < full).groupBy("__bin").agg(F.max("__fill").alias("__held"))
    level, moves, before = 1, None, None
    while level < 16:
        left = items.count()
        if left < 2 or before and left > before * (1 - gain):
            break
        before, level = left, level + 1
        moved = scratch.stored(_packed(items.withColumnRenamed("__bin", "__item"), left, "__item", "__held", level, capacity, block_rows), f"level{level}")
        step = moved.select("__item", F.col("__bin").alias("__to"), F.col("offset").alias("__base"))
        if moves is None:
            moves = step.select(F.col("__item").alias("__bin"), "__to", "__base")
        else:
            on = moves.join(step.withColumnsRenamed({"__to": "__next", "__base": "__more"}), F.col("__to") == F.col("__item"), "left")
            moves = scratch.stored(on.select("__bin", F.coalesce("__next", "__to").alias("__to"), (F.col("__base") + F.coalesce("__more", F.lit(0))).alias("__base")), f"moves{level}")
        items = moved.filter(F.col("__fill") < full).groupBy("__bin").agg(F.max("__fill").alias("__held"))
    if moves is None:
        return placed.select(*cut.columns, F.col("__bin").alias("sequence_id"), "offset")
    rows = placed.join(moves, "__bin", "left")
    return rows.select(*cut.columns, F.coalesce("__to", "__bin").alias("sequence_id"), (F.col("offset") + F.coalesce("__base", F.lit(0))).alias("offset"))
