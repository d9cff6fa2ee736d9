"""Chunks of whole rows, and an exchange that counts their keys over all chunks.

A chunk is one table row that holds some megabytes of input rows as a compressed Arrow stream, so a
step that needs "all keys of these rows" gets them together without a shuffle by row. The exchange
sends each chunk's *distinct* keys, sorted and delta-coded, to key-range buckets; a bucket adds up
what the chunks sent and answers each chunk with one byte a key. A key that a third of all rows hold
is one entry a chunk, so no bucket grows with a hot key.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import Scratch
from citeloom.llm.tokens import forget

CHUNK_BYTES = 3 << 20
CHUNK = "chunk_id long, n_rows long, n_bytes long, blob binary"
SENT = "bucket long, chunk_id long, stage int, n long, first long, wide int, keys binary, second binary, flags binary"
ANSWER = "chunk_id long, stage int, bucket long, n long, counts binary"
#: Bits of a key: so many that keys of a chunk rarely meet by chance, so few that sorted neighbours of a chunk are less than 2**32 apart.
KEY_BITS = 44
#: Codec of the answers, most of which are runs of one value.
CODEC = "zstd"


def to_blob(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_blob(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(blob)).read_all()


def chunked(df: DataFrame, text: str, scratch: Scratch, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """All rows and columns of df as a stored table of chunks (CHUNK)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, held, size = TaskContext.get().partitionId() << 24, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, held, size
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            row = pa.RecordBatch.from_arrays([pa.array([seq]), pa.array([whole.num_rows]), pa.array([size]), pa.array([to_blob(whole)], pa.binary())], ["chunk_id", "n_rows", "n_bytes", "blob"])
            seq, held, size = seq + 1, [], 0
            return row

        for batch in batches:
            if not batch.num_rows:
                continue
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 8)
            lo = 0
            while lo < batch.num_rows:
                base = int(ends[lo - 1]) if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, base + chunk_bytes - size, side="right")))
                held.append(batch.slice(lo, hi - lo))
                size += int(ends[hi - 1]) - base
                lo = hi
                if size >= chunk_bytes or lo < batch.num_rows:
                    yield flush()
        if held:
            yield flush()

    return scratch.stored(df.mapInArrow(pack, CHUNK), "chunks", "uncompressed")


def bucket_count(chunks: DataFrame, bytes_each: int = 12 << 20) -> int:
    """So many buckets that each gets the keys of about bytes_each of text."""
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    return max(16, math.ceil(total / bytes_each))


def distinct(keys: np.ndarray, flags: np.ndarray | None = None, second: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray]:
    """Sorted distinct keys, how often each came (127 at most) with the highest bit of any flag, their second lanes, and the order of the input."""
    order = np.argsort(keys, kind="stable") if second is None else np.lexsort((second, keys))
    k = keys[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    if second is not None:
        s = second[order]
        new[1:] |= s[1:] != s[:-1]
    at = np.flatnonzero(new)
    count = np.minimum(np.diff(np.append(at, len(k))), 127).astype(np.uint8)
    if flags is not None and len(at):
        count |= np.maximum.reduceat(flags[order], at) & np.uint8(128)
    return k[at], count, (None if second is None else s[at]), order


def short(hashes: np.ndarray) -> np.ndarray:
    """Keys: the highest KEY_BITS bits of 64-bit hashes."""
    return hashes >> np.uint64(64 - KEY_BITS)


def _width(buckets: int, wide: bool) -> int:
    return -(-(1 << (64 if wide else KEY_BITS)) // buckets)


def send(chunk_id: int, stage: int, keys: np.ndarray, flags: np.ndarray, buckets: int, second: np.ndarray | None = None) -> pa.RecordBatch:
    """One row (SENT) for each bucket with keys. Without a second lane keys have KEY_BITS bits."""
    wide = second is not None
    bucket = (keys // np.uint64(_width(buckets, wide))).astype(np.int64)
    at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(keys) else np.zeros(0, np.int64)
    ends = np.append(at[1:], len(keys)) if len(at) else at
    out: list[list] = [[] for _ in range(9)]
    for lo, hi in zip(at, ends, strict=True):
        part = keys[lo:hi]
        gaps = np.diff(part)
        raw = wide or (len(gaps) and int(gaps.max()) >> 32)
        for col, x in zip(out, (int(bucket[lo]), chunk_id, stage, hi - lo, 0 if raw else int(part[0]), int(bool(raw)), part.tobytes() if raw else gaps.astype(np.uint32).tobytes(), second[lo:hi].tobytes() if wide else b"", flags[lo:hi].tobytes()), strict=True):
            col.append(x)
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    names = ("bucket", "chunk_id", "stage", "n", "first", "wide", "keys", "second", "flags")
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], list(names))


def _received(row: dict) -> np.ndarray:
    if row["wide"]:
        return np.frombuffer(row["keys"], np.uint64)
    out = np.empty(row["n"], np.uint64)
    out[0] = row["first"]
    np.cumsum(np.frombuffer(row["keys"], np.uint32), dtype=np.uint64, out=out[1:])
    out[1:] += np.uint64(row["first"])
    return out


def quantised(total: np.ndarray) -> np.ndarray:
    """A count in 7 bits: itself below 64, then four steps for each doubling."""
    high = 64 + np.minimum(63, 4 * np.log2(np.maximum(total, 64) / 64))
    return np.where(total < 64, total, high).astype(np.uint8)


def add_up(table: pa.Table) -> pa.Table:
    """A bucket's rows (SENT) to its answers (ANSWER): for each key the count over all chunks (quantised), with the highest bit of any flag."""
    rows = table.to_pylist()
    keys = np.concatenate([_received(r) for r in rows])
    flags = np.concatenate([np.frombuffer(r["flags"], np.uint8) for r in rows])
    wide = bool(rows[0]["second"])
    second = np.concatenate([np.frombuffer(r["second"], np.uint32) for r in rows]) if wide else None
    order = np.lexsort((second, keys)) if wide else np.argsort(keys, kind="stable")
    k = keys[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    if wide:
        s = second[order]
        new[1:] |= s[1:] != s[:-1]
    at = np.flatnonzero(new)
    f = flags[order]
    result = quantised(np.add.reduceat((f & 127).astype(np.int64), at)) | np.maximum.reduceat(f & np.uint8(128), at)
    answer = np.empty(len(keys), np.uint8)
    answer[order] = np.repeat(result, np.diff(np.append(at, len(keys))))
    ends = np.cumsum([r["n"] for r in rows])
    packed = [pa.compress(answer[e - r["n"] : e].tobytes(), CODEC, asbytes=True) for r, e in zip(rows, ends, strict=True)]
    pick = lambda c: [r[c] for r in rows]
    return pa.table({"chunk_id": pa.array(pick("chunk_id"), pa.int64()), "stage": pa.array(pick("stage"), pa.int32()), "bucket": pa.array(pick("bucket"), pa.int64()), "n": pa.array(pick("n"), pa.int64()), "counts": pa.array(packed, pa.binary())})


def exchanged(sent: DataFrame) -> DataFrame:
    return sent.groupBy("bucket").applyInArrow(add_up, ANSWER)


def answered(table: pa.Table, stage: int) -> np.ndarray:
    """The bytes for a chunk's sorted distinct keys."""
    rows = sorted((r for r in table.to_pylist() if r["stage"] == stage), key=lambda r: r["bucket"])
    parts = [np.frombuffer(pa.decompress(r["counts"], r["n"], CODEC, asbytes=True), np.uint8) for r in rows]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint8)


def each_chunk(chunks: DataFrame, run: Callable[[int, pa.Table], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for row in batch.select(["chunk_id", "blob"]).to_pylist():
                yield from run(row["chunk_id"], from_blob(row["blob"]))
                pa.default_memory_pool().release_unused()

    return chunks.mapInArrow(over, schema)


def each_answered(chunks: DataFrame, answers: DataFrame, run: Callable[[int, pa.Table, pa.Table], pa.Table], schema) -> DataFrame:
    """run(chunk_id, rows, answers) for each chunk; the chunk crosses the network compressed."""

    def over(left: pa.Table, right: pa.Table) -> pa.Table:
        forget()
        row = left.select(["chunk_id", "blob"]).to_pylist()[0]
        return run(row["chunk_id"], from_blob(row["blob"]), right)

    return chunks.select("chunk_id", "blob").groupBy("chunk_id").cogroup(answers.groupBy("chunk_id")).applyInArrow(over, schema)
