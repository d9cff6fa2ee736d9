"""Substring dedup with fixed-block anchors.

The words of every text are cut into non-overlapping blocks of `block` words, and these are indexed.
Every rolling window of `block` words probes the index. A repeated window of `window` words holds a
whole block if window >= 2 * block - 1, so each occurrence of a repeat has an indexed block that the
other occurrence probes: no repeat escapes. Hits extend to all windows around their block; windows
that come up again grow together to maximal exact repeats, which are removed.

Blocks, probes and windows travel as sorted distinct hashes of a chunk (see chunks.py), never as
pairs, so a passage in a third of all documents costs one entry a chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from citeloom.llm.chunks import SENT, answered, bucket_count, chunked, distinct, each_answered, each_chunk, exchanged, send, short
from citeloom.llm.common import Scratch, scratch_of
from citeloom.llm.textarrays import Words, inside, joined, windows

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
OUT = {"n_words": T.LongType(), "n_removed": T.LongType(), "kept_text": T.StringType(), "removed_spans": SPANS}


def _probes(words: Words, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and keys of all rolling windows, and which of them are index blocks."""
    at = inside(words.at, block)
    keys = short(windows(words.hash, block)[at])
    first = words.at[:-1][words.text_of()[at]] if len(at) else at
    return at, keys, (at - first) % block == 0


def _candidates(words: Words, hits: np.ndarray, block: int, window: int) -> np.ndarray:
    """Starts of the windows around each hit block."""
    at, keys, aligned = _probes(words, block)
    known, _, _, _ = distinct(keys)
    blocks, found = at[aligned], keys[aligned]
    hit = hits[np.searchsorted(known, found)] if len(found) else np.zeros(0, np.uint8)
    blocks = blocks[(hit >> 7 == 1) & (hit & 127 >= 2)]
    around = np.zeros(len(words) + 1, np.int32)
    np.add.at(around, np.maximum(blocks - (window - block), 0), 1)
    np.add.at(around, blocks + 1, -1)
    starts = inside(words.at, window)
    return starts[np.cumsum(around)[starts] > 0]


def _windows(words: Words, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    return windows(words.hash, window)[starts], (windows(words.hash, window, second=True)[starts] >> np.uint64(32)).astype(np.uint32)


def repeated_starts(words: Words, starts: np.ndarray, window: int, counts: np.ndarray) -> np.ndarray:
    if not len(starts):
        return starts
    first, second = _windows(words, starts, window)
    keys, _, _, order = distinct(first, second=second)
    sorted_first, sorted_second = first[order], second[order]
    new = np.zeros(len(order), np.int64)
    new[1:] = (sorted_first[1:] != sorted_first[:-1]) | (sorted_second[1:] != sorted_second[:-1])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new)
    return starts[(counts[group] & 127) >= 2]


def remove_repeats(docs: DataFrame, text: str = "text", window: int = 35, chunk_bytes: int | None = None, prefix: str = "", scratch: Scratch | None = None) -> DataFrame:
    """Every row of docs with n_words, n_removed, kept_text (kept words joined by one space) and removed_spans (word positions).

    A word goes if any window of `window` words that covers it starts elsewhere too, in the same text or
    another; windows are judged on the input. Null texts count as empty: no words, kept_text ''. Texts
    shorter than the window stay whole; a text of any length is judged whole. Repeated rows are separate
    occurrences, so their windows go from both. An empty table gives an empty table. prefix: put in front of the
    four new names; input columns that still have one of them are replaced.
    """
    scratch = scratch_of(docs, scratch, "repeats")
    block = (window + 1) // 2
    chunks = chunked(docs, text, scratch, *([chunk_bytes] if chunk_bytes else []))
    buckets = bucket_count(chunks)

    def probe(chunk_id, rows):
        words = Words(rows[text])
        _, keys, aligned = _probes(words, block)
        known, counts, _, _ = distinct(keys, aligned.astype(np.uint8) << np.uint8(7))
        yield send(chunk_id, 1, known, counts, buckets)

    def extend(chunk_id, rows, answers):
        words = Words(rows[text])
        starts = _candidates(words, answered(answers, 1), block, window)
        first, second = _windows(words, starts, window)
        keys, counts, second, _ = distinct(first, second=second)
        return pa.Table.from_batches([send(chunk_id, 2, keys, counts, buckets, second)])

    named = {f"{prefix}{n}": t for n, t in OUT.items()}
    kept_fields = [f for f in docs.schema.fields if f.name not in named]
    schema = T.StructType([*kept_fields, *(T.StructField(n, t) for n, t in named.items())])

    def remove(chunk_id, rows, answers):
        words = Words(rows[text])
        starts = _candidates(words, answered(answers, 1), block, window)
        starts = repeated_starts(words, starts, window, answered(answers, 2))
        cover = np.zeros(len(words) + 1, np.int32)
        np.add.at(cover, starts, 1)
        np.add.at(cover, starts + window, -1)
        gone = np.cumsum(cover[:-1]) > 0
        total = np.concatenate(([0], np.cumsum(gone)))
        removed = total[words.at[1:]] - total[words.at[:-1]]
        keep = ~gone
        texts = pa.array([joined(words, keep, i) for i in range(len(removed))], pa.binary()).cast(pa.string())
        # runs of removed words within one text
        mark = np.zeros(len(words) + 1, bool)
        mark[:-1] = gone
        starts_here = np.zeros(len(words) + 1, bool)
        starts_here[words.at[:-1]] = True
        before = np.concatenate(([False], mark[:-1]))
        run_start = np.flatnonzero(mark & (~before | starts_here))
        run_end = np.flatnonzero(before & (~mark | starts_here))
        base = words.at[np.searchsorted(words.at, run_start, side="right") - 1]
        spans = pa.StructArray.from_arrays([pa.array(run_start - base), pa.array(run_end - base)], ["start", "end"])
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(run_start, words.at).astype(np.int32)), spans)
        more = [pa.array(words.counts().astype(np.int64)), pa.array(removed.astype(np.int64)), texts, lists]
        return pa.Table.from_arrays([*(rows[f.name].combine_chunks() for f in kept_fields), *more], names=schema.names)

    first = exchanged(each_chunk(chunks, probe, SENT))
    second = exchanged(each_answered(chunks, first, extend, SENT))
    return each_answered(chunks, first.unionByName(second), remove, schema)
