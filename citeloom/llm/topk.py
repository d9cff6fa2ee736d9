"""Exact top-k by inner product, by distributed histogram selection.

Queries and candidates travel as blocks of integer vectors, packed where the rows are read. Every pair of
blocks is scored; per query the scores are counted in a histogram of a range of scores that the k-th largest
lies in, histograms of all blocks are added up, and the range narrows to the bin with the k-th score, until
the range is one score. A last scoring keeps what is above it, and fills up with equal scores in the order of
the ids. No block's scores leave its task: only histogram bins and the few rows at or above the k-th score do.

A query vector crosses the network once for each candidate block, so a candidate block is large (some tens
of megabytes): 131,072 multiplications and additions a component pay for each component that is sent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.llm.common import Scratch, scratch_of

BLOCK = "block long, n long, dim int, most double, ids binary, vectors binary"
BINS = 1024
#: Scores and components must stay below these; what does not is an error.
MOST_SCORE, MOST_COMPONENT = 1 << 62, float(1 << 62)
#: Candidates that are scored at a time.
SLICE = 8192


def quantised(df: DataFrame, id_col: str, vector: str, scale: float) -> DataFrame:
    """id and floor(scale * x) of every vector without null or non-finite components; others take no part.

    A component of 2**62 or more after scaling is an error, since no long holds its products.
    """
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    fine = F.col(vector).isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.col(id_col).isNotNull()
    fit = lambda v: F.when(F.abs(v) < MOST_COMPONENT, F.floor(v)).otherwise(F.raise_error(F.concat(F.lit("a component is too large for integer scores: "), v.cast("string"))).cast("long"))
    return df.filter(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda v: fit(v * scale)).alias("v"))


def _exact(q: np.ndarray, c: np.ndarray, q_most: float, c_most: float) -> np.ndarray:
    """Integer inner products; float arithmetic only where it is exact, and Python's integers where 64 bits may not do."""
    bound = q_most * c_most * max(1, q.shape[1])
    if bound < 1 << 24:
        return (q.astype(np.float32) @ c.astype(np.float32).T).astype(np.int64)
    if bound < 1 << 53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    whole = q.astype(object) @ c.astype(object).T
    if whole.size and max(whole.max(), -whole.min()) >= MOST_SCORE:
        raise OverflowError("a score does not fit a 64-bit integer")
    return whole.astype(np.int64)


def _blocks(rows: DataFrame, most_rows: int, name: str, scratch: Scratch) -> DataFrame:
    """Stored blocks (BLOCK) of at most most_rows rows, packed in the order of the scan: no key decides, so no key is hot.

    Shorter vectors are filled up with 0. Blocks are numbered from 0 (one row a block, so one task numbers them).
    """

    def block(number: int, ids: list[np.ndarray], lists: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        size, flat = np.concatenate([s for s, _ in lists]), np.concatenate([f for _, f in lists])
        out = np.zeros((len(size), int(size.max(initial=0))), np.int64)
        out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
        most = float(np.abs(out).max(initial=0))
        out = out.astype(np.int16) if most < 1 << 15 else out
        key = np.concatenate(ids)
        order = np.argsort(key, kind="stable")
        values = ([number], [len(key)], pa.array([out.shape[1]], pa.int32()), [most], pa.array([key[order].tobytes()], pa.binary()), pa.array([out[order].tobytes()], pa.binary()))
        return pa.RecordBatch.from_arrays([pa.array(v) if isinstance(v, list) else v for v in values], ["block", "n", "dim", "most", "ids", "vectors"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, lists, held = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            lo = 0
            while lo < batch.num_rows:
                part = batch.slice(lo, most_rows - held)
                column = part.column(1)
                ids.append(part.column(0).to_numpy())
                lists.append((np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)))
                held, lo = held + part.num_rows, lo + part.num_rows
                if held == most_rows:
                    yield block(number, ids, lists)
                    number, ids, lists, held = number + 1, [], [], 0
        if held:
            yield block(number, ids, lists)

    blocks = scratch.stored(rows.mapInArrow(pack, BLOCK), name, "uncompressed")
    numbers = blocks.select(F.col("block"), (F.row_number().over(Window.orderBy("block")) - 1).cast("long").alias("number"))
    return scratch.stored(blocks.join(numbers, "block").drop("block").withColumnRenamed("number", "block").select("block", "n", "dim", "most", "ids", "vectors"), f"{name}-numbered", "uncompressed")


def _load(n: int, dim: int, most: float, ids: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
    kind = np.int16 if most < 1 << 15 else np.int64
    return np.frombuffer(ids, np.int64), np.frombuffer(vectors, kind).reshape(n, dim)


def _scores(row: dict) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Query ids, candidate ids and scores of a pair of blocks, some candidates at a time; a query's own row scores as absent (the least value)."""
    q_ids, q = _load(row["n"], row["dim"], row["most"], row["ids"], row["vectors"])
    all_ids, every = _load(row["c_n"], row["c_dim"], row["c_most"], row["c_ids"], row["c_vectors"])
    d = min(q.shape[1], every.shape[1])
    for lo in range(0, len(all_ids), SLICE):
        c_ids = all_ids[lo : lo + SLICE]
        s = _exact(q[:, :d], every[lo : lo + SLICE, :d], row["most"], row["c_most"])
        s[q_ids[:, None] == c_ids[None, :]] = np.iinfo(np.int64).min
        yield q_ids, c_ids, s


def top_k(
    df: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector: str = "embedding", scale: float = 64.0, query_rows: int = 1024, candidate_rows: int = 131_072, scratch: Scratch | None = None
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest scores among all other ids, ties to the smaller id; all, if fewer.

    Vectors (queries and candidates alike) with null or non-finite components, null vectors and null ids take
    no part. Of vectors of unlike length the common part counts. Rows with the id of the query are no
    candidates of it; other repeated rows are candidates one by one, and a repeated query row is one query.
    Components of 2**62 or more after scaling, and scores of 2**62 or more, are errors. Other columns, whatever
    their names, are not read. Empty tables give no rows. Nothing is broadcast: blocks of bounded size meet by
    number, in every pair.
    """
    scratch = scratch_of(df, scratch, "topk")
    asked = quantised(queries, id_col, vector, scale).dropDuplicates(["id"])
    candidates = _blocks(quantised(df, id_col, vector, scale), candidate_rows, "candidates", scratch)
    questions = _blocks(asked, query_rows, "queries", scratch)
    n_blocks, c_most, c_dim = candidates.agg(F.count(F.lit(1)), F.max("most"), F.max("dim")).first()
    q_most, q_dim = questions.agg(F.max("most"), F.max("dim")).first()
    high = int(min(float(MOST_SCORE), (c_most or 0) * (q_most or 0) * max(1, min(c_dim or 0, q_dim or 0)))) + 1
    spread = questions.withColumn("meets", F.explode(F.sequence(F.lit(0), F.lit(max(0, n_blocks - 1)))))
    named = candidates.select(*(F.col(c).alias(f"c_{c}") for c in ("block", "n", "dim", "most", "ids", "vectors")))
    # every query holds the range [lo, lo + step * BINS) of its k-th score and how many scores lie above it
    step = 1
    while step * BINS < 2 * high + 1:
        step *= BINS
    state = None

    def met(state: DataFrame | None) -> DataFrame:
        asks = spread if state is None else spread.join(state, "block")
        return asks.join(named, asks["meets"] == named["c_block"])

    while True:
        first, width = state is None, step

        def histogram(batches: Iterator[pa.RecordBatch], first=first, width=width) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    q_ids = np.frombuffer(row["ids"], np.int64)
                    los = np.full(len(q_ids), -high) if first else np.frombuffer(row["los"], np.int64)
                    counts = np.zeros((len(q_ids), BINS), np.int64)
                    for _, _, s in _scores(row):
                        for i, lo in enumerate(los.tolist()):
                            r = s[i]
                            bins = (r[r >= lo] - lo) // width
                            counts[i] += np.bincount(bins[bins < BINS], minlength=BINS)
                    # bins below this block's own k-th score cannot hold the k-th of all
                    tail = counts[:, ::-1].cumsum(axis=1)[:, ::-1]
                    at, used = np.nonzero((counts > 0) & (tail - counts < k))
                    yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (np.full(len(at), row["block"]), q_ids[at], used, counts[at, used])], names=["block", "query", "bin", "n"])

        sums = met(state).mapInArrow(histogram, "block long, query long, bin long, n long").groupBy("block", "query", "bin").agg(F.sum("n").alias("n"))
        above = F.coalesce(F.sum("n").over(Window.partitionBy("block", "query").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        due = F.lit(k) if first else F.col("due")
        if not first:
            sums = sums.join(state_rows, ["block", "query"])
        picked = sums.withColumn("above", above).filter((F.col("above") < due)).groupBy("block", "query").agg(F.min_by(F.struct("bin", "above"), "bin").alias("at"), *([] if first else [F.first("lo").alias("lo"), F.first("due").alias("due")]))
        lo = (F.lit(-high) if first else F.col("lo")) + F.col("at.bin") * width
        state_rows = scratch.stored(picked.select("block", "query", lo.alias("lo"), (due - F.col("at.above")).alias("due")), "range")
        state = _by_block(questions, state_rows, scratch)
        if width == 1:
            break
        step = max(1, width // BINS)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                los = np.frombuffer(row["los"], np.int64)
                for q_ids, c_ids, s in _scores(row):
                    out: list[list] = [[], [], []]
                    for i in np.flatnonzero((s >= los[:, None]).any(axis=1)).tolist():
                        at = np.flatnonzero(s[i] >= los[i])
                        if len(at) > k:
                            at = at[np.lexsort((c_ids[at], -s[i][at]))[:k]]
                        for x, y in zip(out, (np.full(len(at), q_ids[i]), c_ids[at], s[i][at]), strict=True):
                            x.append(y)
                    if out[0]:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in out], names=["query_id", "vec_id", "score"])

    kept = met(state).mapInArrow(keep, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return kept.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _by_block(questions: DataFrame, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Each query block's lower bounds in the order of its ids; a query without any candidate asks for nothing."""

    def gather(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"block": pa.array([], pa.int64()), "los": pa.array([], pa.binary())})
        ids = np.frombuffer(left["ids"][0].as_buffer(), np.int64)
        los = np.full(len(ids), np.iinfo(np.int64).max)
        los[np.searchsorted(ids, right["query"].to_numpy())] = right["lo"].to_numpy()
        return pa.table({"block": left["block"], "los": pa.array([los.tobytes()], pa.binary())})

    return scratch.stored(questions.select("block", "ids").groupBy("block").cogroup(rows.select("block", "query", "lo").groupBy("block")).applyInArrow(gather, "block long, los binary"), "bounds")
