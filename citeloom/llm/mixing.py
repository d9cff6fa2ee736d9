"""Mixing sources to target weights by balanced sampling with the cube method.

Each source gets a target by weight, at most `cap` times its size. A document is taken
floor(target / size of its source) times, and once more with the fraction that is left. The cube
method draws these fractions: it moves the inclusion probabilities of three documents at a time along
the null-space of (words, 1), so the source's word and document totals stay as they are, until one
probability is 0 or 1. Blocks of a source do this in parallel; the few documents that a block leaves
open go on to a block of the next level, and the last few of a source are a landing problem.

A document much larger than its neighbours hardly moves in a step of three and would stay open until the landing, where
nothing makes up for it. So the documents far above a block's mean fly first: each moves along the null-space of
(words, 1) of the whole block, its unit vector projected on it, until it or another document is at 0 or 1.
All but the few documents of the landing are so decided by the flight, at every size of a source. Where a document is
so large that the others cannot make up for both totals, the total of documents is dropped for its step, as a landing of
the cube method does, and the words are kept.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.llm.common import Scratch, distinct_names, free_name, rows_named, scratch_of
from citeloom.llm.textarrays import Words

NEAR = 1e-9
#: Documents of a source that the landing decides together, by trying all 2**LANDING choices.
LANDING = 13
#: Documents of more than so many times a block's mean size fly against the whole block.
LARGE = 4.0
#: Steps that a large document may take while others reach an end before it, and the share of them that may.
STEPS, SPENT = 64, 0.25
#: Draws of a large document's way before a total is dropped.
TRIES = 4


def word_counts(docs: DataFrame, columns: list[str], text: str) -> DataFrame:
    """The named columns and size: the words of the text."""
    fields = [docs.schema[c] for c in columns]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = Words(batch.column(batch.num_columns - 1), hashes=False).counts()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes.astype(np.int64))], names=[*columns, "size"])

    schema = T.StructType([*fields, T.StructField("size", T.LongType())])
    return docs.select(*columns, F.col(text)).mapInArrow(count, schema)


def targets(sizes: DataFrame, source: str, weights: tuple[int, ...], cap: int) -> DataFrame:
    """Per source: source_size, n_docs and target.

    target = min(cap * source_size, level * weight) with the level at which targets sum to all sizes;
    for sources in the order of cap * size / weight the level is the largest of
    (all sizes - caps of the first i) / weights of the rest. Works on one row a source.
    """
    per = sizes.groupBy(F.col(source).alias("__source")).agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    place = F.row_number().over(Window.orderBy(F.col("__source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight)
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("__source").asc_nulls_last())
    whole = Window.partitionBy(F.lit(1))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    capped = F.coalesce(F.sum("source_size").over(before), F.lit(0)) * cap
    left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", (F.sum("source_size").over(whole) - capped) / left)
    level = F.max("level").over(whole)
    return per.select("__source", "source_size", "n_docs", F.least((F.col("source_size") * cap).cast("double"), level * F.col("weight")).alias("target"))


def _steps(g: int, scaled: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray | None:
    """Probabilities after document g has moved to an end along the null-space of (words, 1) of all open documents.

    A step moves the others by v_i = -p_i (1 - p_i) (a + b * size_i), with a and b such that words and documents stay what
    they are, up or down to the first end, so that the expected move is none. None where that takes more than SPENT
    of the others to an end: they cannot make up for g.
    """
    p, at_first = p.copy(), None
    for _ in range(STEPS):
        others = np.flatnonzero((p > NEAR) & (p < 1 - NEAR))
        others = others[others != g]
        at_first = len(others) if at_first is None else at_first
        w, x = p[others] * (1 - p[others]), scaled[others]
        s0, s1, s2 = w.sum(), w @ x, w @ (x * x)
        det = s0 * s2 - s1 * s1
        if len(others) < max(3, (1 - SPENT) * at_first) or det <= 1e-12 * s0 * s2:
            return None
        move = np.append(1.0, -w * ((s2 - s1 * scaled[g]) / det + (s0 * scaled[g] - s1) / det * x))
        who = np.append(g, others)
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(move > 0, (1 - p[who]) / move, np.where(move < 0, -p[who] / move, np.inf)).min()
            down = np.where(move > 0, p[who] / move, np.where(move < 0, (p[who] - 1) / move, np.inf)).min()
        step = up if rng.random() * (up + down) < down else -down
        p[who] = np.clip(p[who] + step * move, 0.0, 1.0)
        near = who[np.abs(p[who] - np.round(p[who])) <= NEAR]
        p[near] = np.round(p[near])
        if not NEAR < p[g] < 1 - NEAR:
            return p
    return None


def _by_words(g: int, size: np.ndarray, p: np.ndarray, rng: np.random.Generator, force: bool) -> np.ndarray | None:
    """Probabilities after g is 0 or 1 and all other open documents are scaled the other way, so that the words stay what they are.

    The constraint on documents is dropped for this one document. The end is drawn where the others can make up for both;
    where they can for neither, the result is None or, with force, the nearer end.
    """
    open_ = np.flatnonzero((p > NEAR) & (p < 1 - NEAR))
    others = open_[open_ != g]
    words, base = size[others].sum(), p[others] @ size[others]
    due = base + p[g] * size[g]
    fits = [t for t in (0.0, 1.0) if -1e-9 <= due - t * size[g] <= words + 1e-9]
    if not fits and not force:
        return None
    if len(fits) == 2:
        take = float(rng.random() < p[g])
    else:
        take = fits[0] if fits else min((0.0, 1.0), key=lambda t: abs(min(max(due - t * size[g], 0.0), words) + t * size[g] - due))
    p, left = p.copy(), min(max(due - take * size[g], 0.0), words)
    p[g] = take
    if left <= base:
        p[others] *= left / base if base else 0.0
    elif words > base:
        p[others] = 1 - (1 - p[others]) * (words - left) / (words - base)
    return np.where(np.abs(p - np.round(p)) <= NEAR, np.round(p), p)


def large_first(size: np.ndarray, prob: np.ndarray, rng: np.random.Generator, large: float = LARGE, last: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities after the steps of the documents over `large` times the mean size, in falling order of size, and which of them are still open.

    A document that the others cannot make up for in words and documents together goes by words alone; one that they
    cannot make up for in words stays open for a larger block, unless this is the last.
    """
    p, waiting = prob.astype(float), np.zeros(len(size), bool)
    at = np.flatnonzero((p > NEAR) & (p < 1 - NEAR))
    if len(at) < 4:
        return p, waiting
    scaled = size / max(size[at].mean(), 1e-9)
    for g in at[np.argsort(-size[at], kind="stable")]:
        if scaled[g] <= large:
            break
        if not NEAR < p[g] < 1 - NEAR:
            continue
        # where one end is out of the others' reach, another draw may lead to the one that is not
        moved = next((m for m in (_steps(g, scaled, p, rng) for _ in range(TRIES)) if m is not None), None)
        moved = _by_words(g, size, p, rng, last) if moved is None else moved
        waiting[g] = moved is None
        p = p if moved is None else moved
    return p, waiting


def flight(size: np.ndarray, prob: np.ndarray, rng: np.random.Generator, rest: int = 0) -> np.ndarray:
    """Probabilities after the flight of all but the last `rest` documents; at most two others are still fractions."""
    prob, draws = prob.astype(float), rng.random(len(size) + 3)
    p, x, open_ = prob.tolist(), size.tolist(), []
    for i, draw in zip(range(len(p) - rest + 2), draws, strict=False):
        if i < len(p) - rest:
            if NEAR < p[i] < 1 - NEAR:
                open_.append(i)
            else:
                p[i] = float(round(p[i]))
        while len(open_) >= 3 or len(open_) == 2 and x[open_[0]] == x[open_[1]]:
            if len(open_) >= 3:
                a, b, c = (x[j] for j in open_[:3])
                u = (b - c, c - a, a - b) if a != b or b != c else (1, -1, 0)
            else:
                u = (1, -1)
            moves = [(j, v) for j, v in zip(open_, u, strict=False) if v]
            up = min((1 - p[j]) / v if v > 0 else -p[j] / v for j, v in moves)
            down = min(p[j] / v if v > 0 else (p[j] - 1) / v for j, v in moves)
            step = up if draw * (up + down) < down else -down
            for j, v in moves:
                p[j] += step * v
                if not NEAR < p[j] < 1 - NEAR:
                    p[j] = float(round(p[j]))
            kept = [j for j in open_ if 0 < p[j] < 1]
            if len(kept) == len(open_):  # rounding kept it from an end: round the nearest
                j = min(open_, key=lambda k: min(p[k], 1 - p[k]))
                p[j] = float(round(p[j]))
                kept.remove(j)
            open_ = kept
    return np.array(p)


def landing(size: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """The last fractions, set so that the words, and with less weight the documents, come nearest to what is due."""
    rest = np.flatnonzero((prob > 0) & (prob < 1))
    choices = np.array(list(itertools.product((0.0, 1.0), repeat=len(rest))))
    words = np.abs((choices - prob[rest]) @ size[rest])
    documents = np.abs((choices - prob[rest]).sum(axis=1))
    prob = prob.copy()
    prob[rest] = choices[np.argmin(words + documents * (0.03 * size[rest].mean() if len(rest) else 0))]
    return prob


def _flier(id_col: str, seed: int, level: int, last: bool):
    """Flies one block, in the order of size (large first), id, text and number."""

    def fly(key: tuple, table: pa.Table) -> pa.Table:
        ids = table[id_col].cast(pa.string()).fill_null("").to_numpy().astype(str)
        order = np.lexsort((table["__ordinal"].to_numpy(), table["__digest"].to_numpy(), ids, -table["size"].to_numpy()))
        rest = min(LANDING - 2, table.num_rows // 2)
        if rest:  # evenly by rank, but for the largest
            late = np.linspace(table.num_rows // 6, table.num_rows - 1, rest).astype(int)
            order = np.concatenate((np.delete(order, late), order[late]))
        size, prob = table["size"].to_numpy()[order].astype(float), table["__prob"].to_numpy()[order]
        name = repr((seed, level, *(k.as_py() for k in key)))
        rng = np.random.default_rng(zlib.crc32(name.encode()))
        prob, waiting = large_first(size, prob, rng, last=last)
        if waiting.any():  # behind those that fly
            late = np.argsort(waiting, kind="stable")
            order, size, prob, rest = order[late], size[late], prob[late], rest + int(waiting.sum())
        prob = flight(size, prob, rng, rest)
        prob = landing(size, prob) if last else prob
        return table.take(pa.array(order)).set_column(table.schema.get_field_index("__prob"), "__prob", pa.array(prob))

    return fly


def _ordinals(sizes: DataFrame, keys: list[str], scratch: Scratch) -> DataFrame:
    """sizes (with __part and __row) with __ordinal, from 0 among the rows that are equal in keys: numbered part by part, so that no task holds all of a row's copies."""
    flags = [F.col(k).isNull() for k in keys]
    rows = sizes.withColumn("__class", F.xxhash64(*keys, *flags))
    counts = rows.groupBy("__class", "__part").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy("__class")
    before = F.coalesce(F.sum("__n").over(w.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    again = counts.select("__class", "__part", before.alias("__before"), F.sum("__n").over(w).alias("__all")).filter("__all > 1").drop("__all")
    again = scratch.stored(again, "again")
    if again.isEmpty():
        return rows.withColumn("__ordinal", F.lit(0).cast("long")).drop("__class")
    within = F.row_number().over(Window.partitionBy("__class", "__part").orderBy("__row")) - 1
    out = rows.join(again, ["__class", "__part"], "left").withColumn("__ordinal", F.when(F.col("__before").isNull(), F.lit(0).cast("long")).otherwise(F.col("__before") + within))
    return out.drop("__class", "__before")


def mixed(
    docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: int = 29, block_rows: int = 8192, fan_in: int = 64, scratch: Scratch | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Per row: the id, the source, size, source_size, target, copies and taken (copies * size), and the columns in `keep`.

    Null texts have size 0, null sources are a source of their own, placed last. A source whose words are
    all 0 has target 0 and no copies. Ties and repeated rows are ordered by size, id (a null like an empty one), text and
    number among equal rows; rows equal in id, source and text may swap. An empty table gives an empty table. Reruns
    agree, however the rows are partitioned: blocks, order and draws come from hashes of source, id, text and seed.
    A document's copies stay within the cap. A text of any length is one document with its words as size; where
    it is most of its source, or larger than all others of its block together, the target can be missed by up to half of it. Other columns, whatever their names,
    are not read; an id, source or kept column named like an output is an error.
    """
    distinct_names({id_col, source, *keep}, ("size", "source_size", "target", "copies", "taken"))
    scratch = scratch_of(docs, scratch, "mixing")
    own = list(dict.fromkeys([id_col, source, *keep]))
    digest = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    sizes = word_counts(docs.withColumn("__digest", digest), [*own, "__digest"], text)
    sizes = scratch.stored(sizes.withColumns({"__row": F.monotonically_increasing_id(), "__part": F.spark_partition_id()}), "sizes")
    per = scratch.stored(targets(sizes, source, weights, cap), "targets")
    most = per.agg(F.max("n_docs")).first()[0] or 0
    sizes = _ordinals(sizes, list(dict.fromkeys([id_col, source, "__digest"])), scratch)
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = sizes.join(per, F.col(source).eqNullSafe(F.col("__source"))).drop("__source")
    base = F.floor(due + NEAR)
    block = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), "__digest", "__ordinal"), F.ceil(F.col("n_docs") / block_rows))
    rows = rows.select(*own, "size", "source_size", "target", "__digest", "__ordinal", base.alias("__base"), F.greatest(due - base, F.lit(0.0)).alias("__prob"), block.alias("__block"))
    schema = rows.schema
    out, state, open_blocks, level = None, rows, max(1, math.ceil(most / block_rows)), 0
    while True:
        last = open_blocks == 1

        moved = state.groupBy(source, "__block").applyInArrow(_flier(id_col, seed, level, last), schema)
        moved = moved if last else scratch.stored(moved, f"level{level}")
        done = moved if last else moved.filter("__prob in (0.0, 1.0)")
        out = done if out is None else out.unionByName(done)
        if last:
            break
        state = moved.filter("__prob not in (0.0, 1.0)").withColumn("__block", F.floor(F.col("__block") / fan_in))
        open_blocks, level = -(-open_blocks // fan_in), level + 1
    copies = (F.col("__base") + F.col("__prob").cast("long")).alias("copies")
    return out.select(*own, "size", "source_size", "target", copies).withColumn("taken", F.col("copies") * F.col("size"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", scratch: Scratch | None = None, **options) -> DataFrame:
    """The rows of docs, each as often as mixed() takes it. Rows are told apart by their place in the table, so null and repeated ids take what is theirs."""
    scratch = scratch_of(docs, scratch, "mixing")
    named, at = rows_named(docs, scratch)
    times, copy = free_name("__copies", named), free_name("__copy", named)
    copies = scratch.stored(mixed(named, id_col=id_col, scratch=scratch, keep=tuple(at), **options).filter("copies > 0").select(*at, F.col("copies").alias(times)), "copies")
    return named.join(copies, at).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).select(*docs.columns)
