"""SimHash near-duplicates: fingerprints, pigeonring filtering, components of the links.

A fingerprint is cut into five segments that stand in a ring. If two fingerprints differ in at most `distance` bits,
some segment starts a chain whose first 1, 2, ... segments differ in at most 1, 2, ... times distance / 5 bits, added
up (the pigeonring principle). For four bits the first segment must be equal, the first two may differ in one bit,
three in two, four in three. So two fingerprints meet under a key of 26 bits, two neighbouring segments: every
fingerprint is filed under its own key of each chain, and those of even parity in the second segment also under the
keys with one of its bits turned (of two that differ in one bit there, one is even). Pairs under a key pass the rest of
the chain, then the full Hamming check.

Equal fingerprints are one node from the start. A task joins what it links into local components and emits one edge
a node, never its pairs. Keys with many fingerprints are dealt into blocks: first each block by itself, then, where a
key still holds several components, the rows outside its largest component against each of its blocks. All
pairs whose ends are not yet connected are so compared, and nothing is capped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.llm.common import Scratch, distinct_names, scratch_of
from citeloom.llm.components import components
from citeloom.llm.tokens import slices

U = np.uint64
#: First bit of each segment, and where the last one ends.
RING = (0, 13, 26, 39, 52, 64)
SEGMENTS = len(RING) - 1
#: Shingles that are hashed before their bits are added up.
RUN = 1 << 15
#: Fingerprints of a key that a task compares with each other.
BLOCK = 8192
#: Rows of all keys that go to one task at a time.
TASK_ROWS = 200_000
SEED = 42


def fingerprint(text: bytes, k: int = 4) -> int:
    """64 bits: each is 1 if over half of the hashes of the k-word shingles (repeats included) have it."""
    words = text.lower().split()
    if not words:
        return 0
    data, end = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    start = np.concatenate(([0], end[:-1] + 1))
    ends = end[k - 1 :] if len(words) >= k else end[-1:]
    n, ones, digest = len(ends), np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for lo in range(0, n, RUN):
        hashes = np.array([digest(data[a:b], SEED) for a, b in zip(start[lo : lo + RUN].tolist(), ends[lo : lo + RUN].tolist(), strict=False)], U)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str, text: str, k: int) -> DataFrame:
    """The id and fp, the fingerprint as a long, of each row."""
    schema = T.StructType([docs.schema[id_col], T.StructField("fp", T.LongType())])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 4 << 20):
                found = np.array([fingerprint(t or b"", k) for t in part.column(1).cast(pa.large_binary()).to_pylist()], U)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.view(np.int64))], names=schema.names)

    return docs.select(id_col, F.col(text)).mapInArrow(mark, schema)


def _segment(i: int) -> tuple[int, int]:
    return RING[i % SEGMENTS], RING[i % SEGMENTS + 1] - RING[i % SEGMENTS]


def _mask(first: int, n: int) -> int:
    """The bits of n segments from the first on, around the ring."""
    return sum(((1 << size) - 1) << at for at, size in (_segment(first + j) for j in range(n)))


def budgets(distance: int) -> list[int]:
    """How many bits the first 1, 2, ... segments of a chain may differ in."""
    return [distance * n // SEGMENTS for n in range(1, SEGMENTS + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def filed(fps: DataFrame) -> DataFrame:
    """(chain, key, fp, own): the fingerprint under its own key of each chain, and with one bit of the second segment turned where its parity is even.

    The key keeps the two segments' bits in place. own is false for turned keys; two of these need not be compared.
    """
    entries = []
    for i in range(SEGMENTS):
        at, size = _segment(i + 1)
        key = F.col("fp").bitwiseAND(F.lit(_signed(_mask(i, 2))))
        even = F.bit_count(F.col("fp").bitwiseAND(F.lit(_signed(_mask(i + 1, 1))))) % 2 == 0
        entry = lambda key, own: F.struct(F.lit(i).alias("chain"), key.alias("key"), F.lit(own).alias("own"))  # noqa: B023, E731
        turned = F.array(*(entry(key.bitwiseXOR(F.lit(_signed(1 << (at + b)))), False) for b in range(size)))
        entries.append(F.when(even, F.concat(F.array(entry(key, True)), turned)).otherwise(F.array(entry(key, True))))
    return fps.select("fp", F.explode(F.concat(*entries)).alias("e")).select("e.chain", "e.key", "fp", "e.own")


def _least(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least node that each of n nodes reaches by edges x-y."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _pairs(distance: int, across: bool):
    """The links of a task's blocks (chain, key, block) as one edge (u, v) for each fingerprint but the first of a local component.

    across: only rows of different components are compared, and only those that stand in `minor` with all others.
    """
    cuts = budgets(distance)
    chains = np.array([[_mask(i, n) for n in range(3, SEGMENTS)] for i in range(SEGMENTS)], U)

    def run(table: pa.Table) -> pa.Table:
        t = table.sort_by([("chain", "ascending"), ("key", "ascending"), ("block", "ascending")])
        chain, key, block, own = (t[c].to_numpy() for c in ("chain", "key", "block", "own"))
        fp = t["fp"].to_numpy().view(U)
        own = own.astype(bool)
        if across:
            comp, minor = t["component"].to_numpy(), t["minor"].to_numpy().astype(bool)
        new = np.ones(len(key), bool)
        new[1:] = (chain[1:] != chain[:-1]) | (key[1:] != key[:-1]) | (block[1:] != block[:-1])
        at = np.append(np.flatnonzero(new), len(key))
        left, right = [], []

        def keep(x: np.ndarray, y: np.ndarray) -> None:
            ok = own[x] | own[y]
            if across:
                ok &= (comp[x] != comp[y]) & (minor[x] | minor[y])
            x, y = x[ok], y[ok]
            apart = fp[x] ^ fp[y]
            for step, most in enumerate(cuts[2:-1]):
                ok = np.bitwise_count(apart & chains[chain[x], step]) <= most
                x, y, apart = x[ok], y[ok], apart[ok]
            ok = np.bitwise_count(apart) <= distance
            left.append(x[ok])
            right.append(y[ok])

        size = np.diff(at)
        small = size <= 48
        group = np.repeat(np.arange(len(size)), size)
        rows = np.flatnonzero((small & (size > 1))[group]) if len(group) else np.zeros(0, np.int64)
        for d in range(1, int(size[small].max()) if small.any() else 0):
            x, y = rows[:-d], rows[d:]
            same = group[x] == group[y]
            keep(x[same], y[same])
        for g in np.flatnonzero(~small):
            for r in range(at[g], at[g + 1] - 1):
                y = np.arange(r + 1, at[g + 1])
                keep(np.full(len(y), r), y)
        named, node = np.unique(fp, return_inverse=True)
        join = lambda parts: node[np.concatenate(parts)] if parts else np.zeros(0, np.int64)
        label = _least(len(named), join(left), join(right))
        tied = np.flatnonzero(label != np.arange(len(named)))
        return pa.table({"u": pa.array(named[tied].view(np.int64)), "v": pa.array(named[label[tied]].view(np.int64))})

    return run


def _dealt(rows: DataFrame, n_tasks: int, distance: int, across: bool) -> DataFrame:
    task = F.pmod(F.xxhash64("chain", "key", "block"), F.lit(n_tasks)).alias("task")
    return rows.select("*", task).groupBy("task").applyInArrow(_pairs(distance, across), "u long, v long")


def _block(parts: Column) -> Column:
    return F.pmod(F.xxhash64("fp"), parts).cast("int")


def near_links(fps: DataFrame, distance: int, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """(node, component) of every fingerprint (distinct longs in fp) that has another within the distance."""
    if not 0 <= distance < SEGMENTS:
        raise ValueError(f"the chains of two segments hold for distances below {SEGMENTS}")
    rows = scratch.stored(filed(fps), "filed")
    n_tasks = max(16, math.ceil(rows.count() / TASK_ROWS))
    heavy = scratch.stored(rows.groupBy("chain", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block), "heavy")
    if heavy.isEmpty():
        alone = _dealt(rows.withColumn("block", F.lit(0)), n_tasks, distance, False)
        return scratch.stored(components(scratch.stored(alone, "edges"), scratch=scratch), "linked")
    parts = F.ceil(F.coalesce("n", F.lit(1)) / block)
    alone = rows.join(heavy, ["chain", "key"], "left").withColumn("block", _block(parts)).drop("n")
    edges = scratch.stored(_dealt(alone, n_tasks, distance, False), "edges")
    state = scratch.stored(components(edges, scratch=scratch), "linked")
    # keys of several blocks: the rows outside the largest component against each block of the key, and each other
    open_ = rows.join(heavy, ["chain", "key"]).join(state.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    open_ = scratch.stored(open_, "open")
    sizes = open_.groupBy("chain", "key", "component").agg(F.count(F.lit(1)).alias("held"))
    largest = sizes.groupBy("chain", "key").agg(F.max(F.struct("held", "component")).alias("most"), F.count(F.lit(1)).alias("several"))
    largest = largest.filter("several > 1").select("chain", "key", F.col("most.component").alias("major"))
    open_ = open_.join(largest, ["chain", "key"]).withColumn("minor", F.col("component") != F.col("major")).drop("major")
    parts = F.ceil(F.col("n") / block).cast("int")
    major = open_.filter(~F.col("minor")).withColumn("block", _block(parts))
    minor = open_.filter("minor").withColumn("block", F.explode(F.sequence(F.lit(0), parts - 1)))
    # the minor rows of a key are most often few; where they fill a block themselves they meet in a grid of blocks
    few = minor.groupBy("chain", "key").agg(F.countDistinct("fp").alias("m"))
    minor = minor.join(few, ["chain", "key"])
    grid = F.ceil(F.col("m") / block).cast("int")
    met = minor.filter((F.col("block") < 1) & (grid > 1)).withColumn("mine", _block(grid)).withColumn("other", F.explode(F.sequence(F.lit(0), grid - 1)))
    met = met.withColumn("block", -1 - (F.least("mine", "other") * grid + F.greatest("mine", "other")))
    names = ["chain", "key", "block", "fp", "own", "component", "minor"]
    # against the major rows a task takes so many minor rows at a time
    against = minor.withColumn("slab", _block(grid)).withColumn("block", F.col("slab") * parts + F.col("block"))
    held = minor.groupBy("chain", "key").agg(F.max("m").alias("m"))
    facing = major.join(held, ["chain", "key"]).withColumn("slab", F.explode(F.sequence(F.lit(0), grid - 1))).withColumn("block", F.col("slab") * parts + F.col("block"))
    crossed = _dealt(against.select(names).unionByName(facing.select(names)).unionByName(met.select(names)), n_tasks, distance, True)
    more = scratch.stored(crossed, "edges-across")
    return scratch.stored(components(edges.unionByName(more), scratch=scratch), "linked-across")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 4, distance: int = 4, scratch: Scratch | None = None, block: int = BLOCK) -> DataFrame:
    """Per row: the id, fingerprint (16 hex digits) and component_id, the least id that links reach, the row's own included.

    Words are lower-cased (A-Z) runs outside ASCII white space; a shingle is k words joined by one space and hashed by
    XXH64 with seed 42; a text of fewer words is one shingle. Null, empty and blank texts have the fingerprint zero
    and link like any other. Rows link when their fingerprints differ in at most `distance` (0 to 4) bits, so repeated
    rows do. A null id never becomes a component_id unless a whole component has none. A text of any length is read
    whole. An empty table gives an empty table. Other columns, whatever their names, are not read; an id column named
    like an output or a step's column is an error.
    """
    distinct_names({id_col}, ("fingerprint", "component_id", "fp", "least_id", "node", "component"))
    scratch = scratch_of(docs, scratch, "simhash")
    rows = scratch.stored(fingerprints(docs, id_col, text, k), "fingerprints")
    classes = scratch.stored(rows.groupBy("fp").agg(F.min(id_col).alias("least_id")), "fingerprint-classes")
    linked = near_links(classes.select("fp"), distance, scratch, block).withColumnRenamed("node", "fp")
    named = classes.join(linked, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    ids = scratch.stored(named.join(least, "component").select("fp", "component_id"), "fingerprint-ids")
    out = rows.join(ids, "fp")
    return out.select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
