"""N-gram Jaccard join: rare-first prefix filtering, then components of the links.

A document is the set of its distinct word n-grams. Document frequencies of all n-grams come from the
chunk exchange; every set is ordered by (frequency, n-gram), and two sets that meet the threshold share
an n-gram within their prefixes. An n-gram that no other document has joins nothing, so only documents
whose prefix has a shared n-gram go on: equal sets as one class, with postings of their prefix.

Links are found in rounds that never list all pairs of a group: first each class is compared with one
pivot, that of most of its posting lists, and components are formed; the next rounds compare it with the
nearest class (by the suffix filter's bound) of another component that shares a prefix n-gram. Members of
components that still differ are then paired, in blocks, under the length, positional and suffix filters (the suffix
filter bounds the symmetric difference by a small count sketch of the whole set). A pair is verified
once, on the whole sets. Nothing is capped: a long list is only cut into blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.llm.chunks import SENT, answered, bucket_count, chunked, distinct, each_answered, each_chunk, exchanged, send, short
from citeloom.llm.common import Scratch, distinct_names, rows_named, scratch_of
from citeloom.llm.components import components
from citeloom.llm.textarrays import Words, inside, mix, windows

U = np.uint64
SKETCH = 256


def ngram_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Every text's distinct n-grams as sorted 64-bit hashes, and where each text's start. A text of fewer words is one n-gram."""
    counts, at = words.counts(), words.at
    starts = inside(at, k)
    hashes, text = windows(words.hash, k)[starts], np.searchsorted(at, starts, side="right") - 1
    for n in range(1, k):
        short = np.flatnonzero(counts == n)
        if len(short):
            hashes = np.concatenate((hashes, windows(words.hash, n)[at[short]]))
            text = np.concatenate((text, short))
    order = np.argsort(text, kind="stable")
    hashes, text = hashes[order], text[order]
    edges = np.searchsorted(text, np.arange(len(counts) + 1))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        hashes[a:b].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[new], np.searchsorted(text[new], np.arange(len(counts) + 1))


def least_overlap(n: int, percent: int) -> int:
    """The least intersection of a set of n with any set that meets the threshold."""
    return -(-percent * n // 100)


def set_rows(rows: pa.Table, text: str, kept: list[str], k: int, percent: int, counts: np.ndarray) -> pa.Table:
    """A chunk's documents with n_shingles, and for those with a shared n-gram in the prefix: class, set, prefix, places, sketch."""
    words = Words(rows[text], lower=True)
    sets, at = ngram_sets(words, k)
    keys = short(sets)
    known, _, _, _ = distinct(keys)
    often = counts[np.searchsorted(known, keys)] & 127 if len(keys) else np.zeros(0, np.uint8)
    n_docs = len(at) - 1
    shared = np.concatenate(([0], np.cumsum(often >= 2)))
    out: dict[str, list] = {c: [None] * n_docs for c in ("class", "set", "prefix", "places", "sketch")}
    for i in range(n_docs):
        a, b = int(at[i]), int(at[i + 1])
        n = b - a
        prefix = n - least_overlap(n, percent) + 1
        if not n or shared[b] - shared[a] <= n - prefix:
            continue
        order = np.sort((often[a:b].astype(U) << U(48)) | keys[a:b])[:prefix]
        places = np.flatnonzero(order >> U(48) >= 2)
        mine = sets[a:b]
        lanes = np.array([mix(mine).sum(dtype=U), mix(mine ^ U(0x5851F42D4C957F2D)).sum(dtype=U) + U(n)], U)
        out["class"][i] = lanes.tobytes()
        out["set"][i] = mine.tobytes()
        out["prefix"][i] = (order[places] & U((1 << 48) - 1)).astype(np.int64)
        out["places"][i] = places.astype(np.int32)
        out["sketch"][i] = np.minimum(np.bincount((mine >> U(56)).astype(np.int64), minlength=SKETCH), 255).astype(np.uint8).tobytes()
    kinds = {"class": pa.binary(), "set": pa.binary(), "prefix": pa.list_(pa.int64()), "places": pa.list_(pa.int32()), "sketch": pa.binary()}
    columns = [rows[c].combine_chunks() for c in kept] + [pa.array(np.diff(at))] + [pa.array(out[c], kinds[c]) for c in kinds]
    return pa.Table.from_arrays(columns, names=[*kept, "n_shingles", *kinds])


def _close(n: Column, m: Column, place: Column, other: Column, percent: int) -> Column:
    """The length filter, and the positional filter for a first common n-gram at these places."""
    overlap = F.ceil((n + m) * percent / F.lit(100 + percent))
    rest = F.least(n - place, m - other)
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (rest >= overlap)


def _block_pairs(percent: int, nearest: bool):
    """Pairs of a bucket's posting blocks (token, i, j) whose components differ and that pass all filters.

    nearest: only each class's pair with the least bound on the symmetric difference for its size.
    """

    def run(table: pa.Table) -> pa.Table:
        t = table.sort_by([("token", "ascending"), ("i", "ascending"), ("j", "ascending"), ("class", "ascending")])
        token, i, j, own, n, place = (t[c].to_numpy() for c in ("token", "i", "j", "own", "n", "place"))
        names = np.frombuffer(b"".join(t["class"].to_pylist()), dtype="V16")
        comp = np.unique(np.frombuffer(b"".join(t["component"].to_pylist()), dtype="V16"), return_inverse=True)[1]
        sketch = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint8).reshape(-1, SKETCH)
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        at = np.append(np.flatnonzero(new), len(token))
        left, right, far = [], [], []

        def keep(x: np.ndarray, y: np.ndarray) -> None:
            ok = comp[x] != comp[y]
            ok &= np.minimum(n[x], n[y]) * 100 >= np.maximum(n[x], n[y]) * percent
            x, y = x[ok], y[ok]
            overlap = -(-percent * (n[x] + n[y]) // (100 + percent))
            ok = np.minimum(n[x] - place[x], n[y] - place[y]) >= overlap
            x, y, overlap = x[ok], y[ok], overlap[ok]
            for lo in range(0, len(x), 1 << 16):
                a, b = x[lo : lo + (1 << 16)], y[lo : lo + (1 << 16)]
                apart = np.abs(sketch[a].astype(np.int16) - sketch[b]).sum(axis=1)
                fine = apart <= n[a] + n[b] - 2 * overlap[lo : lo + (1 << 16)]
                left.append(a[fine])
                right.append(b[fine])
                far.append(apart[fine] / (n[a] + n[b])[fine])

        size = np.diff(at)
        small = size <= 48
        # short lists together: each row with the d-th row after it in the same list
        group = np.repeat(np.arange(len(size)), size)
        rows = np.flatnonzero(small[group]) if len(group) else np.zeros(0, np.int64)
        for d in range(1, int(size[small].max()) if small.any() else 0):
            x, y = rows[:-d], rows[d:]
            same = group[x] == group[y]
            keep(x[same], y[same])
        for g in np.flatnonzero(~small):
            a, b = at[g], at[g + 1]
            for r in range(a, b):
                y = np.arange(r + 1, b)
                if i[a] != j[a]:  # pairs of one side come up in its own block
                    y = y[own[r + 1 : b] != own[r]]
                keep(np.full(len(y), r), y)
        x = np.concatenate(left) if left else np.zeros(0, np.int64)
        y = np.concatenate(right) if right else np.zeros(0, np.int64)
        apart = np.concatenate(far) if far else np.zeros(0)
        who = np.unique(names, return_inverse=True)
        a, b = who[1][x], who[1][y]
        if nearest:
            a, b, apart = np.concatenate((a, b)), np.concatenate((b, a)), np.concatenate((apart, apart))
            order = np.lexsort((b, apart, a))
            order = order[np.flatnonzero(np.append(True, a[order][1:] != a[order][:-1]))] if len(order) else order
        else:
            order = np.unique(np.minimum(a, b) * len(who[0]) + np.maximum(a, b), return_index=True)[1]
        named = [v.tobytes() for v in who[0]]
        pick = lambda v: pa.array([named[k] for k in v[order].tolist()], pa.binary())
        return pa.table({"u": pick(a), "v": pick(b), "apart": pa.array(apart[order], pa.float64())})

    return run


def _verified(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose whole sets meet the threshold."""
    sets = classes.select("class", "set")
    both = pairs.join(sets.withColumnsRenamed({"class": "u", "set": "a"}), "u").join(sets.withColumnsRenamed({"class": "v", "set": "b"}), "v")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(a.as_buffer(), U), np.frombuffer(b.as_buffer(), U)
                merged = np.concatenate((x, y))
                merged.sort()
                common = int((merged[1:] == merged[:-1]).sum())
                good.append(100 * common >= percent * (len(merged) - common))
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    return both.select("u", "v", "a", "b").mapInArrow(check, "u binary, v binary")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 4, percent: int = 85, block: int = 1024, near_rounds: int = 2, scratch: Scratch | None = None) -> DataFrame:
    """Per row: the id, n_shingles, class (rows with equal sets share it; null if no other row can link) and component_id.

    Words are lower-cased (A-Z) runs outside ASCII white space. Rows link when 100 * intersection >=
    percent * union of their sets; component_id is the least id that links reach, the row's own included.
    Null, empty and blank texts have no n-grams, link with nothing and keep their own id. Repeated rows
    have equal sets, so they link. A null id never becomes a component_id unless the whole component has
    none. A text of any length is one set. An empty table gives an empty table. Other columns, whatever their
    names, are not read; an id column named like an output or a step's column is an error.
    """
    distinct_names({id_col}, ("n_shingles", "class", "component_id", "set", "prefix", "places", "sketch", "least_id"))
    scratch = scratch_of(docs, scratch, "ngrams")
    chunks = chunked(docs.select(id_col, text), text, scratch)
    buckets = bucket_count(chunks)

    def count(chunk_id, rows):
        sets, _ = ngram_sets(Words(rows[text], lower=True), k)
        known, counts, _, _ = distinct(short(sets))
        yield send(chunk_id, 1, known, counts, buckets)

    answers = exchanged(each_chunk(chunks, count, SENT))
    more = [("n_shingles", T.LongType()), ("class", T.BinaryType()), ("set", T.BinaryType()), ("prefix", T.ArrayType(T.LongType())), ("places", T.ArrayType(T.IntegerType())), ("sketch", T.BinaryType())]
    schema = T.StructType([docs.schema[id_col], *(T.StructField(n, t) for n, t in more)])
    rows = scratch.stored(each_answered(chunks, answers, lambda _, t, a: set_rows(t, text, [id_col], k, percent, answered(a, 1)), schema), "ngram-rows")
    shared = rows.filter("class is not null")
    classes = scratch.stored(
        shared.groupBy("class").agg(F.min(id_col).alias("least_id"), *(F.first(c).alias(c) for c in ("n_shingles", "set", "prefix", "places", "sketch"))),
        "ngram-classes",
    )
    postings = classes.select("class", F.col("n_shingles").alias("n"), F.explode(F.arrays_zip("prefix", "places")).alias("p"))
    postings = scratch.stored(postings.select(F.col("p.prefix").alias("token"), F.col("p.places").alias("place"), "class", "n"), "ngram-postings")
    n_buckets = max(16, math.ceil(postings.count() / 50_000))
    found, state = None, postings.withColumn("component", F.col("class"))
    for turn in range(1 + near_rounds + 1):
        lists = state.groupBy("token").agg(F.count(F.lit(1)).alias("length"), F.min("component").alias("c1"), F.max("component").alias("c2"), F.min(F.struct(F.xxhash64("class").alias("h"), "class", "n", "place", "component")).alias("pivot"))
        open_ = state.join(lists.filter("c1 != c2").select("token", "length", "pivot"), "token")
        if turn == 0:
            star = open_.filter(F.col("component") != F.col("pivot.component")).filter(_close(F.col("n"), F.col("pivot.n"), F.col("place"), F.col("pivot.place"), percent))
            shared_lists = star.groupBy("class", F.col("pivot.class").alias("to")).agg(F.count(F.lit(1)).alias("lists"))
            best = shared_lists.groupBy("class").agg(F.max(F.struct("lists", "to")).alias("best"))
            pairs = best.select(F.least("class", "best.to").alias("u"), F.greatest("class", "best.to").alias("v")).distinct()
        else:
            nearest = turn <= near_rounds
            parts = F.greatest(F.lit(1), F.ceil(F.col("length") / block)).cast("int")
            dealt = open_.drop("pivot").join(classes.select("class", "sketch"), "class").withColumn("parts", parts)
            dealt = dealt.withColumn("own", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int"))
            dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            dealt = dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
            dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("token", "i", "j"), F.lit(n_buckets)))
            dealt = dealt.select("bucket", "token", "i", "j", "own", "class", "component", "n", "place", "sketch")
            pairs = dealt.groupBy("bucket").applyInArrow(_block_pairs(percent, nearest), "u binary, v binary, apart double")
            if nearest:
                pairs = pairs.groupBy("u").agg(F.min(F.struct("apart", "v")).alias("best")).select("u", F.col("best.v").alias("v"))
            pairs = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        links = scratch.stored(_verified(pairs, classes, percent), f"ngram-links{turn}")
        if found is not None and links.isEmpty():
            continue
        found = links if found is None else found.unionByName(links)
        member = scratch.stored(components(found, scratch=scratch), "ngram-components")
        state = postings.join(member.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    named = classes.select("class", "least_id").join(member.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    ids = scratch.stored(named.join(least, "component").select("class", "component_id"), "ngram-ids")
    alone = rows.filter("class is null").select(id_col, "n_shingles", "class", F.col(id_col).alias("component_id"))
    linked = shared.select(id_col, "n_shingles", "class").join(ids, "class").select(id_col, "n_shingles", "class", "component_id")
    return alone.unionByName(linked)


def without_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", scratch: Scratch | None = None, **options) -> DataFrame:
    """One row of each component of jaccard_components(), the one whose id is least (null last; then by text and place), with all its columns.

    Rows that no other links with stay, whatever their ids: rows are told apart by their place in the table, so of near
    or exact copies with null or equal ids one stays as well. What the join needed is removed before this returns;
    the result reads docs and a table of the places that are gone.
    """
    scratch = scratch_of(docs, scratch, "copies")
    named, at = rows_named(docs, scratch)
    work = Scratch(docs.sparkSession, "ngrams")
    key = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("digest"), F.col(at[0]).alias("file"), F.col(at[1]).alias("at"))
    found = jaccard_components(named.select(key.alias("__key"), F.col(text).alias("__text")), "__key", "__text", scratch=work, **options)
    gone = scratch.stored(found.filter(F.col("__key") != F.col("component_id")).select(F.col("__key.file").alias(at[0]), F.col("__key.at").alias(at[1])), "gone")
    work.remove()
    return named.join(gone, at, "left_anti").select(*docs.columns)
