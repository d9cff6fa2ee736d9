"""Embedding tables: pending rows, an embedder hook, means of chunk vectors, exact cosine top-k."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pending(units: DataFrame, vectors: DataFrame, key: str, text: str, status: str | None = None, gone: str = "abolished") -> DataFrame:
    """Units with text and without a vector; a null status is not abolished."""
    rows = units.filter(F.col(text).isNotNull() & (F.trim(text) != ""))
    if status:
        rows = rows.filter(F.coalesce(F.col(status), F.lit("")) != gone)
    return rows.join(vectors.filter("embedding is not null").select(key), key, "left_anti")


def hashing_embedder(dim: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic embedder for tests: counts of hashed words."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for w in (t or "").split():
                out[i, zlib.crc32(w.encode()) % dim] += 1
        return out.tolist()

    return embed


def embedded(chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]], text: str = "chunk", batch: int = 256) -> DataFrame:
    """chunks with embedding: the user's function over batches of texts."""
    from pyspark.sql import types as T

    schema = T.StructType([*chunks.schema.fields, T.StructField("embedding", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, batch):
                part = b.slice(lo, batch)
                vectors = embed(part.column(part.schema.get_field_index(text)).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(vectors, pa.list_(pa.float64()))], names=schema.names)

    return chunks.mapInArrow(run, schema)


def mean_vectors(chunks: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """The unweighted component-wise mean of each key's vectors."""
    parts = chunks.select(key, F.posexplode(vector).alias("i", "x")).groupBy(key, "i").agg(F.avg("x").alias("m"))
    return parts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias(vector))


def attached(nodes: DataFrame, vocabulary: DataFrame, keys: list[str]) -> DataFrame:
    """nodes with the vocabulary's vectors by key; without one the embedding is null."""
    return nodes.join(vocabulary.select(*keys, "embedding"), keys, "left")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All components of an array column as doubles, and how many each row has; null components are NaN."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float), np.diff(column.offsets.to_numpy())


def _unit(table: pa.Table) -> np.ndarray:
    """Rows of length 1; a zero vector stays 0, and vectors of unlike length are filled up with 0."""
    flat, size = _flat(table["embedding"].combine_chunks() if table["embedding"].num_chunks != 1 else table["embedding"].chunk(0))
    m = np.zeros((table.num_rows, int(size.max(initial=0))))
    m[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def packed_rows(df: DataFrame, keys: list[str], rows: int | None, name: str) -> DataFrame:
    """The keys (int) and `name`: the other columns of a group's rows as an Arrow stream, several of them beyond `rows` rows (None: always one)."""

    def pack(group: tuple, table: pa.Table) -> pa.Table:
        table, out = table.drop_columns(keys), []
        for lo in range(0, table.num_rows, rows or table.num_rows):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as stream:
                stream.write_table(table.slice(lo, rows or table.num_rows).combine_chunks())
            out.append(sink.getvalue().to_pybytes())
        return pa.table({**{k: pa.array([g.as_py()] * len(out), pa.int32()) for k, g in zip(keys, group, strict=True)}, name: pa.array(out, pa.binary())})

    return df.groupBy(*keys).applyInArrow(pack, f"{', '.join(f'{k} int' for k in keys)}, {name} binary")


def _blocks(df: DataFrame, rows: int, name: str, n: int) -> DataFrame:
    """df dealt to n blocks by row number, so no key is hot; each block is one value or, beyond `rows` rows, several: name, name_rows (an Arrow stream)."""
    return packed_rows(df.withColumn(name, F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int")), [name], rows, f"{name}_rows")


def best_of_rows(near: np.ndarray, key: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k highest, ties to the smaller key; rows in turn, their best in order."""
    if near.shape[1] > k:
        bar = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
        row, at = np.nonzero(near >= bar[:, None])
    else:
        row, at = np.divmod(np.arange(near.size), max(1, near.shape[1]))
    order = np.lexsort((key[at], -near[row, at], row))
    row, at = row[order], at[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], at[place < k]


def group_numbers(table: pa.Table, by: list[str]) -> np.ndarray:
    """A number for each row's group, from 0; nulls are a group."""
    group = np.zeros(table.num_rows, np.int64)
    for g in by:
        codes = table[g].combine_chunks().dictionary_encode(null_encoding="encode")
        codes = codes if isinstance(codes, pa.Array) else codes.chunk(0)
        group = np.unique(group * (len(codes.dictionary) + 1) + codes.indices.to_numpy(), return_inverse=True)[1]
    return group


def nearest_in_block(q: pa.Table, c: pa.Table, k: int, by: list[str], digits: int, scaled: bool) -> pa.RecordBatch:
    """query_id, id, *by, score: of a block of rows the k nearest of each group to each query of a block."""
    a, b = _unit(q), _unit(c)
    d = min(a.shape[1], b.shape[1])
    s = a[:, :d] @ b[:, :d].T
    s = (1 + s) / 2 if scaled else s
    asked, key, near, group = q["query_id"].to_numpy(), c["id"].to_numpy(), np.round(s, digits), group_numbers(c, by)
    rows, picked = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    order = np.argsort(group, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
        row, top = best_of_rows(near[:, at], key[at], k)
        rows.append(row)
        picked.append(at[top])
    row, top = np.concatenate(rows), np.concatenate(picked)
    found = c.take(pa.array(top)).combine_chunks()
    return pa.RecordBatch.from_arrays([pa.array(asked[row]), *(found[f].chunk(0) if found.num_rows else pa.array([], found.schema.field(f).type) for f in ("id", *by)), pa.array(s[row, top])], names=["query_id", "id", *by, "score"])


def cosine_top_k(corpus: DataFrame, queries: DataFrame, k: int, by: list[str] = (), digits: int = 9, query_rows: int = 1024, corpus_rows: int = 65_536, scaled: bool = False) -> DataFrame:
    """query_id, id, *by, score, rank: each query's k nearest corpus rows by cosine, in each group of `by`.

    corpus: id, embedding, *by; queries: query_id (long), embedding. A zero vector scores 0. Equal scores (to `digits`)
    go by id. scaled: (1 + cosine) / 2. Blocks of queries meet blocks of the corpus by number, and a query crosses the
    network once for each large block of the corpus; each pair of blocks keeps a query's own k best of a group, so what
    is shuffled on grows with queries * k * blocks.
    """
    by = list(by)
    corpus = corpus.filter("embedding is not null").select("id", "embedding", *by)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in corpus.drop("embedding").schema)
    n = max(1, -(-corpus.count() // corpus_rows))
    c_blocks = _blocks(corpus, corpus_rows, "c", n)
    asked = queries.filter("embedding is not null").select(F.col("query_id").cast("long"), "embedding")
    q_blocks = _blocks(asked, query_rows, "q", int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    met = q_blocks.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(c_blocks, "c").select("q_rows", "c_rows")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_rows, c_rows in zip(batch.column(0), batch.column(1), strict=True):
                q, c = (pa.ipc.open_stream(x.as_buffer()).read_all() for x in (q_rows, c_rows))
                yield nearest_in_block(q, c, k, by, digits, scaled)

    found = met.mapInArrow(score, f"query_id long, {kinds}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", *by).orderBy(F.desc(F.round("score", digits)), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def relevant_vocabulary(sections: DataFrame, vocabulary: DataFrame, per_section: int = 15, per_case: int = 50) -> DataFrame:
    """case_id, category, id, score: the best vocabulary of each section, the largest score a term, then the best of the case.

    sections: section_id, case_id, embedding; vocabulary: id, category, embedding. Cases without any vector get the
    whole vocabulary with a null score.
    """
    found = cosine_top_k(vocabulary, sections.filter("embedding is not null").select(F.col("section_id").alias("query_id"), "embedding"), per_section, ["category"])
    best = found.join(sections.select(F.col("section_id").alias("query_id"), "case_id"), "query_id").groupBy("case_id", "category", "id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("case_id", "category").orderBy(F.desc(F.round("score", 9)), "id"))
    kept = best.withColumn("r", rank).filter(F.col("r") <= per_case).drop("r")
    bare = sections.groupBy("case_id").agg(F.count("embedding").alias("n")).filter("n = 0").select("case_id")
    whole = bare.crossJoin(vocabulary.select("category", "id")).withColumn("score", F.lit(None).cast("double"))  # the feature: all terms for a case without vectors
    return kept.unionByName(whole)


def pair_check(pairs: DataFrame, vectors: DataFrame, bar: float = 0.75) -> DataFrame:
    """pairs (a, b, expected) with cosine and agrees: whether cosine > bar is what was expected."""
    v = lambda n: vectors.select(F.col("id").alias(n), F.transform("embedding", lambda x: x.cast("double")).alias(f"{n}_v"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)
    rows = pairs.join(v("a"), "a").join(v("b"), "b")
    cosine = F.coalesce(F.try_divide(dot(F.col("a_v"), F.col("b_v")), F.sqrt(dot(F.col("a_v"), F.col("a_v"))) * F.sqrt(dot(F.col("b_v"), F.col("b_v")))), F.lit(0.0))
    return rows.withColumn("cosine", cosine).withColumn("agrees", (F.col("cosine") > bar) == F.col("expected")).drop("a_v", "b_v")
