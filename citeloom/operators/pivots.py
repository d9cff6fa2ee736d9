"""Exact cosine top-k with pruning: a stored pivot table whose cells have angle bounds.

write_pivots() gives each vector to the nearest of a few pivots, group by group, and stores each cell's vectors in blocks
with the largest angle to its pivot. The angle between a query and a vector of a cell is at least the query's
angle to the pivot less that radius (angles obey the triangle inequality), so a cell has an upper bound for a query.
search() first scores the cells of the best bounds that hold k vectors together, which gives a k-th score, and then only the cells
whose bound reaches it. Nothing is estimated: the rest cannot be among the k nearest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.operators.metrics import null_safe_join
from citeloom.operators.vectors import _unit, nearest_in_block, packed_rows

#: Sums of products of unit vectors may be off by this much.
SLACK = 1e-7


def _pivots(corpus: DataFrame, n: int) -> np.ndarray:
    """n vectors of the corpus by a hash of their id, as unit vectors: a bounded sample that only steers the cells."""
    rows = corpus.orderBy(F.xxhash64("id"), "id").limit(n).select("embedding").toArrow()
    found = _unit(rows) if rows.num_rows else np.zeros((0, 0))
    found = np.unique(found[np.abs(found).sum(axis=1) > 0], axis=0) if len(found) else found
    return found if len(found) else np.zeros((1, found.shape[1] if found.ndim == 2 else 0))


def _angles(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d = min(unit.shape[1], pivots.shape[1])
    return np.arccos(np.clip(unit[:, :d] @ pivots[:, :d].T, -1, 1))


def write_pivots(corpus: DataFrame, path: str, by: list[str] = (), n_pivots: int = 256, block_rows: int = 16_384) -> None:
    """The pivot table of corpus (id, embedding, *by) below path. A group is a value of `by`; each lists its cells with the driver, n_pivots at most.

    Rows with a null embedding are left out. Zero vectors, which are at no angle to anything, are a cell of their own.
    """
    spark, by = corpus.sparkSession, list(by)
    corpus = corpus.filter("embedding is not null").select("id", "embedding", *by)
    pivots = _pivots(corpus, n_pivots)
    schema = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType()), *corpus.schema.fields])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                unit = _unit(pa.Table.from_batches([batch]))
                angles = _angles(unit, pivots)
                cell = np.where(np.abs(unit).sum(axis=1) > 0, angles.argmin(axis=1), -1)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(angles.min(axis=1)), *batch.columns], names=schema.names)

    corpus.mapInArrow(assign, schema).write.parquet(f"{path}/rows")
    rows = spark.read.schema(schema).parquet(f"{path}/rows")
    rows.groupBy("cell", *by).agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")).write.parquet(f"{path}/cells")
    cells = spark.read.parquet(f"{path}/cells")
    # a cell is cut by row number, so one with most of the rows is many blocks
    parts = cells.groupBy("cell").agg(F.ceil(F.sum("n") / block_rows).cast("int").alias("parts"))
    dealt = rows.withColumn("row", F.monotonically_increasing_id()).join(parts, "cell").withColumn("part", F.pmod("row", F.col("parts")).cast("int"))
    packed_rows(dealt.select("cell", "part", "id", "embedding", *by), ["cell", "part"], block_rows, "rows").write.parquet(f"{path}/blocks")
    spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(pivots)], "cell int, embedding array<double>").write.parquet(f"{path}/pivots")


class Table:
    """What the driver keeps of a pivot table: the pivots, and count and radius of each cell, group by group."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        cells = spark.read.parquet(f"{path}/cells")
        self.by = [c for c in cells.columns if c not in ("cell", "n", "radius")]
        self.kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spark.read.parquet(f"{path}/rows").drop("cell", "angle", "embedding").schema)
        found = cells.collect()
        names = sorted({tuple(r[g] for g in self.by) for r in found}, key=repr)
        self.groups = {name: i for i, name in enumerate(names)}
        rows = sorted((self.groups[tuple(r[g] for g in self.by)], r.cell, r.n, r.radius) for r in found)
        self.group, self.cell, self.n = (np.array([r[i] for r in rows], np.int64) for i in range(3))
        self.radius = np.array([r[3] for r in rows], float)
        pivots = spark.read.parquet(f"{path}/pivots").orderBy("cell").toArrow()
        self.pivots = np.array(pivots["embedding"].to_pylist(), float).reshape(pivots.num_rows, -1)


def _bounds(unit: np.ndarray, pivots: np.ndarray, cell: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Queries x cells: the largest cosine that a vector of the cell can have."""
    angles = np.append(_angles(unit, pivots), np.full((len(unit), 1), np.pi / 2), axis=1)  # the last: zero vectors
    least = angles[:, cell] - np.where(cell < 0, 0.0, radius)
    return np.cos(np.clip(least, 0, np.pi)) + SLACK


def _visits(table: Table, queries: DataFrame, k: int, later: bool) -> DataFrame:
    """(query_id, embedding, cell) to score. First the cells of the best bounds with k vectors together in a group; later, with bars of the groups, the others that reach one."""
    group, n, cells, radius, pivots, n_groups = table.group, table.n, table.cell, table.radius, table.pivots, len(table.groups)
    schema = T.StructType([queries.schema["query_id"], queries.schema["embedding"], T.StructField("cell", T.IntegerType())])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                bound = _bounds(_unit(pa.Table.from_batches([batch])), pivots, cells, radius)
                chosen = np.zeros((batch.num_rows, len(cells)), bool)
                for g in range(n_groups):
                    mine = np.flatnonzero(group == g)
                    order = np.argsort(-bound[:, mine], axis=1, kind="stable")
                    held = np.cumsum(n[mine][order], axis=1) - n[mine][order]
                    np.put_along_axis(chosen[:, mine[0] : mine[-1] + 1], order, held < k, axis=1)
                if later:
                    bars = np.full((batch.num_rows, n_groups), -np.inf)
                    for i, held in enumerate(batch.column(2).to_pylist()):
                        for bar in held or ():
                            bars[i, bar["__g"]] = bar["bar"]
                    # what the first visits scored for one group they scored for all
                    code = np.unique(cells, return_inverse=True)[1]
                    seen = np.zeros((batch.num_rows, len(cells)), bool)
                    row, at = np.nonzero(chosen)
                    seen[row, code[at]] = True
                    chosen = (bound >= bars[:, group]) & ~seen[:, code]
                # a cell that several groups want is scored once
                row, at = np.nonzero(chosen)
                pairs = np.unique(np.stack((row, cells[at])), axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(pairs[0])), batch.column(1).take(pa.array(pairs[0])), pa.array(pairs[1].astype(np.int32))], names=schema.names)

    return queries.mapInArrow(pick, schema)


def _scored(table: Table, visits: DataFrame, k: int, digits: int, query_rows: int) -> DataFrame:
    """query_id, id, *by, score: each visited cell's k nearest of each group."""
    blocks = table.spark.read.parquet(f"{table.path}/blocks").select("cell", F.col("rows").alias("c_rows"))
    n = int(table.spark.conf.get("spark.sql.shuffle.partitions"))
    asked = packed_rows(visits.withColumn("lot", F.pmod(F.xxhash64("query_id"), F.lit(n)).cast("int")), ["cell", "lot"], query_rows, "q_rows")
    by, kinds = table.by, table.kinds

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_rows, c_rows in zip(batch.column(0), batch.column(1), strict=True):
                q, c = (pa.ipc.open_stream(x.as_buffer()).read_all() for x in (q_rows, c_rows))
                yield nearest_in_block(q, c, k, by, digits, False)

    # packed rows look small to the planner, and a broadcast would take all visits through the driver
    return asked.hint("merge").join(blocks, "cell").select("q_rows", "c_rows").mapInArrow(score, f"query_id long, {kinds}, score double")


def _phases(spark: SparkSession, path: str, queries: DataFrame, k: int, digits: int, query_rows: int) -> tuple[Table, DataFrame, DataFrame, DataFrame]:
    """The table, the first visits, what they found, and the later visits."""
    table = Table(spark, path)
    asked = queries.filter("embedding is not null").select(F.col("query_id").cast("long"), "embedding")
    first = _visits(table, asked, k, False)
    found = _scored(table, first, k, digits, query_rows)
    fields = spark.read.parquet(f"{path}/cells").select(*table.by).schema.fields
    numbers = spark.createDataFrame([(i, *name) for name, i in table.groups.items()], T.StructType([T.StructField("__g", T.IntegerType()), *fields]))
    place = F.row_number().over(Window.partitionBy("query_id", "__g").orderBy(F.desc("score")))
    named = null_safe_join(found.select("query_id", *table.by, "score"), F.broadcast(numbers), table.by)  # a row a group
    kth = named.withColumn("__r", place).filter(F.col("__r") == k)
    # scores that are equal to `digits` go by id, so the bar is a little lower
    bars = kth.groupBy("query_id").agg(F.collect_list(F.struct("__g", (F.col("score") - 10.0**-digits).alias("bar"))).alias("bars"))
    later = _visits(table, asked.join(bars, "query_id", "left").select("query_id", "embedding", "bars"), k, True)
    return table, first, found, later


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, digits: int = 9, query_rows: int = 1024) -> DataFrame:
    """query_id, id, *by, score, rank of vectors.cosine_top_k(), from the pivot table. queries: query_id (distinct, long), embedding."""
    table, _, found, later = _phases(spark, path, queries, k, digits, query_rows)
    both = found.unionByName(_scored(table, later, k, digits, query_rows))
    rank = F.row_number().over(Window.partitionBy("query_id", *table.by).orderBy(F.desc(F.round("score", digits)), "id"))
    return both.withColumn("rank", rank).filter(F.col("rank") <= k)


def scored_share(spark: SparkSession, path: str, queries: DataFrame, k: int, digits: int = 9) -> float:
    """The pairs that a search scores as a share of all pairs of a query and a vector."""
    table, first, _, later = _phases(spark, path, queries, k, digits, 1024)
    sizes = spark.read.parquet(f"{path}/cells").groupBy("cell").agg(F.sum("n").alias("n"))
    pairs = first.select("cell").unionByName(later.select("cell")).join(sizes, "cell").agg(F.sum("n")).first()[0] or 0
    asked = queries.filter("embedding is not null").count()
    return pairs / max(1, asked * int(table.n.sum()))

