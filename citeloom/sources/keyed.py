"""A keyed table that is loaded in steps: copy-on-write by key bucket, with a manifest that is written last.

Rows stand in buckets of a hash of their keys. A load rewrites only the buckets in which a key is new or its row
differs, into a folder of its own; then it writes a manifest that names each bucket's folder. A reader takes the newest
manifest, so a load that breaks leaves the table as it was, and a bucket without changes keeps its files. One load at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.operators.graph import upserted
from citeloom.operators.metrics import null_safe_join

MANIFEST = "version long, bucket int, folder string, n long, fields string"


class KeyedTable:
    """The table below path. keys: columns that name a row (a null is a value like any other); buckets: fixed at the first load."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets

    def manifest(self) -> list:
        """The newest manifest: at most a row a bucket."""
        try:
            rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifests")
        except AnalysisException:
            return []
        newest = rows.agg(F.max("version")).first()[0]
        return rows.filter(F.col("version") == newest).orderBy("bucket").collect() if newest is not None else []

    def read(self, only: set[int] | None = None) -> DataFrame | None:
        """All rows, or those of some buckets; None before the first load."""
        held = self.manifest()
        if not held:
            return None
        schema = T.StructType.fromJson(json.loads(held[0].fields))
        paths = [f"{r.folder}/bucket={r.bucket}" for r in held if r.n and (only is None or r.bucket in only)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys, *(F.col(k).isNull() for k in self.keys)), F.lit(self.buckets)).cast("int")

    def load(self, rows: DataFrame, order: str) -> int:
        """Upsert: the last row of each key by `order` stands for what the table had under the key. Returns how many buckets were rewritten."""
        held = self.manifest()
        new = upserted(rows, self.keys, order)
        marked = new.withColumn("bucket", self._bucket())
        if held:
            met = {r.bucket for r in marked.select("bucket").distinct().collect()}  # at most `buckets` numbers
            old = self.read(met)
            marked_old = old.withColumn("bucket", self._bucket())
            differ = null_safe_join(marked, old.select(*new.columns), new.columns, "left_anti")
            changed = {r.bucket for r in differ.select("bucket").distinct().collect()}
            inside = F.col("bucket").isin(sorted(changed))
            kept = null_safe_join(marked_old.filter(inside), new.select(*self.keys), self.keys, "left_anti")
            marked = marked.filter(inside).unionByName(kept.select(*marked.columns))
        else:
            changed = set(range(self.buckets))
        if not changed:
            return 0
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        marked.repartition("bucket").write.partitionBy("bucket").parquet(folder)
        fields = T.StructType([f for f in marked.schema.fields if f.name != "bucket"]).json()
        written = self.spark.read.schema(T.StructType([*marked.schema.fields])).parquet(folder)
        sizes = {r.bucket: r.n for r in written.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
        version = held[0].version + 1 if held else 1
        kept = [(version, r.bucket, r.folder, r.n, fields) for r in held if r.bucket not in changed]
        fresh = [(version, b, folder, int(sizes.get(b, 0)), fields) for b in sorted(changed)]
        self.spark.createDataFrame(kept + fresh, MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifests")
        return len(changed)
