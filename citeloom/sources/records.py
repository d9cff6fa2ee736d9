"""Sources and sinks: record files, flattened features, pages, reviewed CSV, incremental loads."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CATEGORIES = {"concepts": "concept", "actions": "action", "roles": "role", "objects": "object", "facts": "fact"}
RULING = (
    "ruling_id string, title string, legal_factual_summary string, verdict_number string, verdict_date string, case_type string, "
    "cited_articles array<struct<article_number:int,law_name:string,note_number:int>>, text_cited_articles array<struct<article_number:int,law_name:string,note_number:int>>, "
    "related_ruling_ids array<string>, sections array<struct<court_level:string,text:string>>, url string"
)
_ITEM = "array<struct<category:string,value:string,evidence:struct<quote:string,start_char:int,end_char:int,confidence:double>>>"
FEATURES = "ruling_id string, " + ", ".join(f"{c} {_ITEM}" for c in CATEGORIES)


def read_records(spark: SparkSession, path: str, schema: str = RULING, key: str = "ruling_id") -> tuple[DataFrame, DataFrame]:
    """Records of one JSON object a file, and an error table (path, reason): unreadable, empty, or without a key."""
    rows = spark.read.schema(f"{schema}, _corrupt string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", True).json(path)
    rows = rows.withColumn("path", F.col("_metadata.file_path"))
    bad = rows.filter(F.col("_corrupt").isNotNull() | F.col(key).isNull()).select("path", F.when(F.col("_corrupt").isNotNull(), "corrupt").otherwise("no key").alias("reason"))
    # scans, also of file metadata, skip files without bytes, so these are the listed files that gave no row; the listing is the driver's anyway
    listed = spark.createDataFrame([(f,) for f in rows.inputFiles()], "path string")
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    empty = listed.select(plain(F.col("path")).alias("path")).join(rows.select(plain(F.col("path")).alias("path")).distinct(), "path", "left_anti").withColumn("reason", F.lit("empty"))
    good = rows.filter(F.col("_corrupt").isNull() & F.col(key).isNotNull()).drop("_corrupt", "path")
    return good, bad.unionByName(empty)


def flattened_features(results: DataFrame) -> DataFrame:
    """ruling_id, category, pos, value, quote, start_char, end_char, confidence of the five category arrays."""
    item = lambda x: F.struct(x["value"].alias("value"), *(x["evidence"][c].alias(c) for c in ("quote", "start_char", "end_char", "confidence")))
    # the five arrays in one, so the records are read once
    lists = F.array(*(F.struct(F.lit(name).alias("category"), F.transform(column, item).alias("items")) for column, name in CATEGORIES.items()))
    each = results.select("ruling_id", F.explode(lists).alias("c")).select("ruling_id", "c.category", F.posexplode("c.items").alias("pos", "x"))
    return each.select("ruling_id", "category", "pos", "x.*")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id (the file's name) and html."""
    rows = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return rows.select(F.regexp_extract(F.col("_metadata.file_name"), "([^/]+?)(?:\\.[^./]*)?$", 1).alias("page_id"), F.col("value").alias("html"))


def read_reviewed(spark: SparkSession, path: str, required: tuple[str, ...] = ("term", "decision")) -> DataFrame:
    """A CSV with a header; fails if a required column is absent."""
    rows = spark.read.option("header", True).csv(path)
    if lacking := [c for c in required if c not in rows.columns]:
        raise ValueError(f"{path} has no column {', '.join(lacking)}")
    return rows


def write_table(df: DataFrame, path: str, by: list[str] = (), kind: str = "parquet") -> None:
    """Write a table, or a report as csv or json; by: partition columns."""
    out = df.write.mode("overwrite").partitionBy(*by) if by else df.write.mode("overwrite")
    (out.option("header", True) if kind == "csv" else out).format(kind).save(path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share; a local master without one gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        folder = tempfile.mkdtemp(prefix="citeloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_records(df: DataFrame, path: str, records: int = 2000) -> None:
    """Write the rows as JSON record files of about `records` objects each."""
    n = max(1, -(-df.count() // records))
    body = F.to_json(F.collect_list(F.struct(*df.columns)))
    df.groupBy(F.pmod(F.monotonically_increasing_id(), F.lit(n)).alias("file")).agg(body.alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)
