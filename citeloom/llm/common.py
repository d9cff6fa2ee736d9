"""Session helpers shared by the operators: scratch tables of one call and small column expressions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: what separates words.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a local master gets a temporary one; a cluster is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        folder = tempfile.mkdtemp(prefix="citeloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2000) -> Iterator[None]:
    """Texts may be long, so no Arrow batch of a job in this block gets more than `rows` rows; the session's setting comes back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if int(before) <= 0 or int(before) > rows:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Scratch:
    """The tables of one call, in a folder of their own below the shared one.

    Only its owner removes it: whoever made it and knows that no lazy result still reads it. Two runs in one
    session, or the same one again, never see each other's tables.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def stored(self, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
        """Write df once and read it back: later steps neither recompute it nor need its shuffle files."""
        path = f"{self.path}/{name}-{uuid.uuid4().hex[:8]}"
        with small_batches(self.spark):
            df.write.option("compression", compression).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def remove(self) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def scratch_of(df: DataFrame, scratch: Scratch | None, name: str) -> Scratch:
    """The caller's scratch, or one that stays until the shared folder is cleaned."""
    return scratch or Scratch(df.sparkSession, name)


def free_name(name: str, *frames: DataFrame) -> str:
    """The name, with underscores in front until no column of the frames has it (Spark folds case)."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def distinct_names(given: set[str], outputs: tuple[str, ...]) -> None:
    """An id column named like an output would make two columns of one name."""
    if clash := {g for g in given if g.lower() in outputs}:
        raise ValueError(f"rename the column {', '.join(sorted(clash))}: the result has one of that name")


def rows_named(df: DataFrame, scratch: Scratch) -> tuple[DataFrame, list[str]]:
    """df with two columns that name each row, whatever its id: the file's hash and the row's number in it, the same in every run over these files.

    A frame that is not a plain scan of Parquet files is stored first. Returns the frame and the two new names.
    """
    names = [free_name("__file", df), free_name("__at", df)]
    try:
        df.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        df = scratch.stored(df, "named")
    return df.select("*", F.xxhash64("_metadata.file_path").alias(names[0]), F.col("_metadata.row_index").alias(names[1])), names


def text_or_empty(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
