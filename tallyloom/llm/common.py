"""Helpers shared by the corpus operators: input columns, shared tables, batch sizes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: stands for a null doc_id inside operators that order documents; it sorts first, as nulls do
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id as long and text with null read as empty; any other column is left behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def shared_root(spark: SparkSession) -> str:
    """A folder of this application that driver and executors share: in spark.checkpoint.dir, or in the warehouse where that
    is unset; with a local master, where both are one machine, in its temporary folder."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.tallyloom.scratch", "")
    if not root:
        local = spark.sparkContext.master.startswith("local")
        root = tempfile.mkdtemp(prefix="spark-tallyloom-") if local else spark.conf.get("spark.sql.warehouse.dir")
        spark.conf.set("spark.tallyloom.scratch", root)
    return f"{root.rstrip('/')}/tallyloom/{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: its lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete what this application has written so far. For when its results are stored: they still read from there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the Arrow batches by rows; by bytes Spark bounds them itself (arrow.maxBytesPerBatch, 64 MB), so very long texts
    come few at a time. Only ever lowers the session's value, which Spark reads when a query runs, so it stays lowered."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(rows))


class Memo(dict):
    """A bounded function cache: cleared when full, so memory stays flat however many distinct keys a task sees."""

    def __init__(self, function, most: int, longest: int = 64):
        super().__init__()
        self.function, self.most, self.longest = function, most, longest

    def __missing__(self, key):
        value = self.function(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value
