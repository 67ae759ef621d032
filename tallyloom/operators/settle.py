"""Intermediate results that are computed once, totals, and what came before a row of its key, without one task for all."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The checkpoint folder, which driver and executors share. Where none is set, one in the warehouse is, or a temporary
    one with a local master."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        root = context.getConf().get("spark.checkpoint.dir", None)
        if not root:
            root = tempfile.mkdtemp(prefix="spark-tallyloom-") if context.master.startswith("local") else spark.conf.get("spark.sql.warehouse.dir") + "/checkpoints"
        context.setCheckpointDir(root)
    return context.getCheckpointDir()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder of that name in the checkpoint folder."""
    return f"{shared_root(spark).rstrip('/')}/{uuid.uuid4().hex}/{name}"


def settled(df: DataFrame) -> DataFrame:
    """df computed now and kept in the checkpoint folder (shared_root), so that what is read twice is the same both times
    and lost executors cost a re-read. What was shuffled for it is deleted at once, since nothing else reads that."""
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    shared_root(spark)
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        return df.select("*").checkpoint()  # a frame of its own, since a frame has the setting that it was made with
    finally:
        spark.conf.set(key, before)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt out by its keys, for steps that cost much a row: a file of many short rows is few row groups, each read by one
    task, however many cores there are. The number of parts is the session's for shuffles, and said here, so that adaptive
    execution leaves it: by bytes, of which short rows have few, 90,000 customers would be one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def with_total(df: DataFrame, of: Column, name: str) -> DataFrame:
    """df with the sum of an expression over all rows, added up in parts; one row is broadcast."""
    return df.join(F.broadcast(df.agg(F.sum(of).alias(name))))


def with_share(df: DataFrame, count: str = "n", name: str = "share") -> DataFrame:
    """df with each row's part of the sum of its counts, to four places."""
    return with_total(df, F.col(count), "_total").withColumn(name, F.round(F.col(count) / F.col("_total"), 4)).drop("_total")


# --- what came before a row of its key, where one key may hold a large part of all rows ------------------------------

SHARE = 1_000  # a key with more than this part of all rows is hot; so there are fewer than this many
LEAST = 100_000  # rows that a key may have in any case: one task sorts so many with ease


def parted(df: DataFrame, keys: list[str], order: list[str]) -> list[DataFrame]:
    """df as it is, or, if it has hot keys, the rows of all other keys and those of the hot ones, cut into ranges of their
    order (_range) and kept. Steps that look back over a key's rows (previous) are then taken on each part."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    most = df.agg(F.greatest(F.count("*") / SHARE, F.lit(LEAST)).alias("_most"))
    hot = settled(counts.join(F.broadcast(most), F.col("_n") > F.col("_most")).select(*[F.col(k).alias(f"_hot_{k}") for k in keys]))
    if hot.limit(1).count() == 0:
        return [df]
    same = [df[k].eqNullSafe(hot[f"_hot_{k}"]) for k in keys]
    cold, warm = (df.join(F.broadcast(hot), same, how) for how in ("left_anti", "left_semi"))
    return [cold, settled(warm.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))]


def previous(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column]) -> DataFrame:
    """df with, for each value, what it was in the last row of the key before this one where it was not null.

    In a part with ranges, a row without such a row in its own range takes it from the last range that has one: of each key
    and range there is one row for that.
    """
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    ranged = "_range" in df.columns
    group = ["_range", *keys] if ranged else keys
    own = df.withColumns({n: F.last(v, ignorenulls=True).over(before(Window.partitionBy(*group).orderBy(*order))) for n, v in values.items()})
    if not ranged:
        return own
    at = F.struct(*order)
    ends = df.groupBy(*group).agg(*[F.max(F.when(v.isNotNull(), F.struct(at.alias("at"), v.alias("v"))))["v"].alias(f"_end_{n}") for n, v in values.items()])
    over = before(Window.partitionBy(*keys).orderBy("_range"))
    entry = ends.select(*[F.col(c).alias(f"_key_{c}") for c in group], *[F.last(f"_end_{n}", ignorenulls=True).over(over).alias(f"_entry_{n}") for n in values])
    out = own.join(entry, [own[c].eqNullSafe(entry[f"_key_{c}"]) for c in group], "left")
    return out.withColumns({n: F.coalesce(n, f"_entry_{n}") for n in values}).drop(*[f"_key_{c}" for c in group], *[f"_entry_{n}" for n in values])


def together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p.drop("_range"))
    return out
