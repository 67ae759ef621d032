"""Assertions over loaded tables, and what a load leaves behind: a log, rejects and versions to go back to.

Spark does not enforce constraints on files, so each is a query that gives the rows against it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.text import blank
from tallyloom.operators.settle import with_share


def violations(df: DataFrame, *, key: list[str] = (), unique: list[list[str]] = (), required: list[str] = (), allowed: dict[str, list[str]] = {}) -> DataFrame:
    """rule, value, n: what a table holds against its constraints. A key may not be null or repeat, unique columns may not
    repeat where they are there, required ones may not be null, and others only hold what is allowed, or null.

    Repeats are counted before the shuffle, so a very common value is one row a task.
    """
    spell = lambda columns: F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    found = []
    for columns in [list(key), *unique] if key else list(unique):
        name = ",".join(columns)
        whole = df.where(" and ".join(f"`{c}` is not null" for c in columns))
        repeats = whole.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")
        found.append(repeats.select(F.lit(f"unique({name})").alias("rule"), spell(columns).alias("value"), "n"))
    cells = [(f"required({c})", F.col(c).isNull(), F.lit("")) for c in dict.fromkeys([*key, *required])]
    cells += [(f"allowed({c})", ~F.col(c).isin(*values), F.col(c).cast("string")) for c, values in allowed.items()]
    if cells:
        rows = F.array_compact(F.array(*[F.when(bad, F.struct(F.lit(rule).alias("rule"), value.alias("value"))) for rule, bad, value in cells]))
        found.append(df.select(F.inline(rows)).groupBy("rule", "value").agg(F.count("*").alias("n")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def orphans(df: DataFrame, column: str, parents: DataFrame, parent: str) -> DataFrame:
    """Rows whose value is there, not blank, and no parent's."""
    known = parents.select(F.col(parent).cast("string").alias("_parent")).distinct()
    named = df.where(~blank(F.col(column)))
    return named.join(known, named[column].cast("string") == F.col("_parent"), "left_anti")


def null_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """field, n, nulls, rate: how many rows have nothing in a column."""
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("v")) for c in columns])
    by = df.select(F.inline(cells)).groupBy("field").agg(F.count("*").alias("n"), F.count_if(blank(F.col("v"))).alias("nulls"))
    return by.withColumn("rate", F.round(F.col("nulls") / F.col("n"), 4))


def distribution(df: DataFrame, *columns: str, most: int | None = None) -> DataFrame:
    """The columns' values with n and share; only the `most` frequent ones, if given."""
    out = with_share(df.groupBy(*columns).agg(F.count("*").alias("n")))
    return out.orderBy(F.desc("n"), *columns).limit(most) if most else out


def matched(counts: dict[str, tuple[DataFrame, Column | int]]) -> DataFrame:
    """name, n, verdict: for each check whether a table has as many rows as it should."""
    out = None
    for name, (df, want) in counts.items():
        one = df.agg(F.count("*").alias("n"), (want if isinstance(want, Column) else F.lit(want)).alias("_want"))
        one = one.select(F.lit(name).alias("name"), "n", F.when(F.col("n") == F.col("_want"), "OK").otherwise("MISMATCH").alias("verdict"))
        out = one if out is None else out.unionByName(one)
    return out


LOG = "entity string, action string, run string, row_count long, step long, at timestamp"


def load(df: DataFrame, path: str, entity: str, log: str, run: str) -> None:
    """Write a table over what was there as a version of its own, and add what was done to the log; rows are counted as they
    are written. `current` reads the last version; going back is a log row that names an earlier one. A run that the log
    knows is not loaded again, since an earlier step may be gone back to."""
    if steps(df.sparkSession, log).where((F.col("entity") == entity) & (F.col("run") == run)).limit(1).count():
        raise ValueError(f"{entity} has a version {run!r} already")
    seen = Observation("loaded")
    df.observe(seen, F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/{entity}/version={run}")
    record(df.sparkSession, log, entity, "load", run, seen.get["n"])


def steps(spark: SparkSession, log: str) -> DataFrame:
    """The log so far: entity, action, run, row_count, step (1, 2, ... in the order of what was done) and the time."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(log)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(LOG).parquet(log) if there else spark.createDataFrame([], LOG)


def record(spark: SparkSession, log: str, entity: str, action: str, run: str, row_count: int) -> None:
    """Append a step to a log. One writer at a time."""
    last = steps(spark, log).agg(F.max("step")).first()[0] or 0
    line = spark.createDataFrame([(entity, action, run, row_count, last + 1)], "entity string, action string, run string, row_count long, step long").withColumn("at", F.current_timestamp())
    line.coalesce(1).write.mode("append").parquet(log)


def roll_back(spark: SparkSession, path: str, entity: str, log: str, run: str) -> None:
    """Make an earlier version the current one."""
    record(spark, log, entity, "rollback", run, spark.read.parquet(f"{path}/{entity}/version={run}").count())


def current(spark: SparkSession, path: str, entity: str, log: str) -> DataFrame:
    """The version that the last step of the log names."""
    last = steps(spark, log).where(F.col("entity") == entity).agg(F.max_by("run", "step").alias("run")).first().run
    return spark.read.parquet(f"{path}/{entity}/version={last}")
