"""One front for files of all kinds: rows, failures and columns, whatever a file's format, for one file or for many."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import audit, core
from tallyloom.operators.settle import settled
from tallyloom.sources import delimited, spreadsheet
from tallyloom.sources.delimited import Ingested, Options


def format_of(path: str) -> str:
    """csv or xlsx, by a path's ending."""
    ending = path.rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower()
    if ending in ("csv", "tsv"):
        return "csv"
    if ending in ("xlsx", "xls"):
        return "xlsx"
    raise ValueError(f"no reader for {path!r}")


def read_source(spark: SparkSession, path: str, options: Options = Options(), sheet: str | None = None) -> Ingested:
    """The rows of the files at a path, by their kind, and their failures. What was parsed is kept (settled)."""
    if format_of(path) == "csv":
        return delimited.read(spark, path, options)
    return delimited.tabled(settled(spreadsheet.read(spark, path, sheet, options=options)))


@dataclass(frozen=True)
class Input:
    """A file of a run, with what is known of it."""

    path: str
    key: str = ""
    label: str = ""
    options: Options = Options()
    sheet: str | None = None

    @property
    def source_key(self) -> str:
        return self.key or self.label or self.path.rsplit("/", 1)[-1]


def read_inputs(spark: SparkSession, inputs: list[Input]) -> Ingested:
    """All inputs' rows in one table with _source_key, no file's columns lost, and all their failures."""
    each = [(i, read_source(spark, i.path, i.options, i.sheet)) for i in inputs]
    rows = core.union_files(*[x.rows.withColumn("_source_key", F.lit(i.source_key)) for i, x in each])
    failures = each[0][1].failures
    for _, x in each[1:]:
        failures = failures.unionByName(x.failures)
    return Ingested(rows, failures, list(dict.fromkeys(c for _, x in each for c in x.columns)))


def preview(found: Ingested, rows: int = 100_000, tops: int = 5) -> DataFrame:
    """field, non_empty, top_values of a file's first rows: a look at it before it is imported."""
    first = found.rows.orderBy("_source_file", "row_index").limit(rows)
    counts = audit.value_counts(first, found.columns).groupBy("field").agg(F.sum("n").alias("non_empty"))
    best = audit.top_values(first, found.columns, tops).groupBy("field").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value", "n"))), lambda x: F.struct(x["value"].alias("value"), x["n"].alias("n"))).alias("top_values"))
    return counts.join(best, "field")
