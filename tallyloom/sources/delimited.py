"""Delimited files read without loss: every record comes out as cells, or with the reason why not (ranges.scan)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallyloom.sources.formats import BROKEN, LITERAL, MISALIGNED, OWN, RELAXED, STRICT, UNDECODABLE, Options, unique
from tallyloom.sources.ranges import scan

__all__ = ["BROKEN", "LITERAL", "MISALIGNED", "OWN", "RELAXED", "STRICT", "UNDECODABLE", "Ingested", "Options", "diagnosis", "raw_line_count", "read", "scan", "tabled", "unique", "write", "write_found"]


@dataclass
class Ingested:
    rows: DataFrame
    failures: DataFrame
    columns: list[str]


def tabled(found: DataFrame) -> Ingested:
    """Rows of scan as a table: good records by the names of their own file's header, and the failures.

    Files at one path may have columns of their own or in another order; what a file lacks is blank.
    """
    headers = [r.header for r in found.where("header is not null").groupBy("header").agg(F.min(F.struct("source_file", "row_index")).alias("first")).orderBy("first").select("header").collect()]  # one a kind of file
    columns = list(dict.fromkeys(c for h in headers for c in h))
    cell = lambda c: F.coalesce(F.try_element_at("cells", F.nullif(F.array_position("header", c).cast("int"), F.lit(0))), F.lit("")).alias(c)
    good = found.where("reason is null").select("row_index", F.col("source_file").alias("_source_file"), *[cell(c) for c in columns])
    bad = found.where("reason is not null").select("source_file", "row_index", "raw", F.sha2("raw", 256).alias("raw_sha256"), F.left("raw", F.lit(200)).alias("preview"), "reason", "detail")
    return Ingested(good, bad, columns)


def read(spark: SparkSession, path: str, options: Options = Options()) -> Ingested:
    """The good records of the files at a path as columns of strings with row_index and _source_file, and the failures."""
    return tabled(scan(spark, path, options))


def diagnosis(found: DataFrame) -> DataFrame:
    """One row a file of scan: rows, failures by reason, rows with characters lost, encoding, delimiter, quote mode, columns."""
    n = F.count_if
    by = found.groupBy("source_file").agg(
        n(F.col("reason").isNull()).alias("rows"),
        n(F.col("reason") == MISALIGNED).alias("misaligned"),
        n(F.col("reason") == UNDECODABLE).alias("undecodable"),
        n(F.col("reason") == BROKEN).alias("broken"),
        n(F.col("reason").isNull() & F.col("detail").isNotNull()).alias("rows_with_lost_characters"),
        *[F.any_value(c).alias(c) for c in ("encoding", "delimiter", "quote_mode")],
        F.max(F.size("header")).alias("column_count"),
    )
    return by


def raw_line_count(spark: SparkSession, path: str, blank: bool = True) -> int:
    """Lines of the files at a path, as they stand, with or without blank ones."""
    lines = spark.read.text(path)
    return (lines if blank else lines.where(F.trim("value") != "")).count()


def write(df: DataFrame, path: str, mode: str = "overwrite", delimiter: str = ",", encoding: str = "UTF-8") -> None:
    """CSV with a header, quotes in cells doubled and blanks kept; a header alone where there are no rows."""
    options = {"header": True, "emptyValue": "", "nullValue": "", "escape": '"', "sep": delimiter, "encoding": encoding}
    df.write.mode(mode).options(**options, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_found(df: DataFrame, path: str, file: str | None = None) -> int:
    """Write the rows there are, with the file they are of if one is given, and give their number; nothing where there are
    none. They are counted on the way (one pass)."""
    if file is not None:
        df = df.withColumn("file", F.lit(file))
    seen = Observation("rows")
    some = df.observe(seen, F.count("*").alias("n"))
    if df.limit(1).count():
        write(some, path)
        return seen.get["n"]
    return 0
