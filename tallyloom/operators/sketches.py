"""Profiles that merge: sketches of each file's columns, kept beside the data, from which a batch's profile is made without
reading any file again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import text

#: values that a file's sketch keeps counts of; their counts are exact while a column has fewer different ones
TRACKED = 10_000
LOG_K = 12  # of the sketch of different values: 2**LOG_K buckets, a standard error of 1.04 / 2**(LOG_K / 2), 1.6 %


def sketched(df: DataFrame, columns: list[str], by: str = "_source_file") -> DataFrame:
    """by, field, n, filled, distinct_sketch, longest, top_sketch, number_sketch: a row for each file and column.

    Cells are trimmed; blank ones count in n alone. One pass: what is sketched is added up in tasks before the shuffle, so a
    file's sketches meet, not its rows. Their size is bounded whatever a file holds.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("field"), text.trimmed(F.col(f"`{c}`")).alias("_v")) for c in columns])
    long = df.select(F.col(by), F.inline(cells)).withColumn("_v", F.when(F.col("_v") != "", F.col("_v")))
    return long.groupBy(by, "field").agg(
        F.count("*").alias("n"),
        F.count("_v").alias("filled"),
        F.hll_sketch_agg("_v", LOG_K).alias("distinct_sketch"),
        F.max(F.length("_v")).alias("longest"),
        F.expr(f"approx_top_k_accumulate(_v, {TRACKED})").alias("top_sketch"),
        F.kll_sketch_agg_double(F.col("_v").try_cast("double")).alias("number_sketch"),
    )


def merged(sketches: DataFrame, tops: int = 5, quantiles: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """field, n, filled, fill_rate, distinct, longest, top_values, quantiles of all the files together.

    n, filled and longest are exact. distinct is within about 1.6 % (one standard error). top_values (value, n) are exact
    while a column has fewer than three quarters of TRACKED different values. quantiles are those of cells that are numbers,
    null where none is, within about 1.7 % of the ranks.
    """
    by = sketches.groupBy("field").agg(
        F.sum("n").alias("n"),
        F.sum("filled").alias("filled"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch")).alias("distinct"),
        F.max("longest").alias("longest"),
        F.expr(f"approx_top_k_combine(top_sketch, {TRACKED})").alias("_top"),
        F.collect_list("number_sketch").alias("_numbers"),  # a few thousand bytes a file
    )
    numbers = F.reduce("_numbers", F.lit(None).cast("binary"), lambda a, x: F.coalesce(F.kll_sketch_merge_double(a, x), a, x))
    out = by.withColumn("_numbers", numbers)
    at = F.array(*[F.lit(float(q)) for q in quantiles])
    some = F.kll_sketch_get_n_double("_numbers") > 0
    filled = F.filter(F.expr(f"approx_top_k_estimate(_top, {tops + 1})"), lambda x: x["item"].isNotNull())  # blanks are counted too
    return out.select(
        "field",
        "n",
        "filled",
        F.round(F.col("filled") / F.col("n"), 4).alias("fill_rate"),
        "distinct",
        "longest",
        F.transform(F.slice(filled, 1, tops), lambda x: F.struct(x["item"].alias("value"), x["count"].alias("n"))).alias("top_values"),
        F.when(some, F.kll_sketch_get_quantile_double("_numbers", at)).alias("quantiles"),
    )


def close(estimate: Column, exact: Column, error: float = 0.05) -> Column:
    """Whether an estimate is within so much of the exact number."""
    return F.abs(estimate - exact) <= error * exact
