"""Unique keys checked by increments: a Bloom filter of a table's keys, so that a load tests its own keys alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASHES, BITS = 4, 12  # of each key: one key in 140 that is not there looks as if it were


def _places(key: list[str], size: Column) -> Column:
    """(bucket, bit) of a key's bits, in bitmaps of 32,768 bits."""
    at = F.array(*[F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in key], F.lit(i)), size) for i in range(HASHES)])
    return F.transform(at, lambda p: F.struct(F.bitmap_bucket_number(p).alias("bucket"), F.bitmap_bit_position(p).alias("bit")))


def _whole(df: DataFrame, key: list[str]) -> DataFrame:
    return df.where(" and ".join(f"`{c}` is not null" for c in key))


def key_filter(df: DataFrame, key: list[str], keys: int) -> DataFrame:
    """bucket, bits, size: the filter of a table's keys, made for about so many of them. Keep it beside the table's version."""
    size = F.lit(max(BITS * keys, 32_768)).cast("long")
    bits = _whole(df, key).select(F.inline(_places(key, size)))
    return bits.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).withColumn("size", size)


def joined(a: DataFrame, b: DataFrame) -> DataFrame:
    """The filter of two tables' keys together, from their filters of one size."""
    return a.unionByName(b).groupBy("bucket", "size").agg(F.bitmap_or_agg("bits").alias("bits")).select("bucket", "bits", "size")


def perhaps_known(df: DataFrame, key: list[str], known: DataFrame) -> DataFrame:
    """The distinct keys of df that a filter may hold: all that it does hold, and few others."""
    one = known.agg(F.max("size").alias("_size"))
    asked = _whole(df, key).select(*key).distinct().join(F.broadcast(one)).where("_size is not null")
    bits = asked.select(*key, F.inline(_places(key, F.col("_size"))))
    byte = F.conv(F.hex(F.substring("bits", F.floor(F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.floor(byte / F.pow(F.lit(2), F.col("bit") % 8)).cast("int") % 2 == 1
    met = bits.join(known.select("bucket", "bits"), "bucket").where(is_set)
    # bits of one key may fall together, and are then met as often
    return met.groupBy(*key).agg(F.count("*").alias("_met")).where(F.col("_met") == HASHES).select(*key)


def added_violations(new: DataFrame, key: list[str], known: DataFrame, table) -> DataFrame:
    """rule, value, n of the new rows' keys that are there more than once, in them and the table: what checks.violations says
    of both together for these keys. table() reads the old one; it is asked only if the filter may hold one of the keys, and
    then meets these keys alone."""
    counts = _whole(new, key).groupBy(*key).agg(F.count("*").alias("_new"))
    hits = perhaps_known(new, key, known)
    out = counts.withColumn("_old", F.lit(0).cast("long"))
    if hits.limit(1).count():
        old = table().join(hits, key, "left_semi").groupBy(*key).agg(F.count("*").alias("_old"))
        out = counts.join(old, key, "left").withColumn("_old", F.coalesce("_old", F.lit(0)))
    value = F.concat_ws("|", *[F.col(c).cast("string") for c in key])
    return out.select(F.lit(f"unique({','.join(key)})").alias("rule"), value.alias("value"), (F.col("_new") + F.col("_old")).alias("n")).where("n > 1")
