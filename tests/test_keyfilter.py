"""Violations by increments against the check of the whole."""

from pyspark.sql import functions as F

from tallyloom.operators import checks, keyfilter


def test_added_violations_are_those_of_the_whole(spark):
    old = spark.range(3000).select((F.col("id") * 7).alias("k"), (F.col("id") % 3).cast("string").alias("s"))
    old = old.union(spark.createDataFrame([(None, "x"), (None, "x"), (1, None)], "k long, s string"))
    new = spark.createDataFrame([(7, "1"), (7, "1"), (14, "0"), (14, "2"), (5, "a"), (6, "b"), (6, "b"), (None, "x"), (9, None), (9, None)], "k long, s string")
    for key in (["k"], ["k", "s"]):
        known = keyfilter.key_filter(old, key, 3000)
        keys = new.select(*key).distinct()
        want = checks.violations(old.union(new), unique=[key]).join(keys.select(F.concat_ws("|", *[F.col(c).cast("string") for c in key]).alias("value")), "value", "left_semi")
        got = keyfilter.added_violations(new, key, known, lambda: old)
        assert sorted(map(tuple, got.select("rule", "value", "n").collect())) == sorted(map(tuple, want.select("rule", "value", "n").collect()))
        halves = [keyfilter.key_filter(old.where(c), key, 3000) for c in ("k % 2 = 0", "k % 2 = 1 or k is null")]
        assert sorted(map(tuple, keyfilter.joined(*halves).collect())) == sorted(map(tuple, known.collect()))


def test_a_table_without_the_keys_is_not_read(spark):
    old, new = spark.range(2000).select(F.col("id").alias("k")), spark.range(10**6, 10**6 + 3000).select(F.col("id").alias("k"))
    known = keyfilter.key_filter(old, ["k"], 2000)
    assert keyfilter.perhaps_known(old, ["k"], known).count() == 2000  # all that are there
    assert keyfilter.perhaps_known(new, ["k"], known).count() < 60  # and few that are not

    def table():
        raise AssertionError

    few = spark.createDataFrame([(-5,), (-6,), (-6,)], "k long")
    if keyfilter.perhaps_known(few, ["k"], known).count() == 0:
        assert [tuple(r) for r in keyfilter.added_violations(few, ["k"], known, table).collect()] == [("unique(k)", "-6", 2)]
    assert keyfilter.added_violations(few.limit(0), ["k"], known, table).count() == 0
    assert keyfilter.perhaps_known(few, ["k"], known.limit(0)).count() == 0
