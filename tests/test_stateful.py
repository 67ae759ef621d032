"""Dispositions of a stream with its own state, against merges of whole tables one after another."""

import random
import time

from pyspark.sql import functions as F

from tallyloom.operators import core
from tallyloom.streaming import stateful

SCHEMA = "row_index long, ledger_key string, fp string, batch string"
LEDGER = "ledger_key string, fp string, batch string, last_run string"


def add(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    time.sleep(0.05)  # files are taken in the order of their times


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def run(spark, folder, out, check, **more):
    assert stateful.start(stream(spark, folder), out, check, **more).awaitTermination(120)


def got(spark, out):
    return sorted(map(tuple, spark.read.parquet(out).select("batch", "row_index", "disposition").collect()))


def merged(spark, batches, held=()):
    table, found = spark.createDataFrame(list(held), LEDGER), []
    for rows in batches:
        out, after = core.merge(spark.createDataFrame(rows, SCHEMA), table, rows[0][3], "r")
        found += [(rows[0][3], r.row_index, r.disposition) for r in out.collect()]
        table = spark.createDataFrame(after.collect(), LEDGER)
    return sorted(found), sorted((r.ledger_key, r.fp, r.batch) for r in table.collect())


def state(spark, check):
    return sorted(map(tuple, stateful.ledger(spark, check).collect()))


def test_a_stream_its_restart_and_a_reset_checkpoint(spark, tmp_path):
    r = random.Random(9)
    made = lambda b, n: [(i, f"k{r.randrange(12)}", r.choice("xy"), b) for i in range(n)]
    folder, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    batches = [made(b, n) for b, n in (("b1", 20), ("b2", 15), ("b2", 10), ("b3", 25))]
    for b in batches[:2]:
        add(spark, folder, b)
    run(spark, folder, out, check)
    for b in batches[2:]:
        add(spark, folder, b)
    run(spark, folder, out, check)  # goes on with its state
    run(spark, folder, out, check)  # nothing is new
    want, ledger = merged(spark, batches)
    assert got(spark, out) == want and state(spark, check) == ledger

    other = str(tmp_path / "in2")  # a second stream that starts with what the first one knows
    more = [made("c1", 12), made("c2", 12)]
    for b in more:
        add(spark, other, b)
    known = spark.createDataFrame(ledger, "ledger_key string, fp string, batch string")
    run(spark, other, str(tmp_path / "out2"), str(tmp_path / "check2"), known=known)
    want, after = merged(spark, more, [(*x, "r") for x in ledger])
    assert got(spark, str(tmp_path / "out2")) == want and state(spark, str(tmp_path / "check2")) == after

    known = spark.createDataFrame(after, "ledger_key string, fp string, batch string")
    run(spark, other, str(tmp_path / "out3"), str(tmp_path / "check3"), known=known)  # the checkpoint was lost
    assert got(spark, str(tmp_path / "out3")) == merged(spark, more, [(*x, "r") for x in after])[0]


def test_keys_are_forgotten(spark, tmp_path):
    folder, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    schema = f"{SCHEMA}, seen_at timestamp"

    def run(rows, second):
        df = spark.createDataFrame(rows, SCHEMA).withColumn("seen_at", F.timestamp_seconds(F.lit(second)))
        df.coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        query = stateful.start(stream, out, check, expire_ms=10_000)
        assert query.awaitTermination(120)
        return {k for k, _, _ in state(spark, check)}

    assert run([(0, "a", "1", "b1"), (1, "b", "1", "b1")], 1000) == {"a", "b"}
    assert run([(0, "c", "1", "b2"), (1, "b", "1", "b2")], 1005) == {"a", "b", "c"}
    assert run([(0, "c", "1", "b3")], 1013) == {"b", "c"}
    assert run([(0, "a", "1", "b4")], 1014) == {"a", "b", "c"}
    kinds = sorted(map(tuple, spark.read.parquet(out).select("batch", "ledger_key", "disposition").collect()))
    assert kinds == [("b1", "a", "inserted"), ("b1", "b", "inserted"), ("b2", "b", "unchanged"), ("b2", "c", "inserted"), ("b3", "c", "unchanged"), ("b4", "a", "inserted")]
