"""What packs cost on disk, and that it makes no difference to them."""

import glob
import gzip
import time

from pyspark.sql import functions as F

from tallyloom.functions.hashing import packed, unpacked
from tallyloom.operators import flow
from tallyloom.operators.settle import settled

DONE = ["id as row_index", "if(id % 3 = 0, 'review', 'inserted') as _final_disposition", "'x' as _final_disposition_reason", "'p' as _parent", "'f' as _source_file", "'k' as _source_key", "sha2(cast(id % 7 as string), 256) as _source_record_key", "if(id % 2 = 0, '', sha2(cast(id % 5 as string), 256)) as _structural_fingerprint_full", "if(id % 4 = 0, null, sha2(cast(id as string), 256)) as _ledger_key"]


def test_fingerprints_as_bytes_are_the_same_again(spark):
    values = ["", None, "a" * 64, "0f" * 32, "A" * 64, "a" * 63, "a" * 64 + "\n", "山", "\0", "x" * 32]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").withColumn("b", packed(F.col("v")))
    got = df.select("i", F.length("b").alias("n"), unpacked(F.col("b")).alias("w")).orderBy("i").collect()
    assert [r.w for r in got] == values and [r.n for r in got[:4]] == [0, None, 32, 32]


def test_places_are_those_of_the_order_as_text(spark, tmp_path):
    done = spark.range(200).selectExpr(*DONE)
    full = flow.pack_rows(done)
    key = lambda r: (*(r[c] for c in flow.PACK_ORDER), r["_ledger_key"] is not None, r["_ledger_key"] or "", str(r["row_index"]))
    was = {r.row_index: r for r in done.collect()}
    got = full.collect()
    for pack in ("mainline", "review"):
        mine = sorted((r for r in got if r.pack == pack), key=lambda r: r.place)
        assert [r.row_index for r in mine] == [r["row_index"] for r in sorted((was[r.row_index] for r in mine), key=key)]
        assert [r.place for r in mine] == list(range(1, len(mine) + 1))
    assert all(r[c] == was[r.row_index][c] for r in got for c in done.columns)
    equal = spark.range(200).selectExpr(*DONE[:6], "'a' as _source_record_key", "'b' as _structural_fingerprint_full")
    places = [(r.place, r.row_index) for r in flow.pack_rows(equal).where("pack = 'review'").orderBy("place").collect()]
    assert [i for _, i in places] == sorted(range(0, 200, 3), key=str)


def test_packs_may_be_compressed(spark, tmp_path):
    done = spark.range(300).selectExpr(*DONE)
    plain, small = str(tmp_path / "plain"), str(tmp_path / "small")
    assert flow.write_packs(done, plain) == flow.write_packs(done, small, "gzip") == {"mainline": 200, "review": 100, "quarantine": 0}
    lines = lambda files, opened: sorted(x for f in files for x in opened(f, "rt").read().splitlines())
    a, b = (glob.glob(f"{p}/*/part-*.csv{e}") for p, e in ((plain, ""), (small, ".gz")))
    assert a and set(lines(a, open)) == set(lines(b, gzip.open))
    back = lambda p: sorted(map(tuple, spark.read.option("header", True).csv(p).collect()), key=repr)
    assert back(plain) == back(small)


def test_what_was_shuffled_for_kept_rows_is_deleted(spark):
    def files():
        dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
        return {f for d in dirs for f in glob.glob(f"{d.getAbsolutePath()}/*/shuffle_*.data")}

    before = files()
    kept = settled(spark.range(1_000).repartition(5, "id").groupBy((F.col("id") % 10).alias("k")).count())
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before
    assert kept.count() == 10 and kept.join(kept.withColumnRenamed("count", "n"), "k").count() == 10
