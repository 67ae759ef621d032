"""The ledger as a versioned table: a merge writes what it changes, a stream merges each micro-batch once."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyloom.operators import core

LEDGER = "ledger_key string, fp string, batch string, last_run string"
MERGES = "version long, run string, batch string, base long"
MANIFEST = "bucket int, whole long, deltas array<long>"


class Ledger:
    """A ledger in hash buckets, its versions, and a table of the merges that made them. One writer at a time.

    A merge reads the buckets that its keys fall into and writes the rows of those keys alone, as a delta. A version's
    manifest names, for each bucket, the version that wrote it as a whole and those that wrote deltas since, oldest first;
    a read takes of each key the last. A bucket with `deltas` of them is written as a whole by the next merge that meets it,
    so what is written grows with the batch, and what is read stays near the ledger's size.

    Data and manifest are written before the row in `merges` that makes a version count. A crash in between leaves folders
    that the next merge, which takes the same number, writes over. Going back is a version with an earlier one's manifest.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, deltas: int = 8):
        self.spark, self.path, self._buckets, self.deltas = spark, path.rstrip("/"), buckets, deltas

    # --- versions ---

    def _there(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def merges(self) -> DataFrame:
        """The merges so far: the version each made and the one it started from."""
        path = f"{self.path}/merges"
        return self.spark.read.schema(MERGES).parquet(path) if self._there(path) else self.spark.createDataFrame([], MERGES)

    def current(self) -> dict:
        """The last version's number and how many merges there were; 0 before the first."""
        last = self.merges().agg(F.max("version"), F.count("*")).first()
        return {"version": last[0] or 0, "merges": last[1]}

    def manifest(self, version: int) -> dict[int, tuple[int, list[int]]]:
        """For each bucket the version that wrote it as a whole (0: none) and those of the deltas since."""
        if not version:
            return {b: (0, []) for b in range(self._buckets)}
        return {r.bucket: (r.whole, list(r.deltas)) for r in self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifests/{version:08d}").collect()}  # a row a bucket

    def read(self, version: int | None = None) -> DataFrame:
        """The ledger as it is now, or as a version had it."""
        return self._rows(self.manifest(self.current()["version"] if version is None else version))

    def _data(self, parts: list[tuple[int, int]]) -> DataFrame:
        """The rows that versions wrote for buckets, with _version."""
        schema = f"{LEDGER}, _version long"
        paths = [f"{self.path}/data/{v:08d}/_bucket={b}" for v, b in parts]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _rows(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        picked = {b: x for b, x in manifest.items() if buckets is None or b in buckets}
        names = [F.col(c.split()[0]) for c in LEDGER.split(", ")]
        whole = self._data([(v, b) for b, (v, _) in picked.items() if v]).select(*names)
        deltas = [(v, b) for b, (_, vs) in picked.items() for v in vs]
        if not deltas:
            return whole
        last = self._data(deltas).groupBy("ledger_key").agg(F.max_by(F.struct(*names), "_version").alias("r")).select("r.*")
        return whole.join(last.select("ledger_key"), "ledger_key", "left_anti").unionByName(last)

    # --- merges ---

    def merge(self, rows: DataFrame, batch: str, run: str) -> DataFrame:
        """Merge a batch of rows and give their dispositions. A batch and run merged before leave the ledger as it is and
        get the dispositions they had then."""
        done = self.merges().where((F.col("run") == run) & (F.col("batch") == batch)).orderBy("version").first()
        base = done.base if done else self.current()["version"]
        manifest = self.manifest(base)
        n = len(manifest)
        bucket = lambda key: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
        met = sorted(r[0] for r in rows.select(bucket("ledger_key")).distinct().collect())  # buckets at most
        known = self._rows(manifest, met).join(rows.select("ledger_key").distinct(), "ledger_key", "left_semi")
        out, touched = core.merged(rows, known, batch, run)
        if not done:
            self._commit(manifest, met, touched, base, batch, run, bucket("ledger_key"))
        return out

    def _commit(self, manifest: dict, met: list[int], touched: DataFrame, base: int, batch: str, run: str, bucket: Column) -> None:
        version = self.current()["version"] + 1
        full = [b for b in met if len(manifest[b][1]) >= self.deltas or not manifest[b][0]]
        old = self._rows(manifest, [b for b in full if manifest[b][0]])
        kept = old.join(touched.select("ledger_key"), "ledger_key", "left_anti")
        new = touched.select(*kept.columns).unionByName(kept).withColumns({"_bucket": bucket, "_version": F.lit(version).cast("long")})
        new.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/data/{version:08d}")
        after = manifest | {b: (version, []) if b in full else (manifest[b][0], [*manifest[b][1], version]) for b in met}
        self._name(after, version, run, batch, base)

    def _name(self, manifest: dict, version: int, run: str, batch: str, base: int) -> None:
        rows = [(b, whole, deltas) for b, (whole, deltas) in sorted(manifest.items())]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifests/{version:08d}")
        self.spark.createDataFrame([(version, run, batch, base)], MERGES).coalesce(1).write.mode("append").parquet(f"{self.path}/merges")

    def roll_back(self, version: int, run: str) -> None:
        """Make an earlier version the current one again, as a version of its own. No data is written."""
        last = self.current()["version"]
        self._name(self.manifest(version), last + 1, run, f"rollback to {version}", last)


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a stream keeps with its checkpoint: another checkpoint, or one that was reset, is another stream."""
    return json.loads(spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first().value)["id"]


def merge_stream(rows: DataFrame, ledger: Ledger, dispositions: str, checkpoint: str) -> StreamingQuery:
    """Start merging a stream of (row_index, ledger_key, fp, ...) rows; their dispositions go to a Parquet folder, a
    sub-folder for each stream and micro-batch, written over if the batch is replayed.

    A batch is known by its stream's id and its number, so several streams may merge into one ledger, one after the other.
    """
    spark, name = rows.sparkSession, []

    def each(df: DataFrame, epoch: int) -> None:
        if not name:
            name.append(query_id(spark, checkpoint))
        held = df.persist()
        ledger.merge(held, f"{name[0]}/{epoch}", name[0]).write.mode("overwrite").parquet(f"{dispositions}/query={name[0]}/epoch={epoch}")
        held.unpersist()

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
