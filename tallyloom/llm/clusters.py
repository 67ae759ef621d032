"""Centroid clustering of integer vectors; n-simplex projections filter centroids before exact comparison."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import small_batches, table, written

PIVOTS = 8  # distances cached for each vector
LARGE = 2**27  # beyond it squared distances of 64 components may leave 64 bits, so Python's integers count
MOST = 2**58  # no scaled component reaches it: sums stay within 38 digits
SLACK = 1e-6  # of squared lengths: far above what rounding can do to a bound


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows, as they broadcast."""
    if a.size and b.size and max(np.abs(a).max(), np.abs(b).max()) >= LARGE:
        a, b = a.astype(object), b.astype(object)
    d = a - b
    return (d * d).sum(axis=-1)


class Simplex:
    """Pivots as the base of a simplex, and other points as its apexes, from their distances to the pivots alone.

    Two apexes, each with its height over the base, are at most as far apart as the points if the heights point the same
    way, and at least as far if they point opposite ways. Pivots that hardly add a dimension are left out, since they would
    make coordinates inexact.
    """

    def __init__(self, points: np.ndarray, most: int = PIVOTS):
        self.pivots = points[:1]
        self.base = np.zeros((len(self.pivots), 0))
        for p in points[1:]:
            if len(self.pivots) == most:
                break
            apex = self.apexes(np.sqrt(squared(p, self.pivots).astype(float))[None])[0]
            if apex[-1] > 0.1 * np.linalg.norm(apex):
                self.base = np.vstack([np.pad(self.base, ((0, 0), (0, 1))), apex])
                self.pivots = np.vstack([self.pivots, p])

    def distances(self, points: np.ndarray) -> np.ndarray:
        return np.sqrt(squared(points[:, None, :], self.pivots[None]).astype(float))

    def apexes(self, distances: np.ndarray) -> np.ndarray:
        """A row of coordinates for each row of distances to the pivots; the last one is the height."""
        n = len(self.base)
        out = np.zeros((len(distances), n))
        first = distances[:, 0] ** 2
        for i in range(1, n):
            b = self.base[i]
            out[:, i - 1] = (first - distances[:, i] ** 2 + b @ b - 2 * out[:, : i - 1] @ b[: i - 1]) / (2 * b[i - 1])
        out[:, n - 1] = np.sqrt(np.maximum(first - (out[:, : n - 1] ** 2).sum(axis=1), 0))
        return out


def nearest(vectors: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, tops: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each vector its nearest centroid (the first of ties), the exact squared distance, and how many were compared."""
    flat = ((apexes[:, None, :-1] - tops[None, :, :-1]) ** 2).sum(axis=2)
    lower = flat + (apexes[:, None, -1] - tops[None, :, -1]) ** 2
    upper = flat + (apexes[:, None, -1] + tops[None, :, -1]) ** 2
    slack = SLACK * ((apexes**2).sum(axis=1)[:, None] + (tops**2).sum(axis=1)[None])
    row, column = np.nonzero(lower - slack <= (upper + slack).min(axis=1, keepdims=True))
    exact = squared(vectors[row], centroids[column])
    order = np.lexsort((column, exact, row))
    best = order[np.flatnonzero(np.diff(row[order], prepend=-1))]
    return column[best], exact[best], len(row)


def scaled(embedding: Column, size: int = 64, by: int = 64) -> Column:
    """floor(by * x) of each component; null unless there are `size`, all finite (and below MOST, scaled)."""
    d = embedding.cast("array<double>")
    fit = (F.size(d) == size) & F.forall(d, lambda x: F.coalesce(F.abs(x * by) < F.lit(float(MOST)), F.lit(False)) & ~F.isnan(x))
    return F.when(fit, F.transform(d, lambda x: F.floor(x * by)))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sums(kept: DataFrame, simplex: Simplex, centroids: np.ndarray) -> list:
    """(cluster, members, sums by component) of each cluster that has any: added up in tasks, then by Spark."""
    tops = simplex.apexes(simplex.distances(centroids))

    def batches(it):
        total: dict[int, list] = {}
        for b in it:
            if not b.num_rows:
                continue
            v = _matrix(b.column("v"))
            which, _, _ = nearest(v, _matrix(b.column("apex")), centroids, tops)
            wide = v.astype(object) if np.abs(v).max() >= LARGE else v
            for c in np.unique(which).tolist():
                own = wide[which == c]
                n, s = total.get(c, (0, 0))
                total[c] = (n + len(own), s + own.sum(axis=0).astype(object))
        rows = [(c, j, n, Decimal(int(x))) for c, (n, s) in total.items() for j, x in enumerate(s)]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0))
        yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows) if rows else [[]] * 4, kinds)], names=["cluster", "j", "n", "s"])

    parts = kept.select("v", "apex").mapInArrow(batches, "cluster int, j int, n long, s decimal(38,0)")
    sums = parts.groupBy("cluster", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    return sums.groupBy("cluster", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "s"))), lambda x: x["s"]).alias("s")).collect()  # one row a cluster


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, size: int = 64, by: int = 64, seed: str = "1") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for each vector of `size` finite components.

    Components become floor(by * x). The first k centroids are the vectors with the smallest sha256 of `seed:vec_id`; each
    round takes the floor of every cluster's means, and empty clusters keep their centroid. Distances to PIVOTS of the first
    centroids are taken once and kept as apex coordinates, from which each round tells which centroids may be nearest; those
    alone are compared, in exact integers. Sums are added up in tasks; k rows a round reach the driver.

    Vectors that are null, of another length, or with a component that is null, not finite or 2**58 or more when scaled are
    left out. Repeated rows each count and give a row (as first centroids too, in the order of their components); a null
    vec_id comes last among them. Distances and sums that don't fit a long are null. Fewer than k vectors make fewer
    clusters, none an empty table. Other columns are left behind.
    """
    small_batches(vectors.sparkSession, 5000)
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), scaled(F.col("embedding"), size, by).alias("v")).where("v is not null")
    first = whole.withColumn("_h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)).orderBy(F.asc_nulls_last("_h"), "v").limit(k).select("v").collect()
    out = "vec_id long, cluster int, distance decimal(38,0)"
    if not first:
        return whole.select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256")).limit(0)
    centroids = np.array([r.v for r in first], np.int64)
    simplex = Simplex(centroids)

    def with_apexes(it):
        for b in it:
            v = _matrix(b.column("v")) if b.num_rows else np.zeros((0, size), np.int64)
            apex = simplex.apexes(simplex.distances(v))
            yield pa.record_batch([b.column("vec_id"), b.column("v"), pa.array(list(apex), pa.list_(pa.float64()))], names=["vec_id", "v", "apex"])

    kept = written(whole.mapInArrow(with_apexes, "vec_id long, v array<long>, apex array<double>"), "vectors")
    for _ in range(rounds):
        for r in _sums(kept, simplex, centroids):
            centroids[r.cluster] = [int(x) // r.n for x in r.s]
    tops = simplex.apexes(simplex.distances(centroids))

    def assign(it):
        for b in it:
            if b.num_rows:
                which, distance, _ = nearest(_matrix(b.column("v")), _matrix(b.column("apex")), centroids, tops)
                yield pa.record_batch([b.column("vec_id"), pa.array(which, pa.int32()), pa.array([Decimal(int(d)) for d in distance], pa.decimal128(38, 0))], names=["vec_id", "cluster", "distance"])

    assigned = written(kept.mapInArrow(assign, out), "assigned")
    spark = vectors.sparkSession
    names = spark.createDataFrame([(i, ",".join(map(str, c.tolist()))) for i, c in enumerate(centroids)], "cluster int, components string")
    sums = assigned.groupBy("cluster").agg(F.try_sum("distance").alias("_own"))
    sums = sums.join(F.broadcast(sums.agg(F.try_sum("_own").alias("_all")))).join(F.broadcast(names), "cluster")
    fits = lambda c: F.col(c).try_cast("long")
    return assigned.join(F.broadcast(sums), "cluster").select(
        "vec_id", "cluster", fits("distance").alias("distance"), fits("_own").alias("cluster_inertia"), fits("_all").alias("inertia"), F.sha2("components", 256).alias("centroid_sha256")
    )


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def op12_sql(k: int = 16, rounds: int = 3) -> str:
    steps = [
        "whole as materialized (select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v, row_number() over () as r from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: isfinite(x))) = 64)",
        f"c0 as materialized (select cast(row_number() over (order by sha256('1:' || vec_id), v) - 1 as int) as cluster, v as c from whole order by sha256('1:' || vec_id), v limit {k})",
    ]
    square = "list_sum(list_transform(list_zip(v, c), lambda p: cast((p[1] - p[2]) * (p[1] - p[2]) as hugeint)))"
    for i in range(rounds + 1):
        steps.append(f"a{i} as materialized (select r, min(d).cluster as cluster, min(d).d as d from (select r, {{'d': {square}, 'cluster': cluster}} as d from whole cross join c{i}) group by r)")
        if i < rounds:
            steps.append(f"m{i} as (select cluster, j, sum(x) as s, count(*) as n from (select a.cluster, unnest(w.v) as x, unnest(range(64)) as j from whole w join a{i} a using (r)) group by 1, 2)")
            steps.append(f"n{i} as (select cluster, list(cast((s - ((s % n) + n) % n) // n as bigint) order by j) as c from m{i} group by 1)")
            steps.append(f"c{i + 1} as materialized (select o.cluster, coalesce(n.c, o.c) as c from c{i} o left join n{i} n using (cluster))")
    last = f"a{rounds}"
    return f"with {', '.join(steps)} select w.vec_id, a.cluster, cast(a.d as bigint) as distance, cast(sum(a.d) over (partition by a.cluster) as bigint) as cluster_inertia, cast(sum(a.d) over () as bigint) as inertia, sha256(array_to_string(c.c, ',')) as centroid_sha256 from whole w join {last} a using (r) join c{rounds} c on c.cluster = a.cluster"
