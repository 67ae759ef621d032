"""Profiles made of files' sketches against exact ones."""

import random
from collections import Counter

from pyspark.sql import functions as F

from tallyloom.operators import sketches


def test_a_batch_profile_from_its_files_sketches(spark, tmp_path):
    r = random.Random(4)
    rows = [(f"f{i % 7}.csv", f"v{int(r.expovariate(0.1))}", f"u{i}" if i % 3 else "", str(r.randrange(10_000) / 4) if i % 2 else "x", " ") for i in range(9000)]
    df = spark.createDataFrame(rows, "_source_file string, few string, many string, number string, none string").repartition(5)
    columns = ["few", "many", "number", "none"]
    for f in range(7):  # each file by itself, as it comes in
        sketches.sketched(df.where(F.col("_source_file") == f"f{f}.csv"), columns).write.mode("append").parquet(str(tmp_path / "sketches"))
    kept = spark.read.parquet(str(tmp_path / "sketches"))
    assert kept.count() == 28
    got = {x.field: x for x in sketches.merged(kept).collect()}
    for i, c in enumerate(columns, 1):
        values = [x[i].strip() for x in rows if x[i].strip()]
        one = got[c]
        assert (one.n, one.filled, one.longest) == (9000, len(values), max(map(len, values), default=None))
        assert abs(one.distinct - len(set(values))) <= 0.05 * len(set(values))
    counts = Counter(x[1] for x in rows)
    assert {x.value: x.n for x in got["few"].top_values} == {v: counts[v] for v in [x.value for x in got["few"].top_values]}
    assert sorted((x.n for x in got["few"].top_values), reverse=True) == [n for _, n in counts.most_common(5)]
    numbers = sorted(float(x[3]) for x in rows if x[3] != "x")
    ranks = [sum(v <= q for v in numbers) / len(numbers) for q in got["number"].quantiles]
    assert all(abs(rank - want) < 0.03 for rank, want in zip(ranks, (0.25, 0.5, 0.75)))
    assert got["none"].quantiles is None and got["none"].filled == 0 and not got["none"].top_values
    assert sketches.merged(kept.limit(0)).count() == 0
