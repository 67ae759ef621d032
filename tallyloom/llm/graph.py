"""Connected components over an edge table, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import written

SHARE = 1_000  # a key with more than this part of all rows is hot; so there are fewer than this many hot keys
LEAST = 2_000  # rows that a key may have in any case


def hot_keys(df: DataFrame, *key: str) -> DataFrame:
    """The fewer than SHARE keys that hold more than one row in SHARE, and more than LEAST. Counts are added up before the
    shuffle."""
    counts = df.groupBy(*key).agg(F.count("*").alias("_rows"))
    total = df.agg(F.greatest(F.count("*") / SHARE, F.lit(LEAST)).alias("_most"))
    return counts.join(F.broadcast(total), F.col("_rows") > F.col("_most")).select(*key)


def looked_up(df: DataFrame, values: DataFrame, hot: DataFrame) -> DataFrame:
    """df joined with the only row in values of each key, by hot's columns. The rows of hot keys meet theirs, fewer than SHARE, where they lie; all
    others are shuffled, and none of their keys has more than one row in SHARE."""
    key = hot.columns
    few = F.broadcast(values.join(F.broadcast(hot), key, "left_semi"))
    rest = df.join(F.broadcast(hot), key, "left_anti").join(values, key)
    return df.join(few, key).unionByName(rest)


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node of its component) for all nodes of edges (a, b), of any orderable type.

    Each round gives a node the smallest label among itself and its neighbours, then the label of that label. Minima are
    combined before each shuffle. The edges of a hub and the nodes of a giant component stay spread out (looked_up). The
    tables are written between rounds, which end when no label changes; a chain is halved with each. No edges, no nodes.
    """
    pairs = edges.select("a", "b").where("a is not null and b is not null and a <> b").distinct()
    both = written(pairs.union(pairs.select("b", "a")), "edges")
    hubs = written(hot_keys(both, "b"), "hubs")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("component")), "labels")
    while True:
        near = looked_up(both, labels.select(F.col("node").alias("b"), "component"), hubs)
        near = near.groupBy(F.col("a").alias("node")).agg(F.min("component").alias("seen"))
        lower = written(labels.join(near, "node").select("node", F.least("component", "seen").alias("label"), F.col("component").alias("old")), "lower")
        jump = labels.select(F.col("node").alias("label"), F.col("component").alias("next"))
        after = looked_up(lower, jump, hot_keys(lower, "label"))
        after = written(after.select("node", F.least("label", "next").alias("component"), (F.least("label", "next") != F.col("old")).alias("moved")), "labels")
        labels = after.select("node", "component")
        if after.where("moved").limit(1).count() == 0:
            return labels
