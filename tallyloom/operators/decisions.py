"""Decisions about files and values: families, templates, remembered resolutions, run comparisons.

Rules are small fixed tables given by the caller; what they are applied to is a DataFrame of any size.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import similarity
from tallyloom.functions.text import trimmed
from tallyloom.operators.audit import latest_before, numbered
from tallyloom.operators.settle import parted, previous, together


def detect_family(names: DataFrame, weights: dict[str, tuple[str, float]], least: float) -> DataFrame:
    """names with family and score: the family whose keywords in the name weigh most, `least` or more; else unknown."""
    families = sorted({f for f, _ in weights.values()}, reverse=True)
    scores = []
    for f in families:
        parts = [F.when(F.contains("name", F.lit(k)), F.lit(w)).otherwise(F.lit(0.0)) for k, (g, w) in weights.items() if g == f]
        scores.append(F.struct(sum(parts[1:], parts[0]).alias("score"), F.lit(f).alias("family")))
    best = F.array_max(F.filter(F.array(*scores), lambda s: s["score"] >= least))
    return names.withColumns({"family": F.coalesce(best["family"], F.lit("unknown")), "score": F.coalesce(best["score"], F.lit(0.0))})


def match_template(files: DataFrame, columns: list[str]) -> DataFrame:
    """page_id, n, jaccard, score of files' parts against a template's columns: shared parts 0.2, equal number 0.1."""
    shared = similarity.jaccard(F.col("parts"), F.array(*[F.lit(c) for c in columns]))
    n = F.size("parts")
    score = 0.2 * shared + F.when(n == len(columns), 0.1).otherwise(0.0)
    return files.select("page_id", n.cast("long").alias("n"), F.round(shared, 4).alias("jaccard"), F.round(score, 4).alias("score"))


def auto_apply(asks: DataFrame, memory: DataFrame) -> DataFrame:
    """ask_id, decision, kind: the remembered decision for each question, or unresolved.

    Ignoring a column comes before naming it, a decision of the same family before a global one, then the smaller id.
    The best of a context and family is found before the join, so a much-used context costs one row for each family.
    """
    live = memory.where("not deleted and certainty in ('confirmed', 'high')")
    order = F.struct(F.when(F.col("kind") == "column_ignore", 0).otherwise(1).alias("k"), "id", "kind")
    best = live.groupBy("context", "family").agg(F.min(F.when(F.col("kind") == "column_ignore", order)).alias("ignore"), F.min(F.when(F.col("kind") != "column_ignore", order)).alias("name"))
    own = best.select("context", "family", F.col("ignore").alias("own_ignore"), F.col("name").alias("own_name"))
    common = best.where("family = 'global'").select("context", F.col("ignore").alias("all_ignore"), F.col("name").alias("all_name"))
    out = asks.join(own, ["context", "family"], "left").join(common, "context", "left")
    pick = F.coalesce("own_ignore", "all_ignore", "own_name", "all_name")
    return out.select("ask_id", pick["id"].alias("decision"), F.coalesce(pick["kind"], F.lit("unresolved")).alias("kind"))


def upsert(memory: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """memory with the rows of changes in place of those with the same keys."""
    return memory.join(changes.select(*keys), keys, "left_anti").unionByName(changes)


def stage_impact(dictionary: DataFrame, stages: DataFrame) -> DataFrame:
    """Status values (value, n) with their stage (certain, doubted or unresolved), ranked by count times doubt.

    stages: value, stage, certainty of the values that are known, as a table of any size. The ranking is over distinct
    status values, of which there may be any number.
    """
    known = stages.groupBy("value").agg(F.min(F.struct("stage", "certainty")).alias("_s")).select("value", F.col("_s.stage").alias("_stage"), F.col("_s.certainty").alias("_sure"))
    out = dictionary.join(known, "value", "left")
    sure = F.col("_sure")
    stage = F.when(sure == "high", F.col("_stage")).when(sure.isNotNull(), F.concat("_stage", F.lit("?"))).otherwise("unresolved")
    weight = F.when(sure == "high", 1).when(sure == "medium", 2).otherwise(3)
    out = out.withColumn("stage", stage).withColumn("impact", F.col("n") * weight).drop("_stage", "_sure")
    ranked = numbered(out, [F.desc("impact"), F.col("value")], "priority_rank")
    return ranked.withColumn("priority_rank", F.col("priority_rank").cast("int"))


def run_diff(runs: DataFrame) -> DataFrame:
    """run_id, change, row_delta of each run against the one it is comparable with."""
    pairs = latest_before(runs)
    old = runs.select(F.col("run_id").alias("previous_run"), F.col("schema_fp").alias("o_schema"), F.col("profile").alias("o_profile"), F.col("row_count").alias("o_rows"))
    out = pairs.join(old, "previous_run", "left")
    change = (
        F.when(F.col("previous_run").isNull(), "first_import")
        .when(F.col("o_schema") != F.col("schema_fp"), "schema_changed")
        .when(F.col("o_profile") != F.col("profile"), "profile_changed")
        .when(F.col("o_rows") != F.col("row_count"), "row_count_changed")
        .otherwise("same_content")
    )
    return out.select("run_id", change.alias("change"), (F.col("row_count") - F.col("o_rows")).alias("row_delta"))


def pre_run_diff(runs: DataFrame) -> DataFrame:
    """run_id, previous_run, column_delta, change, duplicate_warning, schema_drift: each run against the latest completed
    run of its source before it.

    runs: run_id, source, status, started_at, file_fp, schema_fp, column_count. What is not known about a previous run
    doesn't count as a change of it.
    """
    old = F.when(F.col("status") == "completed", F.struct("run_id", "file_fp", "schema_fp", "column_count"))
    order = ["started_at", "run_id"]
    out = together([previous(part, ["source"], order, {"_old": old}) for part in parted(runs, ["source"], order)])
    delta = F.col("column_count") - F.col("_old.column_count")
    drift = F.coalesce(delta != 0, F.lit(False)) | F.coalesce(F.col("_old.schema_fp") != F.col("schema_fp"), F.lit(False))
    same = F.coalesce(F.col("_old.file_fp") == F.col("file_fp"), F.lit(False))
    change = F.when(F.col("_old").isNull(), "first_import").when(same, "same_file").when(drift, "column_changed").otherwise("row_changed")
    out = out.select("run_id", F.col("_old.run_id").alias("previous_run"), delta.alias("column_delta"), change.alias("change"))
    return out.withColumns({"duplicate_warning": F.col("change") == "same_file", "schema_drift": F.col("change") == "column_changed"})


@dataclass(frozen=True)
class Profile:
    """A known kind of file: patterns of names (* for anything), the spellings of each of its columns, and its family."""

    name: str
    files: tuple[str, ...] = ()
    columns: tuple[tuple[str, ...], ...] = ()
    column_count: int | None = None
    headerless_suitable: bool = False
    default_has_header: bool = True
    family: str | None = None


def _points(p: Profile) -> Column:
    glob = "|".join(".*".join(re.escape(x) for x in g.split("*")) for g in p.files)
    names = F.transform(F.col("columns"), trimmed)
    hits = [F.arrays_overlap(names, F.array(*[F.lit(h) for h in hints])).cast("int") for hints in p.columns if hints]
    found = sum(hits[1:], hits[0]) if hits else F.lit(0)
    off = F.abs(F.col("column_count") - (p.column_count or len(p.columns)))
    bare = 20 if p.headerless_suitable else 0 if p.default_has_header else 10
    return (
        F.when(F.col("file").rlike(f"(?iu)^({glob})\\z") if p.files else F.lit(False), 100).otherwise(0)
        + F.when(F.col("headerless"), bare).otherwise(F.round(found / max(len(p.columns), 1) * 50))
        + F.when(F.col("column_count") > 0, F.when(off == 0, 25).when(off == 1, 15).when(off == 2, 8).otherwise(0)).otherwise(0)
        + F.when(F.col("family").eqNullSafe(F.lit(p.family)) & F.col("family").isNotNull(), 80).otherwise(0)
    ).cast("int")


def match_profile(files: DataFrame, profiles: list[Profile]) -> DataFrame:
    """files (file, columns, column_count, headerless, family) with profile, score, confidence; of equal scores the first
    profile given. A name that fits counts 100, known columns up to 50, their number up to 25, a family 80."""
    scored = F.array(*[F.struct(_points(p).alias("score"), F.lit(-i).alias("o"), F.lit(p.name).alias("name")) for i, p in enumerate(profiles)])
    out = files.withColumn("_best", F.array_max(F.filter(scored, lambda s: s["score"] > 0)))
    score = F.coalesce("_best.score", F.lit(0))
    confidence = F.when(score >= 100, "high").when(score >= 30, "medium").when(score > 0, "low").otherwise("none")
    return out.withColumns({"profile": F.col("_best.name"), "score": score, "confidence": confidence}).drop("_best")


def eligibility(low: int, total: int) -> str:
    """How far a template with so many doubtful decisions may be applied by itself."""
    return "full" if low == 0 else "partial" if low <= 0.2 * total else "review_required"
