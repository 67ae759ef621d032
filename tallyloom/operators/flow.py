"""From files to packs: one plan that maps, extracts parents, normalises, identifies, quarantines, merges and hands off.

Each step is a function from DataFrames to DataFrames, so a run of any size is one chain of projections with a shuffle where
rows of a key must meet. Nothing is counted by collecting rows: every count comes from one grouping over the table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tallyloom.functions import text
from tallyloom.functions.hashing import packed, pairs, raw_cell, sha, structural_fingerprint, unpacked
from tallyloom.operators import core
from tallyloom.operators.audit import numbered
from tallyloom.operators.settle import settled


@dataclass(frozen=True)
class Source:
    """What a run knows of one file: its name and key, how it is treated, and what its columns mean."""

    file: str
    key: str = ""
    batch: str = ""
    mainline: bool = False
    mixed: bool = False  # may hold parents and their children in one sheet
    mapping: dict = field(default_factory=dict)
    strategy: core.Strategy = core.Strategy()

    @property
    def source_key(self) -> str:
        return self.key or self.file.rsplit("/", 1)[-1]


def child_columns(df: DataFrame) -> list[str]:
    """Columns of a related table, as exports name them: table::field."""
    return [c for c in core.business(df) if "::" in c]


def normalize_file(df: DataFrame, source: Source, run: str, fields: core.Fields = core.FIELDS) -> DataFrame:
    """A file's rows with lineage, parent class, identity and the disposition that they have before any merge.

    Parents are judged on the columns as the file names them. What a parent's columns say fills mapped fields that are
    blank. Of the reasons for quarantine a child's continuation comes first; an ambiguous parent is never quarantined.
    """
    children = child_columns(df)
    if source.mixed and children:
        found = core.parent_fields(df, children)
        df = core.parent_extraction(df, children).withColumn("_has_child", core.any_filled(df, children))
        df = df.withColumns({f"_parent_{k}": v for k, v in found.items()})
    else:
        found = {}
        df = df.withColumns({"_parent": F.lit("not_applicable"), "_parent_reason": F.lit("not_mixed"), "_parent_columns": F.lit(""), "_has_child": F.lit(False)})
    df = core.rename(df, source.mapping)
    own = lambda k: F.col(f"`{k}`") if k in df.columns else F.lit("")
    df = df.withColumns({k: text.first_nonblank(own(k), F.col(f"_parent_{k}")) for k in found}).drop(*[f"_parent_{k}" for k in found])
    df = core.normalize(df, fields)
    lineage = {"_source_file": source.file, "_source_key": source.source_key, "_source_batch_id": source.batch, "_import_run_id": run, "_record_family": source.strategy.family, "_mode": "mainline" if source.mainline else "archive"}
    df = df.withColumns({k: F.lit(v) for k, v in lineage.items()})
    strategy = source.strategy
    df = core.identify(df, core.Strategy(strategy.family, strategy.native, strategy.deterministic, strategy.entity, strategy.mainline, not source.mainline, source.mixed and bool(children), strategy.rules))
    reason = F.when(F.col("_parent") == "child_continuation", "CHILD_CONTINUATION").when(F.col("_parent") == "ambiguous_parent", "").otherwise(core.quarantine_reason(df, fields))
    return df.withColumn("_quarantine_reason", reason)


def normalize_files(frames: list[tuple[DataFrame, Source]], run: str, fields: core.Fields = core.FIELDS) -> DataFrame:
    """All files' rows in one table, deterministic keys that collide among the kept ones sent to review. The normalised rows
    are kept (settled), since collisions are looked for among them all before any row is judged."""
    rows = _unpacked(settled(_packed(core.union_files(*[normalize_file(df, source, run, fields) for df, source in frames]))))
    good = core.demote_collisions(rows.where("_quarantine_reason = ''"))
    rows = good.unionByName(rows.where("_quarantine_reason <> ''"))
    return rows.withColumns({"_final_disposition": before_merge(), "_final_disposition_reason": before_merge_reason()})


# Columns of fingerprints, most of a row's bytes, which are kept and shuffled as bytes.
FINGERPRINTS = ("_source_record_key", "_entity_match_key", "_structural_fingerprint", "_structural_fingerprint_full", "_ledger_key")


def _packed(df: DataFrame) -> DataFrame:
    return df.withColumns({c: packed(F.col(c)) for c, t in df.dtypes if c in FINGERPRINTS and t == "string"})


def _unpacked(df: DataFrame) -> DataFrame:
    return df.withColumns({c: unpacked(F.col(c)) for c, t in df.dtypes if c in FINGERPRINTS and t == "binary"})


def before_merge() -> Column:
    return F.when(F.col("_quarantine_reason") != "", "quarantine").otherwise(F.col("_merge_eligibility"))


def before_merge_reason() -> Column:
    why = F.when(F.col("_review_reason") != "", F.col("_review_reason")).otherwise(F.col("_merge_eligibility"))
    return F.when(F.col("_quarantine_reason") != "", F.col("_quarantine_reason")).when(F.col("_merge_eligibility") == "mainline_ready", "eligible_for_mainline_merge").otherwise(why)


# --- merge -----------------------------------------------------------------------------------------------------------


def gate() -> Column:
    """Whether a row may be merged: it is of a mainline source, was not quarantined, and nothing holds it back."""
    return (F.col("_quarantine_reason") == "") & (F.col("_mode") == "mainline") & F.col("_merge_eligibility").isin("", "mainline_ready")


def ledger_key(source_key: Column, identity: Column) -> Column:
    return sha(text.text(source_key), "\0", text.text(identity))


@dataclass(frozen=True)
class DiffRule:
    """Which fields tell records of a source apart."""

    record_id: str | None = None
    updated_at: str | None = None
    natural: tuple[str, ...] = ()
    fingerprint: tuple[str, ...] | None = None


def diff_identity(df: DataFrame, rule: DiffRule | None) -> DataFrame:
    """df with _identity_key, _diff_key, _updated_at and _warning: by record id, else by a natural key whose parts are all
    there, else by a fingerprint of the values as they are."""
    have = core.business(df)
    value = lambda c: text.trimmed(F.col(f"`{c}`")) if c in have else F.lit("")
    kept = [c for c in have if rule is None or rule.fingerprint is None or c in rule.fingerprint]
    print_ = F.concat(F.lit("fp:"), structural_fingerprint(kept, raw_cell))
    if rule is None:
        return df.withColumns({"_identity_key": print_, "_diff_key": print_, "_updated_at": F.lit(""), "_warning": F.lit("diff key rule missing; fallback fingerprint")})
    record = value(rule.record_id) if rule.record_id else F.lit("")
    updated = F.when(record != "", value(rule.updated_at) if rule.updated_at else F.lit("")).otherwise("")
    named = pairs(list(rule.natural), have)
    whole = F.forall(F.array(*[value(c) for c in rule.natural]), lambda v: v != "") if rule.natural else F.lit(False)
    natural = F.concat(F.lit("natural:"), named)
    identity = F.when(record != "", F.concat(F.lit("rid:"), record)).when(whole, natural).otherwise(print_)
    diff = F.when(updated != "", F.concat(F.lit("rid+updated:"), record, F.lit("|"), updated)).otherwise(identity)
    warning = F.when((record == "") & ~whole, "record id/natural key unavailable; fingerprint fallback").otherwise("")
    return df.withColumns({"_identity_key": identity, "_diff_key": diff, "_updated_at": updated, "_warning": warning})


def merged(rows: DataFrame, ledger: DataFrame, run: str) -> tuple[DataFrame, DataFrame]:
    """Rows of normalize_files with their last dispositions, and the ledger after them.

    Rows of a ledger key are taken in the order of their files and rows. Those that the gate holds back are archived or
    left for review, each with its reason.
    """
    keyed = rows.withColumn("_ledger_key", ledger_key(F.col("_source_key"), F.col("_source_record_key")))
    ready = keyed.where(gate()).withColumns({"ledger_key": F.col("_ledger_key"), "fp": F.col("_structural_fingerprint"), "_order": F.struct("_source_file", "row_index")})
    settled, after = core.merge(ready, ledger, F.col("_source_batch_id"), run, order="_order")
    done = settled.drop("_final_disposition", "_final_disposition_reason", "ledger_key", "fp", "_order").withColumnsRenamed({"disposition": "_final_disposition", "disposition_reason": "_final_disposition_reason"})
    held = keyed.where(~gate())
    gone, archived = F.col("_quarantine_reason") != "", F.col("_mode") != "mainline"
    held = held.withColumns(
        {
            "_final_disposition": F.when(gone, "quarantine").when(archived, "archive_only").otherwise("review"),
            "_final_disposition_reason": F.when(gone, F.col("_quarantine_reason")).when(archived, "archive_mode").otherwise(F.when(F.col("_review_reason") != "", F.col("_review_reason")).otherwise("review_hold")),
        }
    )
    return done.unionByName(held), after


# Names of the counts of a merge by disposition.
MERGE_COUNTS = {"inserted": "inserted", "updated": "updated", "unchanged": "unchanged", "duplicate": "duplicate", "archive_only": "skipped_archive", "review": "skipped_review"}


def merge_summary(rows: DataFrame) -> DataFrame:
    """value, n: the merge's counts, with 0 for those that don't occur."""
    name = F.element_at(F.create_map(*[F.lit(x) for p in MERGE_COUNTS.items() for x in p]), F.col("_final_disposition"))
    return core.breakdown(rows.select(name.alias("_count")).where("_count is not null"), "_count", tuple(MERGE_COUNTS.values()))


def merge_warnings(rows: DataFrame) -> DataFrame:
    """warning, n: what was held back from the merge and why, once for each file and reason."""
    held = rows.where((F.col("_final_disposition") == "review") & (F.col("_mode") == "mainline"))
    name = F.regexp_extract("_source_file", "[^/]*$", 0)
    warning = F.concat(name, F.lit(": merge eligibility="), F.col("_merge_eligibility"), F.lit(" reason="), F.col("_review_reason"))
    return held.groupBy(warning.alias("warning")).agg(F.count("*").alias("n"))


# --- counts ----------------------------------------------------------------------------------------------------------


def row_flow(rows: DataFrame) -> DataFrame:
    """One row for each source file: how its rows were taken, in one pass."""
    kept = F.col("_quarantine_reason") == ""
    of = lambda kind: F.count_if(F.col("_parent") == kind)
    return rows.groupBy("_source_file").agg(
        F.count("*").alias("input_rows"),
        F.count_if(kept).alias("normalized_rows"),
        F.count_if(~kept).alias("quarantine_rows"),
        F.count_if("_has_child").alias("rows_with_child_data"),
        of("parent_candidate").alias("parent_candidates"),
        of("ambiguous_parent").alias("ambiguous_parents"),
        of("child_continuation").alias("child_continuations"),
        F.count_if(F.col("_has_child") & (F.col("_parent") != "child_continuation")).alias("mixed_rows"),
    )


def parent_summary(rows: DataFrame) -> DataFrame:
    """kind, reason, n of the parent extraction."""
    return rows.groupBy(F.col("_parent").alias("kind"), F.col("_parent_reason").alias("reason")).agg(F.count("*").alias("n"))


# Stages of eligibility, kinds of parents and dispositions, as they are counted.
STAGES = ("mainline_ready", "review", "archive_only", "quarantine")
PARENTS = ("not_applicable", "parent_candidate", "ambiguous_parent", "child_continuation")
DISPOSITIONS = ("mainline_ready", "review", "archive_only", "quarantine", "inserted", "updated", "unchanged", "duplicate")


def reconciliation(rows: DataFrame) -> DataFrame:
    """name, a, b, n: four counts of one field and four of two, zero-filled where the values are fixed, from one grouping."""
    stage = F.when(F.col("_quarantine_reason") != "", "quarantine").otherwise(F.col("_merge_eligibility"))
    reason = F.coalesce(*[F.when(c != "", c) for c in (F.col("_quarantine_reason"), F.col("_final_disposition_reason"), F.col("_review_reason"))], F.col("_final_disposition"))
    base = rows.select(F.col("_parent").alias("p"), stage.alias("e"), F.col("_final_disposition").alias("d"), reason.alias("r"))
    p, e, d, r = (F.col(c) for c in "pedr")
    counted = base.groupingSets([[p], [e], [d], [r], [p, e], [p, d], [e, d], [d, r]], p, e, d, r).agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    # a bit of g is set where its field, of p e d r, is not grouped by
    names = {0b0111: "parent", 0b1011: "eligibility", 0b1101: "disposition", 0b1110: "reason", 0b0011: "parent_eligibility", 0b0101: "parent_disposition", 0b1001: "eligibility_disposition", 0b1100: "disposition_reason"}
    name = F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.col("g").cast("int"))
    first = F.when(name.isin("parent", "parent_eligibility", "parent_disposition"), p).when(name.isin("eligibility", "eligibility_disposition"), e).when(name == "reason", r).otherwise(d)
    second = F.when(name == "parent_eligibility", e).when(name.isin("parent_disposition", "eligibility_disposition"), d).when(name == "disposition_reason", r).otherwise("")
    found = counted.select(name.alias("name"), first.alias("a"), second.alias("b"), "n")
    every = [("parent", x, "") for x in PARENTS] + [("eligibility", x, "") for x in STAGES] + [("disposition", x, "") for x in DISPOSITIONS]
    every += [("parent_eligibility", x, y) for x in PARENTS for y in STAGES] + [("parent_disposition", x, y) for x in PARENTS for y in DISPOSITIONS] + [("eligibility_disposition", x, y) for x in STAGES for y in DISPOSITIONS]
    zeros = rows.sparkSession.createDataFrame([(*x, 0) for x in every], "name string, a string, b string, n long")
    return found.unionByName(zeros).groupBy("name", "a", "b").agg(F.sum("n").alias("n"))


def identity_counts(rows: DataFrame) -> DataFrame:
    """name, value, n: eight breakdowns of the rows that were not quarantined, from one grouping."""
    review = F.col("_merge_eligibility") == "review"
    or_unknown = lambda c: F.when(F.col(c) != "", F.col(c)).otherwise("unknown")
    owner, method, family = or_unknown("_semantic_owner"), or_unknown("_source_record_key_method"), or_unknown("_record_family")
    cells = {
        "reason": F.when(F.col("_review_reason") != "", F.col("_review_reason")),
        "eligibility": F.when(F.col("_merge_eligibility") != "", F.col("_merge_eligibility")).otherwise("review"),
        "owner": owner,
        "method": method,
        "family": family,
        "review_method": F.when(review, method),
        "review_family": F.when(review, family),
        "review_owner": F.when(review, owner),
    }
    pairs_ = F.array(*[F.struct(F.lit(k).alias("name"), v.alias("value")) for k, v in cells.items()])
    return rows.where("_quarantine_reason = ''").select(F.inline(pairs_)).where("value is not null").groupBy("name", "value").agg(F.count("*").alias("n"))


def identity_tops(rows: DataFrame, k: int = 5) -> DataFrame:
    """name, place, value, n: the k most frequent reasons for review, and warning indicators: these and how many rows of
    review have no key but the fallback."""
    return _tops(settled(identity_counts(rows)), k)


def _tops(counts: DataFrame, k: int) -> DataFrame:
    reasons = counts.where("name = 'reason'").select("value", "n")
    fallback = counts.where("name = 'review_method' and value = 'fallback'").select(F.lit("fallback_method_review").alias("value"), "n")
    both = reasons.withColumn("name", F.lit("reasons")).unionByName(reasons.unionByName(fallback).withColumn("name", F.lit("indicators")))
    place = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("n"), "value"))
    return both.withColumn("place", place).where(F.col("place") <= k).select("name", "place", "value", "n")


def review_ratios(rows: DataFrame) -> DataFrame:
    """name (family or method), value, review_rows, n, review_ratio, place: the first of each name has the highest ratio,
    of equals the most rows in review."""
    return _ratios(identity_counts(rows))


def _ratios(counts: DataFrame) -> DataFrame:
    counts = counts.where("name in ('family', 'method', 'review_family', 'review_method')")
    is_review = F.col("name").startswith("review_")
    by = counts.groupBy(F.regexp_replace("name", "^review_", "").alias("name"), "value").agg(F.sum(F.when(is_review, F.col("n")).otherwise(0)).alias("review_rows"), F.sum(F.when(~is_review, F.col("n")).otherwise(0)).alias("n"))
    by = by.withColumn("review_ratio", F.round(F.col("review_rows") / F.col("n"), 4))
    place = F.row_number().over(Window.partitionBy("name").orderBy(F.desc(F.col("review_rows") / F.col("n")), F.desc("review_rows"), "value"))
    return by.withColumn("place", place)


# What a frequent reason for review says should be tuned.
TARGETS = {
    "mixed_parent_child_export": "mixed_parent_child_export_handling",
    "mixed_parent_child_ambiguous": "mixed_parent_child_parent_rules",
    "fallback_key": "source_record_key",
    "activity_timestamp_insufficient": "activity_timestamp_fields",
    "semantic_owner_unknown": "semantic_owner_inputs",
    "semantic_owner_hybrid": "semantic_owner_inputs",
    "deterministic_collision": "deterministic_key_fields",
    "archive_mode": "source_mode_routing",
}


def tuning_hints(rows: DataFrame) -> DataFrame:
    """kind, value: targets of the three most frequent reasons for review, and families and key methods most of whose rows
    are in review."""
    target = F.element_at(F.create_map(*[F.lit(x) for p in TARGETS.items() for x in p]), F.col("value"))
    counts = settled(identity_counts(rows))  # a row a reason, family, owner or method
    targets = _tops(counts, 3).where("name = 'reasons'").select(F.lit("target").alias("kind"), target.alias("value")).where("value is not null").distinct()
    heavy = _ratios(counts).where("place = 1 and review_ratio >= 0.5").select(F.concat(F.lit("review_heavy_"), F.col("name")).alias("kind"), "value")
    return targets.unionByName(heavy)


def compare_runs(hints: DataFrame) -> DataFrame:
    """reason, total, place of several runs' reasons (run, value, n): summed, the five most frequent."""
    total = hints.groupBy(F.col("value").alias("reason")).agg(F.sum("n").alias("total"))
    out = total.withColumn("place", F.row_number().over(Window.orderBy(F.desc("total"), "reason")))  # as many rows as reasons
    return out.where("place <= 5")


# --- hand-off --------------------------------------------------------------------------------------------------------

# The fields that a pack is in the order of.
PACK_ORDER = ("_final_disposition", "_final_disposition_reason", "_parent", "_source_file", "_source_key", "_source_record_key", "_structural_fingerprint_full")


def pack_rows(rows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """rows (of them the columns to keep, if given) with pack and place: their number in a pack, in the order of seven fields
    and then of the whole row.

    Text is ordered by code point. Places are taken in ranges of that order (audit.numbered), so no task holds a pack. What
    is the same in the seven fields need not be compared again, so the rest of a row, column by column as text, tells equals
    apart. Fingerprints are shuffled, kept and compared as bytes, whose order is that of their letters (behind any other text),
    and columns are compared as they stand, not as another text beside.
    """
    rest = [c for c in sorted(rows.columns) if c not in PACK_ORDER]
    held = core.hand_off(rows, "_final_disposition")
    if keep is not None:
        tie = F.array(*[F.col(f"`{c}`").cast("string") for c in rest])
        held = held.select("pack", *PACK_ORDER, tie.alias("_tie"), *[F.col(f"`{c}`") for c in keep if c not in PACK_ORDER])
    small = _packed(held)
    as_text = lambda c: F.col(f"`{c}`") if c in FINGERPRINTS else F.col(f"`{c}`").cast("string")
    n = numbered(small, ["pack", *PACK_ORDER, *(["_tie"] if keep is not None else map(as_text, rest))], "_n").drop("_tie")
    first = n.groupBy("pack").agg(F.min("_n").alias("_first"))  # three rows at most
    return _unpacked(n.join(F.broadcast(first), "pack").withColumn("place", F.col("_n") - F.col("_first") + 1).drop("_n", "_first"))


def write_packs(rows: DataFrame, path: str, compression: str = "none") -> dict[str, int]:
    """Write each pack's rows, in order, as CSV under path/pack=..., and give their numbers, counted as they are written.
    Raises if they are not all rows. A pack without rows has no folder. compression: none or gzip."""
    packed = pack_rows(rows)
    seen = Observation("packs")
    ordered = packed.sortWithinPartitions("pack", "place")  # in ranges of this order already (audit.numbered)
    counted = ordered.observe(seen, *[F.count_if(F.col("pack") == n).alias(n) for n in core.PACKS], F.count("*").alias("_all"))
    counted.write.mode("overwrite").partitionBy("pack").options(header=True, escape='"', emptyValue="", nullValue="", compression=compression).csv(path)
    counts = dict(seen.get)
    if sum(counts[n] for n in core.PACKS) != counts.pop("_all"):
        raise ValueError(f"hand-off count mismatch: {counts}")
    return counts


def write_run(root: str, run: str, tables: dict[str, DataFrame]) -> None:
    """Write a run's tables as Parquet, each under root by name and run, so runs lie side by side. Writing a run again
    replaces it and no other; an empty table is written with its columns alone."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}/_run={run}")


def read_run(spark, root: str, name: str, run: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}/_run={run}")


def latest_runs(runs: DataFrame, offset: int = 0, limit: int = 50, most: int = 500) -> tuple[DataFrame, int]:
    """A page of runs, newest first, and how many there are. A page has `most` rows at most."""
    return runs.orderBy(F.desc("run_id")).offset(offset).limit(min(limit, most)), runs.count()


def own_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """A file's rows with the columns that it had itself, in its order; those that were added, or that it lacks, are not
    there."""
    have = set(df.columns)
    return df.select(*[F.col(f"`{c}`") for c in columns if c in have])


def write_parts(df: DataFrame, path: str, rows_per_part: int, order: list[str], columns: list[str] | None = None) -> DataFrame:
    """Write a large file's rows in parts of so many, in order, each with the header and the file's own columns (all of df,
    if not given), and give the manifest: part, rows, first_row, last_row."""
    parts = numbered(df, order, "_n").withColumn("part", F.floor((F.col("_n") - 1) / rows_per_part) + 1)
    out = parts.repartitionByRange("part").sortWithinPartitions("part", "_n")
    out = own_columns(out, [*(columns or df.columns), "part"])
    out.write.mode("overwrite").partitionBy("part").options(header=True, escape='"', emptyValue="", nullValue="").csv(path)
    return parts.groupBy("part").agg(F.count("*").alias("rows"), F.min("_n").alias("first_row"), F.max("_n").alias("last_row"))
