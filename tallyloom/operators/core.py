"""The core operators: normalise, quarantine, identify, merge, propose duplicates, classify, hand off.

All take and give DataFrames whose business columns are strings and whose order, where it matters, is a row_index column.
Nothing here confirms or deletes a record.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import dates, hashing, text
from tallyloom.functions.hashing import pairs, sha, structural_fingerprint
from tallyloom.operators.settle import parted, previous, together


@dataclass(frozen=True)
class Fields:
    """Column names, by what they hold."""

    phone: tuple[str, ...] = ("phone", "電話番号")
    email: tuple[str, ...] = ("email", "メールアドレス")
    name: tuple[str, ...] = ("customer_name", "顧客名")
    company: tuple[str, ...] = ("company_name", "会社名")
    store: tuple[str, ...] = ("store_name", "店舗名")
    address: tuple[str, ...] = ("address", "住所")

    def of(self, df: DataFrame, kind: str) -> list[str]:
        """The columns of a kind that df has, in order of preference; case does not matter."""
        have = {c.lower(): c for c in df.columns}
        return [have[a.lower()] for a in getattr(self, kind) if a.lower() in have]

    def value(self, df: DataFrame, kind: str) -> Column:
        return text.first_nonblank(*[F.col(f"`{c}`") for c in self.of(df, kind)])


FIELDS = Fields()


def is_date_column(name: str) -> bool:
    return bool(re.search("date|日付|日$", name, re.I))


def business(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith("_") and c != "row_index"]


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Columns renamed by mapping, the rest kept. Where two become one, the last wins."""
    source: dict[str, str] = {}
    for c in df.columns:
        source[mapping.get(c, c)] = c
    return df.select(*[F.col(f"`{c}`").alias(n) for n, c in source.items()])


def union_files(*frames: DataFrame) -> DataFrame:
    """All rows and all columns of several files; what a file lacks is blank."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.na.fill("", [c for c, t in out.dtypes if t == "string"])


def normalize(df: DataFrame, fields: Fields = FIELDS) -> DataFrame:
    """Each business column normalised by what it holds.

    Each step is a projection, and names the columns of the one before: as text, as normal text, as what the column holds.
    So every step is worked out once a value, by generated code, the code grows by columns and not by steps, and columns
    that nobody asks for are still pruned.
    """
    by_kind = (("phone", text.phone_of_normal), ("email", text.email_of_normal), ("company", text.company_of_normal), ("address", text.address_of_normal))

    def held(c: str) -> Column | None:
        steps = [function for kind, function in by_kind if c in fields.of(df, kind)] + [dates.date] * is_date_column(c)
        v = F.col(f"`{c}`")
        for i, step in enumerate(steps):
            v = text.bound(v, step) if i else step(v)
        return v if steps else None

    columns = business(df)
    as_text = {c: f"_text_{i}" for i, c in enumerate(columns)}
    out = df.withColumns({t: text.text(F.col(f"`{c}`")) for c, t in as_text.items()})
    out = out.withColumns({c: text.normal_of_text(F.col(t)) for c, t in as_text.items()}).drop(*as_text.values())
    return out.withColumns({c: v for c in columns if (v := held(c)) is not None})


def quarantine_reason(df: DataFrame, fields: Fields = FIELDS) -> Column:
    """ALL_COLUMNS_EMPTY, BUSINESS_KEY_EMPTY (an address alone is no key) or blank."""
    columns = business(df)
    empty = F.forall(F.array(*[F.col(f"`{c}`") for c in columns]), text.blank) if columns else F.lit(True)
    keys = [F.col(f"`{c}`") for k in ("phone", "email", "name", "company", "store") for c in fields.of(df, k)]
    return F.when(empty, "ALL_COLUMNS_EMPTY").when(text.first_nonblank(*keys) == "", "BUSINESS_KEY_EMPTY").otherwise("")


def row_names(df: DataFrame) -> list[str]:
    """What tells rows apart: their number, and their file where several may be in one table."""
    return [c for c in ("_source_file", "row_index") if c in df.columns]


def anomalies(df: DataFrame, fields: Fields = FIELDS) -> DataFrame:
    """row_index (behind _source_file, if df has it), field, value, reason of phone, e-mail and date values that do not normalise to sound ones."""
    checks = [("phone", fields.value(df, "phone"), lambda v: text.phone_fault(text.phone(v))), ("email", fields.value(df, "email"), lambda v: text.email_fault(text.email(v)))]
    checks += [(c, text.trimmed(F.col(f"`{c}`")), lambda v: dates.date_fault(dates.date(v))) for c in business(df) if is_date_column(c)]
    judged = lambda n, fault: lambda v: F.struct(F.lit(n).alias("field"), v.alias("value"), F.when(v != "", fault(v)).alias("reason"))
    found = F.array(*[text.bound(v, judged(n, fault)) for n, v, fault in checks])
    return df.select(*row_names(df), F.inline(found)).where("reason is not null")


# --- parents in mixed exports ----------------------------------------------------------------------------------------

# What names a parent's fields, and whether it is a strong sign of one.
PARENT_FIELDS = (
    ("customer_id", True, r"^(お客様ID|顧客番号|顧客ID|customer.?id|id)$"),
    ("customer_name", True, r"^(契約者|申込者|氏名|顧客名|名前|customer_name)$"),
    ("phone", True, r"^(電話番号|連絡先|phone|tel)$"),
    ("phone", False, r"^(設置電話番号|代表者携帯|担当者携帯|電番【検索用】)$"),
    ("address", True, r"^(住所|所在地|address)$"),
    ("address", False, r"^(設置住所)$"),
    ("company_name", False, r"^(会社名|法人名|設置店名|company_name)$"),
)


def any_filled(df: DataFrame, columns: list[str]) -> Column:
    return F.exists(F.array(*[text.text(F.col(f"`{c}`")) for c in columns]), lambda v: ~text.blank(v)) if columns else F.lit(False)


def parent_fields(df: DataFrame, child_columns: list[str]) -> dict[str, Column]:
    """What a mixed export's own columns say of a parent: for each field that any of them can name, its first value."""
    own = [c for c in business(df) if c not in child_columns]
    names: dict[str, list[str]] = {}
    for key, _, pattern in PARENT_FIELDS:
        names.setdefault(key, []).extend(c for c in own if re.match(pattern, c, re.I))
    return {key: text.first_nonblank(*[F.col(f"`{c}`") for c in columns]) for key, columns in names.items() if columns}


def parent_extraction(df: DataFrame, child_columns: list[str]) -> DataFrame:
    """Adds _parent (parent_candidate, child_continuation, ambiguous_parent), _parent_reason and _parent_columns."""
    own = [c for c in business(df) if c not in child_columns]
    any_of = lambda conditions: F.exists(F.array(*conditions), lambda x: x) if conditions else F.lit(False)
    used, has, strong = [], {}, []
    for key, is_strong, pattern in PARENT_FIELDS:
        names = [c for c in own if re.match(pattern, c, re.I)]
        hit = F.coalesce(*[F.when(~text.blank(F.col(f"`{c}`")), F.lit(c)) for c in names], F.lit(None).cast("string"))
        used.append(hit)
        has.setdefault(key, []).append(hit.isNotNull())
        if is_strong:
            strong.append(hit.isNotNull().cast("int"))
    has = {k: any_of(v) for k, v in has.items()}
    safe = has["customer_id"] | has["customer_name"] & (has["phone"] | has["address"] | has["company_name"]) | (sum(strong[1:], strong[0]) >= 2)
    columns = F.array_compact(F.array(*used))
    child = any_of([~text.blank(F.col(f"`{c}`")) for c in child_columns])
    kind = F.when(safe, "parent_candidate").when(child & (F.size(columns) == 0), "child_continuation").otherwise("ambiguous_parent")
    reason = F.when(safe, "strong_parent_signals").when(child & (F.size(columns) == 0), "child_columns_only").otherwise("insufficient_parent_signals")
    return df.withColumns({"_parent": kind, "_parent_reason": reason, "_parent_columns": F.array_join(columns, "|")})


def fill_forward(df: DataFrame, key: str, carried: list[str], order: str = "row_index", bucket: int = 100_000) -> DataFrame:
    """Adds _filled_<column> for key and carried: the values of the last row so far with a key, all from that one row.

    Order is over the whole file. The file is cut into stretches of `bucket` order values, each filled by itself; a
    stretch's rows before its first key take the last key of the stretches before, of which there is one row each. Those
    rows are cut the same way again, so the one window over all of the file has a row for each `bucket` stretches.
    """
    filled = [key, *carried]
    row = F.when(~text.blank(F.col(key)), F.struct(F.col(order).alias("at"), *[F.col(c).alias(c) for c in filled]))
    cut = df.withColumn("_stretch", F.floor(F.col(order) / bucket))
    within = Window.partitionBy("_stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    last = cut.groupBy("_stretch").agg(F.max(row).alias("last"))
    last = last.withColumn("_far", F.floor(F.col("_stretch") / bucket))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    far = last.groupBy("_far").agg(F.max("last").alias("last"))
    far = far.select("_far", F.last("last", ignorenulls=True).over(before(Window.orderBy("_far"))).alias("_far_entry"))
    near = F.last("last", ignorenulls=True).over(before(Window.partitionBy("_far").orderBy("_stretch")))
    entry = last.select("_stretch", "_far", near.alias("_near")).join(far, "_far").select("_stretch", F.coalesce("_near", "_far_entry").alias("_entry"))
    out = cut.withColumn("_own", F.last(row, ignorenulls=True).over(within)).join(entry, "_stretch")
    got = F.coalesce("_own", "_entry")
    return out.withColumns({f"_filled_{c}": got[c] for c in filled}).drop("_own", "_entry", "_stretch")


# --- identity --------------------------------------------------------------------------------------------------------

# Fields that identify records where a source has no strategy of its own.
DETERMINISTIC = ("fm_record_id", "customer_name", "company_name", "activity_date", "activity_type", "phone")
ENTITY = ("customer_name", "company_name", "store_name", "phone", "email")
MAINLINE = {
    "apo_list": ("customer_name", "phone", "activity_date", "activity_type", "note"),
    "customer_master_like": ("customer_name", "company_name", "phone", "email", "address"),
    "deal_like": ("customer_name", "product", "contract_date", "amount"),
    "call_activity": ("customer_name", "activity_date", "activity_type", "note"),
    "visit_activity": ("customer_name", "activity_date", "staff", "note"),
    "retry_followup": ("customer_name", "activity_date", "product", "note"),
    "unknown": (),
}
# What a dated activity must have: one of the first and one of the second fields.
SUFFICIENT = {
    "call_activity": (("activity_date",), ("operator", "staff", "result_code")),
    "visit_activity": (("activity_date",), ("operator", "staff", "visit_type", "result_code")),
    "retry_followup": (("scheduled_followup_date", "retry_date"), ("operator", "staff", "retry_status", "outcome")),
}


@dataclass(frozen=True)
class Strategy:
    """How a source's records are identified."""

    family: str = "unknown"
    native: str | None = None
    deterministic: tuple[str, ...] = DETERMINISTIC
    entity: tuple[str, ...] = ENTITY
    mainline: tuple[str, ...] = ()
    archive: bool = False
    mixed: bool = False
    rules: frozenset = field(default=frozenset({"fallback", "owner_unknown", "owner_hybrid"}))


def identify(df: DataFrame, s: Strategy) -> DataFrame:
    """Adds keys, fingerprints, semantic owner, eligibility and review reason to each record."""
    have = business(df)
    at = {c: f"_cell_{i}" for i, c in enumerate(have)}
    value = lambda c: F.col(at[c])
    filled = lambda names: F.exists(F.array(*[value(c) for c in names if c in at]), lambda v: v != "") if any(c in at for c in names) else F.lit(False)
    mainline = s.mainline or MAINLINE[s.family]
    full = structural_fingerprint(have, value)
    # each value is trimmed once, and each text that several columns are made of is put together once
    df = df.withColumns({at[c]: hashing.cell(c) for c in have})
    df = df.withColumns(
        {
            "_native": value(s.native) if s.native in at else F.lit(""),
            "_fixed": pairs(list(s.deterministic), have, value=value),
            "_entity": pairs(list(s.entity), have, ordered=True, value=value),
            "_structural_fingerprint_full": full,
            "_is_customer": filled(["customer_name", "company_name", "phone", "email"]),
            "_is_deal": filled(["product", "contract_date", "amount"]),
            "_weak": ~(filled(SUFFICIENT[s.family][0]) & filled(SUFFICIENT[s.family][1])) if s.family in SUFFICIENT else F.lit(False),
            "_main": structural_fingerprint([f for f in mainline if f in at], value) if mainline else F.lit(None).cast("string"),
        }
    )
    customer, deal = F.col("_is_customer"), F.col("_is_deal")
    owner = F.when(customer & deal, "hybrid").when(customer, "customer_like").when(deal, "deal_like").otherwise("unknown")
    if s.family in ("deal_like", "retry_followup"):
        owner = F.lit("deal_like")
    elif s.family in ("call_activity", "visit_activity", "apo_list"):
        owner = F.lit("customer_like")
    native, fixed, entity = F.col("_native"), F.col("_fixed"), F.col("_entity")
    key = (
        F.when(native != "", sha(f"native\0{s.family}\0{s.native}\0", native))
        .when(fixed != "", sha(f"deterministic\0{s.family}\0", fixed))
        .otherwise(sha(f"fallback\0{s.family}\0", F.col("_structural_fingerprint_full")))
    )
    df = df.withColumns(
        {
            "_source_record_key": key,
            "_source_record_key_method": F.when(native != "", "native").when(fixed != "", "deterministic").otherwise("fallback"),
            "_entity_match_key": F.when(entity != "", sha(f"entity\0{s.family}\0", entity)).otherwise(""),
            "_structural_fingerprint": F.col("_main") if mainline else F.col("_structural_fingerprint_full"),
            "_semantic_owner": owner,
        }
    )
    parent = F.col("_parent") if "_parent" in df.columns else F.lit("not_applicable")
    owner, method, master = F.col("_semantic_owner"), F.col("_source_record_key_method"), F.lit(s.family == "customer_master_like")
    reason = (
        F.when(F.lit(s.archive), "archive_mode")
        .when(parent == "ambiguous_parent", "mixed_parent_child_ambiguous")
        .when(F.lit(s.mixed) & (parent != "parent_candidate"), "mixed_parent_child_export")
        .when((method == "fallback") & F.lit("fallback" in s.rules), "fallback_key")
        .when(F.col("_weak"), "activity_timestamp_insufficient")
        .when(master & (owner == "hybrid") & F.lit("owner_hybrid" in s.rules), "semantic_owner_hybrid")
        .when(master & (owner == "unknown") & F.lit("owner_unknown" in s.rules), "semantic_owner_unknown")
        .otherwise("")
    )
    df = df.withColumn("_review_reason", reason)
    eligibility = F.when(F.col("_review_reason") == "", "mainline_ready").when(F.col("_review_reason") == "archive_mode", "archive_only").otherwise("review")
    return df.withColumn("_merge_eligibility", eligibility).drop(*at.values(), "_native", "_fixed", "_entity", "_main", "_is_customer", "_is_deal", "_weak")


def demote_collisions(df: DataFrame) -> DataFrame:
    """Deterministic keys with more than one fingerprint send all their rows to review."""
    own = F.when(F.col("_source_record_key_method") == "deterministic", F.col("_structural_fingerprint"))
    bad = df.groupBy("_source_record_key").agg(F.min(own).alias("a"), F.max(own).alias("b")).where("a <> b").select("_source_record_key", F.lit(True).alias("_collides"))
    out = df.join(bad, "_source_record_key", "left")
    hit = F.coalesce("_collides", F.lit(False))
    return out.withColumns(
        {"_merge_eligibility": F.when(hit, "review").otherwise(F.col("_merge_eligibility")), "_review_reason": F.when(hit, "deterministic_collision").otherwise(F.col("_review_reason"))}
    ).drop("_collides")


# --- ledger ----------------------------------------------------------------------------------------------------------


def merge(rows: DataFrame, ledger: DataFrame, batch: str | Column, run: str, order: str = "row_index") -> tuple[DataFrame, DataFrame]:
    """Rows with their dispositions (merged), and the whole ledger after them."""
    out, touched = merged(rows, ledger, batch, run, order)
    after = ledger.join(touched.select("ledger_key"), "ledger_key", "left_anti").select("ledger_key", "fp", "batch", "last_run").unionByName(touched)
    return out, after


def merged(rows: DataFrame, ledger: DataFrame, batch: str | Column, run: str, order: str = "row_index") -> tuple[DataFrame, DataFrame]:
    """Rows with their dispositions, and what the ledger has of their keys after them.

    rows: ledger_key, fp, the order's column and whatever else; ledger: ledger_key, fp, batch, last_run. Rows of a key are
    taken in order, also where one key has very many (settle.parted): inserted, updated, duplicate (the key's last change came from this batch) or unchanged.
    """
    known = ledger.select("ledger_key", F.col("fp").alias("_ledger_fp"), F.col("batch").alias("_ledger_batch"))
    rows = rows.withColumn("_batch", F.lit(batch) if isinstance(batch, str) else batch)
    batch = F.col("_batch")
    parts = []
    for part in parted(rows.join(known, "ledger_key", "left"), ["ledger_key"], [order]):
        part = previous(part, ["ledger_key"], [order], {"_last": F.struct("fp")}).withColumn("_prev", F.coalesce("_last.fp", "_ledger_fp"))
        part = part.withColumn("_changed", F.col("_prev").isNull() | (F.col("_prev") != F.col("fp")))
        parts.append(previous(part, ["ledger_key"], [order], {"_moved": F.when(F.col("_changed"), F.lit(True))}))
    joined = together(parts).withColumn("_batch_then", F.when(F.col("_moved"), batch).otherwise(F.col("_ledger_batch")))
    label = F.when(F.col("_prev").isNull(), "inserted").when(F.col("_prev") != F.col("fp"), "updated").when(F.col("_batch_then") == batch, "duplicate").otherwise("unchanged")
    reasons = {"inserted": "new_identity", "updated": "existing_changed_fingerprint", "duplicate": "same_batch_same_fingerprint", "unchanged": "existing_same_fingerprint"}
    reason = F.element_at(F.create_map(*[F.lit(x) for p in reasons.items() for x in p]), F.col("disposition"))
    out = joined.withColumn("disposition", label).withColumn("disposition_reason", reason)
    touched = out.groupBy("ledger_key").agg(F.max_by("fp", order).alias("fp"), F.when(F.max("_changed"), F.max_by(batch, order)).otherwise(F.max("_ledger_batch")).alias("batch"), F.lit(run).alias("last_run"))
    return out.drop("_batch", "_last", "_moved", "_prev", "_changed", "_batch_then", "_ledger_fp", "_ledger_batch"), touched


# --- candidates ------------------------------------------------------------------------------------------------------

# Kinds of keys that rows are matched by, in order.
MATCH_TYPES = ("phone", "email", "name_company", "name_address", "entity_match", "source_record")


def match_keys(df: DataFrame, fields: Fields = FIELDS) -> DataFrame:
    """row_index (behind _source_file, if df has it), match_type, match_key: every key that a row can be matched by."""
    kinds = ("phone", "email", "name", "company", "store", "address")
    df = df.withColumns({f"_v_{k}": fields.value(df, k) for k in kinds})
    v = {k: F.col(f"_v_{k}") for k in kinds}
    organisation = F.when(v["company"] != "", text.company_key(v["company"])).when(v["store"] != "", text.store_key(v["store"]))
    named = lambda key: F.when(v["name"] != "", F.concat(F.lower(v["name"]), F.lit("|"), key))
    own = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    keys = (
        v["phone"],
        F.lower(v["email"]),
        named(organisation),
        F.when(v["address"] != "", named(text.address_key(v["address"]))),
        own("_entity_match_key"),
        F.when(own("_source_record_key_method") != "fallback", own("_source_record_key")),
    )
    rows = F.array(*[F.struct(F.lit(t).alias("match_type"), k.alias("match_key")) for t, k in zip(MATCH_TYPES, keys)])
    return df.select(*row_names(df), F.inline(rows)).where("match_key is not null and match_key <> ''")


def duplicate_groups(df: DataFrame, fields: Fields = FIELDS) -> DataFrame:
    """match_type, match_key, first_row (and first_file, if df has _source_file), size: keys that two rows or more share.
    Counted before the shuffle, so a very common key costs one row a task."""
    return groups_of(match_keys(df, fields), row_names(df))


def groups_of(keys: DataFrame, names: list[str]) -> DataFrame:
    """duplicate_groups of rows of match_keys that are told apart by these names."""
    first = F.min(F.struct(*names)) if len(names) > 1 else F.min("row_index")
    groups = keys.groupBy("match_type", "match_key").agg(first.alias("first_row"), F.count("*").alias("size")).where("size >= 2")
    if len(names) == 1:
        return groups
    return groups.select("match_type", "match_key", F.col("first_row._source_file").alias("first_file"), F.col("first_row.row_index").alias("first_row"), "size")


def duplicate_members(df: DataFrame, fields: Fields = FIELDS) -> DataFrame:
    """match_type, match_key, first_row, size, row_index: the candidate groups with their rows (and the files of both, if df
    has _source_file). A group's name is its match type and first row.

    Rows are shuffled by key once, and both counted and matched there, so their keys are worked out once."""
    keys = match_keys(df, fields).repartition("match_type", "match_key")
    return keys.join(groups_of(keys, row_names(df)), ["match_type", "match_key"])


@dataclass(frozen=True)
class Rules:
    """Fields that speak for each type of record, how many it takes, and which type goes first in a tie."""

    customer: tuple[str, ...] = ("customer_name", "phone", "email", "address", "company_name")
    deal: tuple[str, ...] = ("product", "contract_date", "amount")
    transaction: tuple[str, ...] = ("invoice_no", "payment_date", "amount")
    activity: tuple[str, ...] = ("activity_date", "activity_type", "note")
    least: int = 2
    priority: tuple[str, ...] = ("customer", "deal", "activity", "transaction")


def classify(df: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Adds candidate_type, confidence and reason: the type with most of its fields filled."""
    have = {c.lower(): c for c in business(df)}
    types = ("customer", "deal", "transaction", "activity")
    scored = []
    for t in types:
        names = getattr(rules, t)
        score = sum([(~text.blank(F.col(f"`{have[n.lower()]}`"))).cast("int") for n in names if n.lower() in have], F.lit(0))
        order = rules.priority.index(t) if t in rules.priority else 999
        scored.append(F.struct(score.alias("score"), F.lit(-order).alias("order"), F.lit(t).alias("type"), F.lit(len(names)).alias("total")))
    viable = F.filter(F.array(*scored), lambda s: s["score"] >= rules.least)
    df = df.withColumn("_viable", viable).withColumn("_best", F.array_max("_viable"))
    best, ratio = F.col("_best"), F.col("_best.score") / F.greatest(F.col("_best.total"), F.lit(1))
    tied = F.size(F.filter("_viable", lambda s: s["score"] == F.col("_best.score"))) > 1
    none = best.isNull()
    confidence = F.when(none, "low").when((ratio >= 0.6) & ~tied, "high").when(ratio >= 0.4, "medium").otherwise("low")
    reason = F.when(none, "insufficient fields for classification").otherwise(F.concat(best["score"].cast("string"), F.lit("/"), best["total"].cast("string"), F.lit(" fields matched for "), best["type"]))
    return df.withColumns({"candidate_type": F.when(none, "quarantine").otherwise(best["type"]), "confidence": confidence, "reason": reason}).drop("_viable", "_best")


def breakdown(df: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """Counts of each value, with 0 for those that don't occur. Not a join, whose test for nulls would work out the column
    once more, in the few tasks that read the rows."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).withColumn("_asked", F.lit(False))
    every = df.sparkSession.createDataFrame([(v, 0, True) for v in values], "value string, n long, _asked boolean")
    both = counts.unionByName(every).groupBy("value").agg(F.sum("n").alias("n"), F.max("_asked").alias("_asked"))
    return both.where("_asked").drop("_asked")


# --- hand-off --------------------------------------------------------------------------------------------------------

# Packs, and the dispositions of the rows in each.
PACKS = {"mainline": ("inserted", "updated", "duplicate", "unchanged", "archive_only"), "review": ("review", "pending"), "quarantine": ("quarantine",)}


def pack_of(disposition: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, values in PACKS.items():
        out = F.coalesce(F.when(disposition.isin(*values), F.lit(name)), out)
    return out


def hand_off(df: DataFrame, disposition: str = "disposition") -> DataFrame:
    """Adds pack; raises if a row fits none, so counts always add up."""
    fits = pack_of(F.col(disposition))
    return df.withColumn("pack", F.when(fits.isNull(), F.raise_error(F.concat(F.lit("no pack for disposition "), text.text(F.col(disposition))))).otherwise(fits))
