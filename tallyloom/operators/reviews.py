"""Human review: sheets that people fill in, checks of what they filled in, and what their answers change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.text import blank, text, trimmed
from tallyloom.operators.audit import numbered, smallest

# What a decision and a strategy may be.
DECISIONS = ("resolved", "skip", "unclear", "defer", "")
STRATEGIES = ("assign_all", "assign_by_date", "split", "")


def enriched(lists: DataFrame, ids: str, lookup: DataFrame, key: str, shown: Column, name: str, separator: str = ";") -> DataFrame:
    """lists with `name`: what `shown` says of each id of a separated list, in the list's order; ? for what is not known.

    Equal lists are looked up once.
    """
    distinct = lists.select(ids).where(F.col(ids) != "").distinct()
    parts = distinct.select(ids, F.posexplode(F.split(ids, separator)).alias("_at", "_id"))
    known = lookup.select(F.col(key).cast("string").alias("_id"), shown.alias("_shown"))
    named = parts.join(known, "_id", "left").groupBy(ids).agg(F.array_sort(F.collect_list(F.struct("_at", F.coalesce(F.nullif(F.col("_shown"), F.lit("")), F.lit("?")).alias("v")))).alias("_all"))
    return lists.join(named.select(ids, F.array_join(F.col("_all.v"), " / ").alias(name)), ids, "left")


def resolution_template(queue: DataFrame) -> DataFrame:
    """One row for each number of the queue's high-severity calls, numbered by first appearance, to be filled in."""
    high = queue.where("severity = 'high'").groupBy("normalized_phone").agg(F.count("*").alias("call_count"), F.min("row_index").alias("first_row"), F.min_by(F.struct("candidates", "candidate_count"), "row_index").alias("_first"))
    out = numbered(high, ["first_row", "normalized_phone"], "_n")
    return out.select(F.format_string("HR-%04d", "_n").alias("review_id"), "normalized_phone", "_first.*", "call_count", *[F.lit("").alias(c) for c in ("decision_status", "chosen_customer_id", "chosen_strategy", "note")])


def apply_resolutions(matched: DataFrame, answers: DataFrame, applies: Column) -> DataFrame:
    """matched with resolved numbers given their customer, where `applies` and several had matched.

    Only answers that are resolved, for all calls of a number, with a customer, count; of several for a number the first
    by review_id. before_match_type and before_candidate_count keep what `revoke_resolutions` needs.
    """
    usable = answers.where((F.col("decision_status") == "resolved") & (F.col("chosen_strategy") == "assign_all") & ~blank(F.col("chosen_customer_id")))
    one = usable.groupBy("normalized_phone").agg(F.min_by(trimmed(F.col("chosen_customer_id")), "review_id").alias("_chosen"))
    out = matched.join(one, "normalized_phone", "left")
    hit = applies & (F.col("match_type") == "multi_match") & F.col("_chosen").isNotNull()
    return out.withColumns(
        {
            "before_match_type": F.when(hit, F.col("match_type")),
            "before_candidate_count": F.when(hit, F.col("candidate_count")),
            "matched_customer_id": F.when(hit, F.col("_chosen")).otherwise(F.col("matched_customer_id").cast("string")),
            "candidate_count": F.when(hit, 1).otherwise(F.col("candidate_count")),
            "match_type": F.when(hit, "manual_resolved").otherwise(F.col("match_type")),
        }
    ).drop("_chosen")


def revoke_resolutions(resolved: DataFrame) -> DataFrame:
    """The calls as they were before apply_resolutions, counts included."""
    was = F.col("before_match_type").isNotNull()
    return resolved.withColumns(
        {
            "matched_customer_id": F.when(~was, F.col("matched_customer_id")),
            "candidate_count": F.coalesce("before_candidate_count", "candidate_count"),
            "match_type": F.coalesce("before_match_type", "match_type"),
        }
    ).drop("before_match_type", "before_candidate_count")


def _issue(when: Column, severity: str, field: str, code: str) -> Column:
    return F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(field).alias("field"), F.lit(code).alias("code")))


def _issues(df: DataFrame, key: str, rules: list[Column]) -> DataFrame:
    return df.select(key, F.inline(F.array_compact(F.array(*rules))))


def packet_issues(packet: DataFrame) -> DataFrame:
    """review_id, severity, field, code of what is wrong or open in a filled-in review packet."""
    status, chosen = text(F.col("decision_status")), trimmed(F.col("chosen_customer_id"))
    offered = F.filter(F.transform(F.split(text(F.col("candidate_customer_ids")), ";"), trimmed), lambda x: x != "")
    done = status == "resolved"
    return _issues(
        packet,
        "review_id",
        [
            _issue(~status.isin(*DECISIONS), "error", "decision_status", "unknown_value"),
            _issue(done & (chosen == ""), "error", "chosen_customer_id", "resolved_without_customer"),
            _issue(done & (chosen != "") & (F.size(offered) > 0) & ~F.array_contains(offered, chosen), "warning", "chosen_customer_id", "not_a_candidate"),
            _issue(status == "", "info", "decision_status", "open"),
        ],
    )


def template_issues(template: DataFrame) -> DataFrame:
    """review_id, severity, field, code of what is wrong in a filled-in resolution template."""
    status, strategy = text(F.col("decision_status")), text(F.col("chosen_strategy"))
    return _issues(
        template,
        "review_id",
        [
            _issue(~status.isin(*DECISIONS), "error", "decision_status", "unknown_value"),
            _issue(~strategy.isin(*STRATEGIES), "error", "chosen_strategy", "unknown_value"),
            _issue((status == "resolved") & blank(strategy), "warning", "chosen_strategy", "resolved_without_strategy"),
            _issue((strategy == "assign_by_date") & blank(F.col("note")), "warning", "note", "dates_missing"),
        ],
    )


def hearing_issues(sheet: DataFrame) -> DataFrame:
    """status_value, severity, field, code of what is missing in a filled-in hearing sheet."""
    return _issues(
        sheet,
        "status_value",
        [
            _issue(~blank(F.col("answer")) & blank(F.col("confirmed_stage")), "warning", "confirmed_stage", "answer_without_stage"),
            _issue(~blank(F.col("confirmed_stage")) & blank(F.col("confirmed_by")), "warning", "confirmed_by", "stage_without_name"),
        ],
    )


def hearing_sheet(doubted: DataFrame, lookup: DataFrame, key: str, shown: Column) -> DataFrame:
    """doubted statuses (value, n, sample_ids, stage) with details of their samples and a guess at their place in the work.

    The lookup is cut to the sampled ids first, which are few.
    """
    ids = doubted.select(F.explode(F.split("sample_ids", ";")).alias("_sample")).distinct()
    few = lookup.join(ids, F.col(key).cast("string") == F.col("_sample"), "left_semi")
    stage = text(F.col("stage"))
    guess = (
        F.when(stage.contains("scheduling") | stage.contains("waiting"), "waiting_before_work")
        .when(stage.contains("hold"), "stopped")
        .when(stage == "in_progress", "under_way")
        .otherwise("unknown")
    )
    return enriched(doubted, "sample_ids", few, key, shown, "samples").withColumn("hypothesis", guess)


def load_rejects(calls: DataFrame, kinds: tuple[str, ...] = ("source_a", "source_b")) -> DataFrame:
    """The calls that may not be loaded, with reject_reason: an unknown source_kind, or neither a date nor content."""
    reason = F.when(~text(F.col("source_kind")).isin(*kinds), "bad_source_kind").when(blank(F.col("call_date")) & blank(F.col("content")), "no_date_and_content")
    return calls.withColumn("reject_reason", reason).where("reject_reason is not null")


def rejected_records(df: DataFrame, key: str = "customer_id") -> DataFrame:
    """The customers or deals that may not be loaded, with reject_reason: they have no customer id."""
    return df.where(blank(F.col(key))).withColumn("reject_reason", F.lit(f"no_{key}"))


def prioritized(queue: DataFrame) -> DataFrame:
    """A review queue in the order in which it should be worked on: place, by priority and then by row."""
    return numbered(queue, ["priority", "row_index"], "place")


def packet(queue: DataFrame, contents: int = 3) -> DataFrame:
    """normalized_phone, calls, first_date, last_date, contents of a queue: one row a number, with the contents of its first
    calls by row. Only so many calls of a number are kept at any step."""
    numbers = queue.groupBy("normalized_phone").agg(F.count("*").alias("calls"), F.min("call_date").alias("first_date"), F.max("call_date").alias("last_date"))
    first = smallest(queue.select("normalized_phone", "row_index", "content"), "normalized_phone", "row_index", contents)
    texts = first.groupBy("normalized_phone").agg(F.array_sort(F.collect_list(F.struct("row_index", "content"))).alias("_c"))
    return numbers.join(texts, "normalized_phone").select("normalized_phone", "calls", "first_date", "last_date", F.array_join("_c.content", " | ").alias("contents"))


def bucket_samples(matched: DataFrame, samples: int = 10) -> DataFrame:
    """match_type, n, numbers and samples of a match: the first numbers of each kind, as they are written."""
    counts = matched.groupBy("match_type", "raw_phone").agg(F.count("*").alias("n"), F.min("row_index").alias("row_index"))
    totals = counts.groupBy("match_type").agg(F.sum("n").alias("n"), F.count("*").alias("numbers"))
    first = smallest(counts, "match_type", "row_index", samples).groupBy("match_type").agg(F.array_sort(F.collect_list(F.struct("row_index", "raw_phone"))).alias("_s"))
    return totals.join(first, "match_type").select("match_type", "n", "numbers", F.array_join("_s.raw_phone", ";").alias("samples"))


def top_phones(matched: DataFrame, k: int = 5) -> DataFrame:
    """match_type, place, normalized_phone, n: the numbers of each kind of match with most calls."""
    counts = matched.where("normalized_phone <> ''").groupBy("match_type", "normalized_phone").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("match_type").orderBy(F.desc("n"), "normalized_phone"))
    return counts.withColumn("place", place).where(F.col("place") <= k).select("match_type", "place", "normalized_phone", "n")


def verdict(packet: DataFrame, template: DataFrame, hearing: DataFrame) -> DataFrame:
    """One row: packet_rows, template_rows, resolved, confirmed, verdict, reason.

    Without a packet or a template it is NO-GO; with them CONDITIONAL-GO, whose reason says if people have answered yet.
    """
    counts = packet.agg(F.count("*").alias("packet_rows"))
    counts = counts.crossJoin(template.agg(F.count("*").alias("template_rows"), F.count_if(F.col("decision_status") == "resolved").alias("resolved")))
    counts = counts.crossJoin(hearing.agg(F.count_if(~blank(F.col("confirmed_stage"))).alias("confirmed")))  # one row by one row
    missing = (F.col("packet_rows") == 0) | (F.col("template_rows") == 0)
    none = (F.col("resolved") == 0) & (F.col("confirmed") == 0)
    return counts.withColumns({"verdict": F.when(missing, "NO-GO").otherwise("CONDITIONAL-GO"), "reason": F.when(missing, "input_missing").when(none, "no_answers").otherwise("some_answers")})
